"""Target-distribution importance resampling.

Features are runs of up to ``n`` words, hashed to buckets.  Their counts over a raw and
a target corpus give each bucket a log ratio, its gain; a document's weight is the sum
of its features' gains, and the documents with the highest weight plus Gumbel noise
(seeded by ``doc_id``) are drawn, which samples without replacement in proportion to
the exponential of the weights.

Long texts are cut into chunks at word boundaries, dealt over all tasks: a chunk owns
the features that start in it and carries the ``n - 1`` words after it, so that features
over a cut are counted once; counts and weights of the chunks are summed by document.
The driver holds one number a bucket.  Ranks come from a range partitioning and the
sizes of its partitions.

Null and empty texts have no features, weight 0 and are not drawn; very long texts are
read whole.  Each row is a document: rows that repeat a ``doc_id`` have noise of their
own id and can all be drawn.  A null ``doc_id`` counts as the empty string in the noise
and comes last among ties; ties of one id are broken by text.  Empty tables give empty
results, an empty target leaves the raw corpus' gains.  Other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import cut, remove, stored

BUCKETS = 10_000
CHUNK_BYTES = 1 << 16
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_KNOWN = 200_000


def chunks(text: bytes, n: int, most: int = CHUNK_BYTES) -> Iterator[tuple[bytes, int]]:
    """``(chunk, owned)``: parts of the lower-cased text, each with the bytes that it owns and a carry of ``n - 1`` words.

    A part ends before the first byte after ``most`` of them that is in no word.
    """
    start = 0
    while start < len(text):
        end = min(start + most, len(text))
        while end < len(text) and _WORD.match(text, end):  # a word goes on here
            end = _WORD.match(text, end).end()
        stop = end
        for _ in range(n - 1):
            word = _WORD.search(text, stop)
            if word is None:
                break
            stop = word.end()
        yield text[start:stop], end - start
        start = end


class Buckets:
    """Buckets of the features of chunks; those of short features seen before come from a bounded table."""

    def __init__(self, n: int, buckets: int):
        self.n, self.buckets, self.known = n, buckets, {}

    def __call__(self, chunk: bytes, owned: int) -> tuple[np.ndarray, int]:
        """Bucket of every owned feature, and the number of owned words."""
        words = _WORD.findall(chunk)
        own = len(words) if owned == len(chunk) else len(_WORD.findall(chunk[:owned]))
        runs = list(words[:own])
        for k in range(2, self.n + 1):
            runs += [b" ".join(words[i : i + k]) for i in range(min(own, len(words) - k + 1))]
        if len(self.known) > _KNOWN:
            self.known.clear()
        known, mod = self.known, self.buckets
        out = np.empty(len(runs), np.int32)
        for i, run in enumerate(runs):
            b = known.get(run)
            if b is None:
                b = zlib.crc32(run) % mod
                if len(run) < 64:
                    known[run] = b
            out[i] = b
        return out, own


def _pieces(df: DataFrame, text: str, n: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, digest, part, chunk, owned)``: short texts as they are, and the chunks of long ones dealt over all tasks."""
    long = F.octet_length(text) > CHUNK_BYTES
    key = [F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("digest")]
    value = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t")
    schema = "doc_id long, digest string, part int, chunk binary, owned int"

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (doc, digest, t) in enumerate(zip(*(b.column(k).to_pylist() for k in range(3)))):
                for part, (chunk, owned) in enumerate(chunks(t.lower(), n)):
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc, "digest": digest, "part": part, "chunk": chunk, "owned": owned}], schema=_arrow(schema))

    short = df.where(~F.coalesce(long, F.lit(False))).select(*key, value)
    short = short.select("doc_id", "digest", F.lit(-1).alias("part"), F.col("t").alias("chunk"), F.octet_length("t").alias("owned"))
    parts = df.where(long).select(*key, value).mapInArrow(cut_up, schema)
    return short, parts.repartition("digest", "doc_id", "part")


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def _each(batches: Iterator[pa.RecordBatch], find: Buckets) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, int]]]]:
    for b in batches:
        texts, owned = b.column("chunk").to_pylist(), b.column("owned").to_pylist()
        yield b, [find(t.lower(), o) for t, o in zip(texts, owned)]


def bucket_counts(df: DataFrame, text: str = "text", n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; a task sends one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, found in _each(batches, Buckets(n, buckets)):
            for x, _ in found:
                total += np.bincount(x, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "c"])

    if "doc_id" not in df.columns:
        df = df.withColumn("doc_id", F.lit(None).cast("long"))
    short, parts = _pieces(df, text, n)
    rows = short.unionAll(parts).select("chunk", "owned").mapInArrow(count, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():  # at most ``buckets`` rows
        out[r.bucket] = r.c
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to raw share of each bucket, one added to each count, rounded down."""
    n, m, k = float(raw.sum()), float(target.sum()), len(raw)
    return np.array([math.floor(1000 * math.log((float(t + 1) * (n + k)) / (float(s + 1) * (m + k)))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, n: int = 1) -> DataFrame:
    """``(doc_id, digest, n_features, n_words, weight)``, a row for each row of ``docs``."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in _each(batches, Buckets(n, len(gain))):
            sums = [[len(x) for x, _ in found], [w for _, w in found], [int(gain[x].sum()) for x, _ in found]]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(3)] + [pa.array(x, pa.int64()) for x in sums], names)

    names = ["doc_id", "digest", "part", "n_features", "n_words", "weight"]
    whole, parts = (df.mapInArrow(weigh, "doc_id long, digest string, part int, n_features long, n_words long, weight long") for df in _pieces(docs, "text", n))
    whole = whole.drop("part")
    # rows of one id and text have equal sums, so theirs are divided and dealt back
    copies = F.sum((F.col("part") == 0).cast("long"))
    share = [F.expr(f"sum({c}) div sum(cast(part = 0 as long))").alias(c) for c in names[3:]]
    long = parts.groupBy("doc_id", "digest").agg(*share, copies.alias("copies"))
    long = long.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return whole.unionAll(long.select(whole.columns))


def resample(docs: DataFrame, target: DataFrame, n: int = 1, percent: int = 10, least: int = 20, seed: int = 2024, buckets: int = BUCKETS) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)``, a row for each row of ``docs``.

    Of the documents with at least ``least`` words, ``percent`` in a hundred (rounded down) with the highest
    scores have a rank, from 1; the others' is null.
    """
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, "text", n, buckets), bucket_counts(target, "text", n, buckets))
    rows = weights(docs, gain, n)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.log(-F.log((h + 0.5) / F.lit(4294967296.0))) * -1000)
    rows, path = stored(rows.withColumn("score", F.col("weight") + noise))
    fit = rows.where(F.col("n_words") >= least)
    drawn = fit.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("digest")]
    # fewer than a task's rows share a score above the cut: score counts say how far down the drawn ones reach
    line = _score_line(fit, drawn)
    top = fit.where(F.col("score") >= line).select("doc_id", "digest", "n_features", "weight", "score")
    top = top.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    top = cut(top).withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes, before = top.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect(), 0  # a row a partition
    starts = []
    for r in sizes:
        starts.append((r["_part"], before))
        before += r["n"]
    starts = spark.createDataFrame(starts, "_part long, _before long")
    ranked = top.join(F.broadcast(starts), "_part").withColumn("rank", F.col("_before") + F.col("_at") + 1)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = rows.where((F.col("n_words") < least) | (F.col("score") < line)).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, "rank").unionAll(rest)


def _score_line(fit: DataFrame, drawn: int) -> int:
    """A score that at least ``drawn`` rows reach, and as few others as halving cells of scores can tell."""
    ends = fit.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    if not drawn or ends.lo is None:
        return 1 << 62
    lo, hi, above = ends.lo, ends.hi, 0
    while hi > lo:
        width = max(1, -(-(hi - lo + 1) // 1000))
        cell = F.floor((F.col("score") - F.lit(lo)) / width)
        found = fit.where(F.col("score").between(lo, hi)).groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).orderBy(F.desc("cell")).collect()
        for r in found:  # at most a thousand rows
            if above + r["n"] >= drawn:
                lo, hi = lo + r["cell"] * width, min(hi, lo + (r["cell"] + 1) * width - 1)
                break
            above += r["n"]
        if width == 1:
            break
    return lo
