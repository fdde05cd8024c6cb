"""Document fingerprints by locally consistent parsing.

A text's bytes are the symbols of level 0.  On each level runs of one symbol
become one symbol; deterministic coin tossing (the lowest bit in which a symbol
differs from its left neighbour, and that bit) shortens the symbols' labels to a
handful of values; blocks begin at the labels' local maxima, and a block's name,
a hash of its symbols, is a symbol of the next level, until a text is one symbol.
A block depends on a few neighbours only, so equal substrings have the same names
inside, at any offset.  The fingerprint is the smallest hashes of the names, in
hexadecimal; a name of the first level, phrases of three or four bytes that unlike
texts share too, counts as a ``LOW_WEIGHT``-th of one of a higher level.  So it
matters in texts that have few others, without a switch by length.  Likeness is
the share of common hashes among the smallest of both.

For the edited texts the rows are dealt to range shards of about ``shard_bytes`` by
``doc_id``, one shard a task; each shard also gets the first row of the next one, so
all is done in one shuffle.  Order is by falling ``doc_id`` (null last), rows with
equal ids by text; those of one id stay in one shard.  A null text is an empty one;
empty texts have an empty fingerprint, which is like itself only.  A very long text
is parsed whole, in a slice of its own.  A single document follows itself; repeated
rows follow each other; an empty table gives an empty result.  Other columns of
``docs``, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.ranges import LEAST, range_bounds, range_shard
from gridloom.llm.textops import distinct, mix, powers, slices, utf8

KEPT = 48
LOW_BITS = 6
LOW_WEIGHT = 1 << LOW_BITS
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _toss(x: np.ndarray, new_row: np.ndarray) -> np.ndarray:
    """One round of coin tossing: twice the place of the lowest differing bit, plus that bit."""
    d = np.empty_like(x)
    d[1:] = x[1:] ^ x[:-1]
    d[new_row] = 1
    place = np.bitwise_count((d & (~d + x.dtype.type(1))) - x.dtype.type(1)).astype(np.uint8)
    return (place << np.uint8(1)) | ((x >> place.astype(x.dtype)) & x.dtype.type(1)).astype(np.uint8)


def _blocks(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Starts of the blocks; neighbours in a row are distinct."""
    new_row = np.ones(len(x), bool)
    new_row[1:] = row[1:] != row[:-1]
    label = x
    for _ in range(4):
        label = _toss(label, new_row)
    top = np.zeros(len(x), bool)
    top[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~new_row[1:-1] & ~new_row[2:]
    # two landmarks are never neighbours; a row begins with a block
    return np.flatnonzero(top | new_row)


def phrase_names(part: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Names and rows of the phrases of each level from the first on; a row ends with the level where it is one phrase."""
    x = part
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    level = 0
    while len(x):
        starts = np.ones(len(x), bool)
        starts[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
        run = np.flatnonzero(starts)
        length = np.diff(np.append(run, len(x))).astype(np.uint64)
        x, row = x[run].astype(np.uint64), row[run]  # wide symbols in any case: names must not depend on the other rows of a slice
        long = length > 1
        x[long] = mix(x[long] * np.uint64(0x9E3779B97F4A7C15) + length[long])
        start = _blocks(x, row)
        up, down = powers(len(x) + 1)
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x + np.uint64(level + 1)) * up[: len(x)], out=sums[1:])
        end = np.append(start[1:], len(x))
        x = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
        row = row[start]
        yield x, row
        same = row[1:] == row[:-1]
        several = np.append(same, False) | np.append(False, same)
        x, row, level = x[several], row[several], level + 1


def sketches(column: pa.Array) -> Iterator[np.ndarray]:
    """The smallest hashes of each row's phrase names."""
    raw, offsets = utf8(column)
    for lo, hi in slices(offsets):
        at = offsets[lo : hi + 1] - offsets[lo]
        names = [np.zeros(0, np.uint64)]
        for level, (x, row) in enumerate(phrase_names(raw[offsets[lo] : offsets[hi]], at), 1):
            # small hashes are kept: those of higher levels are smaller by the weight
            h = mix(x + np.uint64(level)) >> np.uint64(32 if level == 1 else 32 + LOW_BITS)
            names.append((row.astype(np.uint64) << np.uint64(32)) | h)
        keys = distinct(np.concatenate(names))
        cuts = np.searchsorted(keys, np.arange(hi - lo + 1, dtype=np.uint64) << np.uint64(32))
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield keys[a : min(b, a + KEPT)].astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common phrases, 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    new = np.append(True, both[1:] != both[:-1])
    common = np.append(~new[1:], False)[new]  # a value that comes twice is in both
    return float(common[:KEPT].mean())


def text_of(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def _edit(text: str, after: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        _, offsets = utf8(t.column("text"))
        for lo, hi in slices(offsets, 1 << 22):
            rows = t.slice(lo, hi - lo)
            if held is not None:
                rows = pa.concat_tables([held, rows])
            held = rows.slice(rows.num_rows - 1, 1)
            if rows.num_rows > 1:
                yield _judged(rows)


def _judged(rows: pa.Table) -> pa.RecordBatch:
    """Results of all rows but the last, each followed by the next; guests from other shards have none."""
    texts = [x or "" for x in rows.column("text").to_pylist()]
    own = [i for i, guest in enumerate(rows.column("guest").to_pylist()[:-1]) if not guest]
    edited = [_edit(texts[i], texts[i + 1]) for i in own]
    prints = list(sketches(rows.column("text")))
    other = list(sketches(pa.array(edited, pa.large_string())))
    columns = [
        rows.column("doc_id").combine_chunks().take(pa.array(own, pa.int64())),
        pa.array([len(texts[i]) for i in own], pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
        pa.array([text_of(prints[i]) for i in own], pa.string()),
        pa.array([text_of(x) for x in other], pa.string()),
        pa.array([likeness(prints[i], x) for i, x in zip(own, other)], pa.float64()),
        pa.array([likeness(prints[i], prints[i + 1]) for i in own], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in OUT.split(", ")])


def fingerprints(docs: DataFrame, shard_bytes: int = 32 << 20) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses; one row a document."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds = range_bounds(texts, "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)) + 64, shard_bytes)
    dealt = texts.select("doc_id", "text", range_shard(F.col("doc_id"), bounds).alias("shard"))
    key = F.coalesce("doc_id", F.lit(LEAST))
    heads = sorted((r.shard, r.head) for r in dealt.groupBy("shard").agg(F.max(key).alias("head")).collect())  # one row a shard
    if not heads:
        return spark.createDataFrame([], OUT)
    # the row after the last of a shard is the first of the next lower one; after the lowest, of the highest
    guests = [(head, shard, heads[(i + 1) % len(heads)][0]) for i, (shard, head) in enumerate(heads)]
    guests = spark.createDataFrame(guests, "head long, own int, shard int")
    first = dealt.join(F.broadcast(guests), (key == F.col("head")) & (dealt.shard == F.col("own")))
    first = first.groupBy(guests.shard).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.lit(True).alias("guest"))
    rows = dealt.withColumn("guest", F.lit(False)).unionByName(first.select(F.lit(None).cast("long").alias("doc_id"), "text", "shard", "guest"))
    rows = rows.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions(F.desc("shard"), "guest", F.desc_nulls_last("doc_id"), F.coalesce("text", F.lit("")))
    return rows.select("doc_id", "text", "guest").mapInArrow(_judge, OUT)
