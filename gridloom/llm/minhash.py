"""MinHash near-duplicates with sequential Bayesian verification.

Documents with equal shingle sets are one class.  Band keys of the classes'
signatures bring candidates together.  First each bucket's classes are compared
with a hub (the class that meets most others over all bands, then the first one
outside of that hub's component), which joins large groups in linear work.  Where
a bucket still holds classes of different components, its classes' shingles are
ordered from rare to common, and two classes are compared if they share a band and
one of the rare shingles that every pair at the threshold must share (a prefix), so
that what many texts have in common brings no pairs; a shingle that is in very many
prefixes is dealt over cells of blocks.  Shingles that only one candidate has, and
the place of the first common one, bound the similarity; pairs that cannot reach
the threshold are never made.

A pair's signatures are compared in batches; it is dropped as soon as the posterior
chance of a similarity of at least the threshold falls below the chosen miss
probability.  Survivors are verified on their full sets.

Null text and text without words give an empty set, which is linked with nothing;
very long texts are read whole.  Rows with equal ``doc_id`` are one node, whatever
their texts.  Rows with null ``doc_id`` are linked with nothing, and have a null
component and are kept.  Every row of ``docs`` gives one row; an empty table gives
an empty result.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.textops import mix, shingle_sets, words
from gridloom.operators.components import connected_components
from gridloom.operators.joins import lookup, perhaps
from gridloom.session import compact, cut, remove, stored, without_ids

ROWS = 5
BANDS = 24
SIZE = ROWS * BANDS
BATCH = 24
HUBS = 2
BLOCK = 256
_FACTORS = (mix(np.arange(1, SIZE + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADDENDS = (mix(np.arange(1001, SIZE + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """``SIZE`` minima of the shingles under that many hash functions."""
    out = np.full(SIZE, np.uint32(0xFFFFFFFF))
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 2048):
        y = x[None, at : at + 2048] * _FACTORS[:, None] + _ADDENDS[:, None]
        y ^= y >> np.uint32(15)
        np.minimum(out, y.min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key a band."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key


def least_matches(threshold: float, miss: float) -> list[int]:
    """For each batch end: the fewest matches with P(similarity >= threshold | matches) >= miss.

    The prior is uniform, so the posterior after ``k`` of ``m`` matches is Beta(k+1, m-k+1), whose
    upper tail is the chance of at most ``k`` heads in ``m+1`` throws of a coin of bias ``threshold``.
    """
    out = []
    for m in range(BATCH, SIZE + 1, BATCH):
        tail, k = 0.0, -1
        while tail < miss:
            k += 1
            tail += math.comb(m + 1, k) * threshold**k * (1 - threshold) ** (m + 1 - k)
        out.append(k)
    return out


def _digests(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, one, two, keys = [], [], [], []
            for w in words(b.column(1)):
                for _, s in shingle_sets(w, n):
                    size.append(len(s))
                    one.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                    two.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                    keys.append(band_keys(signature(s)) if len(s) else np.zeros(0, np.uint64))
            at = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))],
                ["doc_id", "n_shingles", "one", "two", "bands"],
            )

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in words(b.column(1)):
                sets = [s for _, s in shingle_sets(w, n)]
                at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
                sigs = pa.array([signature(s).tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(w.lo, w.hi - w.lo), sigs, pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["id", "sig", "shingles"]
                )

    return run


def _survivors(least: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint32).reshape(-1, SIZE) for i in (2, 3))
            alive = np.arange(len(x))
            hits = np.zeros(len(x), np.int64)
            for k, low in enumerate(least):  # a batch of hashes at a time, for pairs that are still possible
                part = slice(k * BATCH, (k + 1) * BATCH)
                hits[alive] += (x[alive, part] == y[alive, part]).sum(axis=1)
                alive = alive[hits[alive] >= low]
            yield pa.RecordBatch.from_arrays([b.column(i).take(pa.array(alive)) for i in (0, 1)], ["u", "v"])

    return run


def _hub_pairs(rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """``(u, v)``: the classes of each bucket beside its hub; ``rows`` are of buckets with several components."""
    best = lambda df: df.groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("less"), "id", "n_shingles", "most", "component")).alias("hub"))
    hubs = best(rows)
    if turn:  # the heaviest class outside of the first hub's component
        first = cut(hubs.select("key", F.col("hub.component").alias("main")))
        hubs = best(lookup(rows, first, ["key"]).where("component <> main"))
    pairs = lookup(rows, cut(hubs), ["key"], "inner").where("id <> hub.id and component <> hub.component")
    common = F.least("most", "hub.most")
    pairs = pairs.where(common * 100 >= (F.col("n_shingles") + F.col("hub.n_shingles") - common) * percent)
    return pairs.select(F.least("id", "hub.id").alias("u"), F.greatest("id", "hub.id").alias("v")).distinct()


def _prefix_pairs(rows: DataFrame, full: DataFrame, bands: DataFrame, percent: int) -> DataFrame:
    """``(u, v)``: classes that share a band and a prefix shingle, of different components.

    With shingles in one order for all, sets of ``n`` and ``m`` shingles at the threshold share one of the
    first ``n - ceil(n * percent / 100) + 1`` of each, and at the first that they share both have enough
    shingles left.
    """
    ids = cut(rows.select("id", "component").distinct())
    token = perhaps(full, ids, "id").select("id", F.xxhash64("sig").alias("text"), F.explode("shingles").alias("s"))  # other texts only add to counts
    counts = cut(token.groupBy("s").agg(F.count("*").alias("c")).where("c > 1"))
    ranked = lookup(token, counts, ["s"], size="c").groupBy("id", "text")
    ranked = ranked.agg(F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "s"))).alias("t"))  # a text's own shingles
    n = F.size("t")
    ranked = ranked.select("id", n.alias("n"), F.posexplode(F.slice("t", 1, n - F.ceil(n * percent / 100).cast("int") + 1)).alias("pos", "x"))
    ranked = cut(lookup(ranked.where("x.c > 1").select("id", "n", "pos", "x.s"), ids, ["id"], "inner"))
    size = ranked.groupBy("s").agg(F.count("*").alias("m")).where("m > 1")
    ranked = lookup(ranked, cut(size), ["s"], "inner", size="m")
    # a shingle of m prefixes is dealt to cells (i, j) of blocks of about BLOCK rows, i <= j
    ranked = ranked.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    ranked = ranked.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    side = lambda i, j, name: ranked.withColumn("other", F.explode(F.sequence(*(("block", F.col("blocks") - 1) if i == "block" else (F.lit(0), "block"))))).select("s", F.col(i).alias("i"), F.col(j).alias("j"), F.struct("id", "component", "n", "pos").alias(name))
    pairs = side("block", "other", "a").join(side("other", "block", "b"), ["s", "i", "j"]).where("a.component <> b.component and (i <> j or a.id < b.id)")
    room = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    pairs = pairs.where(room * (100 + percent) >= (F.col("a.n") + F.col("b.n")) * percent)
    pairs = pairs.select(F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v")).distinct()
    known = perhaps(bands, ids, "id").dropDuplicates(["id"])
    pairs = pairs.join(known.select(F.col("id").alias("u"), F.col("bands").alias("x")), "u").join(known.select(F.col("id").alias("v"), F.col("bands").alias("y")), "v")
    return pairs.where(F.arrays_overlap("x", "y")).select("u", "v")


def near_duplicates(docs: DataFrame, percent: int = 80, n: int = 5, miss: float = 1e-9) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, a row for each row of ``docs``.

    Texts are linked if ``100 * |A & B| >= percent * |A | B|`` for their sets of ``n``-word shingles.
    ``component_id`` is the smallest ``doc_id`` reachable.  ``miss``: the chance at which a pair's
    signatures may rule it out.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_shingles long, one long, two long, bands array<long>"
    found = cut(texts.mapInArrow(_digests(n), schema))
    known = found.where("doc_id is not null")
    same = ["one", "two", "n_shingles"]
    classes = known.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("class_id"), F.count("*").alias("members"))
    member = lookup(known, cut(classes.where("members > 1")), same, size="members").select("doc_id", "n_shingles", "bands", F.coalesce("class_id", "doc_id").alias("class_id"))
    member = cut(member)
    bands = member.where("doc_id = class_id and n_shingles > 0").select(F.col("doc_id").alias("id"), "n_shingles", "bands")
    rows = bands.select("id", "n_shingles", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    bucket = cut(lookup(rows, cut(shared), ["key"], "inner", size="size").distinct())  # rows that repeat an id

    inside = cut(bucket.groupBy("id").agg(F.sum("size").alias("weight")))
    wanted = perhaps(texts.withColumnRenamed("doc_id", "id"), inside, "id")
    full, path = stored(lookup(wanted, inside.select("id"), ["id"], "left_semi").mapInArrow(_sets(n), "id long, sig binary, shingles array<long>"))
    # shingles that no other candidate has can be in no intersection
    alone = full.select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1")
    once = full.groupBy("id").agg(F.count("*").alias("texts")).where("texts = 1")  # of an id with several texts no shingle says which has it
    inside = inside.join(alone.groupBy("id").agg(F.count("*").alias("alone")).join(once, "id", "left_semi"), "id", "left")
    bucket = bucket.join(inside, "id").select("key", "id", "weight", "n_shingles", (F.col("n_shingles") - F.coalesce("alone", F.lit(0))).alias("most"))
    bucket = cut(bucket.where(F.col("most") * 100 >= F.col("n_shingles") * percent))
    least = least_matches(percent / 100, miss)
    one = full.select(F.col("id").alias("u"), F.col("sig").alias("x"), F.col("shingles").alias("a"))
    two = full.select(F.col("id").alias("v"), F.col("sig").alias("y"), F.col("shingles").alias("b"))
    # classes that share a doc_id are linked
    low = cut(member.where("n_shingles > 0").groupBy("doc_id").agg(F.min("class_id").alias("u"), F.max("class_id").alias("w"), F.count("*").alias("size")).where("u <> w"))
    links, n_links = compact(lookup(member.where("n_shingles > 0"), low, ["doc_id"], "inner", size="size").where("class_id <> u").select("u", F.col("class_id").alias("v")).distinct())
    labels = connected_components(links, "u", "v") if n_links else None
    for turn in range(HUBS + 1):
        rows = bucket if labels is None else lookup(bucket, labels, ["id"])
        rows = rows.withColumn("component", F.coalesce("component", "id") if labels is not None else F.col("id"))
        mixed = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
        mixed, n_mixed = compact(mixed.where(f"low <> high and size > {2 if turn else 1}").select("key", "size"))  # a pair has met its hub
        if not n_mixed:
            break
        rows = cut(lookup(rows, mixed, ["key"], "inner", size="size").drop("size"))
        pairs, _ = compact(_hub_pairs(rows, turn, percent) if turn < HUBS else _prefix_pairs(rows, full, bands.select("id", "bands"), percent))
        likely = cut(pairs.join(one.drop("a"), "u").join(two.drop("b"), "v").select("u", "v", "x", "y").mapInArrow(_survivors(least), "u long, v long"))
        new, n_new = compact(  # only the sets of likely pairs are shuffled
            likely.join(perhaps(one.drop("x"), likely, "u"), "u").join(perhaps(two.drop("y"), likely, "v"), "v")
            .withColumn("both", F.size(F.array_intersect("a", "b")))
            .where(F.col("both") * 100 >= (F.size("a") + F.size("b") - F.col("both")) * percent)
            .select("u", "v")
        )
        if n_new:
            links = links.unionAll(new)
            labels = connected_components(links, "u", "v")
    remove(docs.sparkSession, path)  # links are written; nothing reads the sets any more
    if labels is None:
        joined = member.withColumn("component", F.lit(None).cast("long"))
    else:
        joined = lookup(member, labels.withColumnRenamed("id", "class_id"), ["class_id"])
    out = joined.select("doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id"))
    lost = found.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return out.unionAll(lost).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, percent: int = 80, **options) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id.

    Rows with null ``doc_id`` stay.  Of rows that repeat a kept ``doc_id`` each distinct text stays once,
    with the columns that come first in order as JSON.
    """
    groups = near_duplicates(docs, percent, **options).where("doc_id is not null")
    ids = cut(groups.groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"))
    rest = without_ids(docs, ids.select("doc_id"))
    again = ids.where("kept").select("doc_id")  # rows repeat under these ids
    if not again.limit(1).count():
        return rest
    whole = F.struct(*docs.columns)
    once = docs.join(again, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min_by(whole, F.to_json(whole)).alias("row"))
    return rest.unionByName(once.select("row.*"))
