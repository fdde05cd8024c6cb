"""Joins that keep a hot key from filling one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import cut

FEW = 100_000
PARTS = 64
BITS = 2**24


def perhaps(rows: DataFrame, ids: DataFrame, key: str, few: int | None = None) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in ``ids``, and with all whose key is; ``rows`` are not shuffled.

    Few ids are broadcast, and the answer is exact.  Of more, a bit map of their hashes is: at most 2**18 words of
    64 bits however many there are, so that a join that follows shuffles little but what it needs.
    """
    ids = cut(ids.select(key).distinct())
    if ids.limit((FEW if few is None else few) + 1).count() <= (FEW if few is None else few):
        return rows.join(F.broadcast(ids), key, "left_semi")
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(BITS))
    bit = F.expr("shiftleft(1L, cast(_place % 64 as int))")
    words = ids.withColumn("_place", place).groupBy(F.floor(F.col("_place") / 64).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    marked = rows.withColumn("_place", place).withColumn("_word", F.floor(F.col("_place") / 64)).join(F.broadcast(cut(words)), "_word")
    return marked.where(F.col("_bits").bitwiseAND(bit) != 0).select(*rows.columns)


def lookup(rows: DataFrame, table: DataFrame, on: list[str], how: str = "left", size: str | None = None, few: int = FEW) -> DataFrame:
    """``rows`` joined with ``table``, which has at most one row a key.

    A table of at most ``few`` rows is broadcast.  Beyond that both sides are shuffled, and a key with more
    than a 64th of the rows (there are fewer than 64) is dealt over 64 salts.  ``size`` names a column of
    the table that says how many rows have its key; without it they are counted.
    """
    if table.limit(few + 1).count() <= few:
        return rows.join(F.broadcast(table), on, how)
    counts = table.select(*on, F.col(size).alias("_n")) if size else rows.groupBy(*on).agg(F.count("*").alias("_n"))
    hot = counts.where(F.col("_n") * PARTS > rows.count()).drop("_n").collect()  # fewer than 64 keys
    if not hot:
        return rows.join(table, on, how)
    marked = F.broadcast(rows.sparkSession.createDataFrame(hot, counts.drop("_n").schema).withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(PARTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = rows.join(marked, on, "left").withColumn("_salt", salt).drop("_hot")
    spread = table.join(marked, on, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return dealt.join(spread, [*on, "_salt"], how).drop("_salt")
