"""Range shards of about equal weight on an integer key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

LEAST = -(1 << 63)
SHARDS = 50_000


def range_bounds(df: DataFrame, key: str, weight: Column, target: int) -> list[int]:
    """Rising bounds that cut the values of an integer key into runs of about ``target`` weight.

    Weights are summed over ranges of ``2**k`` neighbouring keys, about four of them a shard; ranges that
    still weigh more than half of ``target`` are cut into 64 and summed again, down to single keys.  So
    the driver holds a few numbers a shard, whatever the distribution of the keys.  Beyond ``SHARDS``
    shards the target grows.  Rows without a key count for nothing.
    """
    rows = df.select(F.col(key).alias("k"), weight.cast("long").alias("w")).where("k is not null")
    total = rows.agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.sum("w").alias("w")).first()
    if not total.w:
        return []
    target = max(target, total.w // SHARDS, 1)
    cells, shift = 4 * (total.w // target + 1) + 64, 0
    while (total.hi >> shift) - (total.lo >> shift) >= cells:
        shift += 1
    leaves: list[tuple[int, int]] = []
    while True:
        found = rows.groupBy(F.shiftright("k", shift).alias("cell")).agg(F.sum("w").alias("w")).collect()  # a few a shard
        heavy = [r.cell for r in found if 2 * r.w > target and shift]
        leaves += [(r.cell << shift, r.w) for r in found if 2 * r.w <= target or not shift]
        if not heavy:
            break
        wanted = df.sparkSession.createDataFrame([(c,) for c in heavy], "cell long")
        rows = rows.join(F.broadcast(wanted), F.shiftright("k", shift) == F.col("cell"), "left_semi")
        shift = max(0, shift - 6)
    bounds, held = [], 0
    for start, w in sorted(leaves):
        if held and held + w > target:
            bounds.append(start)
            held = 0
        held += w
    return bounds


def range_shard(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most ``key``; rows without a key belong to the first shard."""
    edges = np.array(bounds, np.int64)

    @pandas_udf("int")
    def number(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, v.to_numpy(np.int64), "right").astype(np.int32))

    return number(F.coalesce(key, F.lit(LEAST)))
