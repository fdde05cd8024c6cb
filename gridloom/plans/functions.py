"""Queries with functions of the user, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import reduce
from gridloom.operators.blocks import map_blocks
from gridloom.plans.registry import register
from gridloom.sources.tables import read_table

TARGET = "o as (select o_orderkey as source_id, o_custkey as target_id, 1 + o_orderkey % 7 as weight, o_totalprice as value from orders)"


def _customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as sources of their customers: weights, values, targets."""
    o = read_table(spark, sf_dir, "orders")
    weights = o.select(F.col("o_custkey").alias("target_id"), F.col("o_orderkey").alias("source_id"), (F.col("o_orderkey") % 7 + 1).cast("double").alias("weight"))
    return weights, o.select(F.col("o_orderkey").alias("source_id"), F.col("o_totalprice").alias("value")), o.select(F.col("o_custkey").alias("target_id")).distinct()


def weighted_median(values: np.ndarray, weights: np.ndarray) -> float:
    """The least value that half of the weight does not exceed."""
    by = np.argsort(values, kind="stable")
    total = np.cumsum(weights[by])
    return values[by][np.searchsorted(total, total[-1] / 2)]


@register(
    "user_reducer",
    f"with {TARGET}, c as (select *, sum(weight) over (partition by target_id order by value, source_id) as upto, sum(weight) over (partition by target_id) as whole from o) select target_id, round(min(value) filter (where upto >= whole / 2.0), 4) as value from c group by 1",
)
def user_reducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.reduce_weights(*_customers(spark, sf_dir), weighted_median).select("target_id", F.round("value", 4).alias("value"))


@register("staged_reducer", f"with {TARGET}, c as (select target_id % 3 as target_id, weight, value / 1000 as value from o) select target_id, round(sqrt(sum(weight * value * value) / sum(weight) - (sum(weight * value) / sum(weight)) ** 2), 4) as value from c group by 1")
def staged_reducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted deviation over three targets with a third of the sources each, in parts of 4096 sources."""
    weights, data, targets = _customers(spark, sf_dir)
    third = (F.col("target_id") % 3).alias("target_id")
    spread = reduce.StagedReducer(lambda v, w: [w.sum(), (w * v).sum(), (w * v * v).sum()], lambda states: states.sum(axis=0), lambda s: np.sqrt(s[2] / s[0] - (s[1] / s[0]) ** 2), rows=4096)
    data = data.select("source_id", (F.col("value") / 1000).alias("value"))
    return reduce.reduce_weights(weights.select(third, "source_id", "weight"), data, targets.select(third).distinct(), spread).select("target_id", F.round("value", 4).alias("value"))


@register(
    "block_runs",
    """with o as (select o_orderkey // 1000 as block, o_orderkey, o_totalprice > lag(o_totalprice) over (partition by o_orderkey // 1000 order by o_orderkey) as up from orders),
    r as (select block, sum(case when coalesce(up, false) then 0 else 1 end) over (partition by block order by o_orderkey) as run from o),
    s as (select block, run, count(*) as n from r group by 1, 2) select block, max(n) as longest, count(*) as runs from s group by 1""",
)
def block_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest rising run of prices, and the number of runs, in each block of a thousand order keys."""

    def runs(block: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        starts = np.flatnonzero(np.append(True, np.diff(block["o_totalprice"]) <= 0))
        length = np.diff(np.append(starts, len(block["o_totalprice"])))
        return {"block": block["o_orderkey"][:1] // 1000, "longest": length.max(keepdims=True), "runs": np.array([len(length)])}

    return map_blocks(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), runs, "block long, longest long, runs long", F.floor(F.col("o_orderkey") / 1000), ["o_orderkey"])
