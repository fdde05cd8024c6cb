"""Reducers and block functions of the user."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import reduce
from gridloom.operators.blocks import map_blocks
from gridloom.operators.regridders import OverlapRegridder, Raster


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(5)
    rows = [(int(t), int(s), float(rng.integers(1, 9))) for t in range(6) for s in rng.choice(40, rng.integers(1, 30), replace=False)]
    weights = spark.createDataFrame(rows, "target_id long, source_id long, weight double")
    data = spark.createDataFrame([(s, k, None if s % 11 == 0 else float(s * s % 17) + k) for s in range(40) for k in (0, 5)], "source_id long, layer int, value double")
    return rows, weights, data, spark.range(7).select(F.col("id").alias("target_id"))


def weighted_median(values, weights):
    ok = ~np.isnan(values)
    by = np.argsort(values[ok], kind="stable")
    total = np.cumsum(weights[ok][by])
    return values[ok][by][np.searchsorted(total, total[-1] / 2)] if len(total) else np.nan


def brute(rows, function, layer):
    out = {}
    for t in range(7):
        mine = sorted((s, w) for u, s, w in rows if u == t)
        v = np.array([np.nan if s % 11 == 0 else s * s % 17 + layer for s, _ in mine], float)
        got = function(v, np.array([w for _, w in mine])) if mine else np.nan
        out[t, layer] = None if np.isnan(got) else round(float(got), 9)
    return out


def test_reducers_of_two_and_three_parameters(tables):
    rows, weights, data, targets = tables
    want = brute(rows, weighted_median, 0) | brute(rows, weighted_median, 5)
    for method in (weighted_median, lambda v, w, workspace: weighted_median(v, w + workspace), reduce.UserReducer(weighted_median)):
        got = reduce.reduce_weights(weights, data, targets, method, ("layer",)).collect()
        assert {(r.target_id, r.layer): r.value if r.value is None else round(r.value, 9) for r in got} == want
    order = lambda v, w: float(np.nansum(v * np.arange(len(v))))  # noqa: E731  values come by source id
    got = reduce.reduce_weights(weights, data.where("layer = 0").drop("layer"), targets, order).collect()
    assert {(r.target_id, 0): r.value for r in got if r.value is not None} == {k: v for k, v in brute(rows, order, 0).items() if v is not None and k[0] < 6}
    with pytest.raises(ValueError):
        reduce.method_of(lambda a: a)


@pytest.mark.parametrize("limit", [3, 100])
def test_staged_reducer(tables, limit):
    """A weighted standard deviation from sums, in parts of a few sources."""
    rows, weights, data, targets = tables
    start = lambda v, w: [np.nansum(w * ~np.isnan(v)), np.nansum(w * v), np.nansum(w * v * v)]
    finish = lambda s: np.sqrt(max(0.0, s[2] / s[0] - (s[1] / s[0]) ** 2)) if s[0] else np.nan
    staged = reduce.StagedReducer(start, lambda states: states.sum(axis=0), finish, rows=limit)
    got = reduce.reduce_weights(weights, data, targets, staged, ("layer",)).collect()
    want = brute(rows, lambda v, w: finish(start(v, w)), 5)
    assert {(r.target_id, r.layer): r.value if r.value is None else round(r.value, 9) for r in got if r.layer == 5} == want


def test_regridder_with_a_function(spark):
    source, target = Raster(spark, (0.0, 1.0, 2.0, 3.0, 4.0), (0.0, 1.0)), Raster(spark, (0.0, 2.0, 4.0), (0.0, 1.0))
    data = spark.createDataFrame([(0, 1.0), (1, 4.0), (2, 9.0)], "source_id long, value double")
    got = OverlapRegridder(source, target, lambda v, w: np.nanmax(np.sqrt(v)) * w.sum()).regrid(data)
    assert sorted((r.target_id, r.value) for r in got.collect()) == [(0, 4.0), (1, 3.0)]


def test_map_blocks(spark):
    df = spark.range(25).select("id", F.when(F.col("id") != 3, F.col("id") * 1.0).alias("v"))

    def differences(block):
        return {"id": block["id"][1:], "d": np.diff(block["v"]), "n": np.full(len(block["id"]) - 1, len(block["id"]))}

    got = map_blocks(df, differences, "id long, d double, n long", F.floor(F.col("id") / 10), ["id"]).collect()
    assert {r.id: (r.d, r.n) for r in got} == {i: (None if i in (3, 4) else 1.0, 10 if i < 20 else 5) for i in range(25) if i % 10}
    assert map_blocks(df.limit(0), differences, "id long, d double, n long", F.lit(0), ["id"]).count() == 0
