"""Polynomial fits against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators.fit import polyfit, polyval


@pytest.mark.parametrize("degree", [0, 1, 3])
def test_fits_equal_numpy(spark, degree):
    rng = random.Random(degree)
    rows = [(k, 1e4 + i * 0.5, rng.random() * 10 + (i * 0.1) ** 2, rng.choice((1.0, 2.0))) for k in ("a", "b", None) for i in range(25)]
    rows += [("a", None, 1.0, 1.0), ("a", 3.0, float("nan"), 1.0), ("few", 2.0, 1.0, 1.0), ("few", 2.0, 3.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double, w double").withColumn("n", F.lit("clash")).drop("n")
    got = {r.k: r for r in polyfit(df.where("k is not null"), ["k"], "x", "y", degree, "w").collect()}
    for k in ("a", "b"):
        mine = [(x, y, w) for key, x, y, w in rows if key == k and x is not None and y == y]
        x, y, w = map(np.array, zip(*mine))
        want = np.polynomial.Polynomial.fit(x, y, degree, w=np.sqrt(w))
        assert got[k].n == 25
        at = np.linspace(1e4, 1e4 + 12, 5)
        assert np.polyval(got[k].coefficients[::-1], at) == pytest.approx(want(at), abs=1e-3 if degree > 1 else 1e-6)
    assert got["few"].coefficients == ([2.0] if degree == 0 else None)


def test_whole_numbers_are_fitted_exactly(spark):
    """Places beside each other and far from 0: sums in doubles lost the constant's digits, or took the places for one."""
    a, b = 9_000_000, 8_000_000_000
    rows = [(k, x, 7 * k - 3 * x + 5 * x * x) for k in range(9) for x in (a, a + 1, a + 2, a + 90_000)] + [(9, a, 1), (9, a, 3), (9, a + 1, 1)]
    got = {r.k: r.coefficients for r in polyfit(spark.createDataFrame(rows, "k long, x long, y long"), ["k"], "x", "y", 2).collect()}
    assert got == {k: [7.0 * k, -3.0, 5.0] for k in range(9)} | {9: None}
    # sums of too many digits go the other way
    wide = spark.createDataFrame([(b * k, 2 * b * k + 1) for k in range(-5, 6)], "x long, y long")
    assert polyfit(wide, [], "x", "y", 2).first().coefficients == pytest.approx([1.0, 2.0, 0.0], abs=1e-6)
    assert polyfit(wide, [], "x", "y", 0).first().coefficients == [1.0]


def test_fit_without_keys_and_values(spark):
    df = spark.range(10).select(F.col("id").alias("x"), (3.0 - 2 * F.col("id") + F.col("id") * F.col("id") / 2).alias("y"))
    one = polyfit(df, [], "x", "y", 2)
    assert one.first().coefficients == pytest.approx([3.0, -2.0, 0.5])
    at = one.withColumn("x", F.lit(4.0)).select(polyval("coefficients", "x").alias("v")).first().v
    assert at == pytest.approx(3.0)
    assert polyfit(df.limit(0), [], "x", "y", 1).count() == 0
    with pytest.raises(ValueError):
        polyfit(df, [], "x", "y", -1)
