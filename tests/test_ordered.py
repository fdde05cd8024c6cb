"""Interpolation along a dimension and recurrences, cut into ranges, against plain loops."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import ordered


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(2)
    rows = [(k, float(rng.randrange(0, 400)), None if rng.random() < 0.1 else rng.random()) for k in (1, 1, 1, 2, None) for _ in range(60)]
    return rows, spark.createDataFrame(rows, "k int, at double, value double")


def plain(rows, k, x, method):
    found = {}
    for key, at, v in rows:
        if key == k and v is not None:
            found.setdefault(at, []).append(v)
    at = sorted(found)
    mean = lambda p: sum(found[p]) / len(found[p])
    i = bisect.bisect_right(at, x)
    lo, hi = (at[i - 1] if i else None), (x if i and at[i - 1] == x else at[i] if i < len(at) else None)
    if method == "ffill":
        return None if lo is None else mean(lo)
    if method == "bfill":
        return None if hi is None else mean(hi)
    if method == "nearest":
        return mean(hi if lo is None or hi is not None and hi - x < x - lo else lo) if at else None
    return None if lo is None or hi is None else mean(lo) if lo == hi else mean(lo) + (mean(hi) - mean(lo)) * (x - lo) / (hi - lo)


@pytest.mark.parametrize("method", ordered.METHODS)
def test_interpolated_equals_a_plain_loop(spark, events, method):
    rows, data = events
    wanted = [(k, float(x)) for k in (1, 2, 3, None) for x in (-5, 0, 3, 77, 200, 200, 399, 500)]
    got = ordered.interpolated(data, spark.createDataFrame(wanted, "k int, at double"), ["k"], "at", method).collect()
    want = [(k, x, plain(rows, k, x, method)) for k, x in wanted]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == [(k, x, v if v is None else pytest.approx(v)) for k, x, v in sorted(want, key=key)]


def test_interpolated_without_keys_or_data(spark, events):
    rows, data = events
    wanted = spark.createDataFrame([(10.5,), (250.0,)], "at double")
    got = ordered.interpolated(data.drop("k"), wanted, [], "at").orderBy("at").collect()
    assert [r.value for r in got] == [pytest.approx(plain([(0, *r[1:]) for r in rows], 0, x, "linear")) for x in (10.5, 250.0)]
    assert [r.value for r in ordered.interpolated(data.limit(0).drop("k"), wanted, [], "at").collect()] == [None, None]
    with pytest.raises(ValueError):
        ordered.interpolated(data, wanted, [], "at", "cubic")


@pytest.mark.parametrize("alpha", [0.3, 1.0])
def test_exponential_mean_over_ranges(spark, alpha):
    rng = random.Random(3)
    rows = [(k, i, None if rng.random() < 0.2 or i == 0 else rng.random()) for k in ("a", "b", None) for i in range(90 if k == "a" else 7)]
    got = ordered.exponential_mean(spark.createDataFrame(rows, "k string, i int, v double").repartition(5), ["k"], ["i"], "v", alpha).collect()
    want, state = {}, {}
    for k, i, v in rows:
        s, w = (x * (1 - alpha) for x in state.get(k, (0.0, 0.0)))
        state[k] = s, w = (s + (v or 0.0), w + (v is not None))
        want[k, i] = s / w if w else None
    assert {(r.k, r.i): r.v for r in got} == {k: v if v is None else pytest.approx(v) for k, v in want.items()}


def test_recurrence_of_changing_factors(spark):
    rows = [(i, 0.5 + (i % 3) / 4, float(i % 7)) for i in range(200)]
    got = ordered.recurrence(spark.createDataFrame(rows, "i int, f double, t double"), [], ["i"], F.col("f"), {"y": F.col("t"), "n": F.lit(1.0)}).orderBy("i").collect()
    y = n = 0.0
    for r, (_, f, t) in zip(got, rows):
        y, n = f * y + t, f * n + 1
        assert (r.y, r.n) == (pytest.approx(y), pytest.approx(n))
    assert ordered.recurrence(spark.createDataFrame([], "i int"), [], ["i"], F.lit(1.0), {"y": F.lit(1.0)}).count() == 0


def test_interpolation_has_no_frame_that_begins_at_its_row(spark, events):
    """Such a frame is added up anew for every row, so a range of n rows took n * n steps."""
    _, data = events
    plan = ordered.interpolated(data, data.select("k", "at"), ["k"], "at")._jdf.queryExecution().executedPlan().toString()
    assert "unboundedpreceding" in plan.lower() and "unboundedfollowing" not in plan.lower()
