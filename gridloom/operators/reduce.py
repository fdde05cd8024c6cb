"""Reductions of weighted source values: one expression over a group for each method.

Values that are null (or NaN) are left out; a group without usable rows gives null.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.joins import FEW, lookup
from gridloom.session import cut


def _values() -> tuple[Column, Column]:
    v = F.nanvl(F.col("value"), F.lit(None).cast("double"))
    return v, F.when(v.isNotNull(), F.col("weight"))


def mean() -> Column:
    v, w = _values()
    return F.try_divide(F.sum(w * v), F.sum(w))


def harmonic_mean() -> Column:
    v, w = _values()
    use = (v != 0) & (w > 0)
    return F.try_divide(F.sum(F.when(use, w)), F.sum(F.when(use, w / F.nullif(v, F.lit(0.0)))))


def geometric_mean() -> Column:
    v, w = _values()
    use = (v > 0) & (w > 0)
    found = F.exp(F.try_divide(F.sum(F.when(use, w * F.ln(F.when(v > 0, v)))), F.sum(F.when(use, w))))
    return F.when(F.coalesce(F.min(v), F.lit(0.0)) >= 0, found)


def total() -> Column:
    """The unweighted sum."""
    v, w = _values()
    return F.when(F.sum(w) != 0, F.sum(v))


def minimum() -> Column:
    v, w = _values()
    return F.when(F.max(w) > 0, F.min(v))


def maximum() -> Column:
    v, w = _values()
    return F.when(F.max(w) > 0, F.max(v))


def percentile(p: float) -> Callable[[], Column]:
    """Unweighted percentile with linear ranks, ``p`` in 0 to 100."""
    if not 0 <= p <= 100:
        raise ValueError("percentile must be from 0 to 100")

    def reduce() -> Column:
        v, w = _values()
        return F.when(F.max(w) > 0, F.percentile(v, p / 100))

    return reduce


def conservative() -> Column:
    """Sum of value times relative weight, not normalised again."""
    v, w = _values()
    return F.when(F.sum(w) != 0, F.sum(w * v))


def max_overlap() -> Column:
    """The value with the largest weight, ties to the largest value."""
    v, w = _values()
    return F.max(F.when(w > 0, F.struct(w.alias("w"), v.alias("v"))))["v"]


_PERCENTILES = {"median": percentile(50), **{f"p{p}": percentile(p) for p in (5, 10, 25, 50, 75, 90, 95)}}
#: Methods for weights that are areas or lengths, and for those relative to the source's.
ABSOLUTE: dict[str, Callable[[], Column]] = {
    "mean": mean, "harmonic_mean": harmonic_mean, "geometric_mean": geometric_mean, "sum": total, "minimum": minimum, "maximum": maximum, **_PERCENTILES, "max_overlap": max_overlap,
}
RELATIVE: dict[str, Callable[[], Column]] = {"conductance": conservative, "first_order_conservative": conservative}
METHODS = ABSOLUTE | RELATIVE | {"conservative": conservative}


@dataclass(frozen=True)
class UserReducer:
    """A function of a target's values and weights, arrays in the order of the source ids; missing values are NaN.

    ``f(values, weights)`` or ``f(values, weights, workspace)`` gives one number, NaN for none.  All sources of
    a target meet in one task; ``StagedReducer`` is for targets with more.
    """

    function: Callable

    def found(self, joined: DataFrame, keys: list[str]) -> DataFrame:
        function, workspace = self.function, len(inspect.signature(self.function).parameters) == 3

        def reduce(source: pa.Array, value: pa.Array, weight: pa.Array) -> float:
            v, w = _ordered(source, value, weight)
            out = function(v, w, np.zeros_like(v)) if workspace else function(v, w)
            return None if out is None or np.isnan(out) else float(out)

        return joined.groupBy(*keys).agg(F.arrow_udf(reduce, "double")(*_three()).alias("value"))


@dataclass(frozen=True)
class StagedReducer:
    """A reducer in stages: ``start(values, weights)`` gives a state, a list of numbers, for some of a target's
    sources, ``merge(states)`` one state for the rows of an array of them, ``finish(state)`` the number.

    A target with more than ``rows`` sources is dealt over tasks; states of up to 4096 parts meet in one.
    """

    start: Callable
    merge: Callable
    finish: Callable
    rows: int = 100_000

    def found(self, joined: DataFrame, keys: list[str]) -> DataFrame:
        start, merge, finish, rows = self.start, self.merge, self.finish, self.rows

        def begin(source: pa.Array, value: pa.Array, weight: pa.Array) -> list[float]:
            return [float(x) for x in start(*_ordered(source, value, weight))]

        def end(states: pa.Array) -> float:
            out = finish(merge(np.array(states.to_pylist(), float)))
            return None if out is None or np.isnan(out) else float(out)

        def again(states: pa.Array) -> list[float]:
            return [float(x) for x in merge(np.array(states.to_pylist(), float))]

        many = cut(joined.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > rows))
        salts = F.coalesce(F.ceil(F.col("n") / rows), F.lit(1))
        dealt = lookup(joined, many, keys, size="n").withColumn("_salt", F.pmod(F.xxhash64("source_id"), salts))
        states = dealt.groupBy(*keys, "_salt").agg(F.arrow_udf(begin, "array<double>")(*_three()).alias("state"))
        states = states.groupBy(*keys, F.floor(F.col("_salt") / 4096).alias("_salt")).agg(F.arrow_udf(again, "array<double>")("state").alias("state"))
        return states.groupBy(*keys).agg(F.arrow_udf(end, "double")("state").alias("value"))


def _three() -> tuple[Column, Column, Column]:
    return F.col("source_id").cast("long"), F.coalesce(F.col("value").cast("double"), F.lit(float("nan"))), F.col("weight").cast("double")


def _ordered(source: pa.Array, value: pa.Array, weight: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(source.to_numpy(zero_copy_only=False), kind="stable")
    return value.to_numpy(zero_copy_only=False)[by], weight.to_numpy(zero_copy_only=False)[by]


Reducer = Callable[[], Column] | UserReducer | StagedReducer


def method_of(method: str | Reducer | Callable, relative: bool | None = None) -> str | Reducer:
    """The expression of a method by name (``mode`` stays a name).

    A function without parameters gives an expression, one of values and weights is a ``UserReducer``.
    """
    if isinstance(method, (UserReducer, StagedReducer)):
        return method
    if callable(method):
        n = len(inspect.signature(method).parameters)
        if n not in (0, 2, 3):
            raise ValueError("a reducer takes nothing, values and weights, or these and a workspace")
        return UserReducer(method) if n else method
    known = METHODS if relative is None else RELATIVE if relative else ABSOLUTE
    if method == "mode" and not relative:
        return method
    if method not in known:
        raise ValueError(f"unknown method {method}; known are {', '.join(sorted(known))}")
    return known[method]


def reduce_weights(weights: DataFrame, data: DataFrame, targets: DataFrame, method: str | Reducer | Callable = "mean", dims: tuple[str, ...] = ()) -> DataFrame:
    """``(*dims, target_id, value)`` for every target and all values of the other dimensions; ``mode`` accumulates weights first."""
    reducer = method_of(method)
    joined = weights.join(data, "source_id")
    if reducer == "mode":
        v, w = _values()
        per = joined.select(*dims, "target_id", v.alias("value"), w.alias("weight")).where("value is not null").groupBy(*dims, "target_id", "value").agg(F.sum("weight").alias("weight"))
        found = per.groupBy(*dims, "target_id").agg(max_overlap().alias("value"))
    elif isinstance(reducer, (UserReducer, StagedReducer)):
        found = reducer.found(joined.select(*dims, "target_id", "source_id", "value", "weight"), [*dims, "target_id"])
    else:
        found = joined.groupBy(*dims, "target_id").agg(reducer().alias("value"))
    every = targets.select("target_id")
    if dims:
        others = data.select(*dims).distinct()
        every = every.join(F.broadcast(others) if others.limit(FEW + 1).count() <= FEW else others)  # the result itself has a row for each
    return every.join(found, [*dims, "target_id"], "left")
