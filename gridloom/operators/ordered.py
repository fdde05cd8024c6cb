"""Operations along an order that no single task has to hold: neighbours on both sides, and linear recurrences.

Rows are cut into ranges by key and place, so a key may span any number of tasks.  Each range is worked on
alone; what it hands to the next one of the same key is a row a range, carried over afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import stored

METHODS = ("linear", "nearest", "ffill", "bfill")


#: Rows of a range where their number is known first.
RANGE = 500_000


def _ranges(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` written in ranges (``parts`` of them), with the range's number ``_part`` and the row's place ``_row`` in it."""
    rows = df.repartitionByRange(*([parts] if parts else []), *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_row", F.monotonically_increasing_id())
    rows, _ = stored(rows)
    return rows.withColumn("_part", F.shiftright("_row", 33))


def interpolated(data: DataFrame, targets: DataFrame, keys: list[str], at: str, method: str = "linear") -> DataFrame:
    """``(*keys, at, value)`` for every row of ``targets(*keys, at)`` from ``data(*keys, at, value)``.

    Linear between the known places on both sides, null beyond them; ``nearest`` takes the nearer one (of two
    at the same distance the lower), ``ffill`` the one before or at the place, ``bfill`` the one after or at it.
    Null values are unknown; of several values at one place the mean counts; equal targets give a row each.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}, not {method}")
    number = (lambda c: F.unix_micros(F.col(c).cast("timestamp"))) if dict(data.dtypes)[at] in ("timestamp", "timestamp_ntz", "date") else F.col
    known = data.where(F.col("value").isNotNull() & F.col(at).isNotNull()).groupBy(*keys, at).agg(F.avg("value").alias("value"))
    rows = known.select(*keys, at, F.struct(number(at).alias("p"), "value").alias("_known"), F.lit(0).alias("_n"))
    wanted = targets.groupBy(*keys, at).agg(F.count("*").cast("int").alias("_n"))
    rows = rows.unionByName(wanted.withColumn("_known", F.lit(None).cast(rows.schema["_known"].dataType)).select(*keys, at, "_known", "_n"))
    rows = _ranges(rows, keys, [at, "_n"])
    inside = Window.partitionBy("_part", *keys).orderBy("_row")
    before = F.last("_known", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    # a frame that ends at the row grows along the order; one that begins there would be added up anew for every row
    backward = Window.partitionBy("_part", *keys).orderBy(F.desc("_row"))
    after = F.last("_known", ignorenulls=True).over(backward.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"_before": before, "_after": after})
    # what a key's ranges hand to the next ones on both sides
    place = F.when(F.col("_known").isNotNull(), F.col("_row"))
    ends = rows.groupBy("_part", *keys).agg(F.max_by("_known", place).alias("_last"), F.min_by("_known", place).alias("_first"))
    along = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # rows are ranges
    carried = ends.withColumns({"_lo": F.last("_last", ignorenulls=True).over(along.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), "_hi": F.last("_first", ignorenulls=True).over(along.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1))})
    carried = carried.where("_lo is not null or _hi is not null").select(F.col("_part").alias("_of"), *[F.col(k).alias(f"_key_{k}") for k in keys], "_lo", "_hi")
    rows = rows.where("_n > 0").join(carried, _same(keys), "left")
    rows = rows.withColumns({"_lo": F.coalesce("_before", "_lo"), "_hi": F.coalesce("_after", "_hi"), "_p": number(at)})
    low, high, a, b, x = (F.col(c) for c in ("_lo.value", "_hi.value", "_lo.p", "_hi.p", "_p"))
    value = {
        "linear": F.when(a == x, low).when(b == x, high).when(F.col("_lo").isNotNull() & F.col("_hi").isNotNull(), low + (high - low) * ((x - a) / F.nullif(b - a, F.lit(0)))),
        "nearest": F.when(F.col("_hi").isNull() | (x - a <= b - x), low).otherwise(high),
        "ffill": F.when(b == x, high).otherwise(low),
        "bfill": F.when(a == x, low).otherwise(high),
    }[method]
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*keys, at, value.alias("value"))


def neighbours(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``df`` with ``before`` and ``after``: the ``value`` of the rows beside each along ``order``, null at the ends of its key."""
    rows = _ranges(df, keys, order, df.count() // RANGE + 1)
    inside = Window.partitionBy("_part", *keys).orderBy("_row")
    ends = rows.groupBy("_part", *keys).agg(F.min_by(value, "_row").alias("_first"), F.max_by(value, "_row").alias("_last"))
    along = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_part")  # rows are ranges
    carried = ends.select(F.col("_part").alias("_of"), *[F.col(k).alias(f"_key_{k}") for k in keys], F.lag("_last").over(along).alias("_lo"), F.lead("_first").over(along).alias("_hi"))
    carried = carried.where("_lo is not null or _hi is not null")
    rows = rows.withColumns({"_b": F.lag("_row").over(inside), "_a": F.lead("_row").over(inside), "before": F.lag(value).over(inside), "after": F.lead(value).over(inside)}).join(carried, _same(keys), "left")
    beside = lambda at, own, other: F.when(F.col(at).isNull(), F.col(other)).otherwise(F.col(own)).alias(own)
    return rows.select(*df.columns, beside("_b", "before", "_lo"), beside("_a", "after", "_hi"))


def _same(keys: list[str]) -> Column:
    out = F.col("_part") == F.col("_of")
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return out


def _scan(factor: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Composed factors and sums of the maps ``y -> factor * y + term``, by doubling."""
    factor, terms, step = factor.copy(), terms.copy(), 1
    while step < len(factor):
        terms[:, step:] = terms[:, step:] + factor[step:] * terms[:, :-step]
        factor[step:] = factor[step:] * factor[:-step]
        step *= 2
    return factor, terms


def recurrence(df: DataFrame, keys: list[str], order: list[str], factor: Column, terms: dict[str, Column]) -> DataFrame:
    """``df`` with a column for each of ``terms``: ``y = factor * y before + term`` along ``order``, from 0 for each of ``keys``.

    The maps of a row compose associatively: ranges are scanned alone, and the driver composes one map a
    range.  Rows of one key with equal order have no defined order between them.
    """
    names = list(terms)
    rows = _ranges(df.withColumns({"_f": factor.cast("double"), **{f"_t_{n}": t.cast("double") for n, t in terms.items()}, "_key": F.xxhash64(*keys) if keys else F.lit(0).cast("long")}), keys, order)
    schema = "_part long, _row long, _key long, _f double, " + ", ".join(f"`{n}` double" for n in names)

    def scan(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_row")
        key, f = rows.column("_key").to_numpy(), rows.column("_f").to_numpy().copy()
        f[np.flatnonzero(key[1:] != key[:-1]) + 1] = 0.0  # a key begins
        alone = f.copy()
        alone[0] = 0.0
        _, sums = _scan(alone, np.array([rows.column(f"_t_{n}").to_numpy() for n in names]))
        left = np.cumprod(f)  # what is left of the value that the range before hands over
        return pa.table([rows.column("_part"), rows.column("_row"), rows.column("_key"), pa.array(left), *map(pa.array, sums)], names=["_part", "_row", "_key", "_f", *names])

    work = rows.select("_part", "_row", "_key", "_f", *[f"_t_{n}" for n in names])
    scanned, _ = stored(work.groupBy("_part").applyInArrow(scan, schema))
    ends = scanned.groupBy("_part").agg(F.max_by(F.struct("_key", "_f", *names), "_row").alias("z"), F.min_by("_key", "_row").alias("first")).orderBy("_part").collect()  # a row a range
    carry, key, y = [], None, np.zeros(len(names))
    for r in ends:
        y = y if r.first == key else np.zeros(len(names))
        carry.append((r["_part"], *y.tolist()))
        y = np.array([r.z[n] for n in names]) + (r.z["_f"] if r.z["_key"] == r.first else 0.0) * y
        key = r.z["_key"]
    carry = df.sparkSession.createDataFrame(carry, "_part long, " + ", ".join(f"`_c_{n}` double" for n in names)) if carry else df.sparkSession.createDataFrame([], "_part long, " + ", ".join(f"`_c_{n}` double" for n in names))
    done = scanned.join(F.broadcast(carry), "_part").select("_part", "_row", *[(F.col(n) + F.col("_f") * F.col(f"_c_{n}")).alias(n) for n in names])
    return rows.select(*df.columns, "_part", "_row").join(done, ["_part", "_row"]).drop("_part", "_row")


def exponential_mean(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float) -> DataFrame:
    """``df`` with ``value`` replaced by the mean of the values up to each, weights falling by ``1 - alpha`` a row; nulls weigh nothing."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be over 0 and at most 1")
    has = F.col(value).isNotNull()
    out = recurrence(df, keys, order, F.lit(1 - alpha), {"_sum": F.when(has, F.col(value)).otherwise(0.0), "_weight": F.when(has, 1.0).otherwise(0.0)})
    return out.withColumn(value, F.try_divide("_sum", "_weight")).drop("_sum", "_weight")
