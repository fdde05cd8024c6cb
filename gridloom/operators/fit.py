"""Least squares fits of each key's values along a dimension."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.joins import lookup
from gridloom.session import cut


WHOLE = ("tinyint", "smallint", "int", "bigint")
DIGITS = 37


def _exact(df: DataFrame, keys: list[str], x: str, y: str, degree: int) -> DataFrame | None:
    """As ``polyfit`` of whole numbers: sums of powers as decimals, equations of whole numbers; None if the sums have too many digits."""
    wide = "decimal(38,0)"
    rows = df.select(*keys, F.col(x).cast(wide).alias("_x"), F.col(y).cast(wide).alias("_y")).where("_x is not null and _y is not null")
    low = rows.groupBy(*keys).agg(F.min("_x").alias("_m"), F.min("_y").alias("_c"), F.max("_x").alias("_p"), F.max("_y").alias("_q"), F.count("*").alias("n"))
    low = cut(low.withColumns({"_p": F.col("_p") - F.col("_m"), "_q": F.col("_q") - F.col("_c")}))
    top = low.agg(F.max("_p").alias("p"), F.max("_q").alias("q"), F.max("n").alias("n")).first()
    if top.n is not None and max(int(top.p), int(top.q), 1) * max(int(top.p), 1) ** max(2 * degree - 1, 0) * top.n >= 10**DIGITS:
        return None
    low = low.drop("_p", "_q")
    rows = lookup(rows, low, keys, "inner", size="n") if keys else rows.crossJoin(F.broadcast(low))  # without keys joined with one row
    rows = rows.select(*keys, "n", "_m", "_c", (F.col("_x") - F.col("_m")).cast(wide).alias("_u"), (F.col("_y") - F.col("_c")).cast(wide).alias("_v"))

    def power(k: int):
        out = F.lit(1).cast(wide)
        for _ in range(k):
            out = (out * F.col("_u")).cast(wide)
        return out

    text = lambda c: F.sum(c.cast(wide)).cast("string")
    sums = rows.groupBy(*keys, "n", "_m", "_c").agg(F.array(*[text(power(k)) for k in range(2 * degree + 1)]).alias("a"), F.array(*[text(F.col("_v") * power(k)) for k in range(degree + 1)]).alias("b"))
    size = degree + 1
    whole = lambda v: np.array([int(t) for t in v.to_pylist()], object)

    def solve(a: pa.Array, b: pa.Array, m: pa.Array, c: pa.Array) -> pa.Array:
        """Elimination without fractions; a pivot is 0 only with fewer different places than coefficients."""
        moments, right, m, c = whole(a.flatten()).reshape(len(a), -1), whole(b.flatten()).reshape(len(b), size), whole(m), whole(c)
        rows = [[*(moments[:, i + j] for j in range(size)), right[:, i]] for i in range(size)]
        before, sound = 1, np.ones(len(a), bool)
        for k in range(size):
            sound &= rows[k][k] != 0
            rows[k][k] = np.where(sound, rows[k][k], 1)
            for i in range(k + 1, size):
                rows[i] = [*rows[i][: k + 1], *((rows[i][j] * rows[k][k] - rows[i][k] * rows[k][j]) // before for j in range(k + 1, size + 1))]
            before = rows[k][k]
        found = [None] * size  # over ``before``, the determinant
        for k in range(degree, -1, -1):
            found[k] = (rows[k][size] * before - sum((rows[k][j] * found[j] for j in range(k + 1, size)), 0)) // rows[k][k]
        out = [0 * before] * size
        for k in range(degree, -1, -1):  # p(x - m) by Horner's rule on polynomials
            out = [found[k] - out[0] * m, *(out[j - 1] - out[j] * m for j in range(1, size))]
        out[0] = out[0] + c * before
        return pa.array([[int(v) / int(d) for v in row] if ok else None for *row, d, ok in zip(*out, before, sound)], pa.list_(pa.float64()))

    return sums.select(*keys, "n", F.arrow_udf(solve, "array<double>")("a", "b", F.col("_m").cast("string"), F.col("_c").cast("string")).alias("coefficients"))


def polyfit(df: DataFrame, keys: list[str], x: str, y: str, degree: int, weight: str | None = None) -> DataFrame:
    """``(*keys, n, coefficients)``: of the polynomial of ``degree`` that fits best, the constant first.

    Rows with a null or NaN are left out.  A key with fewer different places than coefficients has null ones.
    The normal equations are sums of powers, so a key may have any number of rows; places are shifted to their
    mean and scaled by their spread first, which keeps the equations sound.  Whole numbers without a weight are
    fitted exactly and rounded once, as the places of a key may be close together and far from 0.
    """
    if degree < 0:
        raise ValueError("the degree must not be negative")
    if weight is None and all(dict(df.dtypes)[c] in WHOLE for c in (x, y)):
        exact = _exact(df, keys, x, y, degree)
        if exact is not None:
            return exact
    known = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    rows = df.select(*keys, known(x).alias("_x"), known(y).alias("_y"), (known(weight) if weight else F.lit(1.0)).alias("_w")).where("_x is not null and _y is not null and _w > 0")
    spread = rows.groupBy(*keys).agg(F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_s"), F.count("*").alias("n"))
    spread = cut(spread.withColumn("_s", F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)))
    rows = (lookup(rows, spread, keys, "inner", size="n") if keys else rows.crossJoin(F.broadcast(spread))).withColumn("_u", (F.col("_x") - F.col("_m")) / F.col("_s"))  # without keys joined with one row
    power = lambda k: F.lit(1.0) if not k else F.pow("_u", F.lit(float(k)))
    sums = rows.groupBy(*keys, "n", "_m", "_s").agg(
        F.array(*[F.sum(F.col("_w") * power(k)) for k in range(2 * degree + 1)]).alias("a"), F.array(*[F.sum(F.col("_w") * F.col("_y") * power(k)) for k in range(degree + 1)]).alias("b")
    )
    size = degree + 1

    def solve(a: pa.Array, b: pa.Array, m: pa.Array, s: pa.Array) -> pa.Array:
        """The equations of a batch of keys, and their polynomials in the places as they were."""
        moments = np.asarray(a.flatten()).reshape(len(a), -1)
        at = np.arange(size)[:, None] + np.arange(size)
        matrix, right = moments[:, at], np.asarray(b.flatten()).reshape(len(b), size)
        sound = np.linalg.matrix_rank(matrix, tol=1e-10 * np.maximum(1.0, np.abs(matrix).max(axis=(1, 2)))) == size
        scaled = np.zeros((len(a), size))
        scaled[sound] = np.linalg.solve(matrix[sound], right[sound][..., None])[..., 0]
        # p((x - m) / s) by Horner's rule on polynomials
        out, m, s = np.zeros((len(a), size)), np.asarray(m), np.asarray(s)
        for k in range(degree, -1, -1):
            moved = np.zeros_like(out)
            moved[:, 1:] = out[:, :-1]
            out = (moved - out * m[:, None]) / s[:, None]
            out[:, 0] += scaled[:, k]
        return pa.array([row.tolist() if ok else None for row, ok in zip(out, sound)], pa.list_(pa.float64()))

    return sums.select(*keys, "n", F.arrow_udf(solve, "array<double>")("a", "b", "_m", "_s").alias("coefficients"))


def polyval(coefficients: str, x: str):
    """The polynomial's value at ``x``, as a column."""
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda acc, c: acc * F.col(x) + c)
