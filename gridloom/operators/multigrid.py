"""Conjugate gradients with smoothed aggregation multigrid, on matrices and vectors that are tables.

Matrices are ``(i, j, a)``, symmetric and positive definite; vectors are ``(i, v)``.  A level groups
neighbours that are strongly coupled: nodes whose hashed id is the largest around become roots, the others
join the root, else the group, that they are coupled with most.  The interpolation from groups to nodes is
smoothed by one Jacobi step, and the coarse matrix is its product with the matrix on both sides, by joins
and sums.  A V-cycle over the levels is the preconditioner, so that the number of rounds hardly depends on
the size of the mesh.  A level of at most ``direct`` unknowns is solved on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import Round, cut, remove, stored

DIRECT = 4_000
SMOOTH = 2 / 3
STRONG = 0.25


@dataclass(frozen=True)
class Level:
    """A matrix, its diagonal ``(i, d)``, and the interpolation ``(i, g, p)`` from the next level's unknowns.

    They are written tables, whose real sizes the planner knows; ``paths`` are theirs.
    """

    matrix: DataFrame
    diagonal: DataFrame
    interpolation: DataFrame
    paths: tuple[str, ...] = ()


@dataclass(frozen=True)
class Coarsest:
    """Ids and the inverse of a small matrix."""

    ids: np.ndarray
    inverse: np.ndarray

    def solve(self, right: DataFrame) -> DataFrame:
        found = {r.i: r.v for r in right.collect()}  # at most ``direct`` rows
        v = self.inverse @ np.array([found.get(i, 0.0) for i in self.ids.tolist()])
        return right.sparkSession.createDataFrame(list(zip(self.ids.tolist(), v.tolist())), "i long, v double")


def times(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """``(i, v)``: the product."""
    return matrix.join(vector.withColumnRenamed("i", "j"), "j").groupBy("i").agg(F.sum(F.col("a") * F.col("v")).alias("v"))


def groups(matrix: DataFrame) -> DataFrame:
    """``(i, g)``: the group of each node, named by its root."""
    off = matrix.where("i <> j").withColumn("a", F.abs("a"))
    top = off.groupBy("i").agg(F.max("a").alias("most"))
    strong = cut(off.join(top, "i").where(F.col("a") >= STRONG * F.col("most")).select("i", "j", "a"))
    strong = cut(strong.unionAll(strong.select(F.col("j").alias("i"), F.col("i").alias("j"), "a")).groupBy("i", "j").agg(F.max("a").alias("a")))
    ids = matrix.select("i").distinct()
    rank = lambda c: F.struct(F.xxhash64(c), c)
    beaten = strong.groupBy("i").agg(F.max(rank("j")).alias("top")).where(F.struct(F.col("top.col1"), F.col("top.j")) > rank("i")).select("i")
    found = cut(ids.join(beaten, "i", "left_anti").select("i", F.col("i").alias("g")))
    for _ in range(2):  # beside a root, then beside a node of a group
        rest = strong.join(found.select("i"), "i", "left_anti").join(found.withColumnRenamed("i", "j"), "j")
        found = cut(found.unionAll(rest.groupBy("i").agg(F.max(F.struct("a", "g")).alias("best")).select("i", "best.g")))
    alone = ids.join(found, "i", "left_anti").select("i", F.col("i").alias("g"))
    return cut(found.unionAll(alone))


def coarser(matrix: DataFrame) -> tuple[Level, DataFrame]:
    """The level of a matrix, and the next level's matrix."""
    matrix, path = stored(matrix)
    diagonal, other = stored(matrix.where("i = j").select("i", F.col("a").alias("d")))
    group = groups(matrix)
    near = matrix.join(group.withColumnRenamed("i", "j"), "j").groupBy("i", "g").agg(F.sum("a").alias("a"))  # A times the groups
    own = group.select("i", "g", F.lit(1.0).alias("one"))
    p = near.join(own, ["i", "g"], "left").join(diagonal, "i").select("i", "g", (F.coalesce("one", F.lit(0.0)) - SMOOTH * F.col("a") / F.col("d")).alias("p"))
    p, third = stored(p.where("p <> 0"))
    ap = matrix.join(p.select(F.col("i").alias("j"), "g", "p"), "j").groupBy("i", "g").agg(F.sum(F.col("a") * F.col("p")).alias("ap"))
    left = p.select("i", F.col("g").alias("r"), F.col("p").alias("w"))
    coarse = left.join(ap, "i").groupBy(F.col("r").alias("i"), F.col("g").alias("j")).agg(F.sum(F.col("w") * F.col("ap")).alias("a"))
    return Level(matrix, diagonal, p, (path, other, third)), cut(coarse)


def hierarchy(matrix: DataFrame, direct: int = DIRECT, most: int = 30) -> list[Level | Coarsest]:
    """Levels from the fine matrix down to one that the driver solves."""
    out: list[Level | Coarsest] = []
    size = matrix.where("i = j").count()
    while size > direct and len(out) < most:
        level, coarse = coarser(matrix)
        smaller = coarse.where("i = j").count()
        if smaller > 0.9 * size:
            break  # no couplings left: Jacobi steps do
        out.append(level)
        matrix, size = coarse, smaller
    if size <= direct:
        entries = matrix.collect()  # at most ``direct`` squared
        ids = np.array(sorted({e.i for e in entries}), np.int64)
        dense = np.zeros((len(ids), len(ids)))
        for e in entries:
            dense[np.searchsorted(ids, e.i), np.searchsorted(ids, e.j)] = e.a
        out.append(Coarsest(ids, np.linalg.inv(dense)))
    return out


def cycle(levels: list[Level | Coarsest], right: DataFrame) -> DataFrame:
    """``(i, v)``: about the solution of the first level's matrix for ``right(i, v)``; symmetric, for conjugate gradients."""
    level = levels[0]
    if isinstance(level, Coarsest):
        return level.solve(right)
    sub = lambda r, product: r.join(product.withColumnRenamed("v", "_q"), "i", "left").select("i", (F.col("v") - F.coalesce("_q", F.lit(0.0))).alias("v"))
    step = lambda r: r.join(level.diagonal, "i").select("i", (SMOOTH * F.col("v") / F.col("d")).alias("v"))
    add = lambda x, y: x.join(y.withColumnRenamed("v", "_y"), "i", "left").select("i", (F.col("v") + F.coalesce("_y", F.lit(0.0))).alias("v"))
    first = step(right)
    if len(levels) > 1:
        rest = sub(right, times(level.matrix, first))
        coarse = cut(rest.join(level.interpolation, "i").groupBy("g").agg(F.sum(F.col("p") * F.col("v")).alias("v")).withColumnRenamed("g", "i"))
        below = cycle(levels[1:], coarse)
        up = level.interpolation.join(below.withColumnRenamed("i", "g"), "g").groupBy("i").agg(F.sum(F.col("p") * F.col("v")).alias("v"))
        first = cut(add(first, up))
    return cut(add(first, step(sub(right, times(level.matrix, first)))))


def solve(matrix: DataFrame, right: DataFrame, tolerance: float = 1e-8, max_iterations: int = 500, direct: int = DIRECT) -> tuple[DataFrame, int, bool]:
    """``(i, v)``, the rounds, and whether the residual, scaled by the diagonal, fell below ``tolerance`` times the first."""
    levels = hierarchy(matrix, direct)
    fine = levels[0] if levels and isinstance(levels[0], Level) else Level(matrix, cut(matrix.where("i = j").select("i", F.col("a").alias("d"))), matrix.limit(0))
    levels = levels or [fine]  # nothing couples
    states, moves = Round(matrix.sparkSession), Round(matrix.sparkSession)
    start = fine.diagonal.join(right.select("i", F.col("v").alias("r")), "i", "left").select("i", "d", F.lit(0.0).alias("u"), F.coalesce("r", F.lit(0.0)).alias("r"), F.lit(0.0).alias("p"))
    state, rounds, rz = moves.put(start), 0, 1.0
    norm = lambda s: s.agg(F.sum(F.col("r") * F.col("r") / F.col("d")).alias("v")).first().v or 0.0
    left = norm(state)
    goal = tolerance * tolerance * left
    while left > goal and rounds < max_iterations:
        z = cycle(levels, state.select("i", F.col("r").alias("v"))).withColumnRenamed("v", "z")
        state = states.put(state.join(z, "i"))
        new = state.agg(F.sum(F.col("r") * F.col("z")).alias("v")).first().v
        state, rz = state.withColumn("p", F.col("z") + (new / rz if rounds else 0.0) * F.col("p")), new
        ap = times(fine.matrix, state.select("i", F.col("p").alias("v"))).withColumnRenamed("v", "ap")
        moved = moves.put(state.join(ap, "i").drop("z"))
        alpha = rz / moved.agg(F.sum(F.col("p") * F.col("ap")).alias("v")).first().v
        state = moved.select("i", "d", (F.col("u") + alpha * F.col("p")).alias("u"), (F.col("r") - alpha * F.col("ap")).alias("r"), "p")
        left, rounds = norm(state), rounds + 1
    found = cut(state.select("i", F.col("u").alias("v")))
    for path in [p for level in levels if isinstance(level, Level) for p in level.paths] + [p for p in (states.path, moves.path) if p]:
        remove(matrix.sparkSession, path)
    return found, rounds, left <= goal
