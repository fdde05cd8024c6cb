"""A direct solution of large sparse symmetric systems on places, block by block.

Unknowns are put in order along a curve through their places and cut into blocks.  In a task each block's inner
unknowns, those without a neighbour in a later block, are eliminated; what couples the others is added up
as the matrix of the next level, whose blocks are runs of the blocks before.  When all are eliminated, the
levels are gone through backwards.  On long or small meshes a few levels do; where the blocks' borders become
too long for a task, what is left goes to conjugate gradients.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import multigrid
from gridloom.operators.components import connected_components
from gridloom.operators.mesh import dense_ids
from gridloom.session import cut, remove, stored

BLOCK = 256
FRONT = 1_500
BITS = 20


def curve(places: DataFrame) -> DataFrame:
    """``(i, z)``: the place of each of ``places(i, x, y)`` along a Morton curve; cells are squares."""
    ends = places.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-300)).alias("span")).first()
    cell = lambda c, low: F.floor((F.col(c) - F.lit(low)) / F.lit(ends.span) * F.lit((1 << BITS) - 1)).cast("long")

    apart = lambda v: F.conv(F.bin(v), 4, 10).cast("long")  # noqa: E731  its bits read as digits to the base of 4
    return places.select("i", (apart(cell("x", ends.x0)) + 2 * apart(cell("y", ends.y0))).alias("z"))


class _Block:
    """The rows of a block: entries ``(i, j, a)`` of the upper triangle, right sides without ``j``, found values without ``i``."""

    def __init__(self, block: int, width: int, t: pa.Table):
        i, j, p, q = (np.asarray(t.column(c).fill_null(-1)) for c in ("i", "j", "p", "q"))
        a = np.asarray(t.column("a"))
        lone = t.column("j").is_null().to_numpy()
        found = t.column("i").is_null().to_numpy()
        self.found = dict(zip(j[found].tolist(), a[found].tolist()))
        pairs = ~lone & ~found
        i, j, a, p, q, right, at = i[pairs], j[pairs], a[pairs], p[pairs], q[pairs], a[lone], i[lone]
        self.ids, place = np.unique(np.concatenate([i, j, at]), return_inverse=True)
        n, u, v = len(self.ids), place[: len(i)], place[len(i) : 2 * len(i)]
        self.part = np.zeros(n, np.int64)
        self.part[u], self.part[v] = p, q
        whose = self.part // width
        later = np.zeros(n, bool)  # own unknowns with a neighbour in a later block, and all of other blocks
        np.logical_or.at(later, u, whose[v] > whose[u])
        np.logical_or.at(later, v, whose[u] > whose[v])
        later |= whose != block
        self.inner, self.outer = np.flatnonzero(~later), np.flatnonzero(later)
        self.right = np.zeros(n)
        np.add.at(self.right, place[2 * len(i) :], right)
        # what a neighbour in a later block holds too is its
        own = (whose[u] <= block) & (whose[v] <= block)
        self.matrix = np.zeros((n, n))
        np.add.at(self.matrix, (u[own], v[own]), a[own])
        cross = own & (u != v)
        np.add.at(self.matrix, (v[cross], u[cross]), a[cross])
        mine = np.zeros(n, bool)
        mine[u[own]] = mine[v[own]] = True
        self.outer = self.outer[mine[self.outer]]
        # what hangs together within the block, and what of it has right sides or touches what stays
        label, u, v = np.arange(n), u[cross], v[cross]
        inside = ~later[u] & ~later[v]
        u2, v2 = u[inside], v[inside]
        while True:
            low, new = np.minimum(label[u2], label[v2]), label.copy()
            np.minimum.at(new, label[u2], low)
            np.minimum.at(new, label[v2], low)
            new = new[new]
            if np.array_equal(new, label):
                break
            label = new
        self.held = np.zeros(n, bool)
        self.held[place[2 * len(i) :]] = True
        self.label, (self.stay, self.go) = label, (np.concatenate(p) for p in zip(*((a[m], b[m]) for a, b in ((u, v), (v, u)) for m in [later[a] & ~later[b]])))
        touch = self.of(self.go)
        have = self.of(np.flatnonzero(self.held & ~later))
        self.held[self.stay[have[self.go]]] = True
        self.inner = self.inner[(touch | have)[self.inner]]  # others are without any value

    def of(self, some):
        """Which unknowns hang together with ``some`` inner ones."""
        hit = np.zeros(len(self.ids), bool)
        hit[self.label[some]] = True
        return hit[self.label]

    def parts(self):
        return self.matrix[np.ix_(self.inner, self.inner)], self.matrix[np.ix_(self.inner, self.outer)]


ROWS = pa.schema([("block", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("a", pa.float64()), ("p", pa.int64()), ("q", pa.int64())])


def _eliminated(width: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        b = _Block(key[0].as_py(), width, t)
        out, right = b.matrix[np.ix_(b.outer, b.outer)], b.right[b.outer]
        if len(b.inner):
            own, side = b.parts()
            x = np.linalg.solve(own, np.column_stack([side, b.right[b.inner]]))
            out, right = out - side.T @ x[:, :-1], right - side.T @ x[:, -1]
        u, v = np.nonzero(np.triu(out))
        ids, part, held = b.ids[b.outer], b.part[b.outer], b.held[b.outer]
        n, wanted = int(held.sum()), len(ids) if len(b.inner) else 0  # values that the inner ones will be found from
        none, more = pa.nulls(n, pa.int64()), pa.nulls(wanted, pa.int64())
        columns = (
            (pa.nulls(len(u) + n, pa.int64()), np.full(wanted, key[0].as_py())),
            (ids[u], ids[held], more),
            (ids[v], none, ids[:wanted]),
            (out[u, v], right[held], np.zeros(wanted)),
            (part[u], part[held], more),
            (part[v], none, more),
        )
        joined = [pa.chunked_array([pa.array(c, f.type) for c in cs], f.type) for cs, f in zip(columns, ROWS)]
        return pa.table(joined, schema=ROWS)

    return run


FOUND = pa.schema([("i", pa.int64()), ("v", pa.float64())])


def _found(width: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        b = _Block(key[0].as_py(), width, t)
        if not len(b.inner):
            return FOUND.empty_table()
        without = np.zeros(len(b.ids), bool)
        without[b.outer] = [k not in b.found for k in b.ids[b.outer].tolist()]
        b.inner = b.inner[~b.of(b.go[without[b.stay]])[b.inner]]
        own, side = b.parts()
        beside = np.array([b.found.get(k, 0.0) for k in b.ids[b.outer].tolist()])
        return pa.table([pa.array(b.ids[b.inner]), pa.array(np.linalg.solve(own, b.right[b.inner] - side @ beside))], schema=FOUND)

    return run


def _dealt(entries: DataFrame, width: int) -> DataFrame:
    """Each entry beside the blocks of its ends."""
    one, two = F.floor(F.col("p") / width), F.floor(F.coalesce("q", "p") / width)
    return entries.select(F.explode(F.array_distinct(F.array(one, two))).alias("block"), "i", "j", "a", "p", "q")


def solve(matrix: DataFrame, right: DataFrame, places: DataFrame, tolerance: float = 1e-8, max_iterations: int = 500, block: int = BLOCK, front: int = FRONT) -> tuple[DataFrame, bool]:
    """``(i, v)`` that the symmetric ``matrix(i, j, a)`` makes ``right(i, v)``, and whether it is exact or has converged.

    What hangs together without any row of ``right`` is left out, as that is what makes a component's values known.
    ``places(i, x, y)`` of all unknowns only bring neighbours together; ``matrix`` may have entries repeated.
    """
    spark, paths = matrix.sparkSession, []
    order = curve(cut(places))
    part = cut(dense_ids(order, ["z", "i"], "rank").select("i", F.floor(F.col("rank") / block).alias("p")))
    upper = matrix.where("i <= j").select("i", "j", "a")  # blocks add up what is repeated
    upper = upper.join(part, "i").join(part.select(F.col("i").alias("j"), F.col("p").alias("q")), "j").select("i", "j", "a", "p", "q")
    lone = right.join(part, "i").select("i", F.lit(None).cast("long").alias("j"), F.col("v").alias("a"), "p", F.lit(None).cast("long").alias("q"))
    entries, path = stored(upper.unionByName(lone))
    paths.append(path)
    size = part.agg(F.max("p").alias("p"), F.count("*").alias("n")).first()
    blocks, left, width, levels = (size.p or 0) + 1, size.n, 1, []
    exact, base = True, None
    while True:
        out, path = stored(_dealt(entries, width).groupBy("block").applyInArrow(_eliminated(width), "block long, i long, j long, a double, p long, q long"))
        paths.append(path)
        levels.append((entries, out.where("block is not null").select("block", "j"), width))
        rest = out.where("block is null").groupBy("i", "j").agg(F.sum("a").alias("a"), F.first("p").alias("p"), F.first("q").alias("q"))  # of an entry they are the same
        entries, path = stored(rest)
        paths.append(path)
        before, left = left, entries.where("i = j").count()
        if not left:
            break
        if left * 2 > front * blocks or left > 0.8 * before:  # borders too long for a task
            both = entries.where("j is not null").select("i", "j", "a")
            label = connected_components(both, "i", "j")
            alive = label.join(entries.where("j is null").select(F.col("i").alias("id")), "id", "left_semi").select("component").distinct()  # of components with a right side
            both = both.join(label.join(alive, "component", "left_semi").select(F.col("id").alias("i")), "i", "left_semi")
            both = cut(both.unionAll(both.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "a")))
            base, _, exact = multigrid.solve(both, entries.where("j is null").select("i", F.col("a").alias("v")), tolerance, max_iterations)
            break
        more = max(2, block * blocks // left)
        width, blocks = width * more, -(-blocks // more)
    found = base if base is not None else spark.createDataFrame([], "i long, v double")
    for entries, wanted, width in reversed(levels):
        beside = wanted.join(found.select(F.col("i").alias("j"), F.col("v").alias("a")), "j")
        none = F.lit(None).cast("long")
        rows = _dealt(entries, width).unionByName(beside.select("block", none.alias("i"), "j", "a", none.alias("p"), none.alias("q")))
        got = rows.groupBy("block").applyInArrow(_found(width), "i long, v double")
        found, path = stored(got.unionByName(found))
        paths.append(path)
    found = cut(found)
    for path in paths:
        remove(spark, path)
    return found, exact
