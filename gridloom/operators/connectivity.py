"""Connectivity tables: inversions and self-joins of the face and edge tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.mesh import Grid, Mesh, dense_ids, edge_pairs, face_nodes, sides
from gridloom.session import cut


def face_edges(mesh: Mesh) -> DataFrame:
    """``(face_id, pos, edge_id)`` in face order."""
    return sides(mesh).join(edge_pairs(mesh), ["a", "b"]).select("face_id", "pos", "edge_id")


def edge_faces(mesh: Mesh) -> DataFrame:
    """``(edge_id, a, b, f1, f2)``: lower face first, ``f2`` null at the boundary."""
    pair = sides(mesh).groupBy("a", "b").agg(F.min("face_id").alias("f1"), F.max("face_id").alias("f2"))
    return edge_pairs(mesh).join(pair, ["a", "b"]).select("edge_id", "a", "b", "f1", F.nullif("f2", "f1").alias("f2"))


def face_faces(mesh: Mesh) -> DataFrame:
    """``(src, dst, via)``: faces that share an edge, both ways."""
    inner = edge_faces(mesh).where("f2 is not null")
    return inner.select(F.inline(F.array(F.struct(F.col("f1").alias("src"), F.col("f2").alias("dst"), F.col("edge_id").alias("via")), F.struct(F.col("f2").alias("src"), F.col("f1").alias("dst"), F.col("edge_id").alias("via")))))


def face_pairs(mesh: Mesh) -> DataFrame:
    """``(src, dst)`` of ``face_faces``; edges that no table names get no numbers for it."""
    if mesh.edge_table is not None:
        return face_faces(mesh).select("src", "dst")
    pair = sides(mesh).groupBy("a", "b").agg(F.min("face_id").alias("f1"), F.max("face_id").alias("f2")).where("f1 < f2")
    return pair.select(F.inline(F.array(F.struct(F.col("f1").alias("src"), F.col("f2").alias("dst")), F.struct(F.col("f2").alias("src"), F.col("f1").alias("dst")))))


def node_faces(mesh: Mesh) -> DataFrame:
    """``(node_id, faces)`` ascending."""
    return face_nodes(mesh).groupBy("node_id").agg(F.array_sort(F.collect_set("face_id")).alias("faces"))


def edge_ends(edge: DataFrame) -> DataFrame:
    """``(edge_id, node_id)`` of both ends."""
    return edge.select("edge_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("node_id"))


def node_edges(edge: DataFrame) -> DataFrame:
    """``(node_id, edges)`` ascending."""
    return edge_ends(edge).groupBy("node_id").agg(F.array_sort(F.collect_list("edge_id")).alias("edges"))


def node_nodes(edge: DataFrame) -> DataFrame:
    """``(src, dst, via)``: both ways along each edge."""
    there = edge.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("edge_id").alias("via"))
    return there.unionAll(edge.select(F.col("b").alias("src"), F.col("a").alias("dst"), F.col("edge_id").alias("via")))


def directed_node_nodes(edge: DataFrame) -> DataFrame:
    """``(src, dst, via)``: along each edge from its first to its second node only."""
    return edge.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("edge_id").alias("via"))


def edge_edges(edge: DataFrame) -> DataFrame:
    """``(src, dst, via)``: edges that share node ``via``."""
    one, two = edge_ends(edge), edge_ends(edge)
    return one.select(F.col("edge_id").alias("src"), "node_id").join(two.select(F.col("edge_id").alias("dst"), "node_id"), "node_id").where("src <> dst").select("src", "dst", F.col("node_id").alias("via"))


def directed_edge_edges(edge: DataFrame) -> DataFrame:
    """``(src, dst, via)``: edges that touch the second node of ``src`` with either end."""
    out = edge.select(F.col("edge_id").alias("src"), F.col("b").alias("node_id"))
    return out.join(edge_ends(edge).withColumnRenamed("edge_id", "dst"), "node_id").where("src <> dst").select("src", "dst", F.col("node_id").alias("via"))


def boundary_edges(mesh: Mesh) -> DataFrame:
    """``(edge_id, a, b, face_id)`` of edges with one face."""
    return edge_faces(mesh).where("f2 is null").select("edge_id", "a", "b", F.col("f1").alias("face_id"))


def exterior_faces(mesh: Mesh) -> DataFrame:
    """Distinct ``face_id`` that have a boundary edge."""
    return boundary_edges(mesh).select("face_id").distinct()


def edge_validity(mesh: Mesh, edge: DataFrame) -> DataFrame:
    """``(edge_id, valid)``: the edge is a side of a face and the first of its pair."""
    known = sides(mesh).select("a", "b").distinct().withColumn("known", F.lit(True))
    pair = edge.select("edge_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = F.row_number().over(Window.partitionBy("a", "b").orderBy("edge_id")) == 1
    return pair.join(known, ["a", "b"], "left").select("edge_id", (F.col("known").isNotNull() & first).alias("valid"))


def adjacency_weights(adjacency: DataFrame, points: DataFrame) -> DataFrame:
    """Add ``weight``: the mean distance over the distance of the two ends; ``points(id, x, y)``."""
    one, two = (points.select(F.col("id").alias(k), F.col("x").alias(f"{k}_x"), F.col("y").alias(f"{k}_y")) for k in ("src", "dst"))
    d = adjacency.join(one, "src").join(two, "dst")
    dx, dy = F.col("src_x") - F.col("dst_x"), F.col("src_y") - F.col("dst_y")
    via = ["via"] if "via" in adjacency.columns else []
    d = d.select("src", "dst", *via, F.sqrt(dx * dx + dy * dy).alias("d"))
    return d.crossJoin(F.broadcast(d.agg(F.avg("d").alias("mean")))).select("src", "dst", *via, F.try_divide("mean", "d").alias("weight"))  # joined with one row


def neighbors(adjacency: DataFrame, cell: int) -> DataFrame:
    """``(dst)``: the neighbours of one cell."""
    return adjacency.where(F.col("src") == cell).select("dst")


def connectivity_matrix(grid: Grid, facet: str, xy_weights: bool = True) -> DataFrame:
    """``(src, dst, via, weight)`` of neighbouring nodes or faces; without ``xy_weights`` all weigh 1."""
    from gridloom.operators.geometry import facet_points

    if facet == "node":
        pairs = node_nodes(grid.edges)
    elif facet == "face" and isinstance(grid, Mesh):
        pairs = face_faces(grid)
    else:
        raise ValueError(f"no connectivity matrix of facet {facet}")
    return adjacency_weights(pairs, facet_points(grid, facet)) if xy_weights else pairs.withColumn("weight", F.lit(1.0))


def prior_edges(mesh: Mesh, edge: DataFrame) -> Mesh:
    """The mesh with edges in the order of ``edge(edge_id, a, b)``; other edges than those of its faces raise."""
    valid = edge_validity(mesh, edge)
    known = sides(mesh).select("a", "b").distinct().count()
    if edge.count() != known or valid.where("not valid").limit(1).count():
        raise ValueError("the edge table does not hold the edges of the faces, each once")
    return replace(mesh, edge_table=edge.select("edge_id", "a", "b"))


def inverted(table: DataFrame, key: str, member: str) -> DataFrame:
    """``(member, pos, key)`` from a table of ``(key, member)``: who holds each member, ascending."""
    pairs = table.select(key, member).distinct().groupBy(member).agg(F.sort_array(F.collect_list(key)).alias("of"))
    return pairs.select(member, F.posexplode("of").alias("pos", key))


def to_dense(table: DataFrame, key: str, member: str, n_columns: int | None = None, fill: int = -1) -> DataFrame:
    """``(key, members)``: members in the order of ``pos``, filled up to the widest row or to ``n_columns``.

    A row wider than ``n_columns`` raises when run.
    """
    rows = table.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", member))).alias("m")).select(key, F.col(f"m.{member}").alias("m"))
    if n_columns is None:
        n_columns = rows.agg(F.max(F.size("m"))).first()[0] or 0
    wide = F.concat("m", F.array_repeat(F.lit(fill).cast("long"), F.lit(n_columns) - F.size("m")))
    return rows.select(key, F.when(F.size("m") > n_columns, F.raise_error(F.lit("n_columns is too small")).cast("array<bigint>")).otherwise(wide).alias("members"))


def to_sparse(dense: DataFrame, key: str, member: str, fill: int = -1, start_index: int = 0) -> DataFrame:
    """``(key, pos, member)`` of the filled columns of ``(key, members)``; ids from 0.

    An id that is negative and not the fill value raises when run.
    """
    rows = dense.select(key, F.posexplode("members").alias("pos", member)).where(F.col(member).isNotNull() & (F.col(member) != fill))
    low = F.col(member) < start_index
    return rows.select(key, "pos", F.when(low, F.raise_error(F.lit("negative ids that are not the fill value")).cast("long")).otherwise(F.col(member) - start_index).alias(member))


def ragged_index(sizes: DataFrame, width: int) -> DataFrame:
    """``(*, mask)``: for ``sizes(..., n)`` a mask of ``width`` flags, the first ``n`` of them true."""
    return sizes.withColumn("mask", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: k < F.col("n")))


def reverse_orientation(mesh: Mesh) -> Mesh:
    """All faces with their nodes in reverse."""
    return replace(mesh, faces=mesh.faces.withColumn("nodes", F.reverse("nodes")))


def argsort_rows(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """``(key, rank)``: the place of each row in the lexicographic order of ``columns``, ties by ``key``."""
    return dense_ids(rows, [*columns, key], "rank").select(key, "rank")


def structured_connectivity(active: DataFrame) -> DataFrame:
    """``(src, dst)``: the four neighbours among active cells ``(iy, ix, active)``, cells numbered row by row."""
    cells = active.where("active").select("iy", "ix")
    cells = cells.join(dense_ids(cells, ["iy", "ix"], "id"), ["iy", "ix"])
    other = cells.select(F.col("iy").alias("jy"), F.col("ix").alias("jx"), F.col("id").alias("dst"))
    step = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)))))
    near = cells.withColumn("d", step).select(F.col("id").alias("src"), (F.col("iy") + F.col("d.dy")).alias("jy"), (F.col("ix") + F.col("d.dx")).alias("jx"))
    return near.join(other, ["jy", "jx"]).select("src", "dst")


def index_like(one: DataFrame, two: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """``(id, like)``: for each of ``two(id, x, y)`` the row of ``one`` at the same place.

    With a tolerance, coordinates are rounded to multiples of it for the comparison.  Places that are not
    the same set raise ``ValueError``.
    """
    snap = lambda c: F.round(F.col(c) / tolerance) if tolerance else F.col(c) + 0.0
    a = one.select(F.col("id").alias("like"), snap("x").alias("kx"), snap("y").alias("ky"))
    b = two.select("id", snap("x").alias("kx"), snap("y").alias("ky"))
    found = cut(b.join(a, ["kx", "ky"], "full").select("id", "like"))
    counts = found.agg(F.count("*").alias("n"), F.count_distinct("id").alias("b"), F.count_distinct("like").alias("a")).first()
    if not counts.n == counts.a == counts.b:
        raise ValueError("the coordinates are not identical within the tolerance")
    return found


def renumber(df: DataFrame, column: str) -> DataFrame:
    """Replace ids by their dense rank from 0."""
    ids = dense_ids(df.where(F.col(column).isNotNull()), [column], "_id")
    return df.join(ids, column, "left").drop(column).withColumnRenamed("_id", column)


def faces_subset(mesh: Mesh, keep: DataFrame) -> Mesh:
    """Mesh of the faces in ``keep(face_id)``: used nodes, edges and kept faces renumbered in ascending order."""
    from gridloom.operators.topology import subset

    return subset(mesh, keep.select("face_id").distinct())[0]
