"""Meshes and networks as tables, and builders for them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.session import cut, stored


@dataclass(frozen=True)
class Mesh:
    """A 2-D mesh: ``nodes(node_id, x, y)`` and ``faces(face_id, nodes)``, nodes counter-clockwise without fill.

    ``edge_table(edge_id, a, b)`` gives edges in an order of their own; else they are derived.  ``crs`` is a
    name such as ``EPSG:28992``; ``projected`` is None if unknown.
    """

    nodes: DataFrame
    faces: DataFrame
    edge_table: DataFrame | None = None
    name: str = "mesh2d"
    crs: str | None = None
    projected: bool | None = True

    @cached_property
    def edges(self) -> DataFrame:
        """``(edge_id, a, b)``, derived and written once for all that read it."""
        if self.edge_table is not None:
            return self.edge_table
        return cut(dense_ids(sides(self), ["a", "b"], "edge_id").select("edge_id", "a", "b"))


@dataclass(frozen=True)
class Network:
    """A 1-D network: ``nodes(node_id, x, y)`` and ``edges(edge_id, a, b)``."""

    nodes: DataFrame
    edges: DataFrame
    name: str = "network1d"
    crs: str | None = None
    projected: bool | None = True


Grid = Mesh | Network


def dense_ids(df: DataFrame, keys: list[str], name: str, unique: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """Distinct ``keys`` with their rank from 0 in lexicographic order.

    The keys are range-partitioned; a row's rank is its place in its partition plus the sizes of the
    partitions before, so nothing but one count a partition meets in one task.  Keys that are ``unique`` in a table
    that is written already are not made distinct first, and may have columns ``carried`` beside them.
    """
    order = (df.select(*keys, *carried) if unique else df.select(*keys).distinct()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    order, _ = stored(order.withColumn("_at", F.monotonically_increasing_id()))  # packed, as it stays to the end
    order = order.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = order.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return order.join(F.broadcast(sizes), "_part").select(*keys, *carried, (F.col("_before") + F.col("_at")).alias(name))


def structured(spark: SparkSession, nx: int, ny: int, dx: float = 1.0, dy: float = 1.0, x0: float = 0.0, y0: float = 0.0) -> Mesh:
    """Raster of ``nx * ny`` quads: faces and nodes row-major, corners from lower left counter-clockwise."""
    ids = lambda n: spark.range(n)
    wide = nx + 1
    nodes = ids(wide * (ny + 1)).select(F.col("id").alias("node_id"), (x0 + (F.col("id") % wide) * dx).alias("x"), (y0 + F.floor(F.col("id") / wide) * dy).alias("y"))
    low = F.floor(F.col("id") / nx) * wide + F.col("id") % nx
    faces = ids(nx * ny).select(F.col("id").alias("face_id"), F.array(low, low + 1, low + wide + 1, low + wide).alias("nodes"))
    return Mesh(nodes, faces)


def from_breaks(spark: SparkSession, xs: list[float], ys: list[float]) -> Mesh:
    """Rectilinear quads between breaks, corners from lower left counter-clockwise whatever way the breaks run."""
    mesh, wide = structured(spark, len(xs) - 1, len(ys) - 1), len(xs)
    x, y = (spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], f"{c}k long, {c} double") for c, values in (("x", xs), ("y", ys)))
    nodes = mesh.nodes.select("node_id", (F.col("node_id") % wide).alias("xk"), F.floor(F.col("node_id") / wide).alias("yk"))
    nodes = nodes.join(F.broadcast(x), "xk").join(F.broadcast(y), "yk").select("node_id", "x", "y")  # the breaks came from the driver
    return Mesh(nodes, lower_left_first(mesh.faces, xs[-1] < xs[0], ys[-1] < ys[0]))


def lower_left_first(faces: DataFrame, x_falls: bool, y_falls: bool) -> DataFrame:
    """Quads of rising breaks turned for falling ones, so that corners start lower left and run counter-clockwise."""
    order = [0, 1, 2, 3]
    if x_falls:
        order = [order[k] for k in (1, 0, 3, 2)]
    if y_falls:
        order = [order[k] for k in (3, 2, 1, 0)]
    return faces.withColumn("nodes", F.array(*(F.get("nodes", F.lit(k)) for k in order)))


def split_even_quads(mesh: Mesh) -> Mesh:
    """Mixed mesh: quads of even id become two triangles; face ``2 q`` and, for the second triangle, ``2 q + 1``."""
    q, n = F.col("face_id"), lambda k: F.get("nodes", F.lit(k))
    odd = mesh.faces.where(q % 2 == 1).select((2 * q).alias("face_id"), "nodes")
    even = mesh.faces.where(q % 2 == 0).select(F.posexplode(F.array(F.array(n(0), n(1), n(2)), F.array(n(0), n(2), n(3)))).alias("p", "nodes"), q)
    return Mesh(mesh.nodes, odd.unionByName(even.select((2 * q + F.col("p")).alias("face_id"), "nodes")))


def from_polygons(polygons: DataFrame) -> Mesh:
    """Mesh of rings ``(face_id, ring: array<struct<x, y>>)``: closing vertices dropped, node ids by rank of (x, y)."""
    ring = F.when(F.get("ring", F.lit(0)) == F.element_at("ring", -1), F.slice("ring", 1, F.size("ring") - 1)).otherwise(F.col("ring"))
    corners = polygons.select("face_id", F.posexplode(ring).alias("pos", "v")).select("face_id", "pos", "v.x", "v.y")
    nodes = dense_ids(corners, ["x", "y"], "node_id")
    placed = corners.join(nodes, ["x", "y"]).groupBy("face_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id"))).alias("c"))
    return Mesh(nodes.select("node_id", "x", "y"), placed.select("face_id", F.col("c.node_id").alias("nodes")))


def from_lines(lines: DataFrame) -> Network:
    """Network of polylines ``(line_id, pos, x, y)``: consecutive vertices are edges, node ids by rank of (x, y)."""
    nodes = dense_ids(lines, ["x", "y"], "node_id")
    along = Window.partitionBy("line_id").orderBy("pos")
    parts = lines.join(nodes, ["x", "y"]).withColumn("b", F.lead("node_id").over(along)).where("b is not null")
    ids = dense_ids(parts, ["line_id", "pos"], "edge_id")
    return Network(nodes.select("node_id", "x", "y"), parts.join(ids, ["line_id", "pos"]).select("edge_id", F.col("node_id").alias("a"), "b"))


def face_nodes(mesh: Mesh) -> DataFrame:
    """``(face_id, pos, node_id)``."""
    return mesh.faces.select("face_id", F.posexplode("nodes").alias("pos", "node_id"))


def sides(mesh: Mesh, *carried: str) -> DataFrame:
    """``(face_id, *carried, pos, a, b)``: the sides of each face, ``a < b``; sides from a node to itself are dropped."""
    after = F.get("nodes", (F.col("pos") + 1) % F.size("nodes"))
    s = mesh.faces.select("face_id", *carried, "nodes", F.posexplode("nodes").alias("pos", "p")).withColumn("q", after)
    return s.where("p <> q").select("face_id", *carried, "pos", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def edges(mesh: Mesh) -> DataFrame:
    """``(edge_id, a, b)``: rank of the sorted node pair, or the mesh's own table."""
    return mesh.edges


def edge_pairs(mesh: Mesh) -> DataFrame:
    """``(edge_id, a, b)`` with ``a < b``, whichever way the mesh's own table has them."""
    return mesh.edges.select("edge_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def fold_corners(start: Column, step) -> Column:
    """Sum of ``step(corner, next corner)`` over the closed ring in column ``ring``."""
    pairs = F.zip_with("ring", F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1)), lambda p, q: step(p, q))
    return F.aggregate(pairs, start, lambda acc, v: acc + v)


def rings(mesh: Mesh) -> DataFrame:
    """``(face_id, ring)``: corner coordinates of each face in order."""
    placed = face_nodes(mesh).join(mesh.nodes, "node_id").groupBy("face_id")
    return placed.agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("c")).select("face_id", F.transform("c", lambda c: F.struct(c.x.alias("x"), c.y.alias("y"))).alias("ring"))
