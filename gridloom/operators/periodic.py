"""Meshes that are joined at their left and right ends, and back."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.mesh import Mesh, dense_ids
from gridloom.operators.topology import Index, LateEdges, node_bounds
from gridloom.session import cut


def _close(c: Column, value: float) -> Column:
    return F.abs(c - value) <= 1e-8 + 1e-5 * abs(value)


def _renamed(mesh: Mesh, mapping: DataFrame) -> DataFrame:
    """``(face_id, nodes)`` with nodes of ``mapping(node_id, new)``."""
    corner = mesh.faces.select("face_id", F.posexplode("nodes").alias("pos", "node_id")).join(mapping, "node_id")
    return corner.groupBy("face_id").agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("c")).select("face_id", F.col("c.new").alias("nodes"))


def to_periodic(mesh: Mesh) -> tuple[Mesh, Index]:
    """The nodes at the right end become those at the left with the same y; others keep their order.

    Edges that become the same are one, the first.  Ends whose y differ raise ``ValueError``.
    """
    xmin, _, xmax, _ = node_bounds(mesh)
    n = mesh.nodes.select("node_id", F.when(_close(F.col("x"), xmax), xmin).otherwise(F.col("x")).alias("x"), "y", _close(F.col("x"), xmin).alias("left"), _close(F.col("x"), xmax).alias("right"))
    ends = cut(n.where("left or right").select(F.round("y", 9).alias("y"), "left"))
    if ends.where("left").select("y").exceptAll(ends.where("not left").select("y")).limit(1).count() or ends.where("not left").select("y").exceptAll(ends.where("left").select("y")).limit(1).count():
        raise ValueError("the y-coordinates of the left and right boundaries do not match")
    first = n.groupBy("x", "y").agg(F.min("node_id").alias("first"))
    merged = cut(n.join(first, ["x", "y"]).select("node_id", "first"))
    kept = dense_ids(merged.select(F.col("first").alias("id")), ["id"], "new")
    mapping = merged.join(kept.withColumnRenamed("id", "first"), "first").select("node_id", "new")
    nodes = mesh.nodes.join(kept.withColumnRenamed("id", "node_id"), "node_id").select(F.col("new").alias("node_id"), F.when(_close(F.col("x"), xmax), xmin).otherwise(F.col("x")).alias("x"), "y")
    new = replace(mesh, nodes=nodes, faces=_renamed(mesh, mapping), edge_table=None)
    face = mesh.faces.select(F.col("face_id").alias("id"), F.col("face_id").alias("new"))

    def once() -> DataFrame:
        one, two = (mapping.select(F.col("node_id").alias(k), F.col("new").alias(f"n{k}")) for k in "ab")
        moved = mesh.edges.join(one, "a").join(two, "b").select("edge_id", F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
        return cut(moved.groupBy("a", "b").agg(F.min("edge_id").alias("id")))

    if mesh.edge_table is None:
        return new, LateEdges(lambda: dense_ids(once(), ["id"], "new"), node=kept, face=face)
    table = once()
    edge = dense_ids(table, ["id"], "new")
    return replace(new, edge_table=table.join(edge, "id").select(F.col("new").alias("edge_id"), "a", "b")), {"node": kept, "edge": edge, "face": face}


def to_nonperiodic(mesh: Mesh, xmax: float) -> tuple[Mesh, Index]:
    """Faces that reach from the right end back to the left get nodes of their own at ``xmax``.

    New nodes are numbered after the others by the node they stand for; a new edge has the data of the one
    between the nodes that it stands for.
    """
    points, cells = cut(mesh.nodes), cut(mesh.faces)
    left, _, right, _ = node_bounds(replace(mesh, nodes=points))
    corner = cells.select("face_id", F.posexplode("nodes").alias("pos", "node_id"))
    far = corner.join(points.select("node_id", "x"), "node_id").groupBy("face_id").agg(F.max("x").alias("far"), F.min("x").alias("near"))
    far = far.select("face_id", "far", (F.col("far") - F.col("near") > (right - left) / 2).alias("wide"))
    cells = cut(cells.join(far, "face_id"))
    wide = cells.where("wide").select("face_id", "far", F.posexplode("nodes").alias("pos", "node_id")).join(points, "node_id")  # only these get other nodes
    wide = cut(wide.select("face_id", "pos", "node_id", (F.col("far") - F.col("x") > (right - left) / 2).alias("back")))
    doubled = dense_ids(wide.where("back"), ["node_id"], "rank")
    count = points.count()
    doubled = cut(doubled.select("node_id", (F.col("rank") + count).alias("new")))
    placed = wide.join(doubled, "node_id", "left").select("face_id", "pos", F.when(F.col("back"), F.col("new")).otherwise(F.col("node_id")).alias("new"))
    faces = placed.groupBy("face_id").agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("c")).select("face_id", F.col("c.new").alias("nodes"))
    faces = cells.where("not wide").select("face_id", "nodes").unionByName(faces)
    added = doubled.join(points, "node_id").select(F.col("new").alias("node_id"), F.lit(float(xmax)).alias("x"), "y")
    new = replace(mesh, nodes=points.select("node_id", "x", "y").unionByName(added), faces=faces, edge_table=None)
    node = points.select(F.col("node_id").alias("id"), F.col("node_id").alias("new")).unionByName(doubled.select(F.col("node_id").alias("id"), "new"))
    face = mesh.faces.select(F.col("face_id").alias("id"), F.col("face_id").alias("new"))

    def edges() -> DataFrame:
        one, two = (node.select(F.col("new").alias(k), F.col("id").alias(f"o{k}")) for k in "ab")
        old = new.edges.join(one, "a").join(two, "b").select("edge_id", F.least("oa", "ob").alias("u"), F.greatest("oa", "ob").alias("v"))
        known = mesh.edges.select(F.col("edge_id").alias("id"), F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
        edge = cut(old.join(known, ["u", "v"], "left").select("id", F.col("edge_id").alias("new")))
        if edge.where("id is null").limit(1).count():
            raise ValueError("the new mesh has edges without a counterpart in the periodic one")
        return edge

    if mesh.edge_table is None:  # derived from the same faces, so that each has its counterpart
        return new, LateEdges(edges, node=node, face=face)
    return new, {"node": node, "edge": edges(), "face": face}
