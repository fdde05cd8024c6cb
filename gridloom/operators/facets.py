"""Values between facets, and constants on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.connectivity import edge_faces, face_edges
from gridloom.operators.mesh import Grid, Mesh, face_nodes


def links(mesh: Grid, source: str, target: str) -> DataFrame:
    """``(target_id, pos, source_id)`` of two different facets of node, edge and face."""
    if source == target:
        raise ValueError("source and target facets are the same")
    pair = {source, target}
    if "face" in pair and not isinstance(mesh, Mesh):
        raise ValueError("a network has no faces")
    if pair == {"face", "node"}:
        t = face_nodes(mesh).select("face_id", "pos", "node_id")
    elif pair == {"face", "edge"}:
        t = face_edges(mesh)
    elif pair == {"edge", "node"}:
        t = mesh.edges.select("edge_id", F.posexplode(F.array("a", "b")).alias("pos", "node_id"))
    else:
        raise ValueError(f"unknown facets {source}, {target}")
    return t.select(F.col(f"{target}_id").alias("target_id"), "pos", F.col(f"{source}_id").alias("source_id"))


def to_facet(mesh: Grid, data: DataFrame, source: str, target: str, dims: tuple[str, ...] = ()) -> DataFrame:
    """``(target_id, *dims, source_id, value)``: the values around each target, for the caller to reduce."""
    if not dims:
        return links(mesh, source, target).join(data.select(F.col("id").alias("source_id"), "value"), "source_id", "left").select("target_id", "source_id", "value")
    return links(mesh, source, target).join(data.select(F.col("id").alias("source_id"), *dims, "value"), "source_id").select("target_id", *dims, "source_id", "value")


def mean_on(mesh: Mesh, data: DataFrame, source: str, target: str) -> DataFrame:
    """``(target_id, value)``: mean of the values around each target, nulls left out."""
    return to_facet(mesh, data, source, target).groupBy("target_id").agg(F.avg("value").alias("value"))


def full_like(data: DataFrame, value: float) -> DataFrame:
    """The ids and dimensions of ``data`` with one value."""
    return data.withColumn("value", F.lit(float(value)))


def edge_contrast(mesh: Mesh, data: DataFrame) -> DataFrame:
    """``(edge_id, value)``: difference of the two faces of inner edges."""
    one, two = (data.select(F.col("id").alias(k), F.col("value").alias(f"v_{k}")) for k in ("f1", "f2"))
    return edge_faces(mesh).join(one, "f1").join(two, "f2").select("edge_id", (F.col("v_f2") - F.col("v_f1")).alias("value"))
