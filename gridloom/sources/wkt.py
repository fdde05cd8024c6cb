"""Well-known text of points, lines and polygons, to vertices and back, with string functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.geometry import edge_geometry, wkt
from gridloom.operators.mesh import Grid, Mesh, Network, from_lines, from_polygons
from gridloom.session import stored

XY = "array<struct<x:double,y:double>>"


def kind(text: Column) -> Column:
    """``POINT``, ``LINESTRING``, ``LINEARRING`` or ``POLYGON``; others raise when run."""
    found = F.upper(F.regexp_extract(text, r"^\s*([A-Za-z]+)", 1))
    known = found.isin("POINT", "LINESTRING", "LINEARRING", "POLYGON")
    return F.when(known, found).otherwise(F.raise_error(F.concat(F.lit("unsupported geometry: "), F.coalesce(text, F.lit("null")))))


def _vertices(part: Column) -> Column:
    words = F.transform(F.split(part, ","), lambda p: F.split(F.trim(p), r"\s+"))
    return F.transform(words, lambda w: F.struct(F.get(w, F.lit(0)).cast("double").alias("x"), F.get(w, F.lit(1)).cast("double").alias("y")))


def rings(text: Column) -> Column:
    """Vertices of each part: one part for points and lines, the outer ring and the holes of a polygon."""
    parts = F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), 1)
    return F.transform(parts, _vertices)


def points_to_nodes(geometry: DataFrame) -> DataFrame:
    """``(id, x, y)`` of ``geometry(id, wkt)`` points."""
    p = F.get(F.get(rings(F.col("wkt")), F.lit(0)), F.lit(0))
    return geometry.select("id", p.x.alias("x"), p.y.alias("y"))


def nodes_to_points(nodes: DataFrame) -> DataFrame:
    """``(node_id, wkt)``."""
    return nodes.select("node_id", F.format_string("POINT (%s %s)", F.col("x").cast("string"), F.col("y").cast("string")).alias("wkt"))


def edges_to_lines(grid: Grid) -> DataFrame:
    """``(edge_id, wkt)``."""
    e = edge_geometry(grid.edges, grid.nodes)
    return e.select("edge_id", F.format_string("LINESTRING (%s %s, %s %s)", *(F.col(c).cast("string") for c in ("ax", "ay", "bx", "by"))).alias("wkt"))


def to_wkt(grid: Grid, facet: str) -> DataFrame:
    """``(id, wkt)`` of a facet: points, lines or polygons."""
    if facet == "node":
        table = nodes_to_points(grid.nodes)
    elif facet == "edge":
        table = edges_to_lines(grid)
    elif facet == "face" and isinstance(grid, Mesh):
        table = wkt(grid)
    else:
        raise ValueError(f"{type(grid).__name__} has no facet {facet}")
    return table.withColumnRenamed(f"{facet}_id", "id")


def grid_from_wkt(geometry: DataFrame) -> Mesh | Network:
    """Mesh of polygons, or network of lines, from ``geometry(id, wkt)`` of one kind; other or mixed kinds raise ``ValueError``."""
    known = F.upper(F.regexp_extract("wkt", r"^\s*([A-Za-z]+)", 1))
    parts, _ = stored(geometry.select("id", known.alias("kind"), F.when(known.isin("POLYGON", "LINESTRING"), F.get(rings(F.col("wkt")), F.lit(0))).alias("part")))  # texts are made and read once
    kinds = sorted(r[0] for r in parts.select("kind").distinct().limit(5).collect())
    if kinds == ["POLYGON"]:
        return from_polygons(parts.select(F.col("id").alias("face_id"), F.col("part").alias("ring")))
    if kinds == ["LINESTRING"]:
        vertices = parts.select(F.col("id").alias("line_id"), F.posexplode("part").alias("pos", "v"))
        return from_lines(vertices.select("line_id", "pos", "v.x", "v.y"))
    raise ValueError(f"expected polygons or lines of one kind, not {kinds}")


def segments(geometry: DataFrame) -> DataFrame:
    """``(line_id, pos, x0, y0, x1, y1)`` of ``geometry(id, wkt)`` lines or rings; other kinds raise when run."""
    line = kind(F.col("wkt"))
    only = F.when(line.isin("LINESTRING", "LINEARRING"), F.get(rings(F.col("wkt")), F.lit(0))).otherwise(F.raise_error(F.lit("only lines can be snapped")).cast(XY))
    part = F.arrays_zip(F.slice(F.col("v"), 1, F.size("v") - 1).alias("a"), F.slice(F.col("v"), 2, F.size("v") - 1).alias("b"))
    rows = geometry.select(F.col("id").alias("line_id"), only.alias("v")).select("line_id", F.posexplode(part).alias("pos", "s"))
    return rows.select("line_id", "pos", F.col("s.a.x").alias("x0"), F.col("s.a.y").alias("y0"), F.col("s.b.x").alias("x1"), F.col("s.b.y").alias("y1"))


def burnable(geometry: DataFrame, value: str | None = None) -> dict[str, DataFrame]:
    """Tables of ``geometry(row, wkt, ...)`` to burn: polygons, lines and points, with the column ``value`` or 1."""
    rows = geometry.select("row", (F.col(value).cast("double") if value else F.lit(1.0)).alias("value"), kind(F.col("wkt")).alias("kind"), rings(F.col("wkt")).alias("r"))
    first = F.get("r", F.lit(0))
    lines = rows.where("kind in ('LINESTRING', 'LINEARRING')").select("row", "value", first.alias("v"))
    part = F.arrays_zip(F.slice(F.col("v"), 1, F.size("v") - 1).alias("a"), F.slice(F.col("v"), 2, F.size("v") - 1).alias("b"))
    lines = lines.select("row", "value", F.posexplode(part).alias("pos", "s"))
    return {
        "polygons": rows.where("kind = 'POLYGON'").select("row", "value", first.alias("ring"), F.slice("r", 2, F.greatest(F.lit(0), F.size("r") - 1)).alias("holes")),
        "lines": lines.select("row", "value", "pos", F.col("s.a.x").alias("x0"), F.col("s.a.y").alias("y0"), F.col("s.b.x").alias("x1"), F.col("s.b.y").alias("y1")),
        "points": rows.where("kind = 'POINT'").select("row", "value", F.get(first, F.lit(0)).x.alias("x"), F.get(first, F.lit(0)).y.alias("y")),
    }
