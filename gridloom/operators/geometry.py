"""Face and edge geometry as projections over corner rings."""

from __future__ import annotations

from dataclasses import replace
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.mesh import Grid, Mesh, dense_ids, edges, fold_corners, rings


def with_geometry(mesh: Mesh) -> DataFrame:
    """``(face_id, ring, area, perimeter, cx, cy, xmin, ymin, xmax, ymax)``.

    Area by the shoelace rule relative to the first corner; centroids are area-weighted, the mean of the
    corners for triangles; a face without area has a null centroid.
    """
    corner = lambda k: F.try_element_at("ring", F.lit(k + 1))
    r = rings(mesh).select("face_id", "ring", F.size("ring").alias("n"), *(corner(k)[c].alias(f"{c}{k}") for k in range(4) for c in "xy"))
    at = [SimpleNamespace(x=F.col(f"x{k}"), y=F.col(f"y{k}")) for k in range(4)]
    o, zero = at[0], F.lit(0.0)

    def of(three: Column, four: Column, more: Column) -> Column:
        """Triangles and quads have plain columns: functions over arrays are interpreted, and take most of the time."""
        return F.when(F.col("n") == 3, three).when(F.col("n") == 4, four).otherwise(more)

    def folded(step) -> Column:
        return of(*(sum((step(at[k], at[(k + 1) % n]) for k in range(n)), zero) for n in (3, 4)), fold_corners(zero, step))

    cross = lambda p, q: (p.x - o.x) * (q.y - o.y) - (q.x - o.x) * (p.y - o.y)
    side = lambda p, q: F.sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))
    mx, my = (lambda p, q: (p.x + q.x - 2 * o.x) * cross(p, q)), (lambda p, q: (p.y + q.y - 2 * o.y) * cross(p, q))
    mean = lambda c: (zero + getattr(at[0], c) + getattr(at[1], c) + getattr(at[2], c)) / 3
    weighted = lambda m, c: getattr(o, c) + F.try_divide(folded(m), 3 * F.col("twice"))
    end = lambda f, g, c: F.when(F.col("n").isin(3, 4), f(*(getattr(p, c) for p in at))).otherwise(g(f"ring.{c}"))
    r = r.withColumn("twice", folded(cross))
    return r.select(
        "face_id", "ring", (F.abs("twice") / 2).alias("area"), folded(side).alias("perimeter"),
        F.when(F.col("n") == 3, mean("x")).otherwise(weighted(mx, "x")).alias("cx"),
        F.when(F.col("n") == 3, mean("y")).otherwise(weighted(my, "y")).alias("cy"),
        end(F.least, F.array_min, "x").alias("xmin"), end(F.least, F.array_min, "y").alias("ymin"), end(F.greatest, F.array_max, "x").alias("xmax"), end(F.greatest, F.array_max, "y").alias("ymax"),
    )


def circumcenters(mesh: Mesh) -> DataFrame:
    """``(face_id, x, y)`` of triangles; a mesh with other faces raises when run."""
    r = rings(mesh).withColumn("n", F.size("ring"))
    p = [F.get("ring", F.lit(k)) for k in range(3)]
    ax, ay, bx, by, cx, cy = (v[c] for v in p for c in ("x", "y"))
    d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
    sq = lambda x, y: x * x + y * y
    x = F.try_divide(sq(ax, ay) * (by - cy) + sq(bx, by) * (cy - ay) + sq(cx, cy) * (ay - by), d)
    y = F.try_divide(sq(ax, ay) * (cx - bx) + sq(bx, by) * (ax - cx) + sq(cx, cy) * (bx - ax), d)
    fail = F.raise_error(F.lit("circumcenters need triangles"))
    return r.select("face_id", F.when(F.col("n") == 3, x).otherwise(fail).alias("x"), F.when(F.col("n") == 3, y).alias("y"))


def counterclockwise(mesh: Mesh) -> Mesh:
    """Reverse the faces whose corners run clockwise."""
    turn = fold_corners(F.lit(0.0), lambda p, q: p.x * q.y - q.x * p.y)
    signs = rings(mesh).select("face_id", (turn < 0).alias("clockwise"))
    faces = mesh.faces.join(signs, "face_id").select("face_id", F.when(F.col("clockwise"), F.reverse("nodes")).otherwise(F.col("nodes")).alias("nodes"))
    return replace(mesh, faces=faces)


def edge_geometry(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(edge_id, a, b, ax, ay, bx, by, x, y, length)``: ends, midpoint and length."""
    one, two = (nodes.select(F.col("node_id").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y")) for k in "ab")
    e = edge.join(one, "a").join(two, "b")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    return e.select("edge_id", "a", "b", "ax", "ay", "bx", "by", ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"), F.sqrt(dx * dx + dy * dy).alias("length"))


def mesh_edge_geometry(mesh: Mesh) -> DataFrame:
    return edge_geometry(edges(mesh), mesh.nodes)


def edge_bounds(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(edge_id, xmin, ymin, xmax, ymax)``."""
    e = edge_geometry(edge, nodes)
    return e.select("edge_id", F.least("ax", "bx").alias("xmin"), F.least("ay", "by").alias("ymin"), F.greatest("ax", "bx").alias("xmax"), F.greatest("ay", "by").alias("ymax"))


def facet_points(grid: Grid, facet: str) -> DataFrame:
    """``(id, x, y)`` of a facet: nodes, edge midpoints or face centroids."""
    if facet == "node":
        return grid.nodes.select(F.col("node_id").alias("id"), "x", "y")
    if facet == "edge":
        return edge_geometry(grid.edges, grid.nodes).select(F.col("edge_id").alias("id"), "x", "y")
    if facet == "face" and isinstance(grid, Mesh):
        return with_geometry(grid).select(F.col("face_id").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    raise ValueError(f"{type(grid).__name__} has no facet {facet}")


def sizes(grid: Grid) -> DataFrame:
    """One row: ``n_node, n_edge`` and, of a mesh, ``n_face, n_max_node_per_face``."""
    rows = grid.nodes.agg(F.count("*").alias("n_node")).join(grid.edges.agg(F.count("*").alias("n_edge")))  # one row each
    if isinstance(grid, Mesh):
        rows = rows.join(grid.faces.agg(F.count("*").alias("n_face"), F.max(F.size("nodes")).alias("n_max_node_per_face")))
    return rows


def nodes_per_face(mesh: Mesh) -> DataFrame:
    """``(face_id, n)``."""
    return mesh.faces.select("face_id", F.size("nodes").alias("n"))


def bounds(nodes: DataFrame) -> DataFrame:
    """One row: ``xmin, ymin, xmax, ymax``."""
    return nodes.agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))


def triangles(mesh: Mesh) -> DataFrame:
    """``(face_id, part, n0, n1, n2)``: the fan of each face from its first node."""
    fan = F.transform(F.sequence(F.lit(1), F.size("nodes") - 2), lambda k: F.struct(F.get("nodes", F.lit(0)).alias("n0"), F.get("nodes", k).alias("n1"), F.get("nodes", k + 1).alias("n2")))
    return mesh.faces.where(F.size("nodes") >= 3).select("face_id", F.posexplode(fan).alias("part", "t")).select("face_id", "part", "t.*")


def triangulate(mesh: Mesh) -> tuple[Mesh, DataFrame]:
    """Mesh of the triangles, numbered by face and part, and ``(face_id, of)``: the face that each came from."""
    t = triangles(mesh)
    t = t.join(dense_ids(t, ["face_id", "part"], "new"), ["face_id", "part"])
    faces = t.select(F.col("new").alias("face_id"), F.array("n0", "n1", "n2").alias("nodes"))
    return replace(mesh, faces=faces, edge_table=None), t.select(F.col("new").alias("face_id"), F.col("face_id").alias("of"))


def wkt(mesh: Mesh) -> DataFrame:
    """``(face_id, wkt)`` polygons."""
    point = lambda p: F.concat_ws(" ", p.x.cast("string"), p.y.cast("string"))
    closed = F.concat("ring", F.slice("ring", 1, 1))
    return rings(mesh).select("face_id", F.concat(F.lit("POLYGON (("), F.array_join(F.transform(closed, point), ", "), F.lit("))")).alias("wkt"))
