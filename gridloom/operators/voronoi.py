"""Voronoi tessellation of a mesh: a cell around each node, its corners the centroids of the node's faces.

A cell at the exterior also gets the projections of its faces' centroids on the exterior edges, and the node
itself or, where that would make the cell concave, the midpoint between its two projections.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.connectivity import boundary_edges
from gridloom.operators.geometry import circumcenters, facet_points, triangulate
from gridloom.operators.mesh import Mesh, dense_ids, sides
from gridloom.session import cut, stored

CLOSE = 1e-16


@dataclass(frozen=True)
class Voronoi:
    """``vertices(vertex_id, x, y, face_id)``, ``cells(cell_id, node_id, corners)`` and ``between(vertex_id, first, second)``.

    ``face_id`` is the face whose centroid a vertex is or comes from, null for those of exterior nodes;
    ``between`` names for these the two projections beside them.
    """

    vertices: DataFrame
    cells: DataFrame
    between: DataFrame | None = None


def _area(ring: Column) -> Column:
    """Area of a ring of structs with x and y."""
    o = F.get(ring, F.lit(0))
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    parts = F.zip_with(ring, after, lambda p, q: (p.x - o.x) * (q.y - o.y) - (q.x - o.x) * (p.y - o.y))
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)) / 2


def _around(corner: DataFrame, center: DataFrame) -> DataFrame:
    """``(node_id, ring)``: corners ``(node_id, key, x, y)`` counter-clockwise around ``center(node_id, ox, oy)``."""
    turned = corner.join(center, "node_id").withColumn("turn", F.atan2(F.col("y") - F.col("oy"), F.col("x") - F.col("ox")))
    return turned.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("turn", "key", "x", "y"))).alias("ring"))  # a node's own faces


def tessellation(mesh: Mesh, centroids: DataFrame | None = None, add_exterior: bool = False, add_vertices: bool = False, skip_concave: bool = False) -> Voronoi:
    """Cells around the nodes from ``centroids(face_id, x, y)``, by default those of the faces.

    Without ``add_exterior`` a cell needs three faces and has only centroids as corners.  With it, interior
    nodes come first, exterior ones after them; ``add_vertices`` adds the exterior nodes as corners, and
    ``skip_concave`` only those that do not make their cell smaller.
    """
    if add_vertices and not add_exterior:
        raise ValueError("add_vertices needs add_exterior")
    mesh = replace(mesh, nodes=cut(mesh.nodes), faces=cut(mesh.faces))  # these and the centroids are read several times
    points = centroids if centroids is not None else facet_points(mesh, "face").withColumnRenamed("id", "face_id")
    points = cut(points.select("face_id", "x", "y"))
    own = mesh.nodes.select("node_id", F.col("x").alias("ox"), F.col("y").alias("oy"))
    at_nodes = lambda placed, *c: mesh.faces.join(placed, "face_id").select(F.explode(F.array_distinct("nodes")).alias("node_id"), *c, "x", "y")  # noqa: E731  faces are moved, not their corners
    if not add_exterior:
        corner = at_nodes(points, F.struct(F.lit(0).alias("kind"), F.col("face_id").alias("at")).alias("key"))
        rings = _around(corner, own).where(F.size("ring") >= 3)
        rings = cut(rings.select("node_id", "ring", F.lit(0).alias("late")))
        inside = rings.select(F.explode("ring").alias("c")).select("c.key").distinct()
        vertices = points.select(F.struct(F.lit(0).alias("kind"), F.col("face_id").alias("at")).alias("key"), "x", "y", "face_id").join(inside, "key", "left_semi")
        return _numbered(rings, vertices)
    # exterior edges, and where the centroid of their face falls on them
    one, two = (mesh.nodes.select(F.col("node_id").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y")) for k in "ab")
    border = _border(mesh).join(one, "a").join(two, "b").join(points, "face_id")
    vx, vy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    t = F.try_divide((F.col("x") - F.col("ax")) * vx + (F.col("y") - F.col("ay")) * vy, vx * vx + vy * vy)
    border = border.withColumns({"px": F.col("ax") + t * vx, "py": F.col("ay") + t * vy})
    apart = F.sqrt((F.col("px") - F.col("x")) ** 2 + (F.col("py") - F.col("y")) ** 2) > CLOSE
    # a projection that falls on its centroid is that centroid
    key = F.when(apart, F.struct(F.lit(1).alias("kind"), F.col("edge_id").alias("at"))).otherwise(F.struct(F.lit(0).alias("kind"), F.col("face_id").alias("at")))
    border = cut(border.select("edge_id", "face_id", "a", "b", "px", "py", key.alias("key")))
    ends = border.select("edge_id", "key", "px", "py", F.explode(F.array("a", "b")).alias("node_id"))
    exterior = ends.select("node_id").distinct()
    more = ends.where("key.kind = 1").select("node_id", "key", F.col("px").alias("x"), F.col("py").alias("y"))
    vertices = points.select(F.struct(F.lit(0).alias("kind"), F.col("face_id").alias("at")).alias("key"), "x", "y", "face_id")
    vertices = vertices.unionByName(border.where("key.kind = 1").select("key", F.col("px").alias("x"), F.col("py").alias("y"), "face_id"))
    between = None
    if add_vertices:  # the midpoint of a node's two projections stands for the node until the corners are in order
        place = F.row_number().over(Window.partitionBy("node_id").orderBy("edge_id")) - 1
        both = ends.withColumn("pair", F.floor(place / 2).cast("int")).groupBy("node_id", "pair").agg(F.sort_array(F.collect_list(F.struct("edge_id", "key", "px", "py"))).alias("p")).where(F.size("p") == 2)
        p, q = F.get("p", F.lit(0)), F.get("p", F.lit(1))
        middle = F.struct(F.lit(2).alias("kind"), (F.col("node_id") * 8 + F.col("pair")).alias("at"))
        both = cut(both.select("node_id", middle.alias("key"), ((p.px + q.px) / 2).alias("x"), ((p.py + q.py) / 2).alias("y"), p.key.alias("first"), q.key.alias("second")))
        between = both.select("key", "first", "second")
        more = more.unionByName(both.select("node_id", "key", "x", "y"))
        vertices = vertices.unionByName(both.join(own, "node_id").select("key", F.col("ox").alias("x"), F.col("oy").alias("y"), F.lit(None).cast("long").alias("face_id")))
    # numbers are given to vertices before these are dealt to the cells, which have several times as many corners
    flat = vertices.select(F.col("key.kind").alias("kind"), F.col("key.at").alias("at"), "x", "y", "face_id")
    vertex, _ = stored(flat.join(dense_ids(flat, ["kind", "at"], "vertex_id", unique=True), ["kind", "at"]))
    corner = at_nodes(vertex.where("kind = 0").select("face_id", "kind", "vertex_id", "x", "y"), "kind", "vertex_id")
    late = vertex.where("kind > 0").select("kind", "at", "vertex_id")
    more = more.select("node_id", F.col("key.kind").alias("kind"), F.col("key.at").alias("at"), "x", "y").join(late, ["kind", "at"])
    corner = corner.unionByName(more.select("node_id", "kind", "vertex_id", "x", "y"))
    # corners in order around the node or, of exterior ones, around the mean of the corners
    cell = corner.groupBy("node_id").agg(F.collect_list(F.struct("kind", "vertex_id", "x", "y")).alias("c"))  # a node's own faces
    cell = cell.join(own, "node_id").join(exterior.withColumn("late", F.lit(1)), "node_id", "left").withColumn("late", F.coalesce("late", F.lit(0)))
    center = lambda c, known: F.when(F.col("late") == 1, F.aggregate("c", F.lit(0.0), lambda a, v: a + v[c]) / F.size("c")).otherwise(F.col(known))
    turned = F.transform("c", lambda v: F.struct(F.atan2(v.y - F.col("cy"), v.x - F.col("cx")).alias("turn"), v.kind.alias("kind"), v.vertex_id.alias("vertex_id"), v.x.alias("x"), v.y.alias("y")))
    cell = cell.withColumns({"cx": center("x", "ox"), "cy": center("y", "oy")}).withColumn("ring", F.array_sort(turned))
    named = ["node_id", "late", F.col("ring.vertex_id").alias("corners")]
    if add_vertices and skip_concave:  # keep the midpoints of the cells that the nodes would make smaller
        cell, _ = stored(cell.select(*named, "ox", "oy", "ring"))
        real = F.transform("ring", lambda c: F.struct(F.when(c.kind == 2, F.col("ox")).otherwise(c.x).alias("x"), F.when(c.kind == 2, F.col("oy")).otherwise(c.y).alias("y")))
        smaller = cell.where("late = 1").where(_area(real) < _area(F.col("ring"))).select(F.explode("ring").alias("c")).where("c.kind = 2").select("c.vertex_id", F.col("c.x").alias("mx"), F.col("c.y").alias("my"))
        vertex = vertex.join(smaller, "vertex_id", "left").select("vertex_id", "kind", "at", F.coalesce("mx", "x").alias("x"), F.coalesce("my", "y").alias("y"), "face_id")
    else:
        cell, _ = stored(cell.select(*named))
    cells = cell.join(dense_ids(cell, ["late", "node_id"], "cell_id", unique=True), ["late", "node_id"]).select("cell_id", "node_id", "corners")
    if between is not None:
        named = lambda c, to: vertex.select(F.struct("kind", "at").alias(c), F.col("vertex_id").alias(to))
        between = between.join(named("key", "vertex_id"), "key").join(named("first", "p"), "first").join(named("second", "q"), "second").select("vertex_id", F.col("p").alias("first"), F.col("q").alias("second"))
    return Voronoi(vertex.select("vertex_id", "x", "y", "face_id"), cells, between)


def _border(mesh: Mesh) -> DataFrame:
    """``(edge_id, a, b, face_id)`` of edges with one face; where no table names edges only these are numbered."""
    if mesh.edge_table is not None:
        return boundary_edges(mesh)
    ends = cut(sides(mesh).groupBy("a", "b").agg(F.min("face_id").alias("face_id"), F.max("face_id").alias("other")).where("face_id = other").drop("other"))
    return ends.join(dense_ids(ends, ["a", "b"], "edge_id", unique=True), ["a", "b"]).select("edge_id", "a", "b", "face_id")


def _numbered(rings: DataFrame, vertices: DataFrame) -> Voronoi:
    """Vertices numbered by kind and origin, cells by ``late`` and node."""
    flat = vertices.select(F.col("key.kind").alias("kind"), F.col("key.at").alias("at"), "x", "y", "face_id")
    ids = dense_ids(flat, ["kind", "at"], "vertex_id")
    vertex = flat.join(ids, ["kind", "at"])
    cell = dense_ids(rings, ["late", "node_id"], "cell_id")
    corner = rings.select("node_id", F.posexplode("ring").alias("pos", "c")).select("node_id", "pos", F.col("c.key.kind").alias("kind"), F.col("c.key.at").alias("at")).join(ids, ["kind", "at"])
    corner = corner.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("pos", "vertex_id"))).alias("c"))
    cells = corner.join(cell, "node_id").select("cell_id", "node_id", F.col("c.vertex_id").alias("corners"))
    return Voronoi(vertex.select("vertex_id", "x", "y", "face_id"), cells, None)


def voronoi_topology(mesh: Mesh) -> Voronoi:
    """Cells with the exterior, without the exterior nodes."""
    return tessellation(mesh, add_exterior=True)


def as_mesh(mesh: Mesh, v: Voronoi) -> Mesh:
    """The cells as faces."""
    return replace(mesh, nodes=v.vertices.select(F.col("vertex_id").alias("node_id"), "x", "y"), faces=v.cells.select(F.col("cell_id").alias("face_id"), F.col("corners").alias("nodes")), edge_table=None)


def centroid_triangulation(mesh: Mesh) -> tuple[Mesh, DataFrame]:
    """Triangles between the centroids, and ``(node_id, of)``: the face of each triangle corner."""
    v = voronoi_topology(mesh)
    return triangulate(as_mesh(mesh, v))[0], v.vertices.select(F.col("vertex_id").alias("node_id"), F.col("face_id").alias("of"))


def tesselate_centroidal_voronoi(mesh: Mesh, add_exterior: bool = True, add_vertices: bool = True, skip_concave: bool = False) -> Mesh:
    return as_mesh(mesh, tessellation(mesh, None, add_exterior, add_vertices, skip_concave))


def tesselate_circumcenter_voronoi(mesh: Mesh, add_exterior: bool = True, add_vertices: bool = True, skip_concave: bool = False) -> Mesh:
    """As above around the circumcenters, of a mesh of triangles."""
    mesh = replace(mesh, faces=cut(mesh.faces))
    return as_mesh(mesh, tessellation(mesh, circumcenters(mesh), add_exterior, add_vertices, skip_concave))
