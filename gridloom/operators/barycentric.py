"""Barycentric weights of points in convex faces, and interpolation between face centroids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.geometry import facet_points
from gridloom.operators.mesh import Mesh, rings
from gridloom.operators.select import locate_points
from gridloom.operators.voronoi import Voronoi, as_mesh, tessellation


def _weights(ring: Column, x: Column, y: Column) -> Column:
    """Wachspress weights of a point in a convex ring, without division, so that points on sides and corners have them too."""
    n = F.size(ring)
    at = lambda k: F.get(ring, F.pmod(k, n))
    turn = lambda p, q, u, v: (q.x - p.x) * (v - p.y) - (q.y - p.y) * (u - p.x)
    steps = F.sequence(F.lit(0), n - 1)
    side = F.transform(steps, lambda k: turn(at(k), at(k + 1), x, y))

    def weight(k: Column) -> Column:
        others = F.aggregate(steps, F.lit(1.0), lambda acc, j: F.when((j == k) | (j == F.pmod(k - 1, n)), acc).otherwise(acc * F.get(side, j)))
        return turn(at(k - 1), at(k), at(k + 1).x, at(k + 1).y) * others

    return F.transform(steps, weight)


def compute_barycentric_weights(mesh: Mesh, points: DataFrame, tolerance: float | None = None) -> DataFrame:
    """``(point_id, face_id, pos, node_id, weight)``: the face that holds a point and the weights of its nodes.

    Weights add up to 1: barycentric in triangles, bilinear in rectangles.  Points outside have no rows.
    """
    at = points.join(locate_points(mesh, points, tolerance).where("face_id is not null"), "point_id").join(rings(mesh), "face_id").join(mesh.faces, "face_id")
    at = at.withColumn("w", _weights(F.col("ring"), F.col("x"), F.col("y")))
    total = F.aggregate("w", F.lit(0.0), lambda a, v: a + v)
    at = at.select("point_id", "face_id", F.posexplode(F.zip_with("nodes", "w", lambda n, w: F.struct(n.alias("node_id"), F.try_divide(w, total).alias("weight")))).alias("pos", "p"))
    return at.select("point_id", "face_id", "pos", "p.node_id", "p.weight")


def _shared_out(weights: DataFrame, v: Voronoi) -> DataFrame:
    """Weights of vertices between two projections are given to those, the more the nearer one is."""
    place = v.vertices.select("vertex_id", "x", "y")
    named = lambda k: place.select(F.col("vertex_id").alias(k), F.col("x").alias(f"{k}_x"), F.col("y").alias(f"{k}_y"))
    mid = v.between.join(place, "vertex_id").join(named("first"), "first").join(named("second"), "second")
    away = lambda k: F.sqrt((F.col(f"{k}_x") - F.col("x")) ** 2 + (F.col(f"{k}_y") - F.col("y")) ** 2)
    part = lambda other: F.coalesce(F.try_divide(away(other), away("first") + away("second")), F.lit(0.5))
    to = F.array(F.struct(F.col("first").alias("to"), part("second").alias("part")), F.struct(F.col("second").alias("to"), part("first").alias("part")))
    mid = mid.select("vertex_id", to.alias("to"))
    kept = F.coalesce("to", F.array(F.struct(F.col("vertex_id").alias("to"), F.lit(1.0).alias("part"))))
    return weights.join(mid, "vertex_id", "left").select("point_id", F.col("weight").alias("whole"), F.inline(kept)).select("point_id", F.col("to").alias("vertex_id"), (F.col("whole") * F.col("part")).alias("weight"))


def barycentric_weights(source: Mesh, target: Mesh, tolerance: float | None = None) -> DataFrame:
    """``(target_id, source_id, weight)``: target centroids between the centroids of the source faces around them.

    Target centroids outside of the source have no rows; a source face that stands for several corners has
    their weights together.
    """
    v = tessellation(source, add_exterior=True, add_vertices=True, skip_concave=True)
    points = facet_points(target, "face").withColumnRenamed("id", "point_id")
    held = points.join(locate_points(source, points).where("face_id is not null").select("point_id"), "point_id", "left_semi")
    weights = compute_barycentric_weights(as_mesh(source, v), held, tolerance).where("weight > 0").select("point_id", F.col("node_id").alias("vertex_id"), "weight")
    found = _shared_out(weights, v).join(v.vertices.select("vertex_id", "face_id"), "vertex_id")
    return found.groupBy(F.col("point_id").alias("target_id"), F.col("face_id").alias("source_id")).agg(F.sum("weight").alias("weight")).where("weight > 0")
