"""Burning vector geometry into a mesh, polygonizing, and snapping."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.bins import as_boxes, box_join, inside
from gridloom.operators.connectivity import edge_faces
from gridloom.operators.geometry import mesh_edge_geometry, with_geometry
from gridloom.operators.graph import component_labels
from gridloom.operators.joins import FEW
from gridloom.operators.mesh import Mesh, dense_ids, edge_pairs, sides
from gridloom.operators.regrid import overlap_weights
from gridloom.operators.select import intersect_segments, locate_points
from gridloom.session import Round, cut, stored


def _last(hits: DataFrame) -> DataFrame:
    """``(face_id, value)``: the hit with the largest row wins."""
    return hits.groupBy("face_id").agg(F.max_by("value", "row").alias("value"))


def burn_points(mesh: Mesh, points: DataFrame) -> DataFrame:
    """``(face_id, value)`` of faces that hold ``points(row, x, y, value)``; points outside are dropped."""
    at = locate_points(mesh, points.select(F.col("row").alias("point_id"), "x", "y")).where("face_id is not null")
    return _last(at.join(points.select(F.col("row").alias("point_id"), "value"), "point_id").select("face_id", F.col("point_id").alias("row"), "value"))


def burn_lines(mesh: Mesh, segments: DataFrame) -> DataFrame:
    """``(face_id, value)`` of faces crossed by ``segments(row, pos, x0, y0, x1, y1, value)``."""
    parts = intersect_segments(mesh, segments.select(F.col("row").alias("line_id"), "pos", "x0", "y0", "x1", "y1")).select("face_id", F.col("line_id").alias("row")).distinct()
    return _last(parts.join(segments.select("row", "value").distinct(), "row"))


def burn_polygons(mesh: Mesh, polygons: DataFrame, all_touched: bool = False) -> DataFrame:
    """``(face_id, value)`` of faces whose centroid lies in ``polygons(row, ring, holes, value)``.

    With ``all_touched``, of all faces that overlap a polygon by an area: those that hold a part of a triangle of it.
    """
    if all_touched:
        parts, of = earcut_triangulate_polygons(polygons)
        hits = overlap_weights(parts, mesh).select(F.col("source_id").alias("part"), F.col("target_id").alias("face_id"))
        hits = hits.join(of.select(F.col("face_id").alias("part"), "row"), "part").join(polygons.select("row", "value"), "row")
        return _last(hits.select("face_id", "row", "value"))
    boxes = polygons.withColumns({"xmin": F.array_min("ring.x"), "xmax": F.array_max("ring.x"), "ymin": F.array_min("ring.y"), "ymax": F.array_max("ring.y")})
    centers = as_boxes(with_geometry(mesh).select("face_id", F.col("cx").alias("x"), F.col("cy").alias("y")))
    corners = F.size("ring") + F.aggregate(F.coalesce("holes", F.array().cast("array<array<struct<x:double,y:double>>>")), F.lit(0), lambda a, h: a + F.size(h))
    few = (polygons.agg(F.sum(corners)).first()[0] or 0) <= FEW  # broadcast: centroids that no polygon is near are not shuffled
    pairs = box_join(centers, boxes, points=True, few=few)
    x, y = F.col("l_x"), F.col("l_y")
    hole = F.exists(F.coalesce("r_holes", F.array().cast("array<array<struct<x:double,y:double>>>")), lambda h: inside(h, x, y))
    hits = pairs.where(inside(F.col("r_ring"), x, y) & ~hole)
    return _last(hits.select(F.col("l_face_id").alias("face_id"), F.col("r_row").alias("row"), F.col("r_value").alias("value")))


def burn(mesh: Mesh, polygons: DataFrame | None = None, lines: DataFrame | None = None, points: DataFrame | None = None, fill: float | None = None, all_touched: bool = False) -> DataFrame:
    """``(face_id, value)`` for every face: polygons first, lines over them, points over both; without a ``value`` column 1."""
    polygons, lines, points = (t if t is None or "value" in t.columns else t.withColumn("value", F.lit(1.0)) for t in (polygons, lines, points))
    out = mesh.faces.select("face_id", F.lit(fill).cast("double").alias("value"))
    for layer in (None if polygons is None else burn_polygons(mesh, polygons, all_touched), None if lines is None else burn_lines(mesh, lines), None if points is None else burn_points(mesh, points)):
        if layer is not None:
            out = out.join(layer.withColumnRenamed("value", "new"), "face_id", "left").select("face_id", F.coalesce("new", "value").alias("value"))
    return out


def equal_regions(mesh: Mesh, data: DataFrame) -> DataFrame:
    """``(face_id, label, value)``: connected faces of one value; faces without a value are left out."""
    known, _ = stored(data.where("value is not null and not isnan(value)").select("face_id", "value"))
    ends = sides(replace(mesh, faces=mesh.faces.join(known, "face_id")), "value").groupBy("a", "b")  # edges need no numbers
    pair = ends.agg(F.min(F.struct("face_id", "value")).alias("f"), F.max(F.struct("face_id", "value")).alias("g"))
    if mesh.edge_table is not None:
        pair = pair.join(edge_pairs(mesh), ["a", "b"], "left_semi")
    same = pair.where("f.face_id < g.face_id and f.value = g.value").select(F.col("f.face_id").alias("src"), F.col("g.face_id").alias("dst"))
    labels = component_labels(known.select(F.col("face_id").alias("id")), same)
    return known.join(labels, known.face_id == labels.id).select("face_id", "label", "value")


SIDES = 100_000
ORDER = pa.schema([("id", pa.int64()), ("low", pa.int64()), ("left", pa.int64()), ("n", pa.int64())])


def _rings(t: pa.Table) -> pa.Table:
    """``(id, low, left, n)`` of whole rings ``(id, next)``: the lowest side, the steps to it, and how many sides there are."""
    ids, after = (np.asarray(t.column(c)) for c in ("id", "next"))
    order = np.argsort(ids)
    ids, step = ids[order], np.searchsorted(ids[order], after[order])
    low, far = np.minimum(np.arange(len(ids)), step), step[step]
    while True:
        new = np.minimum(low, low[far])
        if np.array_equal(new, low):
            break
        low, far = new, far[far]
    at_low = low == np.arange(len(ids))
    far, left = np.where(at_low, np.arange(len(ids)), step), (~at_low).astype(np.int64)
    while (far != low).any():
        far, left = far[far], left + left[far]
    return pa.table([pa.array(ids), pa.array(ids[low]), pa.array(left), pa.array(np.bincount(low, minlength=len(ids))[low])], schema=ORDER)


def _long_rings(step: DataFrame) -> DataFrame:
    """As ``_rings``, by joins over doubling steps."""
    spark = step.sparkSession
    walks, ways = Round(spark), Round(spark)
    walk = walks.put(step.select("id", "next", F.least("id", "next").alias("low")))
    while True:
        other = walk.select(F.col("id").alias("next"), F.col("next").alias("far"), F.col("low").alias("far_low"))
        new = walks.put(walk.join(other, "next").select("id", F.col("far").alias("next"), F.least("low", "far_low").alias("low"), (F.col("far_low") < F.col("low")).alias("moved")))
        done = not new.where("moved").limit(1).count()
        walk = new.drop("moved")
        if done:
            break
    # steps from each side to the lowest one, which is where a walk ends
    low = walk.select("id", "low")
    to = ways.put(step.join(low, "id").select("id", "low", F.when(F.col("id") == F.col("low"), F.col("id")).otherwise(F.col("next")).alias("next"), (F.col("id") != F.col("low")).cast("long").alias("left")))
    while to.where("next <> low").limit(1).count():
        other = to.select(F.col("id").alias("next"), F.col("next").alias("far"), F.col("left").alias("more"))
        to = ways.put(to.join(other, "next").select("id", "low", F.col("far").alias("next"), (F.col("left") + F.col("more")).alias("left")))
    return to.join(to.groupBy("low").agg(F.count("*").alias("n")), "low").select("id", "low", "left", "n")


def outlines(mesh: Mesh, data: DataFrame, few: int = SIDES) -> DataFrame:
    """``(label, value, ring, pos, x, y, outer)``: the corners of each region's rings in order.

    A region lies to the left of its rings; ``ring`` is the lowest number of a ring's sides, and the ring with
    the largest box is the outer one.  Sides are chained by joins: each side's next one is that which comes
    first clockwise from it.  Regions of at most ``few`` sides are put in order many in a task; of others the lowest
    side of a ring and the distance from it are found by doubling steps.
    """
    mesh = replace(mesh, nodes=stored(mesh.nodes)[0])
    labelled = mesh.faces.join(equal_regions(mesh, data), "face_id")
    turn = labelled.select("label", "value", F.posexplode("nodes").alias("pos", "p"), "nodes").select("label", "value", "p", F.get("nodes", (F.col("pos") + 1) % F.size("nodes")).alias("q")).where("p <> q")
    # a side that the region has both ways is within it
    both = turn.groupBy("label", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.min(F.col("p") < F.col("q")).alias("low"), F.max(F.col("p") < F.col("q")).alias("on"), F.first("value").alias("value"))
    both = both.where("low = on").select("label", "value", F.when(F.col("on"), F.col("a")).otherwise(F.col("b")).alias("p"), F.when(F.col("on"), F.col("b")).otherwise(F.col("a")).alias("q"))
    side = dense_ids(stored(both)[0], ["label", "p", "q"], "id", unique=True, carried=("value",))
    place = lambda k: mesh.nodes.select(F.col("node_id").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y"))
    side, _ = stored(side.join(place("p"), "p").join(place("q"), "q").select("id", "label", "value", "p", "q", "px", "py", "qx", "qy"))
    here = side.select("label", "id", F.col("q").alias("at"), F.atan2(F.col("py") - F.col("qy"), F.col("px") - F.col("qx")).alias("back"))
    there = side.select("label", F.col("id").alias("next"), F.col("p").alias("at"), F.atan2(F.col("qy") - F.col("py"), F.col("qx") - F.col("px")).alias("on"))
    clockwise = F.pmod(F.col("back") - F.col("on") + 2 * math.pi - 1e-12, F.lit(2 * math.pi))
    step = here.join(there, ["label", "at"]).groupBy("label", "id").agg(F.min(F.struct(clockwise.alias("turn"), "next")).alias("n")).select("label", "id", "n.next")
    step, _ = stored(step)
    big, _ = stored(step.groupBy("label").count().where(F.col("count") > few).select("label"))
    some = big.limit(1).count() > 0
    short = step.join(big, "label", "left_anti") if some else step
    bucket = F.pmod(F.xxhash64("label"), F.lit(step.count() // few + 1)).alias("bucket")
    to = short.select(bucket, "id", "next").groupBy("bucket").applyInArrow(_rings, "id long, low long, left long, n long")
    if some:
        to = to.unionByName(_long_rings(step.join(big, "label", "left_semi").select("id", "next")))
    rows = side.join(to, "id")
    rows, _ = stored(rows.select("label", "value", F.col("low").alias("ring"), F.when(F.col("left") == 0, 0).otherwise(F.col("n") - F.col("left")).alias("pos"), F.col("px").alias("x"), F.col("py").alias("y")))
    extent = rows.groupBy("label", "ring").agg(((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("extent"))
    first = extent.groupBy("label").agg(F.max(F.struct("extent", (-F.col("ring")).alias("less"), "ring")).alias("m")).select("label", F.col("m.ring").alias("first"))
    return rows.join(first, "label").select("label", "value", "ring", "pos", "x", "y", (F.col("ring") == F.col("first")).alias("outer"))


def polygonize(mesh: Mesh, data: DataFrame) -> DataFrame:
    """``(label, value, rings)``: closed rings of each region as arrays, the outer one first; a ring is one value."""
    rows = outlines(mesh, data)
    ring = rows.groupBy("label", "value", "ring", "outer").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("c"))
    ring = ring.withColumn("c", F.transform("c", lambda c: F.struct(c.x.alias("x"), c.y.alias("y")))).withColumn("c", F.concat("c", F.slice("c", 1, 1)))
    whole = ring.groupBy("label", "value").agg(F.array_sort(F.collect_list(F.struct((~F.col("outer")).alias("late"), "ring", "c"))).alias("r"))
    return whole.select("label", "value", F.transform("r", lambda r: r.c).alias("rings"))


def bounding_polygon(mesh: Mesh) -> DataFrame:
    """``(ring, pos, x, y, outer)``: the outline of the mesh, holes kept; of several parts that with the largest box."""
    rows = outlines(mesh, mesh.faces.select("face_id", F.lit(1.0).alias("value")))
    extent = rows.where("outer").groupBy("label").agg(((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("extent"))
    first = extent.agg(F.max(F.struct("extent", (-F.col("label")).alias("less"), "label")).alias("m")).select(F.col("m.label").alias("label"))
    return rows.join(F.broadcast(first), "label", "left_semi").select("ring", "pos", "x", "y", "outer")  # one row


def _ears(ring: list[tuple[float, float]]) -> list[tuple[int, int, int]]:
    """Triangles of a simple counter-clockwise ring, by clipping ears."""
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    left, out = list(range(len(ring))), []
    while len(left) > 3:
        for k in range(len(left)):
            i, j, m = left[k - 1], left[k], left[(k + 1) % len(left)]
            a, b, c = ring[i], ring[j], ring[m]
            if turn(a, b, c) <= 0:
                continue
            others = (ring[o] for o in left if o not in (i, j, m) and ring[o] not in (a, b, c))
            if not any(turn(a, b, p) >= 0 and turn(b, c, p) >= 0 and turn(c, a, p) >= 0 for p in others):
                out.append((i, j, m))
                del left[k]
                break
        else:  # only corners without area are left over
            flat = [k for k in range(len(left)) if abs(turn(ring[left[k - 1]], ring[left[k]], ring[left[(k + 1) % len(left)]])) <= 1e-12]
            if not flat:
                raise ValueError("the ring crosses itself")
            del left[flat[0]]
    return out + ([tuple(left)] if len(left) == 3 and turn(*(ring[k] for k in left)) > 0 else [])


def _bridged(ring: list, holes: list[list]) -> list:
    """One ring of a polygon and its holes, joined to it by the nearest corner that is in sight, from the right."""
    area = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1]))
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    open_ring = lambda r: r[:-1] if len(r) > 1 and r[0] == r[-1] else r
    ring = open_ring(ring)
    out = ring if area(ring) > 0 else ring[::-1]
    holes = [h if area(h) < 0 else h[::-1] for h in map(open_ring, holes)]
    for n, hole in enumerate(sorted(holes, key=lambda h: -max(h)[0])):
        start = hole.index(max(hole))
        hole = hole[start:] + hole[:start]
        p = hole[0]
        walls = [(a, b) for r in (out, hole, *sorted(holes, key=lambda h: -max(h)[0])[n + 1 :]) for a, b in zip(r, r[1:] + r[:1])]
        crossed = lambda q: any(turn(p, q, a) * turn(p, q, b) < 0 and turn(a, b, p) * turn(a, b, q) < 0 for a, b in walls)
        k = min((k for k in range(len(out)) if not crossed(out[k])), key=lambda k: ((out[k][0] - p[0]) ** 2 + (out[k][1] - p[1]) ** 2, k))
        out = out[: k + 1] + hole + [hole[0]] + out[k:]
    return out


def earcut_triangulate_polygons(polygons: DataFrame) -> tuple[Mesh, DataFrame]:
    """Triangles of ``polygons(row, ring, holes)`` with nodes of their own, and ``(face_id, row)``: where each comes from."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for row, ring, holes in zip(b["row"], b["ring"], b["holes"]):
                flat = lambda r: [(float(v["x"]), float(v["y"])) for v in r]
                whole = _bridged(flat(ring), [flat(h) for h in (holes if holes is not None else [])])
                rows += [(row, k, *whole[i], *whole[j], *whole[m]) for k, (i, j, m) in enumerate(_ears(whole))]
            yield pd.DataFrame(rows, columns=["row", "part", "x0", "y0", "x1", "y1", "x2", "y2"])

    parts = cut(polygons.select(F.col("row").cast("long").alias("row"), "ring", "holes").mapInPandas(run, "row long, part long, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double"))
    ids = dense_ids(parts, ["row", "part"], "face_id")
    parts = parts.join(ids, ["row", "part"])
    corner = F.posexplode(F.array(*(F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in range(3)))).alias("k", "v")
    nodes = parts.select("face_id", corner).select((F.col("face_id") * 3 + F.col("k")).alias("node_id"), "v.x", "v.y")
    faces = parts.select("face_id", F.array(*(F.col("face_id") * 3 + k for k in range(3))).alias("nodes"))
    return Mesh(nodes, faces), parts.select("face_id", "row")


def snap_to_nodes(points: DataFrame, targets: DataFrame, max_distance: float, nearest: bool = True) -> DataFrame:
    """``(point_id, x, y, id)``: points moved to a target within the distance, else as they are.

    Of several targets the nearest is taken (ties: lowest id); without ``nearest`` they raise when run.
    """
    wide = points.withColumns({"xmin": F.col("x") - max_distance, "xmax": F.col("x") + max_distance, "ymin": F.col("y") - max_distance, "ymax": F.col("y") + max_distance})
    pairs = box_join(wide, as_boxes(targets))
    d2 = (F.col("l_x") - F.col("r_x")) ** 2 + (F.col("l_y") - F.col("r_y")) ** 2
    near = pairs.withColumn("d2", d2).where(F.col("d2") <= max_distance**2).groupBy(F.col("l_point_id").alias("point_id"))
    near = near.agg(F.min(F.struct("d2", F.col("r_id").alias("id"), F.col("r_x").alias("tx"), F.col("r_y").alias("ty"))).alias("s"), F.count("*").alias("n"))
    if not nearest:
        near = near.withColumn("s", F.when(F.col("n") > 1, F.raise_error(F.lit("several targets in reach"))).otherwise(F.col("s")))
    return points.join(near, "point_id", "left").select("point_id", F.coalesce("s.tx", "x").alias("x"), F.coalesce("s.ty", "y").alias("y"), F.col("s.id").alias("id"))


def snap_nodes(points: DataFrame, max_distance: float) -> tuple[DataFrame, DataFrame]:
    """``(point_id, new)`` and ``(new, x, y)``: points within the distance of an earlier target become it.

    Points are taken in the order of their ids.  One that no target has taken becomes a target itself and takes
    those near it that are no targets; a point that several take goes to the nearest.  Which points are targets
    is settled in rounds: a point whose earlier neighbours are all settled is settled, so a round settles the
    fronts of all clusters at once.
    """
    wide = points.withColumns({"xmin": F.col("x") - max_distance, "xmax": F.col("x") + max_distance, "ymin": F.col("y") - max_distance, "ymax": F.col("y") + max_distance})
    d = F.sqrt((F.col("l_x") - F.col("r_x")) ** 2 + (F.col("l_y") - F.col("r_y")) ** 2)
    near = box_join(wide, as_boxes(points)).where(F.col("l_point_id") != F.col("r_point_id")).select(F.col("l_point_id").alias("id"), F.col("r_point_id").alias("other"), d.alias("d")).where(F.col("d") <= max_distance)
    near = cut(near)
    carried = Round(points.sparkSession)
    state = carried.put(points.select(F.col("point_id").alias("id"), F.lit(None).cast("boolean").alias("target")))
    while state.where("target is null").limit(1).count():
        before = near.where("other < id").join(state.select(F.col("id").alias("other"), F.col("target").alias("t")), "other")
        told = before.groupBy("id").agg(F.bool_or("t").alias("taken"), F.count_if(F.col("t").isNull()).alias("open"))
        # taken by a target: no target; all earlier neighbours settled as no targets: a target
        told = state.join(told, "id", "left").select("id", "target", F.coalesce("taken", F.lit(False)).alias("taken"), F.coalesce("open", F.lit(0)).alias("open"))
        state = carried.put(told.select("id", F.coalesce("target", F.when(F.col("taken"), F.lit(False)).when(F.col("open") == 0, F.lit(True))).alias("target")))
    targets = state.where("target").select(F.col("id").alias("other"))
    to = near.join(targets, "other").join(state.where("not target").select("id"), "id", "left_semi").groupBy("id").agg(F.min(F.struct("d", "other")).alias("m"))
    goal = cut(state.join(to, "id", "left").select("id", F.coalesce("m.other", "id").alias("goal")))
    ids = dense_ids(goal, ["goal"], "new")
    return goal.join(ids, "goal").select(F.col("id").alias("point_id"), "new"), ids.join(points.withColumnRenamed("point_id", "goal"), "goal").select("new", "x", "y")


def lines_as_edges(vertices: DataFrame) -> DataFrame:
    """``(line_id, pos, x0, y0, x1, y1)`` between neighbouring ``vertices(line_id, pos, x, y)`` of a line."""
    along = Window.partitionBy("line_id").orderBy("pos")
    rows = vertices.select("line_id", "pos", F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(along).alias("x1"), F.lead("y").over(along).alias("y1"))
    return rows.where("x1 is not null")


def snapped_segments(mesh: Mesh, segments: DataFrame, max_snap_distance: float | None = None, tolerance: float = 1e-12) -> DataFrame:
    """``(line_id, pos, edge_id, x0, y0, x1, y1, length2, length)``: parts of lines and the inner edges that they stand for.

    A part stands for an edge of its face if the part, lengthened by ``tolerance``, and the line between the
    centroids on both sides of the edge separate each other's ends.  Vertices within ``max_snap_distance`` of a
    node are moved to it first.  ``length2`` is the squared length.
    """
    if max_snap_distance is not None:
        ends = segments.select("line_id", "pos", F.inline(F.array(F.struct(F.lit(0).alias("end"), F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.lit(1).alias("end"), F.col("x1").alias("x"), F.col("y1").alias("y")))))
        ends = ends.withColumn("point_id", F.struct("line_id", "pos", "end"))
        moved = snap_to_nodes(ends.select("point_id", "x", "y"), mesh.nodes.withColumnRenamed("node_id", "id"), max_snap_distance).select("point_id.*", "x", "y")
        one, two = (moved.where(F.col("end") == k).select("line_id", "pos", F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")) for k in (0, 1))
        segments = one.join(two, ["line_id", "pos"])
    parts = intersect_segments(mesh, segments)
    centers = with_geometry(mesh).select("face_id", "cx", "cy")
    inner = edge_faces(mesh).where("f2 is not null").select("edge_id", F.inline(F.array(F.struct(F.col("f1").alias("face_id"), F.col("f2").alias("other")), F.struct(F.col("f2").alias("face_id"), F.col("f1").alias("other")))))
    inner = inner.join(centers.select("face_id", F.col("cx").alias("ax"), F.col("cy").alias("ay")), "face_id").join(centers.select(F.col("face_id").alias("other"), F.col("cx").alias("bx"), F.col("cy").alias("by")), "other")
    at = parts.join(inner.drop("other"), "face_id").where("x0 <> x1 or y0 <> y1")
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    more = tolerance * F.greatest(F.abs(dx), F.abs(dy))
    at = at.withColumns({"px": F.col("x0") - F.signum(dx) * more, "py": F.col("y0") - F.signum(dy) * more, "qx": F.col("x1") + F.signum(dx) * more, "qy": F.col("y1") + F.signum(dy) * more})
    left = lambda x, y, p, q, r, s: (F.col(r) - F.col(p)) * (F.col(y) - F.col(q)) - (F.col(s) - F.col(q)) * (F.col(x) - F.col(p)) > 0
    apart = (left("ax", "ay", "px", "py", "qx", "qy") != left("bx", "by", "px", "py", "qx", "qy")) & (left("px", "py", "ax", "ay", "bx", "by") != left("qx", "qy", "ax", "ay", "bx", "by"))
    length2 = dx * dx + dy * dy
    return at.where(apart).select("line_id", "pos", "edge_id", "x0", "y0", "x1", "y1", length2.alias("length2"), F.sqrt(length2).alias("length"))


def snap_to_grid(mesh: Mesh, segments: DataFrame, max_snap_distance: float | None = None) -> DataFrame:
    """``(edge_id, line_id, length2, length)``: for each inner edge the longest part that stands for it; ties take the lowest line and place."""
    rows = snapped_segments(mesh, segments, max_snap_distance)
    best = rows.groupBy("edge_id").agg(F.min(F.struct((-F.col("length2")).alias("n"), "line_id", "pos")).alias("s"))
    return best.select("edge_id", "s.line_id", (-F.col("s.n")).alias("length2"), F.sqrt(-F.col("s.n")).alias("length"))


def snapped_edges(mesh: Mesh, snapped: DataFrame) -> DataFrame:
    """``(edge_id, line_id)`` of every edge, null where none is snapped."""
    return mesh.edges.select("edge_id").join(snapped.select("edge_id", "line_id"), "edge_id", "left")


def snapped_lines(mesh: Mesh, snapped: DataFrame) -> DataFrame:
    """``(line_id, edge_id, wkt)`` of the edges that lines are snapped to."""
    e = mesh_edge_geometry(mesh).join(snapped.select("edge_id", "line_id"), "edge_id")
    return e.select("line_id", "edge_id", F.format_string("LINESTRING (%s %s, %s %s)", *(F.col(c).cast("string") for c in ("ax", "ay", "bx", "by"))).alias("wkt"))
