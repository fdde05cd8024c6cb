"""Selection: boxes, points, nearest facets, lines and rasters."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.bins import as_boxes, binned, box_join, inside
from gridloom.operators.geometry import edge_geometry, facet_points, with_geometry
from gridloom.operators.mesh import Grid, Mesh, Network
from gridloom.operators.topology import box, node_bounds
from gridloom.session import cut, stored

CROWD = 16
GEOMETRY = ("face_id", "ring", "cx", "cy", "xmin", "ymin", "xmax", "ymax")


def sel_box(mesh: Mesh, x: tuple[float | None, float | None], y: tuple[float | None, float | None]) -> DataFrame:
    """Face ids whose centroid lies in the half-open box; open ends take the bounds of the nodes."""
    return box(mesh, x, y)


def locate_points(grid: Grid, points: DataFrame, tolerance: float | None = None, faces: DataFrame | None = None) -> DataFrame:
    """``(point_id, face_id)``: the lowest face that holds the point, null outside; sides count as inside.

    Of a network ``(point_id, edge_id)``: the lowest edge that the point lies on.  ``tolerance`` is the distance
    at which a point counts as on a side; by default 1e-12 of the grid's extent for edges, and none for faces.
    ``faces`` is the geometry of a mesh's faces where a caller has it written.
    """
    if isinstance(grid, Network):
        if tolerance is None:
            a, b, c, d = node_bounds(grid)
            tolerance = 1e-12 * (((c or 0) - (a or 0)) ** 2 + ((d or 0) - (b or 0)) ** 2) ** 0.5
        e = edge_geometry(grid.edges, grid.nodes)
        boxes = e.select("edge_id", "ax", "ay", "bx", "by", F.least("ax", "bx").alias("xmin"), F.least("ay", "by").alias("ymin"), F.greatest("ax", "bx").alias("xmax"), F.greatest("ay", "by").alias("ymax"))
        hits = box_join(_widened(points, tolerance), boxes).where(_from_segment("l_x", "l_y", "r_ax", "r_ay", "r_bx", "r_by") <= tolerance)
        found = hits.groupBy(F.col("l_point_id").alias("point_id")).agg(F.min("r_edge_id").alias("edge_id"))
        return points.select("point_id").join(found, "point_id", "left")
    faces = stored_geometry(grid) if faces is None else faces
    hits = box_join(as_boxes(points), faces, points=True) if not tolerance else box_join(_widened(points, tolerance), faces)
    within = inside(F.col("r_ring"), F.col("l_x"), F.col("l_y"))
    if tolerance:
        after = F.concat(F.slice("r_ring", 2, F.size("r_ring")), F.slice("r_ring", 1, 1))
        within = within | F.exists(F.zip_with("r_ring", after, lambda p, q: _from_segment("l_x", "l_y", p.x, p.y, q.x, q.y) <= tolerance), lambda v: v)
    found = hits.where(within).groupBy(F.col("l_point_id").alias("point_id")).agg(F.min("r_face_id").alias("face_id"))
    return points.select("point_id").join(found, "point_id", "left")


def stored_geometry(mesh: Mesh) -> DataFrame:
    """Rings, centroids and boxes of the faces, written once for all that read them by column."""
    return stored(with_geometry(mesh).select(*GEOMETRY))[0]


def _widened(points: DataFrame, by: float) -> DataFrame:
    return points.withColumns({"xmin": F.col("x") - by, "xmax": F.col("x") + by, "ymin": F.col("y") - by, "ymax": F.col("y") + by})


def _from_segment(px, py, ax, ay, bx, by) -> Column:
    """Distance of a point from a segment."""
    px, py, ax, ay, bx, by = (F.col(c) if isinstance(c, str) else c for c in (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0))))
    return F.sqrt((px - ax - t * dx) * (px - ax - t * dx) + (py - ay - t * dy) * (py - ay - t * dy))


def locate_nearest(grid: Grid, facet: str, points: DataFrame, max_distance: float | None = None) -> DataFrame:
    """``(point_id, id, distance)`` of the nearest node, edge midpoint or face centroid; null beyond ``max_distance``."""
    return nearest(points, facet_points(grid, facet), max_distance=max_distance)


def sel_points(grid: Grid, points: DataFrame, data: DataFrame, facet: str = "face", method: str | None = None, out_of_bounds: str = "warn", fill: float | None = None, tolerance: float | None = None, dims: tuple[str, ...] = ()) -> DataFrame:
    """``(point_id, x, y, *dims, value)``: values of ``data(id, *dims, value)`` at points.

    Values of the core facet (faces; edges of a network) are those of the one that holds the point, or with
    ``method="nearest"`` of the nearest; values of other facets those of the nearest.  Points that no face (edge)
    holds are out of bounds: they raise, get ``fill`` with or without a warning, or are dropped.
    """
    if method not in (None, "nearest"):
        raise ValueError(f"method must be None or 'nearest', not {method}")
    if out_of_bounds not in ("warn", "raise", "ignore", "drop"):
        raise ValueError(f"out_of_bounds must be warn, raise, ignore or drop, not {out_of_bounds}")
    core = "face" if isinstance(grid, Mesh) else "edge"
    faces = stored_geometry(grid) if core == "face" else None
    held = locate_points(grid, points, tolerance, faces).withColumnRenamed(f"{core}_id", "held")
    if out_of_bounds in ("warn", "raise"):
        held = cut(held)
        if held.where("held is null").limit(1).count():
            if out_of_bounds == "raise":
                raise ValueError("not all points are located on the topology")
            warnings.warn("not all points are located on the topology", stacklevel=2)
    at = points.select("point_id", "x", "y").join(held, "point_id")
    if out_of_bounds == "drop":
        at = at.where("held is not null")
    if facet == core and method is None:
        at = at.withColumn("id", F.col("held"))
    else:
        places = facet_points(grid, facet) if facet != "face" or faces is None else faces.select(F.col("face_id").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"))
        at = at.join(nearest(points, places).select("point_id", "id"), "point_id", "left")
    if dims:
        at = at.join(F.broadcast(data.select(*dims).distinct()) if data.select(*dims).distinct().count() <= 10_000 else data.select(*dims).distinct())  # a value for each
    found = at.join(data.select("id", *dims, "value"), ["id", *dims], "left")
    return found.select("point_id", "x", "y", *dims, F.when(F.col("held").isNull(), F.lit(fill)).otherwise(F.col("value")).cast("double").alias("value"))


def nearest(points: DataFrame, targets: DataFrame, size: float | None = None, max_distance: float | None = None) -> DataFrame:
    """``(point_id, id, distance)`` of the nearest of ``targets(id, x, y)``, ties to the lowest id.

    The first bins are so small that a target shares its own with few others.  Rings of bins are searched
    outwards.  A point is done when its best distance is at most the radius searched; the radius doubles for
    the points that are left, so a sparse mesh needs few rounds.
    Beyond ``max_distance`` (where given; strictly) the result is null.
    """
    targets = cut(targets.groupBy("x", "y").agg(F.min("id").alias("id")).where("x is not null and y is not null"))  # of targets at one place the lowest id
    span = targets.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"), F.count("*").alias("n")).first()
    if not span.n:
        return points.select("point_id", F.lit(None).cast(targets.schema["id"].dataType).alias("id"), F.lit(None).cast("double").alias("distance"))
    extent = max(span.b - span.a, span.d - span.c) or 1.0
    area = (span.b - span.a) * (span.d - span.c)
    radius = size or (min(extent, (area / span.n) ** 0.5) if area else extent / span.n)
    for _ in range(20 if size is None else 0):  # clustered targets: begin with bins that hold few
        bins = targets.groupBy(F.floor(F.col("x") / (2 * radius)), F.floor(F.col("y") / (2 * radius))).count()
        if bins.agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0] <= CROWD:
            break
        radius /= 2
    limit = max_distance if max_distance is not None else float("inf")
    if 0 < limit < radius:  # nothing beyond it counts
        radius = max(limit, 1e-9 * extent)
    points = cut(points.select("point_id", "x", "y"))
    inside_x, inside_y = F.greatest(F.lit(span.a), F.least("x", F.lit(span.b))), F.greatest(F.lit(span.c), F.least("y", F.lit(span.d)))
    left, done = points.withColumn("reach", F.sqrt((F.col("x") - inside_x) ** 2 + (F.col("y") - inside_y) ** 2)), None
    if limit <= radius:
        left = left.where(F.col("reach") < limit)
    while True:
        wide = F.col("reach") + radius
        cells = binned(left.withColumns({"xmin": F.col("x") - wide, "xmax": F.col("x") + wide, "ymin": F.col("y") - wide, "ymax": F.col("y") + wide}), 2 * radius, "l_")
        goal = targets.select(F.floor(F.col("x") / (2 * radius)).alias("_bx"), F.floor(F.col("y") / (2 * radius)).alias("_by"), F.col("id").alias("r_id"), F.col("x").alias("r_x"), F.col("y").alias("r_y"))
        d = F.sqrt((F.col("l_x") - F.col("r_x")) ** 2 + (F.col("l_y") - F.col("r_y")) ** 2)
        best = cells.join(goal, ["_bx", "_by"]).select(F.col("l_point_id").alias("point_id"), (F.col("l_reach") + radius).alias("wide"), F.struct(d.alias("distance"), F.col("r_id").alias("id")).alias("s"))
        best = cut(best.groupBy("point_id").agg(F.min("s").alias("s"), F.first("wide").alias("wide")).where("s.distance <= wide").select("point_id", "s.id", "s.distance"))
        done = best if done is None else done.unionAll(best)
        if radius >= min(2 * extent, limit):
            break
        left = cut(left.join(best, "point_id", "left_anti"))
        if not left.limit(1).count():
            break
        radius *= 2
    if max_distance is not None:
        done = done.where(F.col("distance") < max_distance)
    return points.select("point_id").join(done, "point_id", "left")


def raster_cells(grid: Grid, resolution: float, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """``(point_id, row, col, x, y)``: cell centres on multiples of ``resolution`` over the bounds, rows by falling y."""
    xmin, ymin, xmax, ymax = bounds or node_bounds(grid)
    c0, c1, r0, r1 = math.floor(xmin / resolution), math.ceil(xmax / resolution), math.floor(ymin / resolution), math.ceil(ymax / resolution)
    wide, high = c1 - c0, r1 - r0
    return grid.nodes.sparkSession.range(wide * high).select(
        F.col("id").alias("point_id"), F.floor(F.col("id") / wide).alias("row"), (F.col("id") % wide).alias("col"),
        ((c0 + F.col("id") % wide + 0.5) * resolution).alias("x"), ((r1 - F.floor(F.col("id") / wide) - 0.5) * resolution).alias("y"),
    )


def rasterize(mesh: Mesh, resolution: float, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """``(row, col, x, y, face_id)`` of the cells of a raster over the mesh; null outside."""
    cells = raster_cells(mesh, resolution, bounds)
    return cells.join(locate_points(mesh, cells.select("point_id", "x", "y")), "point_id").select("row", "col", "x", "y", "face_id")


def rasterize_like(mesh: Mesh, x: DataFrame, y: DataFrame) -> DataFrame:
    """``(row, col, x, y, face_id)`` at the crossings of ``x(col, x)`` and ``y(row, y)``; null outside."""
    cells = y.join(x)  # the raster itself: a row for each cell
    cells = cells.withColumn("point_id", F.struct("row", "col"))
    return cells.join(locate_points(mesh, cells.select("point_id", "x", "y")), "point_id").select("row", "col", "x", "y", "face_id")


def clip_to_ring(ring, x0, y0, x1, y1):
    """Parameters ``(t0, t1)`` of a segment inside a convex counter-clockwise ring."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))

    def side(p, q):
        start = (q.x - p.x) * (y0 - p.y) - (q.y - p.y) * (x0 - p.x)
        slope = (q.x - p.x) * (y1 - y0) - (q.y - p.y) * (x1 - x0)
        t = F.try_divide(-start, slope)
        return F.struct(
            F.when(slope > 0, t).otherwise(F.when((slope == 0) & (start < 0), F.lit(2.0)).otherwise(F.lit(0.0))).alias("low"),
            F.when(slope < 0, t).otherwise(F.lit(1.0)).alias("high"),
        )

    parts = F.zip_with(ring, after, side)
    return F.greatest(F.lit(0.0), F.array_max(F.transform(parts, lambda p: p.low))), F.least(F.lit(1.0), F.array_min(F.transform(parts, lambda p: p.high)))


def intersect_segments(mesh: Mesh, segments: DataFrame) -> DataFrame:
    """``(line_id, pos, face_id, x0, y0, x1, y1)``: the part of each segment in each convex face, of positive length."""
    boxes = segments.withColumns({"xmin": F.least("x0", "x1"), "xmax": F.greatest("x0", "x1"), "ymin": F.least("y0", "y1"), "ymax": F.greatest("y0", "y1")})
    pairs = box_join(boxes, with_geometry(mesh).select(*GEOMETRY))
    x0, y0, x1, y1 = (F.col(f"l_{c}") for c in ("x0", "y0", "x1", "y1"))
    low, high = clip_to_ring(F.col("r_ring"), x0, y0, x1, y1)
    pairs = pairs.withColumn("low", low).withColumn("high", high).where("high > low")
    at = lambda a, b, t: a + (b - a) * F.col(t)
    return pairs.select(F.col("l_line_id").alias("line_id"), F.col("l_pos").alias("pos"), F.col("r_face_id").alias("face_id"), at(x0, x1, "low").alias("x0"), at(y0, y1, "low").alias("y0"), at(x0, x1, "high").alias("x1"), at(y0, y1, "high").alias("y1"))


def intersect_edges(network: Network, segments: DataFrame) -> DataFrame:
    """``(line_id, pos, edge_id, x, y)``: the points where segments cross the edges of a network; parallel ones do not."""
    e = edge_geometry(network.edges, network.nodes).select("edge_id", "ax", "ay", "bx", "by", F.least("ax", "bx").alias("xmin"), F.least("ay", "by").alias("ymin"), F.greatest("ax", "bx").alias("xmax"), F.greatest("ay", "by").alias("ymax"))
    boxes = segments.withColumns({"xmin": F.least("x0", "x1"), "xmax": F.greatest("x0", "x1"), "ymin": F.least("y0", "y1"), "ymax": F.greatest("y0", "y1")})
    c = {k: F.col(k) for k in ("l_x0", "l_y0", "l_x1", "l_y1", "r_ax", "r_ay", "r_bx", "r_by")}
    ux, uy, vx, vy = c["l_x1"] - c["l_x0"], c["l_y1"] - c["l_y0"], c["r_bx"] - c["r_ax"], c["r_by"] - c["r_ay"]
    wx, wy, turn = c["r_ax"] - c["l_x0"], c["r_ay"] - c["l_y0"], ux * vy - uy * vx
    t, u = F.try_divide(wx * vy - wy * vx, turn), F.try_divide(wx * uy - wy * ux, turn)
    hits = box_join(boxes, e).withColumns({"t": t, "u": u}).where("t between 0 and 1 and u between 0 and 1")
    return hits.select(F.col("l_line_id").alias("line_id"), F.col("l_pos").alias("pos"), F.col("r_edge_id").alias("edge_id"), (c["l_x0"] + F.col("t") * ux).alias("x"), (c["l_y0"] + F.col("t") * uy).alias("y"))


def intersect_linestring(mesh: Grid, segments: DataFrame) -> DataFrame:
    """``(line_id, face_id, x, y, s)``: midpoints of the parts and their distance along the line.

    Of a network ``(line_id, edge_id, x, y, s)``: the points where the line crosses its edges.
    """
    length = F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)
    along = Window.partitionBy("line_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    starts = segments.select("line_id", "pos", F.col("x0").alias("sx"), F.col("y0").alias("sy"), F.coalesce(F.sum(length).over(along), F.lit(0.0)).alias("before"))
    core = "face_id" if isinstance(mesh, Mesh) else "edge_id"
    if isinstance(mesh, Mesh):
        parts = intersect_segments(mesh, segments).withColumn("x", (F.col("x0") + F.col("x1")) / 2).withColumn("y", (F.col("y0") + F.col("y1")) / 2)
    else:
        parts = intersect_edges(mesh, segments)
    s = F.col("before") + F.sqrt((F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2)
    return parts.join(starts, ["line_id", "pos"]).select("line_id", core, "x", "y", s.alias("s"))


def line(grid: Grid, x: float | tuple, y: float | tuple) -> DataFrame:
    """One segment ``(line_id, pos, x0, y0, x1, y1)`` across the grid at a fixed x or y; open ends take its bounds."""
    known = node_bounds(grid)
    if isinstance(x, tuple):
        (x0, x1), y0, y1 = (a if a is not None else b for a, b in zip(x, known[::2])), y, y
    else:
        (y0, y1), x0, x1 = (a if a is not None else b for a, b in zip(y, known[1::2])), x, x
    return grid.nodes.sparkSession.createDataFrame([(0, 0, float(x0), float(y0), float(x1), float(y1))], "line_id long, pos int, x0 double, y0 double, x1 double, y1 double")


def polyline(spark, vertices: list[tuple[float, float]]) -> DataFrame:
    """Segments ``(line_id, pos, x0, y0, x1, y1)`` of one line of vertices from the driver."""
    if len(vertices) < 2 or any(len(v) != 2 for v in vertices):
        raise ValueError("a line needs a start and an end of two coordinates each")
    rows = [(0, k, *map(float, a), *map(float, b)) for k, (a, b) in enumerate(zip(vertices, vertices[1:]))]
    return spark.createDataFrame(rows, "line_id long, pos int, x0 double, y0 double, x1 double, y1 double")
