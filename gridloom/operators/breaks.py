"""Breaks of axes from cell centres, spacings and bounds, and meshes of structured cells."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.mesh import Mesh, dense_ids, from_breaks, structured
from gridloom.operators.ordered import neighbours
from gridloom.session import cut


def is_increasing(axis: DataFrame) -> bool:
    """Whether ``axis(idx, mid)`` runs upwards; one that is not monotonic raises ``ValueError``."""
    return _rises(neighbours(axis, [], ["idx"], "mid"))


def _rises(axis: DataFrame) -> bool:
    """The same of an axis with the places ``after``."""
    step = axis.select((F.col("after") - F.col("mid")).alias("d"))
    found = step.agg(F.min("d").alias("low"), F.max("d").alias("high")).first()
    if found.low is not None and found.low < 0 < found.high:
        raise ValueError("the input coordinate is not monotonic")
    return found.low is None or found.low >= 0


def infer_interval_breaks(axis: DataFrame, by: str | None = None, check_monotonic: bool = False) -> DataFrame:
    """``(idx, at)``: one break more than ``axis(idx, mid)`` has cells, halfway between them and as far beyond the ends.

    With ``by``, along ``idx`` for each row of a table of two dimensions.  A single cell has breaks at its middle.
    """
    if check_monotonic:
        is_increasing(axis)
    keys = [by] if by else []
    return _halfway(neighbours(axis.select(*keys, "idx", "mid"), keys, ["idx"], "mid"), keys)


def _halfway(row: DataFrame, keys: list[str]) -> DataFrame:
    """The breaks of cells with the places ``before`` and ``after``."""
    half = lambda a, b: (F.col(b) - F.col(a)) / 2
    low = F.when(F.col("before").isNotNull(), F.col("before") + half("before", "mid")).otherwise(F.col("mid") - F.coalesce(half("mid", "after"), F.lit(0.0)))
    first = row.select(*keys, "idx", low.alias("at"))
    last = row.where("after is null").select(*keys, (F.col("idx") + 1).alias("idx"), (F.col("mid") + F.coalesce(half("before", "mid"), F.lit(0.0))).alias("at"))
    return first.unionByName(last)


def infer_interval_breaks1d(axis: DataFrame, spacing: float | None = None) -> DataFrame:
    """``(idx, at)`` breaks of ``axis(idx, mid)``, whose cells have one ``spacing`` or a column ``spacing`` each.

    Centres that are not one spacing apart (to 1e-4 of it) raise, and a single cell without a spacing does.
    """
    axis = neighbours(axis, [], ["idx"], "mid")
    rising = _rises(axis)
    if spacing is not None:
        step = axis.select(F.abs(F.col("after") - F.col("mid")).alias("d"))
        if step.where(F.abs(F.col("d") - abs(spacing)) > 1e-4 * abs(spacing) + 1e-5 * abs(spacing)).limit(1).count():
            raise ValueError("the spacing does not match the coordinate")
        axis = axis.withColumn("spacing", F.lit(float(spacing)))
    if "spacing" in axis.columns:
        half = F.abs("spacing") / 2 * (1 if rising else -1)
        first = axis.agg(F.min(F.struct("idx", (F.col("mid") - half).alias("at"))).alias("m")).select("m.idx", "m.at")
        return first.unionByName(axis.select((F.col("idx") + 1).alias("idx"), (F.col("mid") + half).alias("at")))
    if axis.limit(2).count() < 2:
        raise ValueError("cannot derive the spacing of a coordinate of one cell; give it a spacing")
    return _halfway(axis, [])


def bounds1d_to_vertices(bounds: DataFrame) -> DataFrame:
    """``(idx, at)`` breaks of ``bounds(idx, lower, upper)``, which must run one way."""
    bounds = neighbours(bounds.select("idx", "lower", "upper", F.struct("lower", "upper").alias("both")), [], ["idx"], "both")
    steps = bounds.select((F.col("after.lower") - F.col("lower")).alias("a"), (F.col("after.upper") - F.col("upper")).alias("b"))
    d = steps.agg(F.min(F.least("a", "b")).alias("low"), F.max(F.greatest("a", "b")).alias("high")).first()
    if d.low is not None and d.low < 0 < d.high:
        raise ValueError("bounds are not monotonic ascending or monotonic descending")
    start, end = ("lower", "upper") if d.low is None or d.low >= 0 else ("upper", "lower")
    last = bounds.agg(F.max(F.struct("idx", end)).alias("m")).select((F.col("m.idx") + 1).alias("idx"), F.col(f"m.{end}").alias("at"))
    return bounds.select("idx", F.col(start).alias("at")).unionByName(last)


def values(breaks: DataFrame) -> list[float]:
    """The breaks of one axis on the driver, in order."""
    return [r.at for r in breaks.orderBy("idx").collect()]


def from_intervals1d(spark: SparkSession, x: DataFrame, y: DataFrame) -> Mesh:
    """Quads between breaks ``(idx, at)``, cells row by row."""
    return from_breaks(spark, values(x), values(y))


def from_intervals2d(corners: DataFrame) -> Mesh:
    """Quads of a rotated or curvilinear raster of ``corners(iy, ix, x, y)``, cells row by row, counter-clockwise."""
    wide, high = (v + 1 for v in corners.agg(F.max("ix"), F.max("iy")).first())
    mesh = structured(corners.sparkSession, wide - 1, high - 1)
    nodes = corners.select((F.col("iy").cast("long") * wide + F.col("ix")).alias("node_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    from gridloom.operators.geometry import counterclockwise

    return counterclockwise(Mesh(nodes, mesh.faces))


def from_structured_bounds(bounds: DataFrame) -> tuple[Mesh, DataFrame]:
    """Mesh of cells ``(cell_id, corners: array<struct<x, y>>)`` of up to four corners, and ``(face_id, of)``.

    Cells with null or NaN corners, with fewer than three corners or without area are left out, the latter two
    with a warning; a corner that comes twice makes a triangle.
    """
    good = F.forall("corners", lambda c: c.x.isNotNull() & c.y.isNotNull() & ~F.isnan(c.x) & ~F.isnan(c.y))
    cells = bounds.where(good).withColumn("c", F.array_sort(F.array_distinct("corners")))
    o = F.get("c", F.lit(0))
    pairs = F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda p, q: F.abs((p.x - o.x) * (q.y - o.y) - (p.y - o.y) * (q.x - o.x)))
    area = F.when(F.size("c") >= 3, F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v) / 2).otherwise(0.0)
    cells = cut(cells.withColumn("area", area).select("cell_id", "c", "area"))
    bad = cells.where("area <= 0").count()
    if bad:
        warnings.warn(f"a face needs three corners that are not on one line; {bad} cells are omitted", stacklevel=2)
    mean = lambda k: F.aggregate(f"c.{k}", F.lit(0.0), lambda a, v: a + v) / F.size("c")
    turned = F.array_sort(F.transform("c", lambda p: F.struct(F.atan2(p.y - F.col("my"), p.x - F.col("mx")).alias("turn"), p.x.alias("x"), p.y.alias("y"))))
    rings = cells.where("area > 0").withColumns({"mx": mean("x"), "my": mean("y")}).select("cell_id", turned.alias("c"))
    faces = dense_ids(rings, ["cell_id"], "face_id")
    corner = rings.join(faces, "cell_id").select("face_id", F.posexplode("c").alias("pos", "v")).select("face_id", "pos", "v.x", "v.y")
    nodes = dense_ids(corner, ["x", "y"], "node_id")
    placed = corner.join(nodes, ["x", "y"]).groupBy("face_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id"))).alias("c"))
    mesh = Mesh(nodes.select("node_id", "x", "y"), placed.select("face_id", F.col("c.node_id").alias("nodes")))
    return mesh, faces.select("face_id", F.col("cell_id").alias("of"))


def generate_disk(spark: SparkSession, partitions: int, depth: int) -> Mesh:
    """Triangles of a disk: ring ``k`` of ``depth`` has ``partitions * k`` nodes at the radius ``k / depth``.

    Node 0 is the centre; rings and places in a ring follow.
    """
    if partitions < 3 or depth < 1:
        raise ValueError("a disk needs at least three partitions and a depth of one")
    first = lambda k: 1 + partitions * k * (k - 1) / 2
    ring = spark.range(1, depth + 1).select(F.col("id").alias("k"))
    place = ring.select("k", F.explode(F.sequence(F.lit(0), partitions * F.col("k") - 1)).alias("j"))
    turn = 2 * F.pi() * F.col("j") / (partitions * F.col("k"))
    nodes = place.select((first(F.col("k")) + F.col("j")).cast("long").alias("node_id"), (F.col("k") / depth * F.cos(turn)).alias("x"), (F.col("k") / depth * F.sin(turn)).alias("y"))
    nodes = spark.createDataFrame([(0, 0.0, 0.0)], "node_id long, x double, y double").unionByName(nodes)
    # in each sector ring k has k nodes: k triangles point out, k - 1 point in
    k, s, j = F.col("k"), F.col("s"), F.col("j")
    sector = ring.select("k", F.explode(F.sequence(F.lit(0), F.lit(partitions - 1))).alias("s")).select("k", "s", F.explode(F.sequence(F.lit(0), k - 1)).alias("j"))
    node = lambda r, at: F.when(r == 0, F.lit(0)).otherwise((first(r) + F.pmod(at, F.greatest(F.lit(1), partitions * r))).cast("long"))
    inner, outer = s * (k - 1) + j, s * k + j
    out = sector.select("k", "s", "j", F.lit(0).alias("part"), F.array(node(k - 1, inner), node(k, outer), node(k, outer + 1)).alias("nodes"))
    into = sector.where("j < k - 1").select("k", "s", "j", F.lit(1).alias("part"), F.array(node(k - 1, inner), node(k, outer + 1), node(k - 1, inner + 1)).alias("nodes"))
    faces = out.unionByName(into)
    ids = dense_ids(faces, ["k", "s", "j", "part"], "face_id")
    return Mesh(nodes, faces.join(ids, ["k", "s", "j", "part"]).select("face_id", F.transform("nodes", lambda v: v.cast("long")).alias("nodes")))


def transform_nodes(nodes: DataFrame, scale: float = 1.0, dx: float = 0.0, dy: float = 0.0) -> DataFrame:
    """Nodes scaled about the origin and moved."""
    return nodes.select("node_id", (F.col("x") * scale + dx).alias("x"), (F.col("y") * scale + dy).alias("y"))


def disk(spark: SparkSession, partitions: int = 6, depth: int = 8) -> tuple[Mesh, DataFrame]:
    """A disk of diameter 10 around (5, 5), and ``(id, value)`` of its nodes: a cosine hill that is 1 in the middle."""
    mesh = generate_disk(spark, partitions, depth)
    r2 = F.col("x") * F.col("x") + F.col("y") * F.col("y")
    hill = mesh.nodes.select(F.col("node_id").alias("id"), ((F.cos(F.pi() * F.sqrt(r2)) + 1) / 2).alias("value"))
    return Mesh(transform_nodes(mesh.nodes, 5.0, 5.0, 5.0), mesh.faces), hill
