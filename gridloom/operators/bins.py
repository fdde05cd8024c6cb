"""Spatial joins on a bin index: boxes are dealt to square bins, joined by bin, and a pair kept once.

Bins come in sizes of powers of two.  A box is dealt to bins of at least its own size, so to four at most, on
its own level and on those of larger boxes of the other side; a pair meets on the level of the larger box.  So
one huge box among small ones makes no more rows than they do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("xmin", "ymin", "xmax", "ymax")
POINT = -64


def level(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """The level whose bins, of ``2**level``, are at least the box's longest side."""
    side = F.greatest(xmax - xmin, ymax - ymin)
    return F.when(side > 0, F.ceil(F.log2(side)) + 1).otherwise(POINT).cast("int")


def levels(boxes: DataFrame) -> list[int]:
    """The levels that occur; at most as many as there are powers of two between the sides."""
    return sorted(r[0] for r in boxes.select(level(*(F.col(c) for c in BOX)).alias("v")).where("v is not null").distinct().collect())


def _dealt(boxes: DataFrame, prefix: str, own: Column, deal: Column) -> DataFrame:
    size = F.pow(F.lit(2.0), F.col("_level"))
    rows = boxes.withColumn("_own", own).withColumn("_level", F.explode(deal))
    rows = rows.withColumn("_bx", F.explode(F.sequence(F.floor(F.col("xmin") / size), F.floor(F.col("xmax") / size))))
    rows = rows.withColumn("_by", F.explode(F.sequence(F.floor(F.col("ymin") / size), F.floor(F.col("ymax") / size))))
    return rows.select("_level", "_bx", "_by", F.col("_own").alias(f"_{prefix}own"), *(F.col(c).alias(f"{prefix}{c}") for c in boxes.columns))


def box_join(left: DataFrame, right: DataFrame, points: bool = False, few: bool = False) -> DataFrame:
    """Pairs of touching boxes, columns prefixed ``l_`` and ``r_``; each pair in its first common bin only.

    ``points``: the left boxes have no extent, so their level need not be looked for.  ``few``: the right side is
    small, and is broadcast.
    """
    one, two = [POINT] if points else levels(left), levels(right)
    sized = [v for v in (*one, *two) if v != POINT]
    least = min(sized) if sized else 0  # points use the smallest bins that there are

    def deal(boxes: DataFrame, prefix: str, others: list[int]) -> DataFrame:
        own = F.greatest(level(*(F.col(c) for c in BOX)), F.lit(least))
        others = sorted({max(v, least) for v in others}) or [least]
        return _dealt(boxes.where("xmin is not null and ymin is not null and xmax is not null and ymax is not null"), prefix, own, F.array_distinct(F.transform(F.array(*map(F.lit, others)), lambda v: F.greatest(v, own))))

    dealt = deal(right, "r_", one)
    pairs = deal(left, "l_", two).join(F.broadcast(dealt) if few else dealt, ["_level", "_bx", "_by"])
    size = F.pow(F.lit(2.0), F.col("_level"))
    meet = (F.col("l_xmin") <= F.col("r_xmax")) & (F.col("r_xmin") <= F.col("l_xmax")) & (F.col("l_ymin") <= F.col("r_ymax")) & (F.col("r_ymin") <= F.col("l_ymax"))
    first = (F.col("_bx") == F.floor(F.greatest("l_xmin", "r_xmin") / size)) & (F.col("_by") == F.floor(F.greatest("l_ymin", "r_ymin") / size))
    return pairs.where(meet & first & (F.col("_level") == F.greatest("_l_own", "_r_own"))).drop("_level", "_bx", "_by", "_l_own", "_r_own")


def binned(boxes: DataFrame, size: float, prefix: str) -> DataFrame:
    """A row for each bin of one size that a box touches, its columns renamed with ``prefix``."""
    low, high = (lambda c: F.floor(F.col(c) / size)), (lambda c: F.floor(F.col(c) / size))
    spread = boxes.withColumn("_bx", F.explode(F.sequence(low("xmin"), high("xmax")))).withColumn("_by", F.explode(F.sequence(low("ymin"), high("ymax"))))
    return spread.select("_bx", "_by", *(F.col(c).alias(f"{prefix}{c}") for c in boxes.columns))


def as_boxes(points: DataFrame) -> DataFrame:
    """Points as boxes without extent."""
    return points.withColumns({"xmin": F.col("x"), "ymin": F.col("y"), "xmax": F.col("x"), "ymax": F.col("y")})


def inside_convex(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in or on a convex counter-clockwise ring."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    left = F.zip_with(ring, after, lambda p, q: (q.x - p.x) * (y - p.y) - (q.y - p.y) * (x - p.x) >= 0)
    return F.forall(left, lambda v: v)


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule for any simple ring; points on a side count as inside."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))

    def turn(p: Column, q: Column) -> Column:
        return (q.x - p.x) * (y - p.y) - (q.y - p.y) * (x - p.x)

    def crossing(p: Column, q: Column) -> Column:
        return (((p.y > y) != (q.y > y)) & ((turn(p, q) > 0) == (q.y > p.y))).cast("int")

    def touching(p: Column, q: Column) -> Column:
        return (turn(p, q) == 0) & x.between(F.least(p.x, q.x), F.greatest(p.x, q.x)) & y.between(F.least(p.y, q.y), F.greatest(p.y, q.y))

    odd = F.aggregate(F.zip_with(ring, after, crossing), F.lit(0), lambda a, v: a + v) % 2 == 1
    return odd | F.exists(F.zip_with(ring, after, touching), lambda v: v)
