"""Regridding: sparse weights as a table, then a grouped reduction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.bins import box_join
from gridloom.operators.geometry import with_geometry
from gridloom.operators.mesh import Mesh, Network, dense_ids
from gridloom.operators.select import intersect_segments, locate_points


def axis(spark: SparkSession, breaks: list[float]) -> DataFrame:
    """``(idx, lo, hi, mid)`` of an axis; falling breaks keep their original index order."""
    rows = [(i, float(min(a, b)), float(max(a, b)), (a + b) / 2.0) for i, (a, b) in enumerate(zip(breaks, breaks[1:]))]
    return spark.createDataFrame(rows, "idx int, lo double, hi double, mid double")


def axis_overlap(source: DataFrame, target: DataFrame, relative: bool = False) -> DataFrame:
    """``(source, target, length)`` of overlapping cells of two axes; null bounds give no pair."""
    boxed = lambda a: a.where("lo is not null and hi is not null").select("idx", F.col("lo").alias("xmin"), F.col("hi").alias("xmax"), F.lit(0.0).alias("ymin"), F.lit(0.0).alias("ymax"))
    pairs = box_join(boxed(source), boxed(target))
    length = F.least("l_xmax", "r_xmax") - F.greatest("l_xmin", "r_xmin")
    length = length / (F.col("l_xmax") - F.col("l_xmin")) if relative else length
    return pairs.select(F.col("l_idx").alias("source"), F.col("r_idx").alias("target"), length.alias("length")).where("length > 0")


def axis_centroids(source: DataFrame, target: DataFrame) -> DataFrame:
    """``(source, target, length)`` with weight 1: target midpoints strictly inside the outer bounds, breaks to the lower index."""
    ends = source.agg(F.min("lo").alias("a"), F.max("hi").alias("b"))
    boxed = source.select("idx", F.col("lo").alias("xmin"), F.col("hi").alias("xmax"), F.lit(0.0).alias("ymin"), F.lit(0.0).alias("ymax"))
    points = target.crossJoin(F.broadcast(ends)).where("mid > a and mid < b").select("idx", F.col("mid").alias("xmin"), F.col("mid").alias("xmax"), F.lit(0.0).alias("ymin"), F.lit(0.0).alias("ymax"))
    pairs = box_join(points, boxed)
    return pairs.groupBy(F.col("l_idx").alias("target")).agg(F.min("r_idx").alias("source")).select("source", "target", F.lit(1.0).alias("length"))


def axis_linear(source: DataFrame, target: DataFrame) -> DataFrame:
    """``(source, target, length)``: two-point linear weights between midpoints, the nearest cell alone beyond the end midpoints.

    The gaps between neighbouring midpoints are boxes, and target midpoints are joined with them by bins.
    """
    if source.limit(2).count() < 2:
        raise ValueError("linear weights need an axis of at least two cells")
    rank = dense_ids(source, ["mid", "idx"], "rank")
    ends = source.agg(F.min("lo").alias("a"), F.max("hi").alias("b"), F.max(F.struct("mid", "idx")).alias("top"), F.min(F.struct("mid", "idx")).alias("low"))
    after = rank.select((F.col("rank") - 1).alias("rank"), F.col("idx").alias("next"), F.col("mid").alias("next_mid"))
    flat = {"ymin": F.lit(0.0), "ymax": F.lit(0.0)}
    gap = rank.join(after, "rank").select("idx", "mid", "next", "next_mid", F.col("mid").alias("xmin"), F.col("next_mid").alias("xmax")).withColumns(flat)
    inner = target.crossJoin(F.broadcast(ends)).where("mid >= a and mid <= b").select("idx", "mid", F.col("low.mid").alias("low"), F.col("low.idx").alias("low_idx"), F.col("top.mid").alias("top"), F.col("top.idx").alias("top_idx"))  # joined with one row
    outside = inner.where("mid <= low or mid >= top").select(F.when(F.col("mid") <= F.col("low"), F.col("low_idx")).otherwise(F.col("top_idx")).alias("source"), F.col("idx").alias("target"), F.lit(1.0).alias("length"))
    points = inner.where("mid > low and mid < top").select("idx", "mid", F.col("mid").alias("xmin"), F.col("mid").alias("xmax")).withColumns(flat)
    at = box_join(points, gap).where("r_mid <= l_mid and l_mid < r_next_mid")
    share = (F.col("l_mid") - F.col("r_mid")) / (F.col("r_next_mid") - F.col("r_mid"))
    both = F.array(F.struct(F.col("r_idx").alias("source"), (1 - share).alias("length")), F.struct(F.col("r_next").alias("source"), share.alias("length")))
    found = at.select(F.col("l_idx").alias("target"), F.inline(both)).where("length > 0").select("source", "target", "length")
    return found.unionByName(outside)


def axis_overlap_by(source: DataFrame, target: DataFrame, by: list[str], relative: bool = False) -> DataFrame:
    """``(*by, source, target, length)`` of overlapping cells of two axes in each group ``by``, such as a column of layers."""
    one = source.where("lo is not null and hi is not null").select(*by, F.col("idx").alias("source"), F.col("lo").alias("a"), F.col("hi").alias("b"))
    two = target.where("lo is not null and hi is not null").select(*by, F.col("idx").alias("target"), "lo", "hi")
    length = F.least("b", "hi") - F.greatest("a", "lo")
    pairs = one.join(two, by).where("a < hi and lo < b")  # the layers of one column
    return pairs.select(*by, "source", "target", (length / (F.col("b") - F.col("a")) if relative else length).alias("length")).where("length > 0")


def outer(x: DataFrame, y: DataFrame, source_nx: int, target_nx: int) -> DataFrame:
    """Weights of two rasters from those of their axes: ``(target_id, source_id, weight)``, ids row-major."""
    one = x.select(F.col("source").alias("sx"), F.col("target").alias("tx"), F.col("length").alias("wx"))
    two = y.select(F.col("source").alias("sy"), F.col("target").alias("ty"), F.col("length").alias("wy"))
    pairs = one.crossJoin(two)  # the weights themselves: a row for each pair of overlapping cells
    return pairs.select((F.col("ty").cast("long") * target_nx + F.col("tx")).alias("target_id"), (F.col("sy").cast("long") * source_nx + F.col("sx")).alias("source_id"), (F.col("wx") * F.col("wy")).alias("weight"))


def _padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers as rows of one width, and their lengths."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy()
    return out, sizes


def clipped_areas(sx: np.ndarray, sy: np.ndarray, n: np.ndarray, tx: np.ndarray, ty: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Areas of the intersections of pairs of convex counter-clockwise rings, all pairs a side at a time."""
    room = sx.shape[1] + tx.shape[1]
    x, y = (np.pad(v, ((0, 0), (0, room - v.shape[1]))) for v in (sx, sy))
    n, rows = n.copy(), np.arange(len(x))[:, None]
    for k in range(tx.shape[1]):
        after = np.where(k + 1 < m, k + 1, 0)
        px, py, qx, qy = tx[:, k], ty[:, k], tx[rows[:, 0], after], ty[rows[:, 0], after]
        valid = np.arange(room) < n[:, None]
        nxt = np.where(np.arange(room) + 1 < n[:, None], np.arange(room) + 1, 0)
        d = (qx - px)[:, None] * (y - py[:, None]) - (qy - py)[:, None] * (x - px[:, None])
        ahead = d[rows, nxt]
        kept = valid & (d >= 0)
        crossing = valid & ((d >= 0) != (ahead >= 0))
        t = np.divide(d, d - ahead, out=np.zeros_like(d), where=crossing)
        cx, cy = x + (x[rows, nxt] - x) * t, y + (y[rows, nxt] - y) * t
        keep = np.stack((kept, crossing), axis=2).reshape(len(x), -1)
        order = np.argsort(~keep, axis=1, kind="stable")[:, :room]
        nx_, ny_ = (np.take_along_axis(np.stack((v, c), axis=2).reshape(len(x), -1), order, axis=1) for v, c in ((x, cx), (y, cy)))
        on = k < m
        x, y, n = np.where(on[:, None], nx_, x), np.where(on[:, None], ny_, y), np.where(on, keep.sum(axis=1), n)
    valid = np.arange(room) < n[:, None]
    nxt = np.where(np.arange(room) + 1 < n[:, None], np.arange(room) + 1, 0)
    dx, dy = np.where(valid, x - x[:, :1], 0.0), np.where(valid, y - y[:, :1], 0.0)
    return np.where(n >= 3, np.abs((dx * dy[rows, nxt] - dy * dx[rows, nxt]).sum(axis=1)) / 2, 0.0)


def overlap_weights(source: Mesh, target: Mesh, relative: bool = False) -> DataFrame:
    """``(target_id, source_id, weight)``: intersection areas of convex faces, relative to the source face if asked."""
    columns = ("face_id", "ring", "area", "xmin", "ymin", "xmax", "ymax")
    pairs = box_join(with_geometry(source).select(*columns), with_geometry(target).select(*columns))
    pairs = pairs.select(F.col("r_face_id").alias("target_id"), F.col("l_face_id").alias("source_id"), "l_area", F.col("l_ring.x").alias("sx"), F.col("l_ring.y").alias("sy"), F.col("r_ring.x").alias("tx"), F.col("r_ring.y").alias("ty"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (sx, n), (sy, _), (tx, m), (ty, _) = (_padded(b.column(k)) for k in range(3, 7))
            w = clipped_areas(sx, sy, n, tx, ty, m)
            w = w / b.column(2).to_numpy(zero_copy_only=False) if relative else w
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(w, pa.float64())], ["target_id", "source_id", "weight"])

    return pairs.mapInArrow(run, "target_id long, source_id long, weight double").where("weight > 0")


def centroid_weights(source: Mesh, target: Mesh) -> DataFrame:
    """Weight 1 for the source face that holds a target's centroid."""
    points = with_geometry(target).select(F.col("face_id").alias("point_id"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    return locate_points(source, points).where("face_id is not null").select(F.col("point_id").alias("target_id"), F.col("face_id").alias("source_id"), F.lit(1.0).alias("weight"))


def network_weights(network: Network, target: Mesh) -> DataFrame:
    """Lengths of a network's edges in the faces of a mesh."""
    one, two = (network.nodes.select(F.col("node_id").alias(k), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}")) for i, k in enumerate("ab"))
    segments = network.edges.join(one, "a").join(two, "b").select(F.col("edge_id").alias("line_id"), F.lit(0).alias("pos"), "x0", "y0", "x1", "y1")
    length = F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)
    return intersect_segments(target, segments).select(F.col("face_id").alias("target_id"), F.col("line_id").alias("source_id"), length.alias("weight"))
