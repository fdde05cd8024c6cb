"""Regridders: the weights between two grids, kept as a table and applied to any number of arrays."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import reduce, regrid
from gridloom.operators.barycentric import barycentric_weights
from gridloom.operators.mesh import Mesh, Network, from_breaks
from gridloom.sources.tables import read_mesh, read_weights, write_mesh, write_weights


@dataclass(frozen=True)
class Raster:
    """A raster of cells between breaks, numbered row by row; ``data(source_id, *dims, value)`` refers to these numbers."""

    spark: SparkSession
    x: tuple[float, ...]
    y: tuple[float, ...]

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.y) - 1, len(self.x) - 1

    def axes(self) -> tuple[DataFrame, DataFrame]:
        return regrid.axis(self.spark, list(self.x)), regrid.axis(self.spark, list(self.y))

    def area(self) -> DataFrame:
        """``(id, area)`` of the cells."""
        x, y = self.axes()
        wide = len(self.x) - 1
        cells = y.select(F.col("idx").alias("iy"), (F.col("hi") - F.col("lo")).alias("dy")).join(x.select(F.col("idx").alias("ix"), (F.col("hi") - F.col("lo")).alias("dx")))  # a row for each cell
        return cells.select((F.col("iy").cast("long") * wide + F.col("ix")).alias("id"), (F.col("dx") * F.col("dy")).alias("area"))

    def to_mesh(self) -> Mesh:
        return from_breaks(self.spark, list(self.x), list(self.y))

    def ids(self) -> DataFrame:
        return self.spark.range(self.shape[0] * self.shape[1]).select(F.col("id").alias("target_id"))


Side = Raster | Mesh | Network


def setup_grid(grid: Side) -> Side:
    if not isinstance(grid, (Raster, Mesh, Network)):
        raise TypeError(f"expected a Raster, Mesh or Network, not {type(grid).__name__}")
    return grid


def convert_to_match(source: Side, target: Side) -> tuple[Side, Side]:
    """Two rasters stay; if one side is a mesh, so is the other."""
    if isinstance(source, Raster) and isinstance(target, Raster):
        return source, target
    return tuple(g.to_mesh() if isinstance(g, Raster) else g for g in (source, target))


def target_ids(grid: Side) -> DataFrame:
    return grid.ids() if isinstance(grid, Raster) else grid.faces.select(F.col("face_id").alias("target_id"))


class Regridder:
    """Base of the regridders; ``weights(target_id, source_id, weight)`` are a lazy table."""

    relative: bool | None = False
    default = "mean"

    def __init__(self, source: Side | None, target: Side, method: str | reduce.Reducer | Callable | None = None, weights: DataFrame | None = None, tolerance: float | None = None):
        self.source, self.target, self.tolerance = source, setup_grid(target), tolerance
        self.method = method or self.default
        reduce.method_of(self.method, self.relative)
        self.weights = weights if weights is not None else self.compute(*self.matched(setup_grid(source), target))

    def matched(self, source: Side, target: Side) -> tuple[Side, Side]:
        return convert_to_match(source, target)

    def compute(self, source: Side, target: Side) -> DataFrame:
        raise NotImplementedError

    def regrid(self, data: DataFrame, dims: tuple[str, ...] = ()) -> DataFrame:
        """``(*dims, target_id, value)`` of ``data(source_id, *dims, value)`` for every target."""
        missing = {"source_id", "value", *dims} - set(data.columns)
        if missing:
            raise ValueError(f"the data have no columns {sorted(missing)}")
        return reduce.reduce_weights(self.weights, data, target_ids(self.target), reduce.method_of(self.method, self.relative), dims)

    def weights_as_dataframe(self) -> DataFrame:
        return self.weights.select(F.col("target_id").alias("target_index"), F.col("source_id").alias("source_index"), "weight")

    @classmethod
    def from_weights(cls, weights: DataFrame, target: Side, method: str | None = None) -> Regridder:
        """Rebuilt without computing anything again; the weights must have their three columns."""
        missing = {"target_id", "source_id", "weight"} - set(weights.columns)
        if missing:
            raise ValueError(f"the weights have no columns {sorted(missing)}")
        return cls(None, target, method, weights)

    def to_dataset(self, folder: str) -> None:
        """Keep the weights, the target and the method in a folder."""
        write_weights(self.weights, f"{folder}/weights")
        spark = self.weights.sparkSession
        raster = isinstance(self.target, Raster)
        if not raster:
            write_mesh(self.target, f"{folder}/target")
        facts = {"method": self.method if isinstance(self.method, str) else None, "x": list(self.target.x) if raster else None, "y": list(self.target.y) if raster else None}
        spark.createDataFrame([(json.dumps(facts),)], "facts string").write.parquet(f"{folder}/facts")

    @classmethod
    def from_dataset(cls, spark: SparkSession, folder: str) -> Regridder:
        facts = json.loads(spark.read.parquet(f"{folder}/facts").first().facts)
        target = read_mesh(spark, f"{folder}/target") if facts["x"] is None else Raster(spark, tuple(facts["x"]), tuple(facts["y"]))
        return cls.from_weights(read_weights(spark, f"{folder}/weights"), target, facts["method"])


class OverlapRegridder(Regridder):
    """Weights are areas of intersection."""

    def compute(self, source: Side, target: Side) -> DataFrame:
        if isinstance(source, Raster):
            (sx, sy), (tx, ty) = source.axes(), target.axes()
            return regrid.outer(regrid.axis_overlap(sx, tx, bool(self.relative)), regrid.axis_overlap(sy, ty, bool(self.relative)), source.shape[1], target.shape[1])
        return regrid.overlap_weights(source, target, bool(self.relative))

    @staticmethod
    def create_percentile_method(percentile: float) -> Callable[[], Column]:
        return reduce.percentile(percentile)


class RelativeOverlapRegridder(OverlapRegridder):
    """Weights are areas of intersection over those of the source."""

    relative = True
    default = "first_order_conservative"


class CentroidLocatorRegridder(Regridder):
    """The value of the source cell that holds the target's centre."""

    def compute(self, source: Side, target: Side) -> DataFrame:
        if isinstance(source, Raster):
            (sx, sy), (tx, ty) = source.axes(), target.axes()
            return regrid.outer(regrid.axis_centroids(sx, tx), regrid.axis_centroids(sy, ty), source.shape[1], target.shape[1])
        return regrid.centroid_weights(source, target)


class BarycentricInterpolator(Regridder):
    """Bilinear between rasters, else barycentric between the source's centroids."""

    def compute(self, source: Side, target: Side) -> DataFrame:
        if isinstance(source, Raster):
            (sx, sy), (tx, ty) = source.axes(), target.axes()
            return regrid.outer(regrid.axis_linear(sx, tx), regrid.axis_linear(sy, ty), source.shape[1], target.shape[1])
        return barycentric_weights(source, target, self.tolerance)


class NetworkGridder(Regridder):
    """Edges of a network into faces; weights are lengths."""

    def matched(self, source: Side, target: Side) -> tuple[Side, Side]:
        if not isinstance(source, Network):
            raise TypeError(f"expected a Network, not {type(source).__name__}")
        return source, target.to_mesh() if isinstance(target, Raster) else target

    def compute(self, source: Side, target: Side) -> DataFrame:
        return regrid.network_weights(source, target)
