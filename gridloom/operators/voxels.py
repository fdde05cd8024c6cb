"""Overlap in three dimensions: columns over the cells of two grids, each with layers of its own.

Horizontal weights say which columns meet.  In each pair of columns the bottoms of both columns' layers are
swept in rising order, and the layer of either column that holds a place is carried along, so a pair makes as
many rows as its columns have layers together, not as many as their product.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import reduce


def voxel_weights(weights: DataFrame, source: DataFrame, target: DataFrame, relative: bool = False) -> DataFrame:
    """``(target_id, target_layer, source_id, source_layer, weight)``: weights times the height that layers share.

    ``source(source_id, layer, bottom, top)`` and ``target(target_id, layer, bottom, top)``: the layers of a
    column do not overlap, but may leave gaps.  Layers without a height, or with a null or NaN one, hold
    nothing.  ``relative`` divides by the height of the source's layer.
    """
    pairs = weights.select("target_id", "source_id", "weight")
    layer = F.struct("layer", "bottom", "top")
    solid = lambda df: df.where(F.nanvl("top", F.lit(None).cast("double")) > F.nanvl("bottom", F.lit(None).cast("double")))
    kind = solid(source).select(layer.alias("l")).schema["l"].dataType
    none = F.lit(None).cast(kind)
    rows = pairs.join(solid(source).select("source_id", F.col("bottom").alias("z"), layer.cast(kind).alias("s")), "source_id").withColumn("t", none)
    other = pairs.join(solid(target).select("target_id", F.col("bottom").alias("z"), layer.cast(kind).alias("t")), "target_id").withColumn("s", none)
    rows = rows.unionByName(other)
    along = Window.partitionBy("target_id", "source_id").orderBy("z")  # the layers of two columns
    rows = rows.withColumns({"s": F.last("s", ignorenulls=True).over(along), "t": F.last("t", ignorenulls=True).over(along), "next": F.lead("z").over(along)})
    height = F.least("next", "s.top", "t.top") - F.col("z")
    rows = rows.where(F.col("s").isNotNull() & F.col("t").isNotNull()).withColumn("height", height).where("height > 0")
    share = F.col("height") / (F.col("s.top") - F.col("s.bottom")) if relative else F.col("height")
    return rows.select("target_id", F.col("t.layer").alias("target_layer"), "source_id", F.col("s.layer").alias("source_layer"), (F.col("weight") * share).alias("weight"))


def regrid_voxels(weights: DataFrame, source: DataFrame, target: DataFrame, data: DataFrame, method: str | Callable = "mean", relative: bool = False) -> DataFrame:
    """``(target_id, layer, value)`` for every layer of ``target`` from ``data(source_id, layer, value)``."""
    both = voxel_weights(weights, source, target, relative)
    named = both.select(F.struct("target_id", F.col("target_layer").alias("layer")).alias("target_id"), F.struct("source_id", F.col("source_layer").alias("layer")).alias("source_id"), "weight")
    values = data.select(F.struct("source_id", "layer").alias("source_id"), "value")
    found = reduce.reduce_weights(named, values, target.select(F.struct("target_id", "layer").alias("target_id")), method)
    return found.select("target_id.target_id", "target_id.layer", "value")
