"""Queries through array files, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.data import MeshDataset
from gridloom.plans import fixtures as X
from gridloom.plans.grids import folder
from gridloom.plans.registry import register
from gridloom.sources.datasets import open_dataset, write_dataset

RANK = "o as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as id from orders)"


def _through_files(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    """The lines' prices on the orders' mesh, written and opened again; a box of faces and lines with each face's lowest corner."""
    array = X.line_array(spark, sf_dir)
    write_dataset(MeshDataset({"price": array}), path := folder(spark), form, {"mesh2d_nFaces": 4096, "mesh2d_nNodes": 4096, "line": 4})
    price = open_dataset(spark, path)["price"]
    box = price.df.where("id >= 300 and id < 9700 and line between 2 and 4").where("value is not null and not isnan(value)")
    corner = price.grid.faces.select(F.col("face_id").alias("id"), F.explode("nodes").alias("node_id")).join(price.grid.nodes, "node_id")
    return box.join(corner.groupBy("id").agg(F.min("x").alias("x"), F.min("y").alias("y")), "id").select("id", F.col("line").cast("long").alias("line"), F.round("value", 2).alias("value"), "x", "y")


SQL = f"""with {RANK} select id, cast(l_linenumber as bigint) as line, round(sum(round(l_extendedprice * 100)) / 100, 2) as value, cast(any_value(o_orderkey) % 50 as double) as x, cast(any_value(o_orderkey) // 50 as double) as y
    from lineitem join o on o_orderkey = l_orderkey where id >= 300 and id < 9700 and l_linenumber between 2 and 4 group by id, l_linenumber"""


@register("zarr_dataset", SQL)
def zarr_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through_files(spark, sf_dir, "zarr")


@register("netcdf_dataset", SQL)
def netcdf_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through_files(spark, sf_dir, "netcdf")
