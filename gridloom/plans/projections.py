"""Queries on coordinate systems, and their SQL by other formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.data import set_crs, to_crs
from gridloom.operators.mesh import Mesh
from gridloom.plans import fixtures as X
from gridloom.plans.registry import register

PLACES = "g as (select node_id, x, y, 3 + x / 10 as lon, 40 + y / 100 as lat, radians(40 + y / 100) as p from node)"


def _places(spark: SparkSession, sf_dir: str) -> Mesh:
    """The orders' mesh over western Europe, a node each tenth of a degree east and hundredth north."""
    mesh = X.order_mesh(spark, sf_dir)
    nodes = mesh.nodes.select("node_id", (3 + F.col("x") / 10).alias("x"), (40 + F.col("y") / 100).alias("y"))
    return set_crs(Mesh(nodes, mesh.faces, projected=False), 4326)


def _rounded(mesh: Mesh, digits: int) -> DataFrame:
    return mesh.nodes.select("node_id", F.round("x", digits).alias("x"), F.round("y", digits).alias("y"))


NODES = "node as (select distinct node_id, cast(node_id % 51 as double) as x, cast(node_id // 51 as double) as y from (select unnest([k, k + 1, k + 51, k + 52]) as node_id from (select o_orderkey // 50 * 51 + o_orderkey % 50 as k from orders)))"


@register("web_mercator", f"with {NODES}, {PLACES} select node_id, round(6378137 * radians(lon), 2) as x, round(6378137 * ln(tan(pi() / 4 + p / 2)), 2) as y from g")
def web_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(to_crs(_places(spark, sf_dir), 3857), 2)


@register(
    "utm_zone",
    # the third flattening and the coefficients by Horner's rule
    f"""with {NODES}, {PLACES}, k as (select 0.0016792203863837047 as n, 0.08181919084262149 as e),
    w as (select *, 6378137 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) * 0.9996 as r, n * (1 / 2 + n * (-2 / 3 + n * (5 / 16 + n * 41 / 180))) as a1, n ** 2 * (13 / 48 + n * (-3 / 5 + n * 557 / 1440)) as a2, n ** 3 * (61 / 240 - n * 103 / 140) as a3, n ** 4 * 49561 / 161280 as a4, radians(lon - 3) as d, sinh(atanh(sin(p)) - e * atanh(e * sin(p))) as t from g, k where node_id % 51 <= 30),
    v as (select *, atan2(t, cos(d)) as u, atanh(sin(d) / sqrt(1 + t * t)) as v from w)
    select node_id, round(500000 + r * (v + a1 * cos(2 * u) * sinh(2 * v) + a2 * cos(4 * u) * sinh(4 * v) + a3 * cos(6 * u) * sinh(6 * v) + a4 * cos(8 * u) * sinh(8 * v)), 2) as x,
        round(r * (u + a1 * sin(2 * u) * cosh(2 * v) + a2 * sin(4 * u) * cosh(4 * v) + a3 * sin(6 * u) * cosh(6 * v) + a4 * sin(8 * u) * cosh(8 * v)), 2) as y from v""",
)
def utm_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = to_crs(_places(spark, sf_dir), 32631)
    return _rounded(mesh, 2).where((F.col("node_id") % 51) <= 30)


@register("crs_round_trip", f"with {NODES}, {PLACES} select node_id, round(lon, 7) as x, round(lat, 7) as y from g")
def crs_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the conic, a stereographic system of another datum, and back."""
    mesh = _places(spark, sf_dir)
    for code in (2154, 4258, 28992, 4326):
        mesh = to_crs(mesh, code)
    return _rounded(mesh, 7)
