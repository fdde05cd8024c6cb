"""Transformations against points that the public guidance publishes, round trips, and grids."""

import math

import pytest
from pyspark.sql import functions as F

from gridloom.data import MeshArray, MeshDataset, set_crs, to_crs
from gridloom.operators import crs
from gridloom.operators.crs import Ellipsoid, Geographic, LambertConic, Mercator, System, TransverseMercator, system
from gridloom.operators.mesh import Mesh

CLARKE = Ellipsoid(6378206.4, 294.9786982)
dms = lambda d, m=0.0, s=0.0: math.copysign(abs(d) + m / 60 + s / 3600, d)
#: Published examples: system, longitude and latitude on its own datum, east, north, tolerance.
POINTS = {
    "mercator": (System(Mercator(BESSEL := Ellipsoid(6377397.155, 299.1528128), 110.0, 0.997, 3900000.0, 900000.0)), 120.0, -3.0, 5009726.58, 569150.82),
    "web mercator": (system(3857), dms(-100, 20), dms(24, 22, 54.433), -11169055.58, 2800000.00),
    "transverse mercator": (System(TransverseMercator(Ellipsoid(6377563.396, 299.32496), 49.0, -2.0, 0.9996013, 400000.0, -100000.0)), 0.5, 50.5, 577274.99, 69740.50),
    "conic, one parallel": (System(LambertConic(CLARKE, 18.0, -77.0, (), 1.0, 250000.0, 150000.0)), dms(-76, 56, 37.26), dms(17, 55, 55.80), 255966.58, 142493.51),
    "stereographic": (System(system(28992).projection), 6.0, 53.0, 196105.283, 557057.739),
}


@pytest.mark.parametrize("name", sorted(POINTS))
def test_published_points(spark, name):
    own, lon, lat, east, north = POINTS[name]
    start = spark.createDataFrame([(lon, lat)], "x double, y double")
    geographic = System(Geographic(own.projection.ellipsoid))
    got = crs.transform(start, "x", "y", geographic, own)
    assert tuple(got.first()) == pytest.approx((east, north), abs=0.006)
    assert tuple(crs.transform(got, "x", "y", own, geographic).first()) == pytest.approx((lon, lat), abs=1e-9)


def test_round_trips_below_a_millimetre(spark):
    points = spark.createDataFrame([(i, 3.0 + i % 5, 49.0 + i * 0.13) for i in range(30)], "id long, x double, y double").withColumns({"lon": F.col("x"), "lat": F.col("y")})
    for code in (3857, 3395, 28992, 27700, 2154, 3034, 3812, 31370, 32631, 25832, 4258, 4289):
        there = crs.transform(points, "x", "y", 4326, code)
        back = crs.transform(there, "x", "y", code, 4326)
        off = back.agg(F.max(F.abs(F.col("x") - F.col("lon"))), F.max(F.abs(F.col("y") - F.col("lat")))).first()
        assert max(off) * 111_320 < 1e-3, code
    south = spark.createDataFrame([(31.0, -25.0)], "x double, y double")
    got = crs.transform(south, "x", "y", 4326, 32736).first()
    assert 200_000 < got.x < 400_000 and 7_000_000 < got.y < 7_300_000
    with pytest.raises(ValueError, match="not among"):
        system(9999)


def test_grids_change_systems(spark):
    nodes = spark.createDataFrame([(0, 155000.0, 463000.0), (1, 156000.0, 463000.0), (2, 155000.0, 464000.0)], "node_id long, x double, y double")
    mesh = Mesh(nodes, spark.createDataFrame([(0, [0, 1, 2])], "face_id long, nodes array<long>"))
    with pytest.raises(ValueError, match="no CRS"):
        to_crs(mesh, 4326)
    mesh = set_crs(mesh, 28992)
    with pytest.raises(ValueError):
        to_crs(mesh)
    assert to_crs(mesh, "EPSG:28992") is mesh
    array = MeshArray(mesh, "face", spark.createDataFrame([(0, 1.0)], "id long, value double")).to_crs(4326)
    assert array.grid.crs == "EPSG:4326" and array.grid.projected is False
    at = array.grid.nodes.where("node_id = 0").first()
    assert (at.x, at.y) == pytest.approx((5.38720, 52.15517), abs=2e-5)  # the tower on WGS 84
    both = MeshDataset({"a": MeshArray(mesh, "face", array.df), "b": MeshArray(mesh, "node", array.df)}).to_crs(epsg=32631)
    assert both["a"].grid is both["b"].grid and both["a"].grid.crs == "EPSG:32631" and both["a"].grid.projected


def test_beyond_a_pole_there_is_no_mercator(spark):
    points = spark.createDataFrame([(3.0, 89.0), (3.0, 100.0), (4.0, 220.0)], "x double, y double")
    got = crs.transform(points, "x", "y", 4326, 3857).orderBy("x", F.isnan("y")).collect()
    assert [math.isnan(r.y) for r in got] == [False, True, True] and got[0].y == pytest.approx(6378137 * math.log(math.tan(math.radians(89.5))))
    zone = [r.y for r in crs.transform(points.where("x = 3").union(points.where("y = 89").selectExpr("x", "80.0")), "x", "y", 4326, 32631).collect()]
    assert zone[1] == pytest.approx(zone[2])
