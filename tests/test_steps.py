"""What a query makes is made once: tables are counted as they are read, and steps that nobody asks for are not run."""

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.data import MeshArray, MeshDataset, merge_partitions
from gridloom.operators import geometry, graph, mesh as meshes, select, vector, voronoi
from gridloom.operators.mesh import Mesh, structured
from gridloom.operators.periodic import to_nonperiodic, to_periodic
from gridloom.plans import catalog
from gridloom.sources import wkt


def counting(spark, df, column):
    """``df`` whose ``column`` counts the rows that are made."""
    made = spark.sparkContext.accumulator(0)

    def same(v):
        made.add(1)
        return v

    return df.withColumn(column, F.udf(same, df.schema[column].dataType)(column)), made


def test_holes_are_filled_in_one_search(spark, monkeypatch):
    calls = []
    nearest = select.nearest
    monkeypatch.setattr(select, "nearest", lambda *a, **b: calls.append(1) or nearest(*a, **b))
    places = spark.createDataFrame([(i, float(i), 0.1 * i) for i in range(9)], "id long, x double, y double")
    places, made = counting(spark, places, "x")
    data = spark.createDataFrame([(i, line, None if line == 1 and i % 4 == 1 else float(10 * line + i)) for i in range(9) for line in (1, 2)], "id long, line int, value double")
    got = {(r.id, r.line): r.value for r in graph.fill_nearest(places, data, 1.5, ("line",)).collect()}
    assert len(got) == 18 and got[1, 1] == 10.0 and got[5, 1] == 14.0 and got[1, 2] == 21.0
    assert len(calls) == 1  # the second line has no holes
    assert made.value == 9
    far = {r.id: r.value for r in graph.fill_nearest(places, data.where("line = 1").drop("line"), 0.5).collect()}
    assert far[1] is None and far[5] is None and far[2] == 12.0


@pytest.mark.parametrize("limit", [None, 0.0, 1e-30, 0.3, 5.0])
def test_nearest_within_any_distance(spark, limit):
    targets = [(i, (i * 37 % 11) / 3.0, (i * 17 % 7) / 2.0) for i in range(20)]
    points = [(k, k * 0.7 - 4.0, k * 0.31 - 1.0) for k in range(20)] + [(90, 12.0, 2.0), (91, targets[3][1], targets[3][2])]
    got = select.nearest(spark.createDataFrame(points, "point_id long, x double, y double"), spark.createDataFrame(targets, "id long, x double, y double"), max_distance=limit)
    got = {r.point_id: r.id for r in got.collect()}
    for p, x, y in points:
        d, i = min(((((x - a) ** 2 + (y - b) ** 2) ** 0.5), i) for i, a, b in targets)
        assert got[p] == (i if limit is None or d < limit else None), (p, limit)


def test_faces_of_selected_points_are_made_once(spark):
    mesh = structured(spark, 6, 4)
    nodes, made = counting(spark, mesh.nodes, "x")
    data = mesh.faces.select(F.col("face_id").alias("id"), F.col("face_id").cast("double").alias("value"))
    points = spark.createDataFrame([(k, 0.37 * k, 0.21 * k) for k in range(20)], "point_id long, x double, y double")
    got = {r.point_id: r.value for r in MeshArray(Mesh(nodes, mesh.faces), "face", data).sel_points(points, method="nearest", out_of_bounds="ignore", fill=-1.0).collect()}
    assert got == {k: float(int(0.21 * k) * 6 + int(0.37 * k)) if 0.37 * k <= 6 and 0.21 * k <= 4 else -1.0 for k in range(20)}
    assert made.value == 35


def test_few_polygons_are_broadcast(spark):
    mesh = structured(spark, 6, 4)
    nodes, made = counting(spark, mesh.nodes, "x")
    ring = "array<struct<x:double,y:double>>"
    box = lambda a, b, c, d: [(float(a), float(b)), (float(c), float(b)), (float(c), float(d)), (float(a), float(d))]
    rows = spark.createDataFrame([(0, box(0, 0, 3, 4), None, 1.0), (1, box(1, 1, 6, 3), [box(2, 1, 4, 2)], 2.0)], f"row long, ring {ring}, holes array<{ring}>, value double")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = vector.burn_polygons(Mesh(nodes, mesh.faces), rows)
        assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
        got = {r.face_id: r.value for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    inner = lambda i: 1 <= i % 6 < 6 and 1 <= i // 6 < 3 and not (2 <= i % 6 < 4 and i // 6 == 1)
    assert got == {i: 2.0 if inner(i) else 1.0 for i in range(24) if inner(i) or i % 6 < 3}
    assert made.value == 35


def test_texts_are_read_once(spark):
    texts = spark.createDataFrame([(i, f"POLYGON (({i} 0,  {i + 1} 0, {i + 1} 1.5, {i} 0))") for i in range(5)], "id long, wkt string")
    texts, made = counting(spark, texts, "wkt")
    got = geometry.with_geometry(wkt.grid_from_wkt(texts)).select("face_id", "area").collect()
    assert sorted(tuple(r) for r in got) == [(i, 0.75) for i in range(5)]
    assert made.value == 5
    with pytest.raises(ValueError, match="MULTIPOLYGON"):
        wkt.grid_from_wkt(spark.createDataFrame([(0, "MULTIPOLYGON (((a b)))")], "id long, wkt string"))


def test_edges_of_periodic_meshes_wait(spark):
    m = structured(spark, 4, 2)
    ring, index = to_periodic(m)
    back, other = to_nonperiodic(ring, 4.0)
    assert back.faces.count() == 8 and back.nodes.count() == 15
    assert not any("edges" in g.__dict__ for g in (m, ring, back))
    assert index["edge"].count() == ring.edges.count() == 20 and other["edge"].count() == back.edges.count() == 22
    with pytest.raises(KeyError):
        index["volume"]


def test_geometry_of_any_ring(spark):
    shapes = {0: [(0, 0), (2, 0), (1, 3)], 1: [(0, 0), (2, 0), (2, 1), (0, 1)], 2: [(0, 0), (2, 0), (3, 1), (2, 2), (0, 2)], 3: [(0, 0), (0, 1), (2, 1), (2, 0)], 4: [(1, 1), (2, 2), (3, 3)], 5: [(5, 5), (6, 6)]}
    nodes = [(10 * f + k, float(x), float(y)) for f, ring in shapes.items() for k, (x, y) in enumerate(ring)]
    mesh = Mesh(spark.createDataFrame(nodes, "node_id long, x double, y double"), spark.createDataFrame([(f, [10 * f + k for k in range(len(r))]) for f, r in shapes.items()], "face_id long, nodes array<long>"))
    rows = geometry.with_geometry(mesh)
    got = {r.face_id: r for r in rows.collect()}
    assert [got[f].area for f in range(6)] == [3.0, 2.0, 5.0, 2.0, 0.0, 0.0]
    assert (got[0].cx, got[0].cy) == (1.0, 1.0) and (got[3].cx, got[3].cy) == (1.0, 0.5) and got[2].cx == pytest.approx(19 / 15) and got[5].cx is None
    assert [(got[f].xmin, got[f].ymin, got[f].xmax, got[f].ymax) for f in (0, 2, 5)] == [(0, 0, 2, 3), (0, 0, 3, 2), (5, 5, 6, 6)]
    assert got[1].perimeter == 6.0


def test_all_holes_are_filled_however_far(spark, tmp_path):
    keys = [*range(200), 2_005, *range(5_000, 5_050)]  # 2005 is a quad far from all others, and has no value
    rows = spark.createDataFrame([(k, k, 100.0 + k) for k in keys], "o_orderkey long, o_custkey long, o_totalprice double")
    rows.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = {(r.id, r.line): r.value for r in catalog.QUERIES["interpolate_na"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    want = {(i, line): v for i, line, v in con.execute(catalog.ORACLES["interpolate_na"]).fetchall()}
    assert None not in got.values() and got == want
    near = con.execute(catalog.ORACLES["interpolate_na"].partition("select face_id as id")[0] + "select (select count(*) from near), (select count(*) from far)").fetchone()
    assert near[1] == 1 and sum(near) == len([i for i, line in got if line == 1 and i % 5 == 0])


def test_parts_are_made_once_and_have_no_edges_until_asked(spark):
    mesh = structured(spark, 6, 4)
    nodes, made = counting(spark, mesh.nodes, "x")
    mesh = Mesh(nodes, mesh.faces)
    data = MeshArray(mesh, "face", mesh.faces.select(F.col("face_id").alias("id"), F.col("face_id").cast("double").alias("value")))
    parts = MeshDataset({"v": data}).partition_by_label(mesh.faces.select("face_id", (F.col("face_id") % 3).alias("label")))
    merged = merge_partitions([*parts, parts[1]])
    assert merged.grid.faces.count() == 24 and merged.grid.nodes.count() == 35
    assert sorted(r.value for r in merged["v"].df.collect()) == [float(k) for k in range(24)]
    assert made.value == 35 and "edges" not in mesh.__dict__


def test_shuffles_leave_no_files(spark, tmp_path):
    spark.range(200).selectExpr("id as o_orderkey", "id as o_custkey", "100.0D + id as o_totalprice").write.parquet(str(tmp_path / "orders.parquet"))
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    kept = lambda: {b for b in (str(x) for x in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(folder.getAllBlocks())) if b.startswith("shuffle_")}
    before = kept()
    got = catalog.QUERIES["merge_partitions"](spark, str(tmp_path))
    assert got.count() == 300 and len(got.collect()) == 300
    assert not kept() - before
    assert len(got.collect()) == 300  # a table that is run once more makes its shuffles again


def test_cells_number_no_edges_but_those_of_the_border(spark, monkeypatch):
    mesh, ranked = structured(spark, 6, 4), []
    ranks = meshes.dense_ids
    monkeypatch.setattr(voronoi, "dense_ids", lambda df, keys, *a, **b: ranked.append((keys, df.count())) or ranks(df, keys, *a, **b))
    monkeypatch.setattr(meshes, "dense_ids", lambda df, keys, *a: ranked.append((keys, df.count())) or ranks(df, keys, *a))
    v = voronoi.tessellation(mesh, add_exterior=True, add_vertices=True)
    assert [n for keys, n in ranked if keys == ["a", "b"]] == [20]
    got = geometry.with_geometry(voronoi.as_mesh(mesh, v))
    assert got.count() == 35 and got.agg(F.sum("area")).first()[0] == pytest.approx(24.0)
    assert v.vertices.count() == 24 + 20 + 20 and v.between.count() == 20


def test_short_rings_need_no_rounds(spark, monkeypatch):
    mesh, rounds = structured(spark, 9, 7), []
    put = vector.Round.put
    monkeypatch.setattr(vector.Round, "put", lambda *a: rounds.append(1) or put(*a))
    data = mesh.faces.select("face_id", F.when(F.col("face_id") % 11 == 0, F.lit(None)).otherwise(F.col("face_id") * 7 % 5 % 2).cast("double").alias("value"))
    short = sorted(tuple(r) for r in vector.outlines(mesh, data).collect())
    assert not rounds and "edges" not in mesh.__dict__
    mixed = sorted(tuple(r) for r in vector.outlines(mesh, data, few=8).collect())
    assert rounds and mixed == short
    ends = {}
    for label, _, ring, pos, x, y, _ in short:
        ends.setdefault((label, ring), []).append((pos, x, y))
    area = 0.0
    for ring in ends.values():
        assert [p for p, _, _ in ring] == list(range(len(ring)))
        steps = list(zip(ring, ring[1:] + ring[:1]))
        assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in steps)
        area += sum(a[1] * b[2] - b[1] * a[2] for a, b in steps) / 2
    assert area == data.where("value is not null").count()


def test_fill_numbers_no_edges_and_makes_places_once(spark):
    mesh = structured(spark, 16, 20)
    nodes, made = counting(spark, mesh.nodes, "x")
    mesh = Mesh(nodes, mesh.faces)
    x, y = F.col("face_id") % 16, F.floor(F.col("face_id") / 16)
    plane = (3 * x + 2 * y).cast("double")
    data = mesh.faces.select(F.col("face_id").alias("id"), F.when((x == 0) | (x == 15) | (y == 0) | (y == 19), plane).alias("value"))
    got = MeshArray(mesh, "face", data).laplace_interpolate(tolerance=1e-12).df
    want = mesh.faces.select(F.col("face_id").alias("id"), plane.alias("want"))
    assert got.join(want, "id").where(F.abs(F.col("value") - F.col("want")) < 1e-9).count() == 320
    assert "edges" not in mesh.__dict__ and made.value == 17 * 21
