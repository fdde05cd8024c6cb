"""Hand-computed meshes: connectivity, geometry, selection, reducers, regridding, graphs, vector geometry, partitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import connectivity as C
from gridloom.operators import facets, geometry, graph, multigrid, partition, reduce, regrid, select, vector
from gridloom.operators.components import connected_components
from gridloom.operators.mesh import Mesh, Network, edges, from_breaks, from_lines, from_polygons, structured
from gridloom.operators.periodic import to_periodic
from gridloom.sources.tables import read_mesh, read_weights, write_mesh, write_weights

XY = [(0, 0), (1, 0), (2, 0), (0, 1), (1, 1), (2, 1), (1, 2)]
FACES = [[0, 1, 4, 3], [1, 2, 5, 4], [3, 4, 6], [4, 5, 6]]


@pytest.fixture(scope="module")
def house(spark):
    nodes = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(XY)], "node_id long, x double, y double")
    return Mesh(nodes, spark.createDataFrame(list(enumerate(FACES)), "face_id long, nodes array<long>"))


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_edges_are_ranked_pairs(house):
    assert rows(edges(house), "edge_id") == [(i, a, b) for i, (a, b) in enumerate([(0, 1), (0, 3), (1, 2), (1, 4), (2, 5), (3, 4), (3, 6), (4, 5), (4, 6), (5, 6)])]


def test_edge_faces_and_exterior(house):
    ef = {(r.a, r.b): (r.f1, r.f2) for r in C.edge_faces(house).collect()}
    assert ef[1, 4] == (0, 1) and ef[0, 1] == (0, None) and ef[4, 6] == (2, 3)
    assert rows(C.exterior_faces(house), "face_id") == [(0,), (1,), (2,), (3,)]
    assert C.face_faces(house).count() == 8


def test_geometry(house):
    g = {r.face_id: r for r in geometry.with_geometry(house).collect()}
    assert [g[i].area for i in range(4)] == [1.0, 1.0, 0.5, 0.5]
    assert g[0].perimeter == 4.0 and math.isclose(g[2].perimeter, 2 + math.sqrt(2))
    assert (g[0].cx, g[0].cy) == (0.5, 0.5) and math.isclose(g[2].cx, 2 / 3)


def test_triangles_and_orientation(house):
    assert geometry.triangles(house).count() == 6
    turned = Mesh(house.nodes, house.faces.withColumn("nodes", F.reverse("nodes")))
    assert rows(geometry.with_geometry(geometry.counterclockwise(turned)).select("area"), "area") == [(0.5,), (0.5,), (1.0,), (1.0,)]


def test_box_points_and_raster(spark, house):
    assert rows(select.sel_box(house, (1.25, 2.5), (0.25, 1.5)), "face_id") == [(1,), (3,)]
    points = spark.createDataFrame([(0, 0.5, 0.5), (1, 1.5, 1.2), (2, -1.0, 0.0), (3, 1.0, 0.5)], "point_id long, x double, y double")
    assert rows(select.locate_points(house, points), "point_id") == [(0, 0), (1, 3), (2, None), (3, 0)]
    raster = [[r[0] for r in rows(select.rasterize(house, 0.5).where(f"row = {k}").select("face_id", "col"), "col")] for k in range(4)]
    assert raster[0] == [None, 2, 3, None] and raster[3] == [0, 0, 1, 1]


def test_nearest_finds_far_targets(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0), (1, 100.0, 3.0), (2, -500.0, 0.0)], "point_id long, x double, y double")
    targets = spark.createDataFrame([(7, 1.0, 0.0), (8, 90.0, 3.0), (6, -1.0, 0.0)], "id long, x double, y double")
    assert rows(select.nearest(points, targets), "point_id") == [(0, 6, 1.0), (1, 8, 10.0), (2, 6, 499.0)]
    assert rows(select.nearest(points, targets, max_distance=10.0), "point_id") == [(0, 6, 1.0), (1, None, None), (2, None, None)]


def test_line_through_house(spark, house):
    line = spark.createDataFrame([(0, 0, 0.0, 0.0, 2.0, 2.0)], "line_id long, pos int, x0 double, y0 double, x1 double, y1 double")
    found = rows(select.intersect_linestring(house, line).select("face_id", F.round("s", 9)), "face_id")
    assert found == [(0, round(0.5 * math.sqrt(2), 9)), (3, round(1.25 * math.sqrt(2), 9))]


@pytest.mark.parametrize("method, expected", [("mean", 1.0), ("harmonic_mean", 1.0 / (0.5 / 1 + 0.5 / 2)), ("geometric_mean", math.sqrt(2)), ("sum", 3.0), ("minimum", 0.0), ("maximum", 2.0), ("mode", 2.0), ("median", 1.0), ("conservative", 1.5), ("max_overlap", 2.0)])
def test_reducers(spark, method, expected):
    weights = spark.createDataFrame([(0, k, 0.5) for k in range(4)], "target_id long, source_id long, weight double")
    data = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 2.0), (3, float("nan"))], "source_id long, value double")
    targets = spark.createDataFrame([(0,), (1,)], "target_id long")
    assert rows(reduce.reduce_weights(weights, data, targets, method), "target_id") == [(0, pytest.approx(expected)), (1, None)]


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        reduce.reduce_weights(spark.range(0), spark.range(0), spark.range(0), "nonsense")


def test_overlap_of_rasters_is_separable(spark):
    a, b = from_breaks(spark, [0, 50, 100, 150], [0, 50, 100, 150]), from_breaks(spark, [0, 25, 75, 125], [25, 75, 125])
    general = rows(regrid.overlap_weights(a, b), "target_id", "source_id")
    ax = lambda v: regrid.axis(spark, v)
    x = regrid.axis_overlap(ax([0, 50, 100, 150]), ax([0, 25, 75, 125]))
    y = regrid.axis_overlap(ax([0, 50, 100, 150]), ax([25, 75, 125]))
    assert general == rows(regrid.outer(x, y, 3, 3), "target_id", "source_id")


def test_bilinear_first_row(spark):
    source = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0), (3, 4.0)], "source_id long, value double")
    coarse, fine = [0, 4, 8], list(range(9))
    w = regrid.outer(regrid.axis_linear(regrid.axis(spark, coarse), regrid.axis(spark, fine)), regrid.axis_linear(regrid.axis(spark, coarse), regrid.axis(spark, fine)), 2, 8)
    out = rows(reduce.reduce_weights(w, source, spark.range(64).select(F.col("id").alias("target_id"))), "target_id")
    assert [v for _, v in out[-8:]] == pytest.approx([3, 3, 3.125, 3.375, 3.625, 3.875, 4, 4])


def test_network_weights(spark):
    net = Network(spark.createDataFrame([(0, 0.25, 0.5), (1, 2.75, 0.5)], "node_id long, x double, y double"), spark.createDataFrame([(0, 0, 1)], "edge_id long, a long, b long"))
    assert rows(regrid.network_weights(net, structured(spark, 3, 1)), "target_id") == [(0, 0, 0.75), (1, 0, 1.0), (2, 0, 0.75)]


def chain(spark, n):
    return spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(i + 1, i) for i in range(n - 1)], "src long, dst long")


def test_dilation_and_erosion(spark):
    data = spark.createDataFrame([(i, i == 2) for i in range(5)], "id long, value boolean")
    value = lambda df: [v for _, v in rows(df, "id")]
    assert value(graph.binary_dilation(chain(spark, 5), data)) == [False, True, True, True, False]
    ends = spark.createDataFrame([(0,), (4,)], "id long")
    assert value(graph.binary_dilation(chain(spark, 5), data, exterior=ends, border_value=True)) == [True] * 5
    mask = spark.createDataFrame([(1,)], "id long")
    assert value(graph.binary_dilation(chain(spark, 5), data, mask=mask)) == [False, False, True, True, False]
    full = spark.createDataFrame([(i, i > 0) for i in range(5)], "id long, value boolean")
    assert value(graph.binary_erosion(chain(spark, 5), full, iterations=2)) == [False, False, False, True, True]


def test_components(spark):
    pairs = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (7, 7), (None, 1), (3, 5)], "src long, dst long")
    assert rows(connected_components(pairs), "id") == [(3, 3), (4, 3), (5, 3), (7, 7), (8, 8), (9, 8)]
    assert rows(connected_components(chain(spark, 40)).groupBy("component").count(), "component") == [(0, 40)]
    assert rows(connected_components(chain(spark, 12), few=0).groupBy("component").count(), "component") == [(0, 12)]
    assert connected_components(pairs.limit(0)).count() == 0
    ids = spark.range(10)
    assert [r[1] for r in rows(graph.component_labels(ids, pairs.where("src is not null")), "id")] == [0, 1, 2, 3, 3, 3, 4, 5, 6, 6]


def test_order_and_cycle(spark):
    dag = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3)], "a long, b long")
    assert rows(graph.topological_levels(dag), "id") == [(0, 0), (1, 1), (2, 1), (3, 2)]
    assert not graph.is_cyclic(dag) and graph.is_cyclic(spark.createDataFrame([(0, 1), (1, 0)], "a long, b long"))
    keep = spark.createDataFrame([(0,), (3,)], "id long")
    assert rows(graph.contract_vertices(dag, keep), "a") == [(0, 3)]


def test_laplace_chain(spark):
    data = spark.createDataFrame([(0, 1.0), (1, None), (2, None), (3, None), (4, 5.0), (9, None)], "id long, value double")
    assert [v for _, v in rows(graph.laplace_fill(chain(spark, 5), data), "id")][:5] == pytest.approx([1, 2, 3, 4, 5])
    with pytest.raises(ValueError):
        graph.laplace_fill(chain(spark, 2), data.where("value is null"))


def test_nearest_on_network(spark):
    adj = chain(spark, 5).withColumn("length", F.lit(1.0))
    data = spark.createDataFrame([(0, 0.0), (1, None), (2, None), (3, None), (4, 4.0)], "id long, value double")
    assert [v for _, v in rows(graph.nearest_on_network(adj, data), "id")] == [0, 0, 0, 4, 4]
    assert [v for _, v in rows(graph.nearest_on_network(adj, data, 1.1), "id")] == [0, 0, None, 4, 4]


def test_facets(house, spark):
    data = spark.createDataFrame([(i, float(i)) for i in range(4)], "id long, value double")
    assert rows(facets.mean_on(house, data, "face", "node"), "target_id")[4] == (4, 1.5)
    with pytest.raises(ValueError):
        facets.links(house, "face", "face")


def test_burn_polygonize_snap(spark):
    m = structured(spark, 3, 3)
    square = [(0.0, 0.0), (3.0, 0.0), (3.0, 1.0), (0.0, 1.0)]
    ring = "array<struct<x:double,y:double>>"
    polygons = spark.createDataFrame([(0, square, None, 10.0)], f"row long, ring {ring}, holes array<{ring}>, value double")
    points = spark.createDataFrame([(0, 0.5, 0.5, 20.0), (1, 9.0, 9.0, 30.0)], "row long, x double, y double, value double")
    assert [v for _, v in rows(vector.burn(m, polygons=polygons, points=points, fill=0.0), "face_id")] == [20, 10, 10, 0, 0, 0, 0, 0, 0]
    stripes = spark.createDataFrame([(i, float(i // 3)) for i in range(9)], "face_id long, value double")
    assert [(r.value, r.rings) for r in vector.polygonize(m, stripes).orderBy("label").collect()][0] == (0.0, [[(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (3.0, 0.0), (3.0, 1.0), (2.0, 1.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]])
    hole = spark.createDataFrame([(i, float(i == 4)) for i in range(9)], "face_id long, value double")
    assert sorted(len(r.rings) for r in vector.polygonize(m, hole).collect()) == [1, 2]
    near = spark.createDataFrame([(0, 0.1, 0.0), (1, 0.5, 0.5)], "point_id long, x double, y double")
    assert rows(vector.snap_to_nodes(near, m.nodes.withColumnRenamed("node_id", "id"), 0.2), "point_id") == [(0, 0.0, 0.0, 0), (1, 0.5, 0.5, None)]
    line = spark.createDataFrame([(0, 0, 0.0, 1.1, 3.0, 1.1)], "line_id long, pos int, x0 double, y0 double, x1 double, y1 double")
    at = {r.edge_id: (r.x, r.y) for r in geometry.mesh_edge_geometry(m).collect()}
    assert sorted((at[r.edge_id], r.line_id, round(r.length2, 9)) for r in vector.snap_to_grid(m, line).collect()) == [((0.5 + k, 1.0), 0, 1.0) for k in range(3)]
    assert vector.snap_to_grid(m, line, 0.2).count() == 3


def test_partition_and_merge(spark):
    m = structured(spark, 4, 2)
    merged = partition.merge_partitions([(m.nodes, m.faces.where(f"face_id % 2 = {k}")) for k in range(2)] + [(m.nodes, m.faces)])
    assert merged.faces.count() == 8 and merged.nodes.count() == 15
    labels = partition.label_partitions(m, 4).groupBy("label").count()
    assert rows(labels, "label") == [(0, 2), (1, 2), (2, 2), (3, 2)]
    assert to_periodic(m)[0].nodes.count() == 12
    with pytest.raises(ValueError):
        partition.merge_partitions([])


def test_builders_and_round_trip(spark, house, tmp_path):
    again = from_polygons(geometry.rings(house).select("face_id", "ring"))
    order = sorted(range(7), key=lambda k: XY[k])  # nodes are numbered by x, then y
    assert rows(again.faces, "face_id") == [(i, [order.index(n) for n in f]) for i, f in enumerate(FACES)]
    assert sorted((a, b) for _, a, b in rows(edges(again), "edge_id")) == sorted(tuple(sorted((order.index(a), order.index(b)))) for _, a, b in rows(edges(house), "edge_id"))
    lines = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 1.0, 1.0), (0, 2, 2.0, 2.0)], "line_id long, pos int, x double, y double")
    assert rows(from_lines(lines).edges, "edge_id") == [(0, 0, 1), (1, 1, 2)]
    refined = graph.refine_by_vertices(from_lines(lines), spark.createDataFrame([(0, 0.5, 0.5), (1, 1.0, 1.0)], "vertex_id long, x double, y double"))
    assert rows(refined.edges, "edge_id") == [(0, 0, 3), (1, 3, 1), (2, 1, 2)]
    write_mesh(house, str(tmp_path / "mesh"))
    assert rows(read_mesh(spark, str(tmp_path / "mesh")).faces, "face_id") == rows(house.faces, "face_id")
    w = spark.createDataFrame([(0, 1, 0.5)], "target_id long, source_id long, weight double")
    write_weights(w, str(tmp_path / "w"))
    assert rows(read_weights(spark, str(tmp_path / "w")), "target_id") == rows(w, "target_id")


def plate(spark, n, m):
    """The five-point matrix of a plate held at its border."""
    ids = spark.range(n * m)
    k, x, y = F.col("id"), F.col("id") % n, F.floor(F.col("id") / n)
    near = F.array(F.when(x > 0, k - 1), F.when(x < n - 1, k + 1), F.when(y > 0, k - n), F.when(y < m - 1, k + n))
    off = ids.select(k.alias("i"), F.explode(near).alias("j")).where("j is not null").select("i", "j", F.lit(-1.0).alias("a"))
    return off.unionAll(ids.select(k.alias("i"), k.alias("j"), F.lit(4.0).alias("a")))


def test_multigrid_rounds_hardly_grow(spark):
    rounds = []
    for n in (8, 20):
        found, k, converged = multigrid.solve(plate(spark, n, n), spark.range(n * n).select(F.col("id").alias("i"), (F.col("id") % 3).cast("double").alias("v")), 1e-8, direct=20)
        u = np.pad(np.array([v for _, v in rows(found, "i")]).reshape(n, n), 1)
        left = 4 * u[1:-1, 1:-1] - u[:-2, 1:-1] - u[2:, 1:-1] - u[1:-1, :-2] - u[1:-1, 2:]
        assert converged and np.abs(left - (np.arange(n * n) % 3).reshape(n, n)).max() < 1e-6
        rounds.append(k)
    assert rounds[1] <= rounds[0] + 6 and rounds[1] <= 20


def test_multigrid_without_couplings_and_few_rounds(spark):
    alone = spark.range(40).select(F.col("id").alias("i"), F.col("id").alias("j"), (F.col("id") + 1.0).alias("a"))
    found, _, converged = multigrid.solve(alone, spark.range(40).select(F.col("id").alias("i"), F.lit(2.0).alias("v")), direct=5)
    assert converged and rows(found, "i") == [(i, pytest.approx(2.0 / (i + 1))) for i in range(40)]
    assert not multigrid.solve(plate(spark, 8, 8), spark.range(64).select(F.col("id").alias("i"), F.lit(1.0).alias("v")), 1e-12, 1, direct=9)[2]


def test_fill_by_multigrid_equals_plain_rounds(spark, monkeypatch):
    data = spark.createDataFrame([(i, float(i) if i in (0, 9, 30) else None) for i in range(31)], "id long, value double")
    plain = rows(graph.laplace_fill(chain(spark, 31), data, 1e-12), "id")
    monkeypatch.setattr(graph, "PLAIN", 5)
    monkeypatch.setattr(multigrid.solve, "__defaults__", (1e-8, 500, 5))
    assert [v for _, v in rows(graph.laplace_fill(chain(spark, 31), data, 1e-12), "id")] == pytest.approx([v for _, v in plain])
