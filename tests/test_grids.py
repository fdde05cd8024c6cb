"""Subsets, selection with data, Voronoi cells, regridders, partitions, sources and roles on small grids."""

import math
import random
import re
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.data import MeshArray, MeshDataset, concat, merge, merge_partitions
from gridloom.operators import barycentric, breaks, connectivity, facets, geometry, graph, ordered, partition, regrid, regridders, select, topology, vector, voronoi
from gridloom.operators.bins import box_join
from gridloom.operators.mesh import Mesh, Network, edges, structured
from gridloom.operators.periodic import to_nonperiodic, to_periodic
from gridloom.sources import roles, tables, wkt
from tests.test_mesh import FACES, XY, rows


@pytest.fixture(scope="module")
def house(spark):
    nodes = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(XY)], "node_id long, x double, y double")
    return Mesh(nodes, spark.createDataFrame(list(enumerate(FACES)), "face_id long, nodes array<long>"))


@pytest.fixture(scope="module")
def line(spark):
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 1.0), (2, 2.0, 2.0)], "node_id long, x double, y double")
    return Network(nodes, spark.createDataFrame([(0, 0, 1), (1, 1, 2)], "edge_id long, a long, b long"))


def values(spark, n, facet_values=None):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(facet_values or range(n))], "id long, value double")


def points(spark, *xy):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "point_id long, x double, y double")


# bins, nearest, clipping


def test_boxes_of_all_sizes_meet_once(spark):
    rng = random.Random(1)
    box = lambda i: (i, *(lambda x, y, w, h: (x, y, x + w, y + h))(rng.uniform(-50, 50), rng.uniform(-50, 50), 2.0 ** rng.uniform(-6, 6) if i % 3 else 0.0, 2.0 ** rng.uniform(-6, 6) if i % 3 else 0.0))
    one, two = [box(i) for i in range(120)], [box(i) for i in range(80)]
    schema = "k long, xmin double, ymin double, xmax double, ymax double"
    got = sorted((r.l_k, r.r_k) for r in box_join(spark.createDataFrame(one, schema), spark.createDataFrame(two, schema)).collect())
    want = sorted((a[0], b[0]) for a in one for b in two if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4])
    assert got == want and len(want) > 50
    assert box_join(spark.createDataFrame(one, schema).limit(0), spark.createDataFrame(two, schema)).count() == 0


def test_nearest_of_clustered_targets(spark):
    rng = random.Random(2)
    targets = [(k, rng.gauss(0, 1e-3), rng.gauss(0, 1e-3)) for k in range(3000)] + [(5000 + k, rng.uniform(-9, 9), rng.uniform(-9, 9)) for k in range(30)] + [(9000, 3.0, 3.0), (8000, 3.0, 3.0)]
    at = [(k, rng.uniform(-9, 9), rng.uniform(-9, 9)) for k in range(20)] + [(50, 0.0, 0.0), (51, 3.0, 3.1)]
    got = {r.point_id: r.id for r in select.nearest(spark.createDataFrame(at, "point_id long, x double, y double"), spark.createDataFrame(targets, "id long, x double, y double")).collect()}
    assert got == {p: min(targets, key=lambda t: ((t[1] - x) ** 2 + (t[2] - y) ** 2, t[0]))[0] for p, x, y in at}


def test_clipped_areas():
    square = lambda x, y, s: ([x, x + s, x + s, x], [y, y, y + s, y + s])
    pairs = [(square(0, 0, 2), square(1, 1, 2), 1.0), (square(0, 0, 1), square(2, 2, 1), 0.0), (square(0, 0, 4), ([1, 3, 1], [1, 1, 3]), 2.0), (([0, 2, 0], [0, 0, 2]), square(0, 0, 1), 1.0), (square(0, 0, 1), square(1, 0, 1), 0.0)]
    pad = lambda v: np.array([list(map(float, p)) + [0.0] * (4 - len(p)) for p in v])
    got = regrid.clipped_areas(pad([s[0] for s, _, _ in pairs]), pad([s[1] for s, _, _ in pairs]), np.array([len(s[0]) for s, _, _ in pairs]), pad([t[0] for _, t, _ in pairs]), pad([t[1] for _, t, _ in pairs]), np.array([len(t[0]) for _, t, _ in pairs]))
    assert got == pytest.approx([w for *_, w in pairs])


# subsets and their checks


def test_subsets(spark, house, line):
    new, index = topology.isel(house, face=[1, 3])
    assert rows(new.faces, "face_id") == [(0, [0, 1, 3, 2]), (1, [2, 3, 4])]
    assert rows(index["node"], "id") == [(1, 0), (2, 1), (4, 2), (5, 3), (6, 4)] and rows(index["face"], "id") == [(1, 0), (3, 1)]
    with pytest.raises(ValueError):
        topology.isel(house, node=[0, 1])  # the face has other nodes too
    with pytest.raises(ValueError):
        topology.isel(house, face=[0, 0])
    with pytest.raises(ValueError):
        topology.isel(house, face=[9])
    with pytest.raises(ValueError):
        topology.isel(house, face=[0], node=[2, 4, 5, 1])
    assert topology.isel(house, node=list(range(7)), edge=list(range(10)))[0].faces.count() == 4
    kept = topology.isel(line, edge=[1])
    assert rows(kept[0].edges, "edge_id") == [(0, 0, 1)] and rows(kept[1]["node"], "id") == [(1, 0), (2, 1)]
    with pytest.raises(ValueError):
        topology.isel(line, node=[1])
    assert rows(topology.isel(line, node=[0, 1, 2])[0].edges, "edge_id") == [(0, 0, 1), (1, 1, 2)]
    assert topology.clip_box(house, -1, -1, 5, 5) == (house, None)
    with pytest.raises(ValueError):
        topology.box(line, (None, 1.0), (0.0, 1.0))
    assert topology.equals(house, Mesh(house.nodes, house.faces)) and not topology.equals(house, new) and not topology.equals(house, line)
    assert len(topology.unique_grids([house, new, Mesh(house.nodes, house.faces)])) == 2


def test_connectivity_forms(spark, house):
    with pytest.raises(Exception, match="n_columns"):
        connectivity.to_dense(connectivity.face_nodes(house), "face_id", "node_id", 3).collect()
    dense = connectivity.to_dense(connectivity.face_nodes(house), "face_id", "node_id")
    assert rows(dense, "face_id") == [(i, f + [-1] * (4 - len(f))) for i, f in enumerate(FACES)]
    with pytest.raises(Exception, match="negative"):
        connectivity.to_sparse(dense.withColumn("members", F.transform("members", lambda v: v - 5)), "face_id", "node_id").collect()
    turned = edges(house).withColumn("edge_id", 9 - F.col("edge_id"))
    assert {(r.edge_id, r.f1, r.f2) for r in connectivity.edge_faces(connectivity.prior_edges(house, turned)).collect()} == {(9 - r.edge_id, r.f1, r.f2) for r in connectivity.edge_faces(house).collect()}
    for wrong in (turned.where("edge_id > 0"), turned.unionAll(turned.where("edge_id = 0").withColumn("edge_id", F.lit(10).cast("long"))), turned.withColumn("b", F.lit(0).cast("long"))):
        with pytest.raises(ValueError):
            connectivity.prior_edges(house, wrong)
    one = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0)], "id long, x double, y double")
    two = spark.createDataFrame([(7, 1.0004, 0.0), (8, 0.0, 0.0)], "id long, x double, y double")
    assert rows(connectivity.index_like(one, two, 1e-3), "id") == [(7, 1), (8, 0)]
    with pytest.raises(ValueError):
        connectivity.index_like(one, two)
    with pytest.raises(ValueError):
        connectivity.connectivity_matrix(house, "edge")
    assert rows(connectivity.neighbors(connectivity.face_faces(house), 0), "dst") == [(1,), (2,)]


# arrays


def test_points_on_arrays(spark, house, line):
    a = MeshArray(house, "face", values(spark, 4))
    at = points(spark, (0.5, 0.5), (1.5, 1.2), (-1.0, 0.0), (0.1, 1.9))
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert [r.value for r in a.sel_points(at).orderBy("point_id").collect()] == [0.0, 3.0, None, None]
    assert any("not all points" in str(w.message) for w in said)
    assert [r.value for r in a.sel_points(at, method="nearest", out_of_bounds="ignore", fill=-9.0).orderBy("point_id").collect()] == [0.0, 3.0, -9.0, -9.0]
    assert [r.point_id for r in a.sel_points(at, out_of_bounds="drop").orderBy("point_id").collect()] == [0, 1]
    nodes = MeshArray(house, "node", values(spark, 7))
    assert [r.value for r in nodes.sel_points(at.where("point_id < 2"), out_of_bounds="raise").orderBy("point_id").collect()] == [0.0, 4.0]
    for wrong in ({"out_of_bounds": "raise"}, {"out_of_bounds": "no"}, {"method": "no"}):
        with pytest.raises(ValueError):
            a.sel_points(at, **wrong)
    with pytest.raises(ValueError):
        MeshArray(line, "face", values(spark, 2))
    e = MeshArray(line, "edge", values(spark, 2, [5.0, 6.0]))
    assert [r.value for r in e.sel_points(points(spark, (0.5, 0.5), (1.5, 1.5)), out_of_bounds="raise").orderBy("point_id").collect()] == [5.0, 6.0]
    cross = e.intersect_line((0.0, 1.0), (1.0, 0.0)).collect()
    assert [(r.id, r.x, r.y, round(r.s, 9)) for r in cross] == [(0, 0.5, 0.5, round(math.sqrt(0.5), 9))]
    assert a.sel([0.5, 1.5], 0.5).count() == 2 and a.sel((0, 2), (0, 1), step=0.5).count() == 8
    with pytest.raises(ValueError):
        a.intersect_line((0.0,), (1.0, 1.0))


def test_sel_and_alignment(spark, house):
    a = MeshArray(house, "face", values(spark, 4))
    clipped = a.sel((1.25, 2.5), (0.25, 1.5))
    assert rows(clipped.df, "id") == [(0, 1.0), (1, 3.0)] and clipped.grid.nodes.count() == 5
    dropped = a._with(a.df.withColumn("value", F.when(F.col("id") != 0, F.col("value")))).dropna()
    assert rows(dropped.df, "id") == [(0, 1.0), (1, 2.0), (2, 3.0)] and dropped.grid.faces.count() == 3
    other = Mesh(house.nodes, house.faces.withColumn("face_id", 3 - F.col("face_id")))
    assert rows(a.reindex_like(other, 1e-9).df, "id") == [(0, 3.0), (1, 2.0), (2, 1.0), (3, 0.0)]
    with pytest.raises(TypeError):
        a.reindex_like(Network(house.nodes, edges(house)))
    with pytest.raises(ValueError):
        MeshArray.from_data(values(spark, 3), house, "face")
    assert MeshArray.from_data(values(spark, 4), house, "face").dims == ()
    assert a.rename("other").names == ["other"] and a.total_bounds == (0.0, 0.0, 2.0, 2.0) and a.copy() == a


def test_chosen_faces_are_found_once(spark, house):
    calls = spark.sparkContext.accumulator(0)

    def seen(face_id):
        calls.add(1)
        return face_id < 3

    chosen = house.faces.where(F.udf(seen, "boolean")("face_id")).select("face_id")
    new, index = topology.subset(house, chosen)
    sizes = [new.nodes.count(), new.edges.count(), new.faces.count(), index["edge"].count()]
    assert sizes[2] == 3 and sizes[1] == sizes[3] and calls.value <= 2 * house.faces.count()  # a checkpoint may take two


def test_breaks_need_no_window_over_the_whole_axis(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE", 100)
    cells = spark.range(1000).repartition(7).select(F.col("id").alias("idx"), (F.col("id") * F.col("id")).cast("double").alias("mid"))
    got = breaks.infer_interval_breaks1d(cells)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"lead\(mid#.*?windowspecdefinition\((\w+)", plan)) == {"_part"}
    want = [-0.5, *((k * k + (k + 1) ** 2) / 2 for k in range(999)), 999**2 + (999**2 - 998**2) / 2]
    assert [r["at"] for r in got.orderBy("idx").collect()] == want
    both = breaks.bounds1d_to_vertices(cells.select("idx", F.col("idx").alias("lower"), (F.col("idx") + 1).alias("upper")))
    assert [r["at"] for r in both.orderBy("idx").collect()] == list(range(1001))


def test_unknowns_without_unknown_neighbours_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph.multigrid, "solve", lambda *a: pytest.fail("solved by rounds"))
    way = spark.range(1000).select(F.inline(F.array(F.struct(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), F.struct((F.col("id") + 1).alias("src"), F.col("id").alias("dst")))))
    data = spark.range(1003).select("id", F.when(F.col("id") % 2 == 0, F.col("id").cast("double")).alias("value"))
    got = {r.id: r.value for r in graph.laplace_fill(way, data).collect()}
    assert got == {k: None if k == 1001 else float(k) for k in range(1003)}


def test_a_function_gets_many_whole_groups_in_one_call(spark, house):
    df = spark.createDataFrame([(i, t, float(i * 10 + t)) for i in range(40) for t in range(4)], "id long, t int, value double")

    def spread(rows):
        v = rows.groupby("id")["value"]
        return (v.max() - v.min()).rename("spread").reset_index().assign(groups=rows["id"].nunique())

    got = MeshArray(house, "face", df).apply(spread, "id long, spread double, groups long", together=True).collect()
    assert sorted((r.id, r.spread, r.groups) for r in got) == [(i, 3.0, 40) for i in range(40)]


def test_arithmetic_and_windows(spark, house):
    df = spark.createDataFrame([(i, t, float(i * 10 + t)) for i in range(4) for t in range(4)], "id long, t int, value double")
    a = MeshArray(house, "face", df)
    get = lambda b, k=1: [r.value for r in b.df.where(f"id = {k}").orderBy("t").collect()]
    assert get(a + 1.0) == [11, 12, 13, 14] and get(a / a.reduce("mean", ["t"])) == pytest.approx([10 / 11.5, 11 / 11.5, 12 / 11.5, 13 / 11.5])
    assert get(a.rolling("t", 2)) == [None, 10.5, 11.5, 12.5] and get(a.diff("t")) == [1, 1, 1] and get(a.shift("t", -1)) == [11, 12, 13, None]
    assert get(a.cumsum("t")) == [10, 21, 33, 46] and get(a.cumprod("t"), 0) == [0, 0, 0, 0] and get(a.rank("t")) == [1, 2, 3, 4]
    assert get(a.clip(11, 12)) == [11, 11, 12, 12] and get(-a % 7) == [-3, -4, -5, -6] and get(abs(-a)) == [10, 11, 12, 13]
    gaps = a.where((a > 11.0) | (a < 11.0))
    assert get(gaps) == [10, None, 12, 13] and get(gaps.ffill("t")) == [10, 10, 12, 13] and get(gaps.bfill("t")) == [10, 12, 12, 13]
    assert get(a.coarsen("t", 3)) == [11] and rows(a.interp("t", 1.5).df, "id")[1] == (1, 11.5) and get(a.differentiate("t")) == [1, 1, 1, 1]
    assert a.reduce("max", ["id", "t"]).first().value == 33 and a.arg("max", "t").df.where("id = 0").first().value == 3
    both = concat([a.sel_dims(t=0), a.sel_dims(t=1)], "run", ["x", "y"])
    assert both.dims == ("run",) and both.df.count() == 8
    assert a.unstack("t", [0, 3]).columns == ["id", "0", "3"] and a.expand_dims(layer=1).dims == ("t", "layer")
    listed = a.interp("t", [0.5, 2.0, 9.0]).df.where("id = 1").orderBy("t").collect()
    assert [(r.t, r.value) for r in listed] == [(0.5, 10.5), (2.0, 12.0), (9.0, None)] and a.interp("t", 9.0).dims == ()
    with pytest.raises(ValueError):
        a.reduce("mean", ["nothing"])
    with pytest.raises(ValueError):
        a + MeshArray(house, "node", values(spark, 7))
    with pytest.raises(ValueError):
        merge(a, MeshDataset({"value": a}))


def test_facets_graphs_and_fills(spark, house):
    a = MeshArray(house, "face", values(spark, 4))
    with pytest.raises(ValueError):
        a.to_face()
    assert a.to_edge().count() == 14 and facets.links(house, "edge", "face").count() == 14
    with pytest.raises(ValueError):
        a.binary_dilation()
    flags = a > 2.0
    assert [v for _, v in rows(flags.binary_dilation().df, "id")] == [False, True, True, True]
    assert [v for _, v in rows((a >= 0.0).binary_erosion(border_value=False).df, "id")] == [False] * 4
    assert {v for _, v in rows(a.connected_components().df, "id")} == {0}
    holes = a._with(a.df.withColumn("value", F.when(F.col("id") != 2, F.col("value"))))
    assert rows(holes.interpolate_na().df, "id")[2][1] in (0.0, 3.0)
    assert rows(holes.interpolate_na(max_distance=0.01).df, "id")[2] == (2, None)
    filled = rows(holes.laplace_interpolate(xy_weights=False).df, "id")[2][1]
    assert filled == pytest.approx(1.5)
    with pytest.raises(ValueError):
        a._with(a.df.withColumn("value", F.lit(None).cast("double"))).interpolate_na()
    with pytest.raises(ValueError):
        a.interpolate_na("cubic")
    chain = spark.createDataFrame([(k, k + 1) for k in range(9)] + [(k + 1, k) for k in range(9)], "src long, dst long")
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        graph.laplace_fill(chain, spark.createDataFrame([(k, float(k) if k in (0, 9) else None) for k in range(10)], "id long, value double"), 1e-12, 2)
    assert any("converged" in str(w.message) for w in said)


def test_rcm_keeps_neighbours_near(spark):
    rng = random.Random(3)
    m = structured(spark, 6, 4)
    mixed = list(range(24))
    rng.shuffle(mixed)
    new = spark.createDataFrame(list(enumerate(mixed)), "face_id long, new long")
    shuffled = Mesh(m.nodes, m.faces.join(new, "face_id").select(F.col("new").alias("face_id"), "nodes"))
    a = MeshArray(shuffled, "face", geometry.facet_points(shuffled, "face").select("id", "x", F.col("y").alias("value"))).reverse_cuthill_mckee()
    band = connectivity.face_faces(a.grid).agg(F.max(F.abs(F.col("src") - F.col("dst")))).first()[0]
    assert band <= 6 and sorted(r.face_id for r in a.grid.faces.collect()) == list(range(24))
    at = geometry.facet_points(a.grid, "face")
    assert a.df.withColumnRenamed("x", "own").join(at, "id").where("abs(own - x) > 1e-9 or abs(value - y) > 1e-9").count() == 0


# Voronoi and barycentric


def test_voronoi_of_a_rectangle(spark):
    m = structured(spark, 3, 2)
    inner = voronoi.tessellation(m)
    assert inner.cells.count() == 2 and rows(inner.vertices.select("x", "y"), "x", "y") == [(0.5, 0.5), (0.5, 1.5), (1.5, 0.5), (1.5, 1.5), (2.5, 0.5), (2.5, 1.5)]
    v = voronoi.voronoi_topology(m)
    assert v.cells.count() == 12 and v.vertices.count() == 16 and v.vertices.where("face_id is null").count() == 0
    full = voronoi.tesselate_centroidal_voronoi(m)
    assert full.nodes.count() == 26 and geometry.with_geometry(full).agg(F.sum("area")).first()[0] == pytest.approx(6.0)
    assert rows(voronoi.tessellation(m, add_exterior=True, add_vertices=True).between.select("first", "second"), "first")[0][0] >= 6
    assert rows(v.cells.select("cell_id", "node_id"), "cell_id")[:3] == [(0, 5), (1, 6), (2, 0)]  # interior nodes first
    with pytest.raises(ValueError):
        voronoi.tessellation(m, add_vertices=True)
    tri, of = voronoi.centroid_triangulation(m)
    assert tri.faces.where("size(nodes) <> 3").count() == 0 and of.count() == 16


def test_concave_corner_keeps_its_cell_convex(spark):
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 2.0, 0.0), (2, 2.0, 2.0), (3, 0.0, 2.0), (4, 1.0, 1.0)], "node_id long, x double, y double")
    m = Mesh(nodes, spark.createDataFrame([(0, [0, 1, 4]), (1, [1, 2, 4]), (2, [2, 3, 4])], "face_id long, nodes array<long>"))
    kept = voronoi.tesselate_centroidal_voronoi(m, skip_concave=True)
    whole = voronoi.tesselate_centroidal_voronoi(m)
    a, b = ({r.face_id: r.area for r in geometry.with_geometry(g).collect()} for g in (kept, whole))
    assert sum(b.values()) == pytest.approx(3.0) and all(a[k] >= b[k] - 1e-12 for k in b)


def test_barycentric_weights(spark, house):
    got = barycentric.compute_barycentric_weights(house, points(spark, (0.25, 0.5), (1.0, 1.5), (0.0, 0.0), (5.0, 5.0)))
    w = {(r.point_id, r.node_id): round(r.weight, 9) for r in got.collect() if r.weight > 0}
    assert w == {(0, 0): 0.375, (0, 1): 0.125, (0, 4): 0.125, (0, 3): 0.375, (1, 4): 0.5, (1, 6): 0.5, (2, 0): 1.0}


# regridders


def test_regridders(spark, house, line, tmp_path):
    raster = regridders.Raster(spark, (0.0, 1.0, 2.0, 3.0), (2.0, 1.0, 0.0))
    data = spark.createDataFrame([(i, float(i)) for i in range(6)], "source_id long, value double")
    same = regridders.OverlapRegridder(raster, raster, "mode").regrid(data)
    assert rows(same, "target_id") == [(i, float(i)) for i in range(6)]
    on_mesh = regridders.OverlapRegridder(raster, house, regridders.OverlapRegridder.create_percentile_method(100)).regrid(data)
    assert rows(on_mesh, "target_id") == [(0, 3.0), (1, 4.0), (2, 0.0), (3, 1.0)]
    located = regridders.CentroidLocatorRegridder(house, raster).regrid(values(spark, 4).withColumnRenamed("id", "source_id"))
    assert [v for _, v in rows(located, "target_id")][3:] == [0.0, 1.0, None]
    relative = regridders.RelativeOverlapRegridder(raster, raster)
    assert relative.weights_as_dataframe().columns == ["target_index", "source_index", "weight"] and relative.method == "first_order_conservative"
    relative.to_dataset(str(tmp_path / "w"))
    again = regridders.RelativeOverlapRegridder.from_dataset(spark, str(tmp_path / "w"))
    assert rows(again.regrid(data), "target_id") == rows(relative.regrid(data), "target_id")
    for wrong in (lambda: regridders.OverlapRegridder(raster, raster, "conductance"), lambda: regridders.RelativeOverlapRegridder(raster, raster, "mean"), lambda: regridders.OverlapRegridder.create_percentile_method(101), lambda: regridders.OverlapRegridder.from_weights(data, raster)):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(TypeError):
        regridders.OverlapRegridder(3, raster)
    with pytest.raises(TypeError):
        regridders.NetworkGridder(raster, raster)
    gridder = regridders.NetworkGridder(line, structured(spark, 2, 2), "sum").regrid(spark.createDataFrame([(0, 3.0), (1, 4.0)], "source_id long, value double"))
    assert rows(gridder, "target_id") == [(0, 3.0), (1, None), (2, None), (3, 4.0)]
    by_layer = spark.createDataFrame([(0, 0.0, 2.0, 1), (1, 2.0, 4.0, 1), (0, 0.0, 1.0, 2)], "idx int, lo double, hi double, layer int")
    target = spark.createDataFrame([(0, 1.0, 3.0, 1), (0, 0.5, 9.0, 2)], "idx int, lo double, hi double, layer int")
    assert rows(regrid.axis_overlap_by(by_layer, target, ["layer"]), "layer", "source") == [(1, 0, 0, 1.0), (1, 1, 0, 1.0), (2, 0, 0, 0.5)]


# partitions and periodic meshes


def test_partitions_with_data(spark, house, line):
    a = MeshArray(house, "face", values(spark, 4), "v")
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "face_id long, label int")
    parts = MeshDataset({"v": a}).partition_by_label(labels)
    merged = merge_partitions(parts)
    assert rows(merged["v"].df, "id") == [(0, 0.0), (1, 1.0), (2, 2.0), (3, 3.0)] and merged.grid.nodes.count() == 7
    assert merge_partitions(parts[:1]) is parts[0]
    with pytest.raises(ValueError):
        merge_partitions([])
    with pytest.raises(ValueError):
        merge_partitions([parts[0], parts[1].drop_vars("v")])
    with pytest.raises(TypeError):
        partition.merge_grids([house, line])
    with pytest.raises(TypeError):
        a.partition_by_label(labels.withColumn("label", F.lit("a")))
    whole = spark.createDataFrame([(0, 9), (1, 1), (2, 1), (3, 1)], "id long, weight long")
    sums = partition.label_partitions(house, 2, whole).join(whole.withColumnRenamed("id", "face_id"), "face_id").groupBy("label").agg(F.sum("weight").alias("w"))
    assert max(r.w for r in sums.collect()) <= 11
    for wrong in (whole.where("id > 0"), whole.withColumn("weight", -F.col("weight")), whole.withColumn("weight", F.col("weight") + 0.5)):
        with pytest.raises(ValueError):
            partition.label_partitions(house, 2, wrong)
    assert sum(g.faces.count() for g in partition.partition(house, 2)) == 4
    edge_data = MeshArray(Mesh(house.nodes, house.faces, edges(house)), "edge", values(spark, 10), "e")
    again = merge_partitions(MeshDataset({"e": edge_data}).partition_by_label(labels))
    at = {(r.a, r.b): r.edge_id for r in edges(house).collect()}
    xy = {r.node_id: (r.x, r.y) for r in again.grid.nodes.collect()}
    old = {p: i for i, p in enumerate((float(x), float(y)) for x, y in XY)}
    ends = {r.edge_id: tuple(sorted((old[xy[r.a]], old[xy[r.b]]))) for r in again.grid.edges.collect()}
    assert all(at[ends[i]] == v for i, v in rows(again["e"].df, "id")) and again["e"].df.count() == 10


def test_periodic_round_trip(spark):
    m = structured(spark, 4, 2)
    a = MeshArray(Mesh(m.nodes, m.faces, edges(m)), "edge", edges(m).select(F.col("edge_id").alias("id"), F.col("edge_id").cast("double").alias("value")))
    ring = a.to_periodic()
    assert ring.grid.nodes.count() == 12 and ring.grid.edges.count() == edges(m).count() - 2
    back, index = to_nonperiodic(to_periodic(m)[0], 4.0)
    corner = lambda g: sorted((r.face_id, r.pos, r.x, r.y) for r in connectivity.face_nodes(g).join(g.nodes, "node_id").collect())
    assert corner(back) == corner(m) and index["node"].count() == 15
    assert ring.to_nonperiodic(4.0).df.count() == edges(m).count()
    crooked = Mesh(m.nodes.withColumn("y", F.when(F.col("x") == 4, F.col("y") * 1.1).otherwise(F.col("y"))), m.faces)
    with pytest.raises(ValueError):
        to_periodic(crooked)


# vectors


def test_snapping_equals_taking_points_in_turn(spark):
    rng = random.Random(4)
    xy = [(rng.uniform(0, 3), rng.uniform(0, 3)) for _ in range(90)]
    new, at = vector.snap_nodes(points(spark, *xy), 0.4)
    target, goal, best = {}, list(range(90)), {}
    for i in range(90):
        if i in best:
            continue
        target[i] = True
        for j in range(90):
            d = math.dist(xy[i], xy[j])
            if j != i and j not in target and d <= 0.4 and (j not in best or d < best[j]):
                best[j], goal[j] = d, i
    order = sorted(set(goal))
    assert rows(new, "point_id") == [(i, order.index(g)) for i, g in enumerate(goal)]
    assert rows(at, "new") == [(k, *xy[g]) for k, g in enumerate(order)]


def test_polygons_and_text(spark, house):
    m = structured(spark, 5, 5)
    donut = MeshArray(m, "face", m.faces.select(F.col("face_id").alias("id"), F.col("face_id").isin(6, 7, 8, 11, 13, 16, 17, 18).cast("double").alias("value")))
    found = {r.value: [len(x) - 1 for x in r.rings] for r in donut.polygonize().where("value = 1").collect()}
    assert found == {1.0: [12, 4]}
    assert [tuple(r) for r in wkt.points_to_nodes(spark.createDataFrame([(3, "POINT (1.5 -2)")], "id long, wkt string")).collect()] == [(3, 1.5, -2.0)]
    again = wkt.grid_from_wkt(wkt.to_wkt(house, "face"))
    assert geometry.with_geometry(again).agg(F.sum("area")).first()[0] == 3.0
    network = wkt.grid_from_wkt(spark.createDataFrame([(0, "LINESTRING (0 0, 1 1, 2 2)")], "id long, wkt string"))
    assert rows(network.edges, "edge_id") == [(0, 0, 1), (1, 1, 2)]
    for text in (["POINT (0 0)"], ["LINESTRING (0 0, 1 1)", "POLYGON ((0 0, 1 0, 1 1, 0 0))"]):
        with pytest.raises(ValueError):
            wkt.grid_from_wkt(spark.createDataFrame(list(enumerate(text)), "id long, wkt string"))
    with pytest.raises(Exception, match="unsupported"):
        wkt.burnable(spark.createDataFrame([(0, "CIRCLE (0 0)")], "row long, wkt string"))["points"].collect()
    sets = MeshDataset.from_geodataframe(spark.createDataFrame([(0, "POLYGON ((0 0, 1 0, 1 1, 0 0))", 5.0)], "id long, wkt string, h double"))
    assert sets["h"].facet == "face" and sets.to_geodataframe().first().h == 5.0
    outline = vector.bounding_polygon(house)
    assert outline.count() == 6 and outline.where("not outer").count() == 0


# sources, breaks, roles


def test_sources(spark, house, line, tmp_path):
    tables.write_mesh(Mesh(house.nodes, house.faces, edges(house), "m", "EPSG:28992"), str(tmp_path / "m"), optional=True)
    again = tables.read_grid(spark, str(tmp_path / "m"))
    assert topology.equals(again, Mesh(house.nodes, house.faces, edges(house), "m", "EPSG:28992"))
    assert tables.load(tables.read_table(spark, str(tmp_path / "m"), "face_face")).count() == 8
    with pytest.raises(ValueError):
        tables.read_grid(spark, str(tmp_path))
    with pytest.raises(ValueError):
        tables.read_many(spark, [], "x")
    out, attrs = tables.to_file_tables(line, start_index=1, fill=-99)
    assert rows(out["network1d_edge_nodes"], "edge_id") == [(0, [1, 2]), (1, [2, 3])]
    assert rows(tables.from_file_tables(out, attrs).edges, "edge_id") == [(0, 0, 1), (1, 1, 2)]
    assert rows(tables.from_file_tables(out, attrs | {"start_index": 0}, edge_start_index=1).edges, "edge_id") == [(0, 0, 1), (1, 1, 2)]
    with pytest.raises(NotImplementedError):
        tables.from_file_tables(out, attrs | {"topology_dimension": 3})
    with pytest.raises(ValueError):
        tables.from_file_tables(out, {})


def test_breaks(spark):
    axis = lambda *v: spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "idx long, mid double")
    assert breaks.values(breaks.infer_interval_breaks1d(axis(0, 1, 2))) == [-0.5, 0.5, 1.5, 2.5]
    assert breaks.values(breaks.infer_interval_breaks1d(axis(4), 2.0)) == [3.0, 5.0]
    assert breaks.values(breaks.infer_interval_breaks1d(axis(3, 1).withColumn("spacing", F.lit(2.0)))) == [4.0, 2.0, 0.0]
    for wrong in (lambda: breaks.infer_interval_breaks1d(axis(1)), lambda: breaks.infer_interval_breaks1d(axis(0, 2, 1)), lambda: breaks.infer_interval_breaks1d(axis(0, 1, 3), 1.0), lambda: breaks.generate_disk(spark, 2, 3)):
        with pytest.raises(ValueError):
            wrong()
    grid = spark.createDataFrame([(y, x, float(x + 10 * y)) for y in range(2) for x in range(3)], "row int, idx long, mid double")
    assert [r.at for r in breaks.infer_interval_breaks(grid, "row").orderBy("row", "idx").collect()] == [-0.5, 0.5, 1.5, 2.5, 9.5, 10.5, 11.5, 12.5]
    with pytest.raises(ValueError):
        breaks.bounds1d_to_vertices(spark.createDataFrame([(0, 0.0, 1.0), (1, 2.0, 3.0), (2, 1.0, 2.0)], "idx long, lower double, upper double"))
    falling = breaks.bounds1d_to_vertices(spark.createDataFrame([(0, 1.0, 2.0), (1, 0.0, 1.0)], "idx long, lower double, upper double"))
    assert breaks.values(falling) == [2.0, 1.0, 0.0]
    cells = [(0, [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (2.0, 0.0)]), (1, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])]
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        mesh, of = breaks.from_structured_bounds(spark.createDataFrame(cells, "cell_id long, corners array<struct<x:double,y:double>>"))
    assert any("omitted" in str(w.message) for w in said) and rows(of, "face_id") == [(0, 1)] and mesh.nodes.count() == 4
    for x, y in (([0, 1, 2], [0, 1]), ([2, 1, 0], [0, 1]), ([0, 1, 2], [1, 0]), ([2, 1, 0], [1, 0])):
        from gridloom.operators.mesh import from_breaks

        m = from_breaks(spark, x, y)
        first = {r.node_id: (r.x, r.y) for r in m.nodes.collect()}
        assert [first[n] for n in rows(m.faces, "face_id")[0][1]] == ([(0, 0), (1, 0), (1, 1), (0, 1)] if x[0] == 0 else [(1, 0), (2, 0), (2, 1), (1, 1)])


def test_roles_and_crs(spark, house):
    V = roles.Variable
    attrs = {"cf_role": "mesh_topology", "topology_dimension": 2, "node_coordinates": "x y", "face_node_connectivity": "fn"}
    variables = {"m": V((), (), attrs), "x": V(("n",), (9,), {"standard_name": "longitude"}), "y": V(("n",), (9,), {"standard_name": "latitude"}), "fn": V(("f", "k"), (4, 4)), "h": V(("f",), (4,), {"grid_mapping": "crs"})}
    assert roles.topologies(variables) == ["m"] and roles.coordinates(variables)["m"]["node_coordinates"] == (["x"], ["y"])
    assert roles.dimensions(variables)["m"] == {"node_dimension": "n", "face_dimension": "f"} and roles.connectivity(variables)["m"] == {"face_node_connectivity": "fn"}
    assert roles.is_projected(variables) == {"m": False} and roles.grid_mapping_names(variables) == {"m": "crs"}
    with pytest.raises(ValueError):
        roles.dimensions(variables | {"y": V(("other",), (9,), {"standard_name": "latitude"})})
    with pytest.raises(ValueError):
        roles.is_projected(variables | {"x": V(("n",), (9,), {"standard_name": "projection_x_coordinate"})})
    with pytest.raises(ValueError):
        roles.grid_mapping_names(variables | {"g": V(("f",), (4,), {"grid_mapping": "other"})})
    with pytest.warns(UserWarning):
        roles.connectivity({k: v for k, v in variables.items() if k != "fn"})
    with pytest.raises(ValueError):
        roles.default_attrs("m", 3)
    assert roles.crs_from_attrs({"epsg": 4326, "EPSG_code": "EPSG:4326"}).name == "EPSG:4326" and roles.crs_to_attrs(roles.Crs(4326))["epsg"] == 4326
    with pytest.raises(ValueError):
        roles.crs_from_attrs({"epsg": 4326, "EPSG_code": "EPSG:28992"})
    a = MeshArray(house, "face", values(spark, 4)).set_crs(epsg=28992)
    assert a.crs == {"mesh2d": "EPSG:28992"} and a.set_crs("EPSG:28992").crs == a.crs
    with pytest.raises(ValueError):
        a.set_crs(4326)
    assert a.set_crs(4326, allow_override=True).is_geographic
    with pytest.raises(ValueError):
        MeshArray(house, "face", values(spark, 4)).set_crs(epsg=4326)  # its coordinates are projected
    s = MeshDataset({"v": a, "n": MeshArray(house, "node", values(spark, 7)).rename("other")})
    assert s.names == ["mesh2d", "other"] and s.rename({"other": "third"}).names == ["mesh2d", "third"] and s.total_bounds == (0.0, 0.0, 2.0, 2.0)
    for wrong in (lambda: s.grid, lambda: s.name):
        with pytest.raises(TypeError):
            wrong()
    with pytest.raises(ValueError):
        s.rename({"nothing": "x"})
    moved = s.set_node_coords(house.nodes.withColumn("x", F.col("x") + 5), "other")
    assert moved.bounds["other"][0] == 5.0 and moved.bounds["mesh2d"][0] == 0.0
    with pytest.raises(ValueError):
        s.set_node_coords(house.nodes.where("node_id > 0"), "other")
    assert set(s.assign_face_coords()["v"].columns) > {"mesh2d_face_x"}
    with pytest.raises(ValueError):
        MeshDataset({"a": a, "b": MeshArray(Mesh(house.nodes, house.faces.where("face_id < 2")), "face", values(spark, 2))})
