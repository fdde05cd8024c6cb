"""Queries on subsets, Voronoi cells, periodic meshes, sources, vectors and partitions, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.data import MeshArray, MeshDataset, concat, merge, merge_partitions
from gridloom.operators import breaks, connectivity, geometry, graph, partition, periodic, regridders, select, topology, vector, voronoi
from gridloom.operators.barycentric import compute_barycentric_weights
from gridloom.operators.mesh import Mesh, Network, edges, face_nodes, from_breaks, structured
from gridloom.plans import fixtures as X
from gridloom.plans.registry import on_mesh, r6, register
from gridloom.session import shared_dir
from gridloom.sources import roles, tables, wkt

AB = "list(node_id order by pos)"


def folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/query-{uuid.uuid4().hex}"


# sizes, coordinates, forms of connectivity

on_mesh("grid_sizes", "select (select count(*) from node) as n_node, (select count(*) from edge) as n_edge, (select count(*) from face) as n_face, (select max(len(nodes)) from face) as n_max_node_per_face")(geometry.sizes)
on_mesh("face_sizes", "select face_id, len(nodes) as n from face")(geometry.nodes_per_face)
ENDS = "ee as (select edge_id, p.x as ux, p.y as uy, q.x as vx, q.y as vy from edge e join node p on p.node_id = e.a join node q on q.node_id = e.b)"
on_mesh("edge_bounds", "select edge_id, least(ux, vx) as xmin, least(uy, vy) as ymin, greatest(ux, vx) as xmax, greatest(uy, vy) as ymax from ee", ENDS)(lambda m: geometry.edge_bounds(edges(m), m.nodes))
on_mesh(
    "facet_coordinates",
    "select 'node' as facet, node_id as id, x, y from node union all select 'edge', edge_id, (ux + vx) / 2, (uy + vy) / 2 from ee union all select 'face', face_id, round(cx, 6), round(cy, 6) from geo",
    ENDS,
)(lambda m: geometry.facet_points(m, "node").withColumn("facet", F.lit("node")).unionByName(geometry.facet_points(m, "edge").withColumn("facet", F.lit("edge"))).unionByName(geometry.facet_points(m, "face").withColumn("facet", F.lit("face"))).select("facet", "id", *r6("x", "y")))
on_mesh("directed_node_node", "select a as src, b as dst, edge_id as via from edge")(lambda m: connectivity.directed_node_nodes(edges(m)))
on_mesh("node_matrix", "select src, dst, via, round((select avg(d) from d) / d, 6) as weight from d", ENDS, "l as (select e.*, sqrt((ux - vx) ** 2 + (uy - vy) ** 2) as d from edge e join ee using (edge_id))", "d as (select a as src, b as dst, edge_id as via, d from l union all select b, a, edge_id, d from l)")(
    lambda m: connectivity.connectivity_matrix(m, "node").select("src", "dst", "via", *r6("weight"))
)
on_mesh("face_node_dense", "select face_id, list_concat(nodes, case when len(nodes) = 3 then [-9] else [] end) as members from face")(lambda m: connectivity.to_dense(face_nodes(m), "face_id", "node_id", 4, -9))
on_mesh("face_node_again", "select face_id, cast(pos as integer) as pos, node_id from corner")(lambda m: connectivity.to_sparse(connectivity.to_dense(face_nodes(m), "face_id", "node_id", fill=-1), "face_id", "node_id"))
on_mesh("inverted_face_edge", "select edge_id, cast(row_number() over (partition by edge_id order by face_id) - 1 as integer) as pos, face_id from (select distinct edge_id, face_id from side join edge using (a, b))")(lambda m: connectivity.inverted(connectivity.face_edges(m), "face_id", "edge_id"))
on_mesh("reversed_faces", "select face_id, list_reverse(nodes) as nodes from face")(lambda m: connectivity.reverse_orientation(m).faces)
on_mesh("turned_back", "select face_id, round(area, 6) as area from geo")(lambda m: geometry.with_geometry(geometry.counterclockwise(connectivity.reverse_orientation(m))).select("face_id", *r6("area")))
on_mesh("sorted_rows", "select node_id, row_number() over (order by y, x, node_id) - 1 as rank from node")(lambda m: connectivity.argsort_rows(m.nodes, ["y", "x"], "node_id"))
on_mesh("ragged_mask", "select len(nodes) as n, [true, true, true, len(nodes) > 3] as mask, count(*) as n_face from face group by 1, 2")(lambda m: connectivity.ragged_index(geometry.nodes_per_face(m).groupBy("n").agg(F.count("*").alias("n_face")), 4).select(F.col("n").cast("long").alias("n"), "mask", "n_face"))
on_mesh("edge_validity", "select edge_id, edge_id % 7 <> 0 as valid from edge")(lambda m: connectivity.edge_validity(m, edges(m).withColumn("b", F.when(F.col("edge_id") % 7 == 0, F.col("b") + 7919).otherwise(F.col("b")))))
on_mesh("prior_edges", "select (select max(edge_id) from edge) - edge_id as edge_id, f1, f2 from ef")(
    lambda m: connectivity.edge_faces(connectivity.prior_edges(m, edges(m).crossJoin(F.broadcast(edges(m).agg(F.max("edge_id").alias("n")))).select((F.col("n") - F.col("edge_id")).alias("edge_id"), F.col("b").alias("a"), F.col("a").alias("b")))).select("edge_id", "f1", "f2")  # joined with one row
)
on_mesh("circumcenters", "select face_id, (min(px) + max(px)) / 2 as x, (min(py) + max(py)) / 2 as y from seg join face using (face_id) where len(nodes) = 3 group by 1")(lambda m: _circumcenters(*topology.subset(m, m.faces.where("size(nodes) = 3").select("face_id"))))


def _circumcenters(m: Mesh, index: topology.Index) -> DataFrame:
    return geometry.circumcenters(m).join(index["face"].withColumnRenamed("new", "face_id"), "face_id").select(F.col("id").alias("face_id"), "x", "y")


on_mesh("triangulated_mesh", "select row_number() over (order by face_id, k) - 1 as face_id, face_id as of, [nodes[1], nodes[k + 1], nodes[k + 2]] as nodes from (select face_id, nodes, unnest(range(1, len(nodes) - 1)) as k from face)")(
    lambda m: geometry.triangulate(m)[0].faces.join(geometry.triangulate(m)[1], "face_id")
)


@register("structured_connectivity", "with c as (select iy, ix, row_number() over (order by iy, ix) - 1 as id from (select o_orderkey // 50 as iy, o_orderkey % 50 as ix from orders where o_custkey % 3 > 0)) select p.id as src, q.id as dst from c p join c q on abs(p.iy - q.iy) + abs(p.ix - q.ix) = 1 and q.iy between p.iy - 1 and p.iy + 1 and q.ix between p.ix - 1 and p.ix + 1")
def structured_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return connectivity.structured_connectivity(X.read_table(spark, sf_dir, "orders").select(F.floor(k / 50).alias("iy"), (k % 50).alias("ix"), (F.col("o_custkey") % 3 > 0).alias("active")))


# subsets

SUB = "kept as (select face_id from geo where cx >= 10.2 and cx < 30.7 and cy >= 2 and cy < 15.5)", "kn as (select node_id, row_number() over (order by node_id) - 1 as new from (select distinct node_id from corner join kept using (face_id)))", "kf as (select face_id, row_number() over (order by face_id) - 1 as new from kept)"


@register("clip_box", X.sql(X.MESH, X.DATA, *SUB, select="select kf.new as id, any_value(value) as value, list(kn.new order by pos) as nodes from kf join corner using (face_id) join kn using (node_id) join data using (face_id) group by 1"))
def clip_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _faces(spark, sf_dir).clip_box(10.2, 2, 30.7, 15.5)
    return a.df.join(a.grid.faces.withColumnRenamed("face_id", "id"), "id")


@register("sel_slices", X.sql(X.MESH, X.DATA, select="select row_number() over (order by face_id) - 1 as id, value from geo join data using (face_id) where cx >= 10.2 and cy < 15.5"))
def sel_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _faces(spark, sf_dir).sel((10.2, 100.0), (None, 15.5)).df


@register("isel_nodes", X.sql(X.MESH, *SUB, select="select kn.new as node_id, x, y from kn join node using (node_id)"))
def isel_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of a mesh that nodes and faces select together."""
    m = X.mixed_mesh(spark, sf_dir)
    faces = topology.box(m, (10.2, 30.7), (2, 15.5))
    return topology.isel(m, face=faces.withColumnRenamed("face_id", "id"))[0].nodes


@register("subset_edges", X.sql(X.MESH, *SUB, "ke as (select distinct edge_id, e.a, e.b from side join kept using (face_id) join edge e using (a, b))", select="select row_number() over (order by edge_id) - 1 as edge_id, p.new as a, q.new as b from ke join kn p on p.node_id = ke.a join kn q on q.node_id = ke.b"))
def subset_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = X.mixed_mesh(spark, sf_dir)
    m = Mesh(m.nodes, m.faces, edges(m))
    return topology.clip_box(m, 10.2, 2, 30.7, 15.5)[0].edges


@register("network_box", X.sql(X.CUSTOMERS, "e as (select *, (a % 51 + b % 51) / 2e0 as x, (a // 51 + b // 51) / 2e0 as y from cedge)", "k as (select * from e where x >= 10 and x < 30 and y >= 5 and y < 20)", "n as (select u, dense_rank() over (order by u) - 1 as new from (select a as u from k union select b from k))", select="select row_number() over (order by edge_id) - 1 as edge_id, p.new as a, q.new as b from k join n p on p.u = k.a join n q on q.u = k.b"))
def network_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.clip_box(X.customer_network(spark, sf_dir), 10, 5, 30, 20)[0].edges


@register("reindex_like", X.sql(X.MESH, X.DATA, select="select (select max(face_id) from face) - face_id as id, value from data"))
def reindex_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _faces(spark, sf_dir)
    top = a.grid.faces.agg(F.max("face_id").alias("top"))
    faces = a.grid.faces.crossJoin(F.broadcast(top)).select((F.col("top") - F.col("face_id")).alias("face_id"), "nodes")  # joined with one row
    return a.reindex_like(Mesh(a.grid.nodes, faces), 1e-9).df


@register("equal_grids", "select true as same, false as other")
def equal_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, n = X.mixed_mesh(spark, sf_dir), X.mixed_mesh(spark, sf_dir)
    other = Mesh(n.nodes, n.faces.where("face_id > 0"))
    return spark.createDataFrame([(topology.equals(m, n), topology.equals(m, other))], "same boolean, other boolean")


def _faces(spark: SparkSession, sf_dir: str) -> MeshArray:
    return MeshArray(X.mixed_mesh(spark, sf_dir), "face", X.face_data(spark, sf_dir).withColumnRenamed("face_id", "id"))


# points, lines and rasters with values


@register("sel_points_drop", X.sql(X.MESH, X.DATA, X.POINTS, X.LOCATED, select="select point_id, round(value, 6) as value from located join data using (face_id)"))
def sel_points_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _faces(spark, sf_dir).sel_points(X.order_points(spark, sf_dir), out_of_bounds="drop").select("point_id", *r6("value"))


@register("sel_points_nearest", X.sql(X.MESH, X.DATA, X.POINTS, "mv as (select point_id, x + 0.0137e0 as x, y + 0.0071e0 as y from pt)", select="""select m.point_id, case when m.x <= 50 and m.y <= (select max(y) from node) then round(n.value, 6) else -1e0 end as value from mv m join (
    select p.point_id, arg_min(value, (p.x - n.cx) ** 2 + (p.y - n.cy) ** 2) as value from mv p join geo n on n.cx between p.x - 4 and p.x + 4 and n.cy between p.y - 4 and p.y + 4 join data using (face_id) group by 1) n using (point_id)"""))
def sel_points_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _faces(spark, sf_dir).sel_points(X.order_points(spark, sf_dir, 0.0137, 0.0071), method="nearest", out_of_bounds="ignore", fill=-1.0).select("point_id", *r6("value"))


@register("sel_points_grid", X.sql(X.MESH, X.DATA, "pt as (select j * 40 + i as point_id, i + 0.25e0 as x, j + 0.5e0 as y from range(40) a(i), range(20) b(j))", X.LOCATED, select="select point_id, x, y, value from pt join located using (point_id) join data using (face_id)"))
def sel_points_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All crossings of two lists."""
    return _faces(spark, sf_dir).sel([i + 0.25 for i in range(40)], [j + 0.5 for j in range(20)])


CUT_X = "cuts as (select face_id, max(case when slope > 0 then -start / slope else 0 end) as t0, min(case when slope < 0 then -start / slope else 1 end) as t1, bool_or(slope = 0 and start < 0) as out from (select face_id, (qx - px) * (0 - py) - (qy - py) * (7.3 - px) as start, (qx - px) * (select max(y) from node) as slope from seg) group by 1)"


@register("section_values", X.sql(X.MESH, X.DATA, CUT_X, select="select face_id as id, round((select max(y) from node) * (greatest(t0, 0) + least(t1, 1)) / 2, 6) as s, value from cuts join data using (face_id) where not out and least(t1, 1) > greatest(t0, 0)"))
def section_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _faces(spark, sf_dir).sel(7.3, (None, None)).select("id", *r6("s"), "value")


@register("linestring_values", "select id, s, o_totalprice as value from (select o_orderkey as k, 2 * o_orderkey as id, case when o_orderkey = 49 then 48.75e0 when o_orderkey % 2 = 1 then o_orderkey else o_orderkey + 0.25e0 end as s from orders where o_orderkey < 50 union all select o_orderkey, 2 * o_orderkey + 1, o_orderkey - 0.25e0 from orders where o_orderkey between 1 and 49 and o_orderkey % 2 = 0) join orders on o_orderkey = k")
def linestring_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line along the middle of the lowest row."""
    a = _faces(spark, sf_dir).intersect_linestring([(0.5, 0.5), (20.0, 0.5), (49.5, 0.5)])
    return a.select("id", *r6("s"), "value")


@register("rasterized_values", X.sql(X.MESH, X.DATA, "high as (select cast(ceil((select max(y) from node) / 0.8e0) as bigint) as h)", "pt as (select r * 63 + c as point_id, r, c, (c + 0.5e0) * 0.8e0 as x, (h - r - 0.5e0) * 0.8e0 as y from (select h, unnest(range(h)) as r from high), range(63) a(c))", X.LOCATED, select='select r as "row", c as col, value from pt join located using (point_id) left join data using (face_id)'))
def rasterized_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _faces(spark, sf_dir).rasterize(0.8).select("row", "col", "value")


@register("rasterized_like", X.sql(X.MESH, X.DATA, "pt as (select r * 30 + c as point_id, r, c, c * 2.1e0 - 1 as x, r * 0.7e0 + 0.05e0 as y from range(30) a(c), range(40) b(r))", X.LOCATED, select='select r as "row", c as col, value from pt join located using (point_id) left join data using (face_id)'))
def rasterized_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.range(30).select(F.col("id").alias("col"), (F.col("id") * 2.1 - 1).alias("x"))
    y = spark.range(40).select(F.col("id").alias("row"), (F.col("id") * 0.7 + 0.05).alias("y"))
    return _faces(spark, sf_dir).rasterize_like(x, y).select("row", "col", "value")


#: An edge for each order inside of the order's own unit cell, at a slope of its own: no two meet.
SLOPES = "sl as (select o_orderkey as edge_id, o_orderkey % 50 + 0.1e0 as x0, o_orderkey // 50 + 0.2e0 as y0, o_orderkey % 50 + 0.6e0 + (o_custkey % 30) / 100e0 as x1, o_orderkey // 50 + 0.75e0 as y1 from orders)"


def slopes(spark: SparkSession, sf_dir: str) -> Network:
    o = X.read_table(spark, sf_dir, "orders")
    k, x, y = F.col("o_orderkey"), F.col("o_orderkey") % 50, F.floor(F.col("o_orderkey") / 50)
    nodes = o.select(F.inline(F.array(F.struct((2 * k).alias("node_id"), (x + 0.1).alias("x"), (y + 0.2).alias("y")), F.struct((2 * k + 1).alias("node_id"), (x + 0.6 + (F.col("o_custkey") % 30) / 100).alias("x"), (y + 0.75).alias("y")))))
    return Network(nodes, o.select(k.alias("edge_id"), (2 * k).alias("a"), (2 * k + 1).alias("b")))


@register("network_points", f"with {SLOPES} select 2 * edge_id as point_id, edge_id from sl union all select 2 * edge_id + 1, null from sl")
def network_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point on each edge, and one beside it that no edge holds."""
    n = slopes(spark, sf_dir)
    e = geometry.edge_geometry(n.edges, n.nodes)
    x, y = F.col("ax") + (F.col("bx") - F.col("ax")) * 0.382, F.col("ay") + (F.col("by") - F.col("ay")) * 0.382
    points = e.select(F.inline(F.array(F.struct((2 * F.col("edge_id")).alias("point_id"), x.alias("x"), y.alias("y")), F.struct((2 * F.col("edge_id") + 1).alias("point_id"), (x + 0.01).alias("x"), y.alias("y")))))
    return select.locate_points(n, points, 1e-9).select("point_id", "edge_id")


@register("barycentric_weights", X.sql(X.MESH, X.POINTS, "mv as (select point_id, x + 0.0137e0 as x, y + 0.0071e0 as y from pt)", "spot as (select point_id, x - floor(x) as u, y - floor(y) as v, cast(floor(y) as bigint) * 50 + cast(floor(x) as bigint) as q from mv where x < 50 and y < (select max(y) from node))", select="""
    select point_id, face_id, node_id, round(w, 6) as weight from (
      select point_id, 2 * q as face_id, unnest([ll, ll + 1, ll + 52, ll + 51]) as node_id, unnest([(1 - u) * (1 - v), u * (1 - v), u * v, (1 - u) * v]) as w from spot join quad using (q) where q % 2 = 1
      union all select point_id, 2 * q, unnest([ll, ll + 1, ll + 52]), unnest([1 - u, u - v, v]) from spot join quad using (q) where q % 2 = 0 and u >= v
      union all select point_id, 2 * q + 1, unnest([ll, ll + 52, ll + 51]), unnest([1 - v, u, v - u]) from spot join quad using (q) where q % 2 = 0 and u < v)"""))
def barycentric_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compute_barycentric_weights(X.mixed_mesh(spark, sf_dir), X.order_points(spark, sf_dir, 0.0137, 0.0071)).select("point_id", "face_id", "node_id", *r6("weight"))


# Voronoi cells


CELLS_AROUND = """turned as (select node_id, cx, cy, atan2(cy - y, cx - x) as t, count(*) over (partition by node_id) as n from corner join geo using (face_id) join node using (node_id)),
looped as (select node_id, cx as px, cy as py, coalesce(lead(cx) over w, first(cx) over w) as qx, coalesce(lead(cy) over w, first(cy) over w) as qy from turned where n >= 3 window w as (partition by node_id order by t rows between unbounded preceding and unbounded following))"""
on_mesh("voronoi_cells", "select node_id, count(*) as n, round(abs(sum(px * qy - qx * py)) / 2, 5) as area from looped group by 1", CELLS_AROUND)(lambda m: _cell_area(m, voronoi.tessellation(m)))
on_mesh("voronoi_exterior", "select (select count(*) from node) as n_cell, (select count(*) from face) + (select count(*) from ef where f2 is null) + (select count(*) from (select distinct unnest([a, b]) from ef where f2 is null)) as n_vertex, (select round(sum(area), 4) from geo) as area")(
    lambda m: _totals(voronoi.tesselate_centroidal_voronoi(m))
)
on_mesh("voronoi_projected", "select (select count(*) from node) as n_cell, (select count(*) from face) + (select count(*) from ef where f2 is null) as n_vertex")(lambda m: _totals(voronoi.as_mesh(m, voronoi.voronoi_topology(m))).select("n_cell", "n_vertex"))


def _cell_area(m: Mesh, v: voronoi.Voronoi) -> DataFrame:
    g = geometry.with_geometry(voronoi.as_mesh(m, v)).select(F.col("face_id").alias("cell_id"), "area", F.size("ring").cast("long").alias("n"))
    return v.cells.join(g, "cell_id").select("node_id", "n", F.round("area", 5).alias("area"))


def _totals(m: Mesh) -> DataFrame:
    return geometry.with_geometry(m).agg(F.count("*").alias("n_cell"), F.round(F.sum("area"), 4).alias("area")).crossJoin(m.nodes.agg(F.count("*").alias("n_vertex"))).select("n_cell", "n_vertex", "area")  # one row each


@register("circumcenter_voronoi", "with n as (select distinct unnest([k, k + 1, k + 51, k + 52]) as node_id from (select o_orderkey // 50 * 51 + o_orderkey % 50 as k from orders)) select (select count(*) from n) as n_cell, cast(count(*) as double) as area from orders")
def circumcenter_voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells around the circumcenters of the orders' triangles, which cover the raster, one for each node."""
    triangles, _ = geometry.triangulate(X.order_mesh(spark, sf_dir))
    return _totals(voronoi.tesselate_circumcenter_voronoi(triangles)).select("n_cell", F.round("area", 6).alias("area"))


BILINEAR = """lin as (select target_id, value, greatest(0, 1 - abs(ix - gx)) * greatest(0, 1 - abs(iy - gy)) as weight from (
  select target_id, least(greatest((x0 + x1) / 2 - 0.5, 0), 49) as gx, least(greatest((y0 + y1) / 2 - 0.5, 0), 10) as gy from target where (x0 + x1) / 2 <= 50 and (y0 + y1) / 2 <= 11) join cells on abs(ix - gx) < 1 and abs(iy - gy) < 1)"""


def _price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.price_cells(spark, sf_dir).select(F.col("cell").alias("source_id"), "value")


def _sides(spark: SparkSession) -> tuple[Mesh, Mesh]:
    return structured(spark, X.NX, X.NY), structured(spark, X.TX, X.TY, X.TDX, X.TDY)


@register("regrid_barycentric", X.sql(X.CELLS, X.WEIGHTS, BILINEAR, select="select target_id, round(v, 5) as value from target left join (select target_id, sum(weight * value) / sum(weight) as v from lin group by 1) using (target_id)"))
def regrid_barycentric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between the centroids of a mesh of squares this is bilinear, and constant beyond the outer ones."""
    return regridders.BarycentricInterpolator(*_sides(spark)).regrid(_price(spark, sf_dir)).select("target_id", F.round("value", 5).alias("value"))


MEAN = "select target_id, round(v, 6) as value from target left join (select target_id, sum(weight * value) / sum(weight) as v from w group by 1) using (target_id)"


@register("regridder_mean", X.sql(X.CELLS, X.WEIGHTS, select=MEAN))
def regridder_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster onto a mesh, through weights that were written and read again."""
    target = _sides(spark)[1]
    source = regridders.Raster(spark, tuple(map(float, range(X.NX + 1))), tuple(map(float, range(X.NY + 1))))
    regridders.OverlapRegridder(source, target).to_dataset(at := folder(spark))
    return regridders.OverlapRegridder.from_dataset(spark, at).regrid(_price(spark, sf_dir)).select("target_id", *r6("value"))


@register("regridder_relative", X.sql(X.CELLS, X.WEIGHTS, select="select target_id, round(v, 6) as value from target left join (select target_id, sum(weight * value) as v from w group by 1) using (target_id)"))
def regridder_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regridders.RelativeOverlapRegridder(*_sides(spark)).regrid(_price(spark, sf_dir)).select("target_id", *r6("value"))


@register("regridder_centroid", X.sql(X.CELLS, X.WEIGHTS, select="select target_id, round(value, 6) as value from target left join cells on floor((x0 + x1) / 2) = ix and floor((y0 + y1) / 2) = iy and (x0 + x1) / 2 < 50 and (y0 + y1) / 2 < 11"))
def regridder_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regridders.CentroidLocatorRegridder(*_sides(spark)).regrid(_price(spark, sf_dir)).select("target_id", *r6("value"))


@register("regrid_layers", X.sql(X.CELLS, X.WEIGHTS, "l as (select cast(l_quantity as bigint) - 1 + 50 * cast(round(l_discount * 100) as bigint) as source_id, l_linenumber as line, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double) / count(*) / 100 as v from lineitem group by 1, 2)", select="select line, target_id, round(x, 6) as value from (select line, target_id from (select distinct line from l), target) full_ left join (select line, target_id, sum(weight * v) / sum(weight) as x from w join l using (source_id) group by 1, 2) s using (line, target_id)"))
def regrid_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another dimension, and source cells without a value for some of it."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    at = F.col("l_quantity").cast("long") - 1 + X.NX * F.round(F.col("l_discount") * 100).cast("long")
    t = X.read_table(spark, sf_dir, "lineitem").groupBy(at.alias("source_id"), F.col("l_linenumber").alias("line"))
    data = t.agg((F.sum(cents) / F.count("*") / 100).alias("value"))
    return regridders.OverlapRegridder(*_sides(spark)).regrid(data, ("line",)).select("line", "target_id", *r6("value"))


@register(
    "network_gridder",
    f"""with {SLOPES}, c as (select *, unnest(range(cast(floor(x0 / 7.25) as bigint), cast(floor(x1 / 7.25) as bigint) + 1)) as i from sl), d as (select *, unnest(range(cast(floor(y0 / 3.5) as bigint), cast(floor(y1 / 3.5) as bigint) + 1)) as j from c),
    t as (select *, greatest(0, (i * 7.25 - x0) / (x1 - x0), (j * 3.5 - y0) / (y1 - y0)) as t0, least(1, ((i + 1) * 7.25 - x0) / (x1 - x0), ((j + 1) * 3.5 - y0) / (y1 - y0)) as t1 from d)
    select j * 7 + i as target_id, edge_id as source_id, round((t1 - t0) * sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2), 6) as weight from t where t1 - t0 > 1e-9""",
)
def network_gridder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of each edge in each face of the target."""
    top = X.read_table(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("m")).first().m // 50 + 1
    target = from_breaks(spark, [7.25 * k for k in range(8)], [3.5 * k for k in range(int(top / 3.5) + 2)])
    return regridders.NetworkGridder(slopes(spark, sf_dir), target, "sum").weights.select("target_id", "source_id", *r6("weight"))


@register("raster_area", "with t as (select max(o_orderkey) // 50 + 1 as top from orders) select iy * 3 + ix as id, (ix + 1) * (iy + 1) * 0.5e0 as area from range(3) a(ix), (select unnest(range(top)) as iy from t)")
def raster_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose sides grow with the column and the row, over the rows of the orders."""
    top = X.read_table(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("m")).first().m // 50 + 1
    return regridders.Raster(spark, (0.0, 1.0, 3.0, 6.0), tuple(k * (k + 1) / 4 for k in range(top + 1))).area()


# periodic meshes

RING = "ring as (select face_id, list((node_id // 51) * 50 + (node_id % 51) % 50 order by pos) as nodes from corner group by 1)"
on_mesh("to_periodic", "select face_id, nodes from ring", RING)(lambda m: periodic.to_periodic(m)[0].faces)
on_mesh("to_nonperiodic", "select face_id, sum(x) as x, round(sum(y), 6) as y from corner join node using (node_id) group by 1")(lambda m: _corner_sums(periodic.to_nonperiodic(periodic.to_periodic(m)[0], 50.0)[0]))
on_mesh("periodic_edges", "select new.edge_id, 50 * (a // 51) + a % 51 % 50 + 50 * (b // 51) + b % 51 % 50 as total from (select edge_id, row_number() over (order by edge_id) - 1 as k from (select min(edge_id) as edge_id from (select edge_id, least(pa, pb) as u, greatest(pa, pb) as v from (select edge_id, 50 * (a // 51) + a % 51 % 50 as pa, 50 * (b // 51) + b % 51 % 50 as pb from edge)) group by u, v)) new join edge using (edge_id)")(
    lambda m: _periodic_edges(Mesh(m.nodes, m.faces, edges(m)))
)


def _corner_sums(m: Mesh) -> DataFrame:
    return face_nodes(m).join(m.nodes, "node_id").groupBy("face_id").agg(F.sum("x").alias("x"), F.round(F.sum("y"), 6).alias("y"))


def _periodic_edges(m: Mesh) -> DataFrame:
    new, index = periodic.to_periodic(m)
    return new.edges.join(index["edge"].withColumnRenamed("new", "edge_id"), "edge_id").select(F.col("id").alias("edge_id"), (F.col("a") + F.col("b")).alias("total"))


# sources

on_mesh("file_tables", "select face_id, nodes from face")(lambda m: _through_files(m).faces)
on_mesh("file_edges", "select edge_id, a, b from edge")(lambda m: _through_files(m).edges)
on_mesh("wkt_polygons", "select face_id, round(area, 6) as area, round(perimeter, 6) as perimeter from geo")(lambda m: geometry.with_geometry(wkt.grid_from_wkt(wkt.to_wkt(m, "face"))).select("face_id", *r6("area", "perimeter")))
on_mesh("wkt_points", "select node_id as id, x, y from node")(lambda m: wkt.points_to_nodes(wkt.to_wkt(m, "node")))
on_mesh("wkt_lines", "select edge_id as line_id, ux as x0, uy as y0, vx as x1, vy as y1 from ee", ENDS)(lambda m: wkt.segments(wkt.to_wkt(m, "edge")).drop("pos"))


def _through_files(m: Mesh) -> Mesh:
    """Out to dense tables that start at 1 and are filled with -999, and back."""
    out, attrs = tables.to_file_tables(Mesh(m.nodes, m.faces, edges(m)), fill=-999, start_index=1)
    return tables.from_file_tables(out, attrs)


@register("written_datasets", X.sql(X.MESH, X.DATA, "nd as (select node_id, x + y as value from node)", select="select 'face' as facet, face_id as id, value from data union all select 'node', node_id, value from nd"))
def written_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset with arrays on two facets, written and read again."""
    a = _faces(spark, sf_dir)
    nodes = MeshArray(a.grid, "node", a.grid.nodes.select(F.col("node_id").alias("id"), (F.col("x") + F.col("y")).alias("value")))
    MeshDataset({"price": a, "sum": nodes}).to_dataset(at := folder(spark))
    again = MeshDataset.open(spark, at, {a.grid.name: ["price", "sum"]})
    return again["price"].df.select(F.lit(again["price"].facet).alias("facet"), "id", "value").unionByName(again["sum"].df.select(F.lit(again["sum"].facet).alias("facet"), "id", "value"))


@register("opened_many", "select o_orderkey % 3 as part, o_orderkey as id, o_totalprice as value from orders")
def opened_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of three folders with one topology."""
    o, at = X.read_table(spark, sf_dir, "orders"), folder(spark)
    mesh = X.order_mesh(spark, sf_dir)
    for k in range(3):
        tables.write_mesh(mesh, f"{at}/{k}", {"price": o.where(F.col("o_orderkey") % 3 == k).select(F.lit(k).cast("long").alias("part"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))})
    grid, data = tables.read_many(spark, [f"{at}/{k}" for k in range(3)], "price")
    return data.join(grid.faces.select(F.col("face_id").alias("id")), "id", "left_semi").select("part", "id", "value")


def _axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("int").alias("idx"))


COUNTED = "with n as (select count(*) as n from orders), k as (select n, cast(unnest(range(n + 1)) as int) as idx from n)"


@register("interval_breaks", f"{COUNTED} select idx, case when idx = 0 then 1.5e0 when idx = n then (n - 1) * (n - 1) + 2 + (2 * n - 3) / 2e0 else (cast(idx - 1 as bigint) * (idx - 1) + cast(idx as bigint) * idx + 4) / 2e0 end as \"at\" from k")
def interval_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks of cells around the squares of the orders' keys plus 2: halfway between them, and as far beyond the ends."""
    k = F.col("idx").cast("double")
    return breaks.infer_interval_breaks1d(_axis(spark, sf_dir).select("idx", (k * k + 2.0).alias("mid"))).select(F.col("idx").cast("int").alias("idx"), "at")


@register("spacing_breaks", f"{COUNTED} select idx, 100e0 - 10 * cast(idx as bigint) as \"at\" from k")
def spacing_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = _axis(spark, sf_dir).select("idx", (95.0 - F.col("idx") * 10).alias("mid"))
    return breaks.infer_interval_breaks1d(axis, 10.0).select(F.col("idx").cast("int").alias("idx"), "at")


@register("bounds_breaks", f"{COUNTED} select idx, idx * 1.5e0 as \"at\" from k")
def bounds_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _axis(spark, sf_dir).select("idx", (F.col("idx") * 1.5).alias("lower"), ((F.col("idx") + 1) * 1.5).alias("upper"))
    return breaks.bounds1d_to_vertices(b).select(F.col("idx").cast("int").alias("idx"), "at")


@register("structured_bounds", "select row_number() over (order by o_orderkey) - 1 as face_id, o_orderkey as of, cast(case when o_orderkey % 3 = 0 then 3 else 4 end as bigint) as n, case when o_orderkey % 3 = 0 then 0.5e0 else 1e0 end as area from orders where o_orderkey % 5 <> 0")
def structured_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the orders' raster from their corners: every third is a triangle, every fifth lacks a corner."""
    k = F.col("o_orderkey")
    x, y = (k % 50).cast("double"), F.floor(k / 50).cast("double")
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    corners = F.array(p(x + 1, y + 1), p(x, y), F.when(k % 5 == 0, p(x + 1, F.lit(float("nan")))).otherwise(p(x + 1, y)), F.when(k % 3 == 0, p(x, y)).otherwise(p(x, y + 1)))
    mesh, of = breaks.from_structured_bounds(X.read_table(spark, sf_dir, "orders").select(k.alias("cell_id"), corners.alias("corners")))
    return geometry.with_geometry(mesh).select("face_id", F.size("ring").cast("long").alias("n"), "area").join(of, "face_id")


@register("rotated_raster", "select (o_orderkey // 50) * 49 + o_orderkey % 50 as face_id, 2e0 as area, o_orderkey % 50 + o_orderkey // 50 + 1e0 as x, cast(o_orderkey // 50 - o_orderkey % 50 as double) as y from orders where o_orderkey % 50 < 49 and o_orderkey // 50 < (select max(o_orderkey) // 50 from orders)")
def rotated_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster turned by 45 degrees, from its corners, one for each order."""
    corners = X.read_table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 50).alias("iy"), (F.col("o_orderkey") % 50).alias("ix"))
    mesh = breaks.from_intervals2d(corners.select("iy", "ix", (F.col("ix") + F.col("iy")).cast("double").alias("x"), (F.col("iy") - F.col("ix")).cast("double").alias("y")))
    return geometry.with_geometry(mesh).select("face_id", "area", F.round("cx", 6).alias("x"), F.round("cy", 6).alias("y"))


@register("disk_sizes", "with d as (select cast(floor(sqrt(count(*)) / 10) as bigint) as d from orders) select cast(1 + 3 * d * (d + 1) as double) as n_node, 6 * d * d as n_face, round(25e0 * 3 * d * sin(2 * pi() / (6 * d)), 3) as area from d")
def disk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A disk of six sectors, as deep as a tenth of the root of the orders' number."""
    depth = int(X.read_table(spark, sf_dir, "orders").count() ** 0.5 / 10)
    mesh = breaks.generate_disk(spark, 6, depth)
    mesh = Mesh(mesh.nodes.select("node_id", (F.col("x") * 5).alias("x"), (F.col("y") * 5).alias("y")), mesh.faces)
    total = geometry.with_geometry(mesh).agg(F.count("*").alias("n_face"), F.round(F.sum("area"), 3).alias("area"))
    return total.crossJoin(mesh.nodes.agg(F.count("*").cast("double").alias("n_node"))).select("n_node", "n_face", "area")  # one row each


@register(
    "default_roles",
    """with s as (select 2 * count(*) as nodes, count(*) as edges from orders), role(role, name) as (values ('node_dimension', 'network1d_nNodes'), ('edge_dimension', 'network1d_nEdges'), ('edge_node_connectivity', 'network1d_edge_nodes'))
    select 'network1d' as topology, role, name, case when role = 'node_dimension' then nodes else edges end as size from role, s""",
)
def default_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimensions and connectivities that are found in a file of the orders' network, and their sizes."""
    from gridloom.sources import arrays, datasets

    datasets.write_dataset(MeshDataset({}, (slopes(spark, sf_dir),)), path := folder(spark))
    found, _ = arrays.open_arrays(path)
    variables = {n: roles.Variable(v.dims, v.shape, v.attrs) for n, v in found.items()}
    size = {d: n for v in found.values() for d, n in zip(v.dims, v.shape)}
    rows = [(t, r, n, size[n]) for t, kinds in roles.dimensions(variables).items() for r, n in kinds.items()]
    rows += [(t, r, n, found[n].shape[0]) for t, kinds in roles.connectivity(variables).items() for r, n in kinds.items()]
    return spark.createDataFrame(rows, "topology string, role string, name string, size long")


# vectors


@register("burn_lines", X.sql(X.MESH, select="select face_id, cast(max(k) as double) as value from (select face_id, 1 as k from geo where cy > 2 and cy < 3 and cx < 40 union all select face_id, 2 from geo where cx > 5 and cx < 6) group by 1"))
def burn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line along a row and one up a column, off the middle."""
    top = X.read_table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0] // 50 + 1
    lines = spark.createDataFrame([(1, 0, 0.0, 2.4, 39.9, 2.4, 1.0), (2, 0, 5.3, 0.0, 5.3, float(top), 2.0)], "row long, pos int, x0 double, y0 double, x1 double, y1 double, value double")
    return vector.burn_lines(X.mixed_mesh(spark, sf_dir), lines)


@register("burn_touched", X.sql(X.MESH, "sized as (select geo.*, len(nodes) as len from geo join face using (face_id))", select="select face_id, 1e0 as value from sized where xmax > 2.5 and xmin < 7.25 and ymax > 1.5 and ymin < 4.75 and (len = 4 or (case when face_id % 2 = 1 then least(ymax, 4.75) - greatest(xmin, 2.5) > ymin - xmin else least(xmax, 7.25) - greatest(ymin, 1.5) > xmin - ymin end))"))
def burn_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All faces that a rectangle overlaps."""
    geometry_table = spark.createDataFrame([(0, "POLYGON ((2.5 1.5, 7.25 1.5, 7.25 4.75, 2.5 4.75, 2.5 1.5))")], "row long, wkt string")
    return vector.burn(X.mixed_mesh(spark, sf_dir), **wkt.burnable(geometry_table), all_touched=True).where("value is not null")


@register("burn_wkt", X.sql(X.MESH, select="select face_id, case when face_id = 2 then 30e0 when cx > 8 and cx < 12 and cy > 1 and cy < 3 and not (cx > 9 and cx < 11 and cy > 1.4 and cy < 2.6) then 10e0 end as value from geo"))
def burn_wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(0, "POLYGON ((8 1, 12 1, 12 3, 8 3, 8 1), (9 1.4, 11 1.4, 11 2.6, 9 2.6, 9 1.4))", 10.0), (1, "POINT (1.5 0.25)", 30.0)]
    return vector.burn(X.mixed_mesh(spark, sf_dir), **wkt.burnable(spark.createDataFrame(rows, "row long, wkt string, height double"), "height"))


@register("earcut", "select o_orderkey as row, 1e0 as area, cast(2 as bigint) as n from orders where o_orderkey % 2 = 0 union all select o_orderkey, 8e0, 8 from orders where o_orderkey % 2 = 1")
def earcut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles of a square for even orders, and of a square with a hole for odd ones."""
    k = F.col("o_orderkey")
    square = lambda a, s: F.array(*(F.struct((F.lit(float(x) * s) + a + k % 50).alias("x"), (F.lit(float(y) * s) + a + F.floor(k / 50)).alias("y")) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))))
    polygons = X.read_table(spark, sf_dir, "orders").select(k.alias("row"), F.when(k % 2 == 0, square(0.0, 1)).otherwise(square(0.0, 3)).alias("ring"), F.when(k % 2 == 1, F.array(square(1.0, 1))).otherwise(F.array().cast("array<array<struct<x:double,y:double>>>")).alias("holes"))
    mesh, of = vector.earcut_triangulate_polygons(polygons)
    g = geometry.with_geometry(mesh).join(of, "face_id")
    return g.groupBy("row").agg(F.round(F.sum("area"), 6).alias("area"), F.count("*").alias("n"))


@register("bounding_polygon", X.sql(X.MESH, select="select count(*) as n, sum(len) as length, 50 * (select max(y) from node) as area from (select sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) as len from ef join node p on p.node_id = a join node q on q.node_id = b where f2 is null)"))
def bounding_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = vector.bounding_polygon(X.mixed_mesh(spark, sf_dir))
    w = Window.partitionBy("ring").orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    s = rows.select("x", "y", nxt("x").alias("qx"), nxt("y").alias("qy"))
    return s.agg(F.count("*").alias("n"), F.sum(F.sqrt((F.col("x") - F.col("qx")) ** 2 + (F.col("y") - F.col("qy")) ** 2)).alias("length"), (F.sum(F.col("x") * F.col("qy") - F.col("qx") * F.col("y")) / 2).alias("area"))


@register("snap_to_grid", X.sql("e as (select o_orderkey as q from orders where o_orderkey < 50)", select="select q + 0.5e0 as x, 3e0 as y, cast(7 as bigint) as line_id, 1e0 as length2 from e"))
def snap_to_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line a little above a row of sides stands for these sides."""
    mesh = X.order_mesh(spark, sf_dir)
    line = spark.createDataFrame([(7, 0, 0.0, 3.2, 50.0, 3.2)], "line_id long, pos int, x0 double, y0 double, x1 double, y1 double")
    snapped = vector.snap_to_grid(mesh, line, 0.05)
    at = geometry.mesh_edge_geometry(mesh).select("edge_id", "x", "y")
    return snapped.join(at, "edge_id").select("x", "y", "line_id", F.round("length2", 6).alias("length2"))


@register("snap_nodes", "select o_orderkey as point_id, dense_rank() over (order by o_orderkey // 3) - 1 as new from orders")
def snap_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in groups of three that are near each other."""
    k = F.col("o_orderkey")
    points = X.read_table(spark, sf_dir, "orders").select(k.alias("point_id"), (F.floor(k / 3) % 100 + (k % 3) * 0.01).alias("x"), F.floor(k / 300).cast("double").alias("y"))
    return vector.snap_nodes(points, 0.05)[0]


# graphs


@register("contract_vertices", "with n as (select o_custkey, o_orderkey, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) as b from orders where o_orderkey % 3 <> 1) select o_orderkey as a, b from n where b is not null")
def contract_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders without a third of them."""
    n = X.customer_network(spark, sf_dir)
    keep = n.nodes.where("node_id % 3 <> 1").select(F.col("node_id").alias("id"))
    return graph.contract_vertices(n.edges.select("a", "b"), keep)


@register("refine_by_vertices", X.sql("k as (select o_orderkey as k from orders)", select="select 2 * k as edge_id, k as a, (select count(*) * 2 from k) + k as b from k union all select 2 * k + 1, (select count(*) * 2 from k) + k, (select count(*) from k) + k from k"))
def refine_by_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vertex in the middle of each of many edges."""
    o = X.read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    n = o.count()
    at = lambda x, shift: o.select((F.col("k") + shift).alias("node_id"), (F.col("k") % 50 * 2 + x).cast("double").alias("x"), F.floor(F.col("k") / 50).cast("double").alias("y"))
    network = Network(at(0, 0).unionByName(at(1, n)), o.select(F.col("k").alias("edge_id"), F.col("k").alias("a"), (F.col("k") + n).alias("b")))
    vertices = at(0.5, 0).withColumnRenamed("node_id", "vertex_id")
    return graph.refine_by_vertices(network, vertices).edges


@register("nearest_on_network", "with f as (select o_custkey, min(o_orderkey) as low from orders group by 1) select o_orderkey as id, cast(low as double) as value from orders join f using (o_custkey)")
def nearest_on_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only a customer's first order has a value; along the edges it is the nearest one for all of the customer's."""
    n = X.customer_network(spark, sf_dir)
    first = n.nodes.join(n.edges.select(F.col("b").alias("node_id")), "node_id", "left_anti").select("node_id", F.col("node_id").cast("double").alias("value"))
    data = n.nodes.select("node_id").join(first, "node_id", "left").select(F.col("node_id").alias("id"), "value")
    ways = connectivity.node_nodes(n.edges).select("src", "dst", F.lit(1.0).alias("length"))
    return graph.nearest_on_network(ways, data)


@register("cyclic_graphs", "select false as orders, true as ring")
def cyclic_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = X.customer_network(spark, sf_dir).edges.select("a", "b")
    ring = n.unionByName(n.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return spark.createDataFrame([(graph.is_cyclic(n), graph.is_cyclic(ring))], "orders boolean, ring boolean")


def _strips(m: Mesh) -> DataFrame:
    return MeshArray(m, "face", m.faces.select(F.col("face_id").alias("id"), F.lit(0.0).alias("value"))).connected_components().df.select("id", F.col("value").cast("int").alias("value"))


on_mesh("exterior_dilation", "select face_id as id, face_id in (select f1 from ef where f2 is null) and face_id % 10 <> 3 as value from face")(
    lambda m: MeshArray(m, "face", m.faces.select(F.col("face_id").alias("id"), F.lit(False).alias("value"))).binary_dilation(mask=m.faces.where("face_id % 10 = 3").select(F.col("face_id").alias("id")), border_value=True).df
)
on_mesh("mesh_components", "select face_id as id, cast(face_id // 2 % 50 // 5 as int) as value from face where face_id // 2 % 50 % 5 <> 4")(lambda m: _strips(Mesh(m.nodes, m.faces.where("cast(face_id / 2 as bigint) % 50 % 5 <> 4"))))  # ten strips of four columns


@register(
    "rcm_order",
    """with o as (select o_orderkey as id, min(o_orderkey) over (partition by o_custkey) as label, count(*) over (partition by o_custkey) as n, row_number() over (partition by o_custkey order by o_orderkey) as k from orders),
    p as (select id, label, case when n < 3 then k when k = 1 then 2 when k = 2 then 1 else k end as place from o)
    select id, count(*) over () - row_number() over (order by label, place) as rank from p""",
)
def rcm_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star for each customer, the first order in its middle: walked from its lowest leaf."""
    o = X.read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    first = o.groupBy("o_custkey").agg(F.min("id").alias("first"))
    rays = o.join(first, "o_custkey").where("id <> first").select(F.col("id").alias("src"), F.col("first").alias("dst"))
    return graph.reverse_cuthill_mckee(o.select("id"), rays.unionByName(rays.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))


# partitions with data


@register("merged_networks", X.sql(X.CUSTOMERS, "used as (select a as k from cedge union select b from cedge)", "n as (select k, row_number() over (order by part, k) - 1 as new from (select k, min(part) as part from (select a as k, edge_id % 2 as part from cedge union all select b, edge_id % 2 from cedge) group by 1))", select="select row_number() over (order by edge_id % 2, edge_id) - 1 as edge_id, p.new as a, q.new as b from cedge join n p on p.k = cedge.a join n q on q.k = cedge.b"))
def merged_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = X.customer_network(spark, sf_dir)
    parts = [g for g, _ in partition.split(n, n.edges.select("edge_id", (F.col("edge_id") % 2).alias("label")))]
    return partition.merge_grids(parts)[0].edges


@register("weighted_partitions", X.sql(X.MESH, select="select cast(8 as bigint) as n_label, true as balanced"))
def weighted_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of about equal price."""
    a = MeshArray(X.mixed_mesh(spark, sf_dir), "face", X.face_data(spark, sf_dir).select(F.col("face_id").alias("id"), F.col("value").cast("long").alias("value")))
    parts = a.df.join(a.label_partitions(8).withColumnRenamed("face_id", "id"), "id").groupBy("label").agg(F.sum("value").alias("w"))
    return parts.agg(F.count("*").alias("n_label"), (F.max("w") < 1.05 * F.min("w") + 2_000_000).alias("balanced"))


@register("concatenated", "select o_orderkey as id, run, o_totalprice * (run + 1) as value from orders, range(2) r(run)")
def concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _orders(spark, sf_dir)
    return concat([a, a * 2.0], "run", [0, 1]).df.select("id", F.col("run").cast("long").alias("run"), "value")


@register("merged_sets", "select o_orderkey as id, o_totalprice as price, cast(o_custkey as double) as customer from orders")
def merged_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _orders(spark, sf_dir)
    b = MeshArray(a.grid, "face", X.read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("double").alias("value")), "customer")
    return merge(MeshDataset({"price": MeshArray(a.grid, "face", a.df, "price")}), b).to_geodataframe().select("id", "price", "customer")


def _orders(spark: SparkSession, sf_dir: str) -> MeshArray:
    return MeshArray(X.order_mesh(spark, sf_dir), "face", X.read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value")))


@register("merged_time", "select o_orderkey as id, line, o_totalprice + line as value from orders, range(2) l(line)")
def merged_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions with another dimension, merged."""
    a = _orders(spark, sf_dir)
    a = MeshArray(a.grid, "face", a.df.select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("line"), "value").withColumn("value", F.col("value") + F.col("line")))
    half = X.read_table(spark, sf_dir, "orders").agg(F.floor(F.max("o_orderkey") / 2).alias("h")).first().h
    labels = a.grid.faces.select("face_id", (F.col("face_id") > half).cast("int").alias("label"))
    merged = merge_partitions(MeshDataset({"price": a}).partition_by_label(labels))
    return merged["price"].df.select("id", F.col("line").cast("long").alias("line"), "value")
