"""The registered mesh queries and their SQL: geometry, connectivity, selection, regridding, graphs, vectors, partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators import connectivity as C
from gridloom.operators import facets, geometry, graph, partition, reduce, regrid, select, vector, voxels
from gridloom.data import MeshArray, MeshDataset
from gridloom.data import merge_partitions as merge_sets
from gridloom.operators.mesh import Mesh, edges, face_nodes, structured
from gridloom.operators.regridders import OverlapRegridder, Raster
from gridloom.plans import fixtures as X
from gridloom.plans.registry import ORACLES, QUERIES, Query, on_mesh, r6, register

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query that ``entry`` runs."""
    return QUERIES["regrid_mean"](spark, sf_dir)


# geometry
on_mesh("face_geometry", "select face_id, round(area, 6) as area, round(perimeter, 6) as perimeter, round(cx, 6) as cx, round(cy, 6) as cy from geo")(
    lambda m: geometry.with_geometry(m).select("face_id", *r6("area", "perimeter", "cx", "cy"))
)
on_mesh("face_bounds", "select face_id, xmin, ymin, xmax, ymax from geo")(lambda m: geometry.with_geometry(m).select("face_id", "xmin", "ymin", "xmax", "ymax"))
on_mesh("mesh_bounds", "select min(x) as xmin, min(y) as ymin, max(x) as xmax, max(y) as ymax from node")(lambda m: geometry.bounds(m.nodes))
on_mesh("edge_geometry", "select edge_id, e.a, e.b, (p.x + q.x) / 2 as x, (p.y + q.y) / 2 as y, round(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2), 6) as length from edge e join node p on p.node_id = e.a join node q on q.node_id = e.b")(
    lambda m: geometry.mesh_edge_geometry(m).select("edge_id", "a", "b", "x", "y", *r6("length"))
)
on_mesh("nodes_per_face", "select len(nodes) as n_nodes, count(*) as n_faces from face group by 1")(lambda m: m.faces.groupBy(F.size("nodes").alias("n_nodes")).agg(F.count("*").alias("n_faces")))
on_mesh("triangulate", "select face_id, cast(k - 1 as integer) as part, nodes[1] as n0, nodes[k + 1] as n1, nodes[k + 2] as n2 from (select face_id, nodes, unnest(range(1, len(nodes) - 1)) as k from face)")(geometry.triangles)

# connectivity
on_mesh("edge_node", "select edge_id, a, b from edge")(edges)
on_mesh("face_node", "select face_id, cast(pos as integer) as pos, node_id from corner")(face_nodes)
on_mesh("face_edge", "select face_id, cast(pos as integer) as pos, edge_id from side join edge using (a, b)")(C.face_edges)
on_mesh("edge_face", "select edge_id, a, b, f1, f2 from ef")(C.edge_faces)
on_mesh("face_face", "select src, dst, via from ff")(C.face_faces)
on_mesh("node_face", "select node_id, list(face_id order by face_id) as faces from corner group by 1")(C.node_faces)
on_mesh("node_edge", "select node_id, list(edge_id order by edge_id) as edges from (select edge_id, a as node_id from edge union all select edge_id, b from edge) group by 1")(lambda m: C.node_edges(edges(m)))
on_mesh("node_node", "select a as src, b as dst, edge_id as via from edge union all select b, a, edge_id from edge")(lambda m: C.node_nodes(edges(m)))
ENDS = "ends as (select edge_id, a as node_id from edge union all select edge_id, b from edge)"
on_mesh("edge_edge", "select x.edge_id as src, y.edge_id as dst, node_id as via from ends x join ends y using (node_id) where x.edge_id <> y.edge_id", ENDS)(lambda m: C.edge_edges(edges(m)))
on_mesh("directed_edge_edge", "select x.edge_id as src, y.edge_id as dst, x.b as via from edge x join ends y on y.node_id = x.b where x.edge_id <> y.edge_id", ENDS)(lambda m: C.directed_edge_edges(edges(m)))
on_mesh("boundary_edges", "select edge_id, a, b, f1 as face_id from ef where f2 is null")(C.boundary_edges)
on_mesh("exterior_faces", "select distinct f1 as face_id from ef where f2 is null")(C.exterior_faces)
on_mesh(
    "adjacency_weights",
    "select src, dst, via, round((select avg(d) from d) / d, 6) as weight from d",
    "d as (select src, dst, via, sqrt((p.cx - q.cx) ** 2 + (p.cy - q.cy) ** 2) as d from ff join geo p on p.face_id = src join geo q on q.face_id = dst)",
)(lambda m: C.adjacency_weights(C.face_faces(m), geometry.with_geometry(m).select(F.col("face_id").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"))).select("src", "dst", "via", *r6("weight")))
on_mesh(
    "faces_subset",
    "select row_number() over (order by k.face_id) - 1 as face_id, len(nodes) as n, list_sum(list_transform(nodes, lambda v: m[v])) as total from k join face using (face_id), (select map(list(node_id), list(new)) as m from ids)",
    "k as (select face_id from face where face_id % 3 = 0)",
    "ids as (select node_id, row_number() over (order by node_id) - 1 as new from (select distinct node_id from corner join k using (face_id)))",
)(lambda m: C.faces_subset(m, m.faces.where("face_id % 3 = 0").select("face_id")).faces.select("face_id", F.size("nodes").cast("long").alias("n"), F.aggregate("nodes", F.lit(0).cast("long"), lambda a, v: a + v).alias("total")))

# selection
on_mesh("sel_box", "select face_id from geo where cx >= 10.2 and cx < 30.7 and cy >= 0 and cy < 5.5")(lambda m: select.sel_box(m, (10.2, 30.7), (None, 5.5)))


@register("locate_points", X.sql(X.MESH, X.POINTS, X.LOCATED, select="select point_id, face_id from located"))
def locate_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.locate_points(X.mixed_mesh(spark, sf_dir), X.order_points(spark, sf_dir))


@register("sel_points", X.sql(X.MESH, X.DATA, X.POINTS, X.LOCATED, select="select point_id, round(case when face_id is null then -1.0 else value end, 6) as value from located left join data using (face_id)"))
def sel_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = X.face_data(spark, sf_dir).withColumnRenamed("face_id", "id")
    return select.sel_points(X.mixed_mesh(spark, sf_dir), X.order_points(spark, sf_dir), data, out_of_bounds="ignore", fill=-1.0).select("point_id", *r6("value"))


@register("points_per_face", X.sql(X.MESH, X.POINTS, X.LOCATED, select="select face_id, count(*) as n from located where face_id is not null group by 1"))
def points_per_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate_points(spark, sf_dir).where("face_id is not null").groupBy("face_id").agg(F.count("*").alias("n"))


MOVED = "mv as (select point_id, x + 0.0137e0 as x, y + 0.0071e0 as y from pt)"  # no two targets at one distance


@register("nearest_node", X.sql(X.MESH, X.POINTS, MOVED, select="select point_id, arg_min(n.node_id, (p.x - n.x) ** 2 + (p.y - n.y) ** 2) as id, round(min(sqrt((p.x - n.x) ** 2 + (p.y - n.y) ** 2)), 6) as distance from mv p join node n on n.x between p.x - 3 and p.x + 3 and n.y between p.y - 3 and p.y + 3 group by 1"))
def nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.locate_nearest(X.mixed_mesh(spark, sf_dir), "node", X.order_points(spark, sf_dir, 0.0137, 0.0071)).select("point_id", "id", *r6("distance"))


@register("nearest_face", X.sql(X.MESH, X.POINTS, MOVED, select="select point_id, arg_min(n.face_id, (p.x - n.cx) ** 2 + (p.y - n.cy) ** 2) as id, round(min(sqrt((p.x - n.cx) ** 2 + (p.y - n.cy) ** 2)), 6) as distance from mv p join geo n on n.cx between p.x - 4 and p.x + 4 and n.cy between p.y - 4 and p.y + 4 group by 1"))
def nearest_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.locate_nearest(X.mixed_mesh(spark, sf_dir), "face", X.order_points(spark, sf_dir, 0.0137, 0.0071)).select("point_id", "id", *r6("distance"))


@register("nearest_edge_within", X.sql(X.MESH, X.POINTS, MOVED, "em as (select edge_id, (p.x + q.x) / 2 as x, (p.y + q.y) / 2 as y from edge e join node p on p.node_id = e.a join node q on q.node_id = e.b)", select="select mv.point_id, m.id from mv left join (select p.point_id, arg_min(n.edge_id, (p.x - n.x) ** 2 + (p.y - n.y) ** 2) as id from mv p join em n on n.x between p.x - 1 and p.x + 1 and n.y between p.y - 1 and p.y + 1 where (p.x - n.x) ** 2 + (p.y - n.y) ** 2 < 0.25 ** 2 group by 1) m using (point_id)"))
def nearest_edge_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.locate_nearest(X.mixed_mesh(spark, sf_dir), "edge", X.order_points(spark, sf_dir, 0.0137, 0.0071), 0.25).select("point_id", "id")


HIGH_ROWS = "high as (select cast(ceil((select max(y) from node) / 0.8e0) as bigint) as h)"
RASTER = X.MESH, HIGH_ROWS, "pt as (select r * 63 + c as point_id, r, c, (c + 0.5e0) * 0.8e0 as x, (h - r - 0.5e0) * 0.8e0 as y from (select h, unnest(range(h)) as r from high), range(63) a(c))", X.LOCATED


@register("rasterize", X.sql(*RASTER, select='select r as "row", c as col, round(x, 6) as x, round(y, 6) as y, face_id from pt join located using (point_id)'))
def rasterize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.rasterize(X.mixed_mesh(spark, sf_dir), 0.8).select("row", "col", *r6("x", "y"), "face_id")


CUTS = """cuts as (select face_id, max(case when slope > 0 then -start / slope else 0 end) as t0, min(case when slope < 0 then -start / slope else 1 end) as t1,
  bool_or(slope = 0 and start < 0) as out from (select face_id, (qx - px) * (0.3 - py) - (qy - py) * (0.7 - px) as start, (qx - px) * 10.1 - (qy - py) * 47.9 as slope from seg) group by 1)"""


@register("intersect_line", X.sql(X.MESH, CUTS, select="select face_id, round(47.9 * (t0 + t1) / 2 + 0.7, 6) as x, round(sqrt(47.9 ** 2 + 10.1 ** 2) * (greatest(t0, 0) + least(t1, 1)) / 2, 6) as s from cuts where not out and least(t1, 1) > greatest(t0, 0)"))
def intersect_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.createDataFrame([(0, 0, 0.7, 0.3, 48.6, 10.4)], "line_id long, pos int, x0 double, y0 double, x1 double, y1 double")
    return select.intersect_linestring(X.mixed_mesh(spark, sf_dir), line).select("face_id", *r6("x", "s"))


# regridding
def _weights(spark: SparkSession, relative: bool = False) -> DataFrame:
    a = lambda n, d: regrid.axis(spark, [k * d for k in range(n + 1)])
    x = regrid.axis_overlap(a(X.NX, 1.0), a(X.TX, X.TDX), relative)
    y = regrid.axis_overlap(a(X.NY, 1.0), a(X.TY, X.TDY), relative)
    return regrid.outer(x, y, X.NX, X.TX)


def _regrid(method: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = X.price_cells(spark, sf_dir).select(F.col("cell").alias("source_id"), "value")
        targets = spark.range(X.TX * X.TY).select(F.col("id").alias("target_id"))
        return reduce.reduce_weights(_weights(spark, method in ("conservative", "conductance")), data, targets, method).select("target_id", F.round("value", 4).alias("value"))

    return query


_SQL = {
    "mean": "sum(weight * value) / nullif(sum(weight), 0)",
    "harmonic_mean": "sum(case when value <> 0 then weight end) / sum(case when value <> 0 then weight / value end)",
    "geometric_mean": "exp(sum(case when value > 0 then weight * ln(value) end) / sum(case when value > 0 then weight end))",
    "sum": "sum(value)",
    "minimum": "min(value)",
    "maximum": "max(value)",
    "median": "quantile_cont(value, 0.5)",
    **{f"p{p}": f"quantile_cont(value, {p / 100})" for p in (5, 10, 25, 50, 75, 90, 95)},
    "conservative": "sum(weight * value)",  # source cells have unit area
    "max_overlap": "arg_max(value, struct_pack(w := weight, v := value))",
}
for _name, _expression in _SQL.items():
    _text = X.sql(X.CELLS, X.WEIGHTS, select=f"select target_id, round(v, 4) as value from target left join (select target_id, {_expression} as v from w group by 1) using (target_id)")
    register(f"regrid_{_name}", _text)(_regrid(_name))
register("regrid_mode", X.sql(X.CELLS, X.WEIGHTS, select="select target_id, round(v, 4) as value from target left join (select target_id, arg_max(value, struct_pack(w := w, v := value)) as v from (select target_id, value, sum(weight) as w from w group by 1, 2) group by 1) using (target_id)"))(_regrid("mode"))


OVERLAPS = """with c as (select o_orderkey as source_id, o_orderkey % 50 as ix, o_orderkey // 50 as iy from orders),
    d as (select *, unnest(range(cast(floor(ix / 7.25) as bigint), least(7, cast(ceil((ix + 1) / 7.25) as bigint)))) as i from c), e as (select *, unnest(range(cast(floor(iy / 2.5) as bigint), cast(ceil((iy + 1) / 2.5) as bigint))) as j from d)
    select j * 7 + i as target_id, source_id, round((least(7.25 * (i + 1), ix + 1) - greatest(7.25 * i, ix)) * (least(2.5 * (j + 1), iy + 1) - greatest(2.5 * j, iy)), 6) as weight from e"""


def _order_rasters(spark: SparkSession, sf_dir: str) -> tuple[Raster, Raster]:
    """The orders' raster, row by row, and a coarser one over it."""
    top = X.read_table(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("m")).first().m // X.NX + 1
    return Raster(spark, tuple(map(float, range(X.NX + 1))), tuple(map(float, range(top + 1)))), Raster(spark, tuple(7.25 * k for k in range(8)), tuple(2.5 * k for k in range(int(-(-top // 2.5)) + 1)))


@register("overlap_weights", OVERLAPS)
def overlap_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return OverlapRegridder(*_order_rasters(spark, sf_dir)).weights.select("target_id", "source_id", *r6("weight"))


@register("overlap_general", OVERLAPS)
def overlap_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = regrid.overlap_weights(X.order_mesh(spark, sf_dir), _order_rasters(spark, sf_dir)[1].to_mesh())
    return w.select("target_id", "source_id", *r6("weight"))


@register(
    "regrid_voxels",
    OVERLAPS.replace("select j * 7 + i as target_id", ", w as (select j * 7 + i as target_id", 1).replace(", 6) as weight from e", ", 6) as weight from e)", 1)
    + """, g as (select l_orderkey, l_linenumber, sum(l_quantity) as q, sum(round(l_extendedprice * 100)) / 100 as value from lineitem group by 1, 2),
    l as (select l_orderkey as source_id, sum(q) over (partition by l_orderkey order by l_linenumber) - q as bottom, q as high, value from g),
    x as (select *, unnest(range(cast(floor(bottom / 40) as bigint), least(25, cast(ceil((bottom + high) / 40) as bigint)))) as layer from l),
    y as (select w.target_id, x.layer, weight * (least(bottom + high, 40 * (layer + 1)) - greatest(bottom, 40 * layer)) as weight, value from x join w using (source_id)),
    m as (select target_id, layer, sum(weight * value) / sum(weight) as value from y group by all)
    select target_id, layer, round(value + 0.00012345, 2) as value from (select distinct target_id from w) cross join range(25) k(layer) left join m using (target_id, layer)""",
)
def regrid_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as the layers of its column, as thick as their quantity, on layers of 40 over a coarser raster."""
    source, target = _order_rasters(spark, sf_dir)
    weights = OverlapRegridder(source, target).weights.withColumn("weight", F.round("weight", 6))
    low = Window.partitionBy("l_orderkey").orderBy("l_linenumber")  # an order's lines
    lines = X.read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"), (F.sum(F.round(F.col("l_extendedprice") * 100)) / 100).alias("value"))
    lines = lines.withColumn("top", F.sum("q").over(low)).select(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("layer"), (F.col("top") - F.col("q")).alias("bottom"), "top", "value")
    layers, data = lines.drop("value"), lines.select("source_id", "layer", "value")
    even = weights.select("target_id").distinct().withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(24))))
    even = even.select("target_id", "layer", (F.col("layer") * 40.0).alias("bottom"), (F.col("layer") * 40.0 + 40).alias("top"))
    return voxels.regrid_voxels(weights, layers, even, data).select("target_id", F.col("layer").cast("long").alias("layer"), F.round(F.col("value") + 0.00012345, 2).alias("value"))  # means that are halves of a cent are no ties then


@register("overlap_triangles", X.sql(X.MESH, select="select face_id // 2 as target_id, sum(round(area, 6)) as area from geo group by 1"))
def overlap_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = regrid.overlap_weights(X.mixed_mesh(spark, sf_dir), X.order_mesh(spark, sf_dir))
    return w.groupBy("target_id").agg(F.round(F.sum("weight"), 6).alias("area"))


@register("regrid_centroid", X.sql(X.CELLS, X.WEIGHTS, select="select target_id, round(value, 6) as value from target left join cells on floor((x0 + x1) / 2) = ix and floor((y0 + y1) / 2) = iy and (x0 + x1) / 2 < 50 and (y0 + y1) / 2 < 11"))
def regrid_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = lambda n, d: regrid.axis(spark, [k * d for k in range(n + 1)])
    w = regrid.outer(regrid.axis_centroids(a(X.NX, 1.0), a(X.TX, X.TDX)), regrid.axis_centroids(a(X.NY, 1.0), a(X.TY, X.TDY)), X.NX, X.TX)
    targets = spark.range(X.TX * X.TY).select(F.col("id").alias("target_id"))
    return reduce.reduce_weights(w, X.price_cells(spark, sf_dir).select(F.col("cell").alias("source_id"), "value"), targets).select("target_id", *r6("value"))


LINEAR = """lin as (select target_id, ix, iy, value, greatest(0, 1 - abs(ix - gx)) * greatest(0, 1 - abs(iy - gy)) as weight from (
  select target_id, least(greatest((x0 + x1) / 2 - 0.5, 0), 49) as gx, least(greatest((y0 + y1) / 2 - 0.5, 0), 10) as gy from target where (x0 + x1) / 2 <= 50 and (y0 + y1) / 2 <= 11) join cells on abs(ix - gx) < 1 and abs(iy - gy) < 1)"""


@register("regrid_bilinear", X.sql(X.CELLS, X.WEIGHTS, LINEAR, select="select target_id, round(v, 6) as value from target left join (select target_id, sum(weight * value) / sum(weight) as v from lin group by 1) using (target_id)"))
def regrid_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = lambda n, d: regrid.axis(spark, [k * d for k in range(n + 1)])
    w = regrid.outer(regrid.axis_linear(a(X.NX, 1.0), a(X.TX, X.TDX)), regrid.axis_linear(a(X.NY, 1.0), a(X.TY, X.TDY)), X.NX, X.TX)
    targets = spark.range(X.TX * X.TY).select(F.col("id").alias("target_id"))
    return reduce.reduce_weights(w, X.price_cells(spark, sf_dir).select(F.col("cell").alias("source_id"), "value"), targets).select("target_id", *r6("value"))


# facets
@register("to_node_mean", X.sql(X.MESH, X.DATA, select="select node_id as target_id, round(avg(value), 6) as value from corner left join data using (face_id) group by 1"))
def to_node_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.mean_on(X.mixed_mesh(spark, sf_dir), X.face_data(spark, sf_dir).withColumnRenamed("face_id", "id"), "face", "node").select("target_id", *r6("value"))


@register("to_edge_mean", X.sql(X.MESH, X.DATA, select="select edge_id as target_id, round(avg(value), 6) as value from side join edge using (a, b) left join data using (face_id) group by 1"))
def to_edge_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.mean_on(X.mixed_mesh(spark, sf_dir), X.face_data(spark, sf_dir).withColumnRenamed("face_id", "id"), "face", "edge").select("target_id", *r6("value"))


@register("edge_contrast", X.sql(X.MESH, X.DATA, select="select edge_id, round(q.value - p.value, 6) as value from ef join data p on p.face_id = f1 join data q on q.face_id = f2"))
def edge_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.edge_contrast(X.mixed_mesh(spark, sf_dir), X.face_data(spark, sf_dir).withColumnRenamed("face_id", "id")).select("edge_id", *r6("value"))


# graph
HIGH = "high as (select face_id as id, value > (select quantile_cont(value, 0.9) from data) as value from data)"


def _high(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.face_data(spark, sf_dir)
    top = d.agg(F.percentile("value", 0.9).alias("top"))
    return d.crossJoin(F.broadcast(top)).select(F.col("face_id").alias("id"), (F.col("value") > F.col("top")).alias("value"))  # joined with one row


def _steps(value: bool, n: int) -> list[str]:
    word = str(value).lower()
    return [f"s{k} as (select id, case when exists (select 1 from ff join s{k - 1} t on t.id = ff.src where ff.dst = s.id and t.value = {word}) then {word} else s.value end as value from s{k - 1} s)" for k in range(1, n + 1)]


@register("binary_dilation", X.sql(X.MESH, X.DATA, HIGH, "s0 as (select * from high)", *_steps(True, 2), select="select id, value from s2"))
def binary_dilation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.binary_dilation(C.face_faces(X.mixed_mesh(spark, sf_dir)), _high(spark, sf_dir), iterations=2)


@register("binary_erosion", X.sql(X.MESH, X.DATA, HIGH, "s0 as (select id, not value as value from high)", *_steps(False, 2), select="select id, value from s2"))
def binary_erosion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.binary_erosion(C.face_faces(X.mixed_mesh(spark, sf_dir)), _high(spark, sf_dir).select("id", (~F.col("value")).alias("value")), iterations=2, border_value=True)


SAME = X.KIND + """,
same as (select src, dst from ff join kind p on p.face_id = src join kind q on q.face_id = dst where p.k = q.k),
reach as (select face_id as id, face_id as other from kind union select r.id, s.dst from reach r join same s on s.src = r.other),
low as (select id, min(other) as low from reach group by 1)"""
LABELS = "lab as (select id as face_id, dense_rank() over (order by low) - 1 as label from low)"


def _recursive(text: str) -> str:
    return text.replace("with ", "with recursive ", 1)


@register("equal_regions", _recursive(X.sql(X.MESH, SAME, select="select id as face_id, dense_rank() over (order by low) - 1 as label from low")))
def equal_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.equal_regions(X.mixed_mesh(spark, sf_dir), X.face_kind(spark, sf_dir)).select("face_id", "label")


OUTLINE = """way as (select face_id, p, q, label from turn join lab using (face_id)),
outline as (select w.label, w.p, w.q from way w left join way o on o.label = w.label and o.p = w.q and o.q = w.p where o.label is null)"""


@register("polygonize", _recursive(X.sql(X.MESH, SAME, LABELS, OUTLINE, select="select label, a.x as x0, a.y as y0, b.x as x1, b.y as y1 from outline join node a on a.node_id = p join node b on b.node_id = q")))
def polygonize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sides of all rings, from each corner to the next one."""
    rows = vector.outlines(X.mixed_mesh(spark, sf_dir), X.face_kind(spark, sf_dir))
    ring = Window.partitionBy("label", "ring")
    after = lambda c: F.coalesce(F.lead(c).over(ring.orderBy("pos")), F.first(c).over(ring.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.select("label", F.col("x").alias("x0"), F.col("y").alias("y0"), after("x").alias("x1"), after("y").alias("y1"))


HOLES = "hole as (select face_id from face where (face_id // 2) % 4 = 1)"  # no two of them are neighbours


@register("laplace_fill", X.sql(X.MESH, X.DATA, HOLES, "d as (select src, dst, sqrt((p.cx - q.cx) ** 2 + (p.cy - q.cy) ** 2) as d from ff join geo p on p.face_id = src join geo q on q.face_id = dst)", select="""select face_id as id, round(value, 2) as value from data where face_id not in (select face_id from hole)
    union all select src, round(sum(value / d) / sum(1 / d), 2) from d join hole h on h.face_id = src join data on data.face_id = dst group by 1"""))
def laplace_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.face_data(spark, sf_dir).select(F.col("face_id").alias("id"), F.when(F.floor(F.col("face_id") / 2) % 4 != 1, F.col("value")).alias("value"))
    return MeshArray(X.mixed_mesh(spark, sf_dir), "face", d).laplace_interpolate(tolerance=1e-12).df.select("id", F.round("value", 2).alias("value"))


SHIFTED = "shifted as (select face_id, value, cx + face_id * 7919 % 1000 / 1e5 as x, cy + face_id * 104729 % 1000 / 1e5 as y from data join geo using (face_id))"


GAP = "(p.x - q.x) ** 2 + (p.y - q.y) ** 2"
#: The nearest place with a value, by squares of 2; those that have none within 2 meet all others.
NEAREST = f"""gone as (select face_id, x, y from shifted where face_id % 5 = 0), known as (select face_id, x, y, value from shifted where face_id % 5 <> 0),
near as (select p.face_id, arg_min(q.value, {GAP}) as value from (select *, floor(x / 2) + i as u, floor(y / 2) + j as v from gone, range(-1, 2) a(i), range(-1, 2) b(j)) p
  join (select *, floor(x / 2) as u, floor(y / 2) as v from known) q using (u, v) where {GAP} <= 4 group by 1),
far as (select p.face_id, arg_min(q.value, {GAP}) as value from (select * from gone where face_id not in (select face_id from near)) p, known q group by 1)"""


@register("interpolate_na", X.sql(X.MESH, X.DATA, SHIFTED, NEAREST, select="""select face_id as id, 1 as line, round(value, 6) as value from data where face_id % 5 <> 0 union all
    select face_id, 1, round(coalesce(near.value, far.value), 6) from gone left join near using (face_id) left join far using (face_id) union all
    select face_id, 2, round(value, 6) from data"""))
def interpolate_na(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the faces have no value on the first line, and take that of the nearest face, however far it is."""
    shift = lambda c, k: (F.col(c) + F.col("id") * k % 1000 / 1e5).alias(c)  # noqa: E731  no two faces at one distance
    places = geometry.facet_points(X.mixed_mesh(spark, sf_dir), "face").select("id", shift("x", 7919), shift("y", 104729))
    d = X.face_data(spark, sf_dir).withColumnRenamed("face_id", "id").withColumn("line", F.explode(F.array(F.lit(1), F.lit(2))))
    d = d.withColumn("value", F.when((F.col("id") % 5 != 0) | (F.col("line") == 2), F.col("value")))
    return graph.fill_nearest(places, d, dims=("line",)).select("id", "line", *r6("value"))


@register("remove_self_loops", X.sql(X.USERS, "k as (select * from uedge where a <> b)", "n as (select u, dense_rank() over (order by u) - 1 as new from (select a as u from k union select b from k))", select="select row_number() over (order by edge_id) - 1 as edge_id, p.new as a, q.new as b from k join n p on p.u = k.a join n q on q.u = k.b"))
def remove_self_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.remove_self_loops(X.user_network(spark, sf_dir)).edges


@register("topological_levels", """with recursive d as (select distinct cast(p_partkey as bigint) as a, cast(p_partkey * 2 + 1 as bigint) as b from part),
    l as (select a as id, 0 as level from d where a not in (select b from d) union all select d.b, l.level + 1 from l join d on d.a = l.id)
    select id, max(level) as level from l group by 1""")
def topological_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.read_table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("a"), (F.col("p_partkey") * 2 + 1).cast("long").alias("b"))
    return graph.topological_levels(p)


@register("order_components", "select o_orderkey as id, dense_rank() over (order by low) - 1 as label from (select o_orderkey, min(o_orderkey) over (partition by o_custkey) as low from orders)")
def order_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = X.customer_network(spark, sf_dir)
    return graph.component_labels(n.nodes.select(F.col("node_id").alias("id")), C.node_nodes(n.edges).select("src", "dst"))


# vector geometry
@register("burn_points", X.sql(X.MESH, X.POINTS, X.LOCATED, select="select face_id, cast(max(point_id) as double) as value from located where face_id is not null group by 1"))
def burn_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.order_points(spark, sf_dir).select(F.col("point_id").alias("row"), "x", "y", F.col("point_id").cast("double").alias("value"))
    return vector.burn_points(X.mixed_mesh(spark, sf_dir), p)


@register("burn_polygons", X.sql(X.MESH, select="select face_id, case when cx between 20 and 40 and cy between 4 and 9 and not (cx between 25 and 30 and cy between 5 and 7) then 2.0 else 1.0 end as value from geo where cx between 2 and 35 and cy between 1 and 6 or cx between 20 and 40 and cy between 4 and 9 and not (cx between 25 and 30 and cy between 5 and 7)"))
def burn_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = lambda a, b, c, d: [(float(a), float(b)), (float(c), float(b)), (float(c), float(d)), (float(a), float(d))]
    ring = "array<struct<x:double,y:double>>"
    polygons = spark.createDataFrame([(0, box(2, 1, 35, 6), [], 1.0), (1, box(20, 4, 40, 9), [box(25, 5, 30, 7)], 2.0)], f"row long, ring {ring}, holes array<{ring}>, value double")
    return vector.burn_polygons(X.mixed_mesh(spark, sf_dir), polygons)


@register("snap_to_nodes", X.sql(X.MESH, X.POINTS, "r as (select point_id, x, y, cast(round(x) as bigint) as cx, cast(round(y) as bigint) as cy from pt)", select="select point_id, coalesce(n.x, r.x) as x, coalesce(n.y, r.y) as y, n.node_id as id from r left join node n on n.node_id = 51 * cy + cx and cx <= 50 and (r.x - n.x) ** 2 + (r.y - n.y) ** 2 <= 0.23 ** 2"))
def snap_to_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = X.mixed_mesh(spark, sf_dir).nodes.select(F.col("node_id").alias("id"), "x", "y")
    return vector.snap_to_nodes(X.order_points(spark, sf_dir), nodes, 0.23)


# partitions
PARTS = "part3 as (select face_id, face_id % 3 as label from face)"


@register("partition_by_label", X.sql(X.MESH, PARTS, "ln as (select label, node_id, row_number() over (partition by label order by node_id) - 1 as n from (select distinct label, node_id from corner join part3 using (face_id)))", select="select p.label, p.face_id, any_value(p.r) as local_face, list(ln.n order by corner.pos) as nodes from (select label, face_id, row_number() over (partition by label order by face_id) - 1 as r from part3) p join corner using (face_id) join ln on ln.label = p.label and ln.node_id = corner.node_id group by 1, 2"))
def partition_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = X.mixed_mesh(spark, sf_dir)
    return partition.partition_by_label(m, m.faces.select("face_id", (F.col("face_id") % 3).alias("label")))


@register("merge_partitions", X.sql(X.MESH, X.DATA, "nn as (select node_id, row_number() over (order by part, node_id) - 1 as new from (select node_id, min(face_id % 3) as part from corner group by 1))", "nf as (select face_id, row_number() over (order by face_id % 3, face_id) - 1 as id from face)", select="select nf.id, list(nn.new order by pos) as nodes, any_value(value) as value from corner join nf using (face_id) join nn using (node_id) join data using (face_id) group by 1"))
def merge_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three parts and a repeated one, each with the nodes that it uses, and their values."""
    m = X.mixed_mesh(spark, sf_dir)
    data = MeshDataset({"value": MeshArray(m, "face", X.face_data(spark, sf_dir).withColumnRenamed("face_id", "id"))})
    parts = data.partition_by_label(m.faces.select("face_id", (F.col("face_id") % 3).alias("label")))
    merged = merge_sets([*parts, parts[1]])
    faces = merged.grid.faces.withColumnRenamed("face_id", "id")
    return faces.join(merged["value"].df, "id").select("id", "nodes", "value")


@register("label_partitions", X.sql(X.MESH, "z as (select face_id, cast(floor((cx - x0) / (x1 - x0) * 65535) as bigint) as ix, cast(floor((cy - y0) / (y1 - y0) * 65535) as bigint) as iy from geo, (select min(cx) as x0, max(cx) as x1, min(cy) as y0, max(cy) as y1 from geo))", "c as (select face_id, sum((((ix >> k) & 1) << (2 * k)) + (((iy >> k) & 1) << (2 * k + 1))) as code from z, range(16) r(k) group by 1)", select="select face_id, cast(floor((row_number() over (order by code, face_id) - 1) * 8 / count(*) over ()) as bigint) as label from c"))
def label_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.label_partitions(X.mixed_mesh(spark, sf_dir), 8)


# the forwarded array surface, on values by face or by day
@register("rolling_mean", "select event_id, round(case when count(*) over w = 4 then avg(value) over w end, 6) as value from events window w as (partition by user_id order by ts, event_id rows between 3 preceding and current row)")
def rolling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 0)
    return X.read_table(spark, sf_dir, "events").select("event_id", F.round(F.when(F.count("value").over(w) == 4, F.avg("value").over(w)), 6).alias("value"))


@register("resample_day", "select cast(date_trunc('day', ts) as date) as day, event_type, count(*) as n, round(sum(round(value * 10000)) / 10000, 2) as value from events group by 1, 2")
def resample_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.read_table(spark, sf_dir, "events")
    return e.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.round(F.col("value") * 10000)) / 10000, 2).alias("value"))


@register("groupby_mean", "select event_type, round(avg(round(value, 4)), 4) as value from events group by 1")
def groupby_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg(F.round("value", 4)), 4).alias("value"))


@register("where_fill", X.sql(X.MESH, X.DATA, select="select face_id, round(case when value > 300000 then value else 0 end, 6) as value from data"))
def where_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.face_data(spark, sf_dir).select("face_id", F.round(F.when(F.col("value") > 300000, F.col("value")).otherwise(0.0), 6).alias("value"))


from gridloom.plans import arrays, files, functions, grids, projections  # noqa: E402,F401  more queries for the same registry
