"""Meshes and data derived from the star-schema tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.data import MeshArray
from gridloom.operators.mesh import Mesh, Network, split_even_quads
from gridloom.session import spread
from gridloom.sources.tables import read_table

NX, NY = 50, 11
TX, TY, TDX, TDY = 7, 5, 7.25, 2.5


def price_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(cell, ix, iy, n, value)``: mean price by quantity (x) and discount (y) on unit cells."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    ix, iy = F.col("l_quantity").cast("long") - 1, F.round(F.col("l_discount") * 100).cast("long")
    t = read_table(spark, sf_dir, "lineitem").groupBy(ix.alias("ix"), iy.alias("iy")).agg(F.count("*").alias("n"), F.sum(cents).alias("cents"))
    return t.select((F.col("iy") * NX + F.col("ix")).alias("cell"), "ix", "iy", "n", (F.col("cents") / F.col("n") / 100).alias("value"))


def order_mesh(spark: SparkSession, sf_dir: str) -> Mesh:
    """A quad for each order on a raster of 50 columns, row by row; nodes and faces grow with the table."""
    q = F.col("o_orderkey").cast("long")
    low = F.floor(q / NX) * (NX + 1) + q % NX
    faces = read_table(spark, sf_dir, "orders").select(q.alias("face_id"), F.array(low, low + 1, low + NX + 2, low + NX + 1).alias("nodes"))
    ids = faces.select(F.explode("nodes").alias("node_id")).distinct()
    nodes = ids.select("node_id", (F.col("node_id") % (NX + 1)).cast("double").alias("x"), F.floor(F.col("node_id") / (NX + 1)).cast("double").alias("y"))
    return Mesh(nodes, faces)


def mixed_mesh(spark: SparkSession, sf_dir: str) -> Mesh:
    """The orders' mesh with every even quad split into two triangles."""
    return split_even_quads(order_mesh(spark, sf_dir))


def face_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(face_id, value)`` on the mixed mesh: the total price of the order that the face came from."""
    faces = mixed_mesh(spark, sf_dir).faces.select("face_id", F.floor(F.col("face_id") / 2).alias("o_orderkey"))
    return faces.join(read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("value")), "o_orderkey").select("face_id", "value")


def face_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(face_id, value)``: a third of the customers each, as 0, 1 or 2."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 3).cast("double").alias("value"))
    faces = mixed_mesh(spark, sf_dir).faces.select("face_id", F.floor(F.col("face_id") / 2).alias("o_orderkey"))
    return faces.join(o, "o_orderkey").select("face_id", "value")


def line_array(spark: SparkSession, sf_dir: str) -> MeshArray:
    """Values by face and line number: the price of an order's lines, on the orders' mesh."""
    t = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("id"), F.col("l_linenumber").alias("line"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    t = spread(t, "id").groupBy("id", "line")
    return MeshArray(order_mesh(spark, sf_dir), "face", t.agg((F.sum("cents") / 100).alias("value")))


def order_points(spark: SparkSession, sf_dir: str, dx: float = 0.0, dy: float = 0.0) -> DataFrame:
    """``(point_id, x, y)``: a point for each order, on the mesh, its sides and a little beyond its upper end."""
    o = read_table(spark, sf_dir, "orders")
    rows = o.agg(((F.floor(F.max("o_orderkey") / NX) + 3) * 10).alias("rows"))
    o = o.crossJoin(F.broadcast(rows))  # joined with one row
    return o.select(F.col("o_orderkey").cast("long").alias("point_id"), (F.col("o_custkey") % 500 / 10.0 + dx).alias("x"), (F.col("o_orderkey") * 7 % F.col("rows") / 10.0 + dy).alias("y"))


def customer_network(spark: SparkSession, sf_dir: str) -> Network:
    """Orders as nodes at the corners of the orders' mesh, joined with the same customer's next one."""
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"), "o_custkey")
    nodes = o.select(F.col("k").alias("node_id"), (F.col("k") % (NX + 1)).cast("double").alias("x"), F.floor(F.col("k") / (NX + 1)).cast("double").alias("y"))
    after = F.lead("k").over(Window.partitionBy("o_custkey").orderBy("k"))
    edges = o.select(F.col("k").alias("edge_id"), F.col("k").alias("a"), after.alias("b")).where("b is not null")
    return Network(nodes, edges)


def user_network(spark: SparkSession, sf_dir: str) -> Network:
    """Users as nodes; edges between users of consecutive events of a type."""
    e = read_table(spark, sf_dir, "events")
    after = F.lead("user_id").over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    pairs = e.select(F.col("event_id").cast("long").alias("edge_id"), F.col("user_id").cast("long").alias("a"), after.cast("long").alias("b")).where("b is not null")
    nodes = e.select(F.col("user_id").cast("long").alias("node_id")).distinct()
    return Network(nodes.select("node_id", (F.col("node_id") % 97).cast("double").alias("x"), (F.col("node_id") % 89).cast("double").alias("y")), pairs)


CELLS = """cells as (select (iy * 50 + ix) as cell, ix, iy, n, cents / n / 100 as value from (
  select cast(l_quantity as bigint) - 1 as ix, cast(round(l_discount * 100) as bigint) as iy, count(*) as n,
         cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double) as cents from lineitem group by 1, 2))"""
MESH = """quad as (select o_orderkey as q, 51 * (o_orderkey // 50) + o_orderkey % 50 as ll from orders),
node as (select node_id, cast(node_id % 51 as double) as x, cast(node_id // 51 as double) as y from (select distinct unnest([ll, ll + 1, ll + 52, ll + 51]) as node_id from quad)),
face as (select 2 * q as face_id, [ll, ll + 1, ll + 52, ll + 51] as nodes from quad where q % 2 = 1
  union all select 2 * q, [ll, ll + 1, ll + 52] from quad where q % 2 = 0
  union all select 2 * q + 1, [ll, ll + 52, ll + 51] from quad where q % 2 = 0),
corner as (select face_id, unnest(range(len(nodes))) as pos, unnest(nodes) as node_id from face),
turn as (select face_id, nodes[1] as o, unnest(range(len(nodes))) as pos, unnest(nodes) as p, unnest(list_concat(nodes[2:], nodes[1:1])) as q from face),
side as (select face_id, pos, least(p, q) as a, greatest(p, q) as b from turn),
edge as (select row_number() over (order by a, b) - 1 as edge_id, a, b from (select distinct a, b from side)),
ef as (select edge_id, a, b, min(face_id) as f1, nullif(max(face_id), min(face_id)) as f2 from side join edge using (a, b) group by all),
ff as (select f1 as src, f2 as dst, edge_id as via from ef where f2 is not null union all select f2, f1, edge_id from ef where f2 is not null),
seg as (select t.face_id, p.x as px, p.y as py, q.x as qx, q.y as qy, o.x as ox, o.y as oy, (p.x - o.x) * (q.y - o.y) - (q.x - o.x) * (p.y - o.y) as cr
  from turn t join node p on p.node_id = t.p join node q on q.node_id = t.q join node o on o.node_id = t.o),
geo as (select face_id, abs(sum(cr)) / 2 as area, sum(sqrt((px - qx) ** 2 + (py - qy) ** 2)) as perimeter,
  any_value(ox) + sum((px + qx - 2 * ox) * cr) / (3 * sum(cr)) as cx, any_value(oy) + sum((py + qy - 2 * oy) * cr) / (3 * sum(cr)) as cy,
  min(px) as xmin, min(py) as ymin, max(px) as xmax, max(py) as ymax from seg group by face_id)"""
DATA = "data as (select face_id, o_totalprice as value from face join orders on o_orderkey = face_id // 2)"
KIND = "kind as (select face_id, o_custkey % 3 as k from face join orders on o_orderkey = face_id // 2)"
LINES = "v as (select l_orderkey as id, l_linenumber as line, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double) / 100 as value from lineitem group by 1, 2)"
CUSTOMERS = "cedge as (select k as edge_id, k as a, b from (select o_orderkey as k, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) as b from orders) where b is not null)"
POINTS = "pt as (select o_orderkey as point_id, (o_custkey % 500) / 10e0 as x, (o_orderkey * 7 % ((select max(o_orderkey) // 50 + 3 from orders) * 10)) / 10e0 as y from orders)"
LOCATED = """near as (select point_id, p.x, p.y, cast(floor(p.x) as bigint) - i as cx, cast(floor(p.y) as bigint) - j as cy from pt p, range(2) a(i), range(2) b(j)),
located as (select pt.point_id, h.face_id from pt left join (
  select point_id, min(face_id) as face_id from (
    select p.point_id, s.face_id from near p join seg s on p.cx between 0 and 49 and s.face_id // 2 = p.cy * 50 + p.cx
    group by p.point_id, s.face_id having min((s.qx - s.px) * (p.y - s.py) - (s.qy - s.py) * (p.x - s.px)) >= 0) group by point_id) h using (point_id))"""
WEIGHTS = """target as (select ty * 7 + tx as target_id, tx * 7.25 as x0, (tx + 1) * 7.25 as x1, ty * 2.5 as y0, (ty + 1) * 2.5 as y1 from range(7) a(tx), range(5) b(ty)),
w as (select target_id, cell as source_id, value, (least(x1, ix + 1) - greatest(x0, ix)) * (least(y1, iy + 1) - greatest(y0, iy)) as weight
  from target join cells on ix < x1 and ix + 1 > x0 and iy < y1 and iy + 1 > y0)"""
USERS = """uedge as (select cast(event_id as bigint) as edge_id, cast(user_id as bigint) as a, cast(b as bigint) as b from (
  select event_id, user_id, lead(user_id) over (partition by event_type order by ts, event_id) as b from events) where b is not null)"""


def sql(*parts: str, select: str) -> str:
    return "with " + ",\n".join(parts) + "\n" + select
