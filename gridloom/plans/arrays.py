"""Queries on arrays: the values of the orders' lines by face and line number, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.data import MeshArray
from gridloom.operators import fit, ordered
from gridloom.plans import fixtures as X
from gridloom.plans.registry import register
from gridloom.sources.tables import read_table

W = "window w as (partition by id order by line)"


def lines(name: str, result: str, *more: str):
    """Register a query on the array of lines; the function gets the array."""

    def add(build):
        register(name, X.sql(X.LINES, *more, select=result))(lambda spark, sf_dir: build(X.line_array(spark, sf_dir)))
        return build

    return add


def table(a) -> DataFrame:
    return a.df if isinstance(a, MeshArray) else a


def r(a, digits: int = 6) -> DataFrame:
    df = table(a)
    return df.withColumn("value", F.round("value", digits))


lines("array_arithmetic", "select id, line, round(value * 2 + value / 4 - 1, 6) as value from v")(lambda a: r(a * 2.0 + a / 4.0 - 1.0))
lines("array_compare", "select id, line, (value > 30000 and value <= 60000) or not (value >= 1000) as value from v")(lambda a: table(((a > 30000.0) & (a <= 60000.0)) | ~(a >= 1000.0)))
lines("array_clip", "select id, line, least(greatest(value, 20000), 50000) as value from v")(lambda a: table(a.clip(20000.0, 50000.0)))
lines("array_isin", "select id, line, cast(floor(value / 10000) in (1, 3) as integer) as value from v")(lambda a: table(a.unary(lambda v: F.floor(v / 10000)).isin([1, 3]).astype("int")))
lines("array_where", "select id, line, case when value > 30000 then value else -1 end as value from v")(lambda a: table(a.where(a > 30000.0, -1.0)))
lines("array_fillna", "select id, line, case when value > 30000 then value else 5 end as value from v")(lambda a: table(a.where(a > 30000.0).fillna(5.0)))
lines("array_combine", "select id, line, case when line % 2 = 0 then value else -value end as value from v")(lambda a: table(a._with(a.df.where("line % 2 = 0")).combine_first(-a)))
lines("array_isnull", "select id, line, value <= 30000 as value from v")(lambda a: table(a.where(a > 30000.0).isnull()))
lines("array_reductions", "select id, count(value) as n, round(sum(value), 4) as total, round(avg(value), 4) as mean, min(value) as low, max(value) as high, round(stddev_pop(value), 4) as std, round(median(value), 4) as median from v group by 1")(
    lambda a: _beside(a, {"n": "count", "total": "sum", "mean": "mean", "low": "min", "high": "max", "std": "std", "median": "median"})
)
lines("array_over_faces", "select line, round(sum(value), 2) as value from v group by 1")(lambda a: r(a.reduce("sum", ["id"]), 2))
lines("array_any", "select id, bool_or(value > 60000) as value from v group by 1")(lambda a: table((a > 60000.0).reduce("any", ["line"])))
lines("array_quantile", "select id, round(quantile_cont(value, 0.3), 4) as value from v group by 1")(lambda a: r(a.quantile(0.3, ["line"]), 4))
lines("array_argmax", "select id, min(line) as value from (select id, line, value = max(value) over (partition by id) as top from v) where top group by 1")(lambda a: table(a.arg("max", "line")))
lines("array_argmin", "select id, min(line) as value from (select id, line, value = min(value) over (partition by id) as low from v) where low group by 1")(lambda a: table(a.arg("min", "line")))
lines("array_cumsum", f"select id, line, round(sum(value) over w, 4) as value from v {W}")(lambda a: r(a.cumsum("line"), 4))
lines("array_diff", f"select id, line, round(value, 4) as value from (select id, line, value - lag(value) over w as value, row_number() over w as k from v {W}) where k > 1")(lambda a: r(a.diff("line"), 4))
lines("array_shift", f"select id, line, lag(value) over w as value from v {W}")(lambda a: table(a.shift("line")))
lines("array_ffill", f"select id, line, last_value(case when line % 3 > 0 then value end ignore nulls) over w as value from v {W}")(lambda a: table(_gaps(a).ffill("line")))
lines("array_bfill", "select id, line, first_value(case when line % 3 > 0 then value end ignore nulls) over (partition by id order by line rows between current row and unbounded following) as value from v")(lambda a: table(_gaps(a).bfill("line")))
lines("array_rolling", "select id, line, round(case when count(*) over w = 2 then avg(value) over w end, 4) as value from v window w as (partition by id order by line rows between 1 preceding and current row)")(lambda a: r(a.rolling("line", 2), 4))
lines("array_rank", "select id, line, rank() over (partition by id order by value) + (count(*) over (partition by id, value) - 1) / 2e0 as value from v")(lambda a: table(a.rank("line")))
lines("array_coarsen", f"select id, line, round(avg(value), 4) as value from (select id, cast((row_number() over w - 1) // 2 as bigint) as line, value from v {W}) group by 1, 2 having count(*) = 2")(lambda a: r(a.coarsen("line", 2), 4))
lines("array_groupby", "select id, line % 2 as odd, round(sum(value), 4) as value from v group by 1, 2")(lambda a: r(a.groupby(F.col("line") % 2, "sum", "odd"), 4))
lines("array_bins", "select cast(case when value <= 20000 then 0 when value <= 50000 then 1 else 2 end as integer) as bin, count(*) as value from v where value > 100 and value <= 90000 group by 1")(lambda a: a.groupby_bins([100.0, 20000.0, 50000.0, 90000.0]))
lines("array_interp", "select id, round(max(case when line < 2.5 and n > 2.5 then value + (2.5 - line) / (n - line) * (nv - value) end), 6) as value from (select id, line, value, lead(line) over w as n, lead(value) over w as nv from v window w as (partition by id order by line)) group by 1")(lambda a: r(a.interp("line", 2.5)))
lines("array_differentiate", f"select id, line, round((coalesce(lead(value) over w, value) - coalesce(lag(value) over w, value)) / nullif(coalesce(lead(line) over w, line) - coalesce(lag(line) over w, line), 0), 4) as value from v {W}")(lambda a: r(a.differentiate("line"), 4))
lines("array_dot", "select id, round(sum(value * line), 3) as value from v group by 1")(lambda a: r(a.dot(_places(a), ["line"]), 3))
lines("array_weighted", "select id, round(sum(value * line) / sum(line), 6) as value from v group by 1")(lambda a: r(a.weighted_mean(_places(a), ["line"])))
lines("array_sel", "select id, value from v where line = 3")(lambda a: table(a.sel_dims(line=3)))
lines("array_unstack", 'select id, max(case when line = 1 then value end) as one, max(case when line = 2 then value end) as two from v group by 1')(lambda a: a.unstack("line", [1, 2]).withColumnsRenamed({"1": "one", "2": "two"}))
lines("array_constants", "select id, line, 0e0 as zeros, 1e0 as ones, 7e0 as full from v")(lambda a: a.zeros_like().df.withColumnRenamed("value", "zeros").join(a.ones_like().df.withColumnRenamed("value", "ones"), ["id", "line"]).join(a.full_like(7.0).df.withColumnRenamed("value", "full"), ["id", "line"]))
lines("array_apply", "select id, round(max(value) - min(value), 4) as spread from v group by 1")(lambda a: a.apply(_spread, "id long, spread double", together=True).select("id", F.round("spread", 4).alias("spread")))
lines("array_to_node", "select node_id as target_id, line, round(avg(value), 4) as value from v join (select o_orderkey as id, unnest([51 * (o_orderkey // 50) + o_orderkey % 50, 51 * (o_orderkey // 50) + o_orderkey % 50 + 1, 51 * (o_orderkey // 50) + o_orderkey % 50 + 52, 51 * (o_orderkey // 50) + o_orderkey % 50 + 51]) as node_id from orders) using (id) group by 1, 2")(lambda a: a.to_node().groupBy("target_id", "line").agg(F.round(F.avg("value"), 4).alias("value")))
lines("array_coordinates", "select id, line, value, id % 50 + 0.5e0 as mesh2d_face_x, id // 50 + 0.5e0 as mesh2d_face_y from v")(lambda a: a.assign_face_coords().withColumns({"mesh2d_face_x": F.round("mesh2d_face_x", 9), "mesh2d_face_y": F.round("mesh2d_face_y", 9)}))
lines("array_periodic", "select id, line, value from v")(lambda a: table(a.to_periodic()))


def _beside(a: MeshArray, how: dict[str, str]) -> DataFrame:
    out = None
    for name, reducer in how.items():
        df = table(a.reduce(reducer, ["line"])).withColumnRenamed("value", name)
        df = df.withColumn(name, F.round(name, 4)) if reducer in ("sum", "mean", "std", "median") else df
        out = df if out is None else out.join(df, "id")
    return out


def _spread(rows):
    values = rows.groupby("id")["value"]
    return (values.max() - values.min()).rename("spread").reset_index()


def _gaps(a: MeshArray) -> MeshArray:
    return a._with(a.df.withColumn("value", F.when(F.col("line") % 3 > 0, F.col("value"))))


def _places(a: MeshArray) -> MeshArray:
    return a._with(a.df.withColumn("value", F.col("line").cast("double")))


@register("array_resample", "select user_id as id, date_trunc('day', ts) as ts, round(avg(value), 4) as value from events group by 1, 2")
def array_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by node (user) and time, a mean a day."""
    e = X.read_table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "ts", "value")
    return r(MeshArray(X.user_network(spark, sf_dir), "node", e).resample("ts", "day"), 4).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register("from_structured2d", "select cast(l_quantity as bigint) - 1 + 50 * cast(round(l_discount * 100) as bigint) as id, round(cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double) / count(*) / 100, 6) as value from lineitem group by 1")
def from_structured2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = X.price_cells(spark, sf_dir).select("iy", "ix", "value")
    a = MeshArray.from_structured2d(spark, data, [float(k) for k in range(X.NX + 1)], [float(k) for k in range(X.NY + 1)])
    return r(MeshArray.from_data(a.df.join(a.grid.faces.select(F.col("face_id").alias("id")), "id", "right"), a.grid, "face")).where("value is not null")


@register(
    "laplace_plane",
    """with c as (select o_orderkey as id, o_orderkey % 50 as ix, o_orderkey // 50 as iy, (select max(o_orderkey) // 50 from orders) as top from orders)
    select id, cast(3 * ix + 2 * iy + 2.5 as double) as value, ix > 0 and ix < 49 and iy > 0 and iy < top - 1 as filled from c""",
)
def laplace_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plane known on the border of the orders' raster alone and filled inside, where its harmonic continuation is itself."""
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    top = o.agg(F.floor(F.max("id") / X.NX).alias("top"))
    ix, iy = F.col("id") % X.NX, F.floor(F.col("id") / X.NX)
    inside = (ix > 0) & (ix < X.NX - 1) & (iy > 0) & (iy < F.col("top") - 1)
    d = o.crossJoin(F.broadcast(top)).select("id", inside.alias("filled"), (3 * ix + 2 * iy + 2.5).alias("value"))  # joined with one row
    holes = d.select("id", F.when(~F.col("filled"), F.col("value")).alias("value"))
    got = MeshArray(X.order_mesh(spark, sf_dir), "face", holes).laplace_interpolate(tolerance=1e-9).df
    return got.join(d.select("id", "filled"), "id").select("id", F.round("value", 3).alias("value"), "filled")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp_ntz").alias("at"), "event_id", "value")


@register(
    "interp_events",
    """with e as (select ts as moment, avg(value) as value from events where value is not null group by 1), lohi as (select min(moment) as lo, max(moment) as hi from e),
    t as (select o_orderkey, lo + to_microseconds(cast(floor((epoch_us(hi) - epoch_us(lo)) * ((o_orderkey * 7919) % 10007) / 10007) as bigint)) as moment from orders, lohi),
    a as (select t.*, e.moment as a, e.value as low from t asof left join e on t.moment >= e.moment), b as (select a.*, e.moment as b, e.value as high from a asof left join e on a.moment <= e.moment)
    select moment, count(*) as n, round(any_value(case when a = moment then low when b = moment then high else low + (high - low) * (epoch_us(moment) - epoch_us(a)) / (epoch_us(b) - epoch_us(a)) end), 5) as value from b group by moment""",
)
def interp_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one series, interpolated at a time for each order."""
    e = _events(spark, sf_dir)
    ends = e.where("value is not null").agg(F.unix_micros(F.min("at").cast("timestamp")).alias("lo"), F.unix_micros(F.max("at").cast("timestamp")).alias("hi"))
    o = read_table(spark, sf_dir, "orders").select("o_orderkey").crossJoin(F.broadcast(ends))  # joined with one row
    step = F.floor((F.col("hi") - F.col("lo")) * ((F.col("o_orderkey") * 7919) % 10007) / 10007)
    at = F.timestamp_micros(F.col("lo") + step.cast("long")).cast("timestamp_ntz")
    got = ordered.interpolated(e, o.select(at.alias("at")), [], "at")
    return got.groupBy(F.col("at").alias("moment")).agg(F.count("*").alias("n"), F.round(F.first("value"), 5).alias("value"))


@register(
    "rolling_exp_events",
    """with e as (select event_id, value, row_number() over (order by event_id) as i from events)
    select p.event_id, round(sum(q.value * 0.5 ** (p.i - q.i)) / sum(case when q.value is not null then 0.5 ** (p.i - q.i) end), 5) as value from e p join e q on q.i between p.i - 60 and p.i group by 1""",
)
def rolling_exp_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exponentially weighted mean over all events as one series; weights 60 rows back are below the rounding."""
    e = _events(spark, sf_dir).select("event_id", "value")
    return ordered.exponential_mean(e, [], ["event_id"], "value", 0.5).select("event_id", F.round("value", 5).alias("value"))


@register(
    "polyfit_line",
    "select o_custkey as k, count(*) as n, round(regr_intercept(o_totalprice, o_orderkey), 2) as constant, round(regr_slope(o_totalprice, o_orderkey), 5) as slope from orders group by 1 having count(distinct o_orderkey) > 1",
)
def polyfit_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trend of each customer's prices over their orders' keys."""
    got = fit.polyfit(read_table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice", 1).where("coefficients is not null")
    c = lambda k: F.get("coefficients", F.lit(k))
    return got.select(F.col("o_custkey").alias("k"), "n", F.round(c(0), 2).alias("constant"), F.round(c(1), 5).alias("slope"))


@register("polyfit_parabola", "select o_custkey as k, cast(o_custkey % 7 as double) as a, cast(o_custkey % 5 as double) as b, 0.5e0 as c from orders group by o_custkey having count(distinct o_orderkey) > 2")
def polyfit_parabola(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parabolas over thousandths of the orders' keys, one a customer, are found again.

    The fit is of two million times the parabola over the keys, as these are whole numbers; as doubles its values
    far from 0 would not hold the constant's fourth digit.
    """
    o = read_table(spark, sf_dir, "orders")
    x, k = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")
    y = 2_000_000 * (k % 7) + 2_000 * (k % 5) * x + x * x
    got = fit.polyfit(o.select("o_custkey", x.alias("x"), y.alias("y")), ["o_custkey"], "x", "y", 2).where("coefficients is not null")
    c = lambda k: F.round(F.get("coefficients", F.lit(k)) * 1000**k / 2_000_000, 4) + 0.0
    return got.select(F.col("o_custkey").alias("k"), c(0).alias("a"), c(1).alias("b"), c(2).alias("c"))
