"""Arrays and sets of arrays on grids: values by facet id and other dimensions, with the grid they belong to.

``MeshArray`` holds ``(id, *dims, value)`` for one facet of one grid; ``MeshDataset`` holds named arrays and the
grids among them.  Operations return new objects; tables are lazy.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators import connectivity, facets, geometry, graph, ordered, partition, periodic, select, topology, vector
from gridloom.operators.crs import system, transform
from gridloom.operators.mesh import Grid, Mesh, Network
from gridloom.session import cut, stored
from gridloom.sources import roles, tables, wkt

BLOCK = 100_000  #: about as many rows a call of ``apply`` gets

REDUCERS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_pop, "var": F.var_pop, "median": F.median, "prod": F.product, "count": F.count,
    "any": lambda c: F.bool_or(c.cast("boolean")), "all": lambda c: F.bool_and(c.cast("boolean")),
}


@dataclass(frozen=True)
class MeshArray:
    """Values of one facet; ``df`` has ``id``, the other dimensions and ``value``."""

    grid: Grid
    facet: str
    df: DataFrame
    name: str = "value"

    def __post_init__(self) -> None:
        if self.facet not in self.facets:
            raise ValueError(f"{type(self.grid).__name__} has no facet {self.facet}")
        if "id" not in self.df.columns or "value" not in self.df.columns:
            raise ValueError("an array needs the columns id and value")

    # what it is

    @property
    def facets(self) -> tuple[str, ...]:
        return ("node", "edge", "face") if isinstance(self.grid, Mesh) else ("node", "edge")

    @property
    def core(self) -> str:
        return "face" if isinstance(self.grid, Mesh) else "edge"

    @property
    def dims(self) -> tuple[str, ...]:
        return tuple(c for c in self.df.columns if c not in ("id", "value"))

    @property
    def grids(self) -> list[Grid]:
        return [self.grid]

    @property
    def names(self) -> list[str]:
        return [self.grid.name]

    @property
    def topology(self) -> dict[str, Grid]:
        return {self.grid.name: self.grid}

    @property
    def crs(self) -> dict[str, str | None]:
        return {self.grid.name: self.grid.crs}

    @property
    def is_geographic(self) -> bool | None:
        return None if self.grid.projected is None else not self.grid.projected

    @property
    def bounds(self) -> dict[str, tuple[float, float, float, float]]:
        return {self.grid.name: self.total_bounds}

    @property
    def total_bounds(self) -> tuple[float, float, float, float]:
        return topology.node_bounds(self.grid)

    def _with(self, df: DataFrame) -> MeshArray:
        return replace(self, df=df)

    def copy(self) -> MeshArray:
        return replace(self)

    def rename(self, name: str) -> MeshArray:
        """The same values on a grid of another name."""
        return replace(self, grid=replace(self.grid, name=name))

    def set_crs(self, crs: str | int | None = None, epsg: int | None = None, allow_override: bool = False) -> MeshArray:
        return replace(self, grid=set_crs(self.grid, crs, epsg, allow_override))

    # builders and exports

    @classmethod
    def from_data(cls, data: DataFrame, grid: Grid, facet: str, name: str = "value") -> MeshArray:
        """Checked: one value for each id of the facet and all other dimensions."""
        out = cls(grid, facet, data, name)
        ids = geometry.facet_points(grid, facet).select("id")
        per = data.groupBy(*out.dims).agg(F.count("*").alias("n"), F.count_distinct("id").alias("d"))
        n = ids.count()
        if per.where((F.col("n") != n) | (F.col("d") != n)).limit(1).count() or data.join(ids, "id", "left_anti").limit(1).count():
            raise ValueError(f"the data do not have one value for each of the {n} {facet}s")
        return out

    @classmethod
    def from_structured2d(cls, spark: SparkSession, data: DataFrame, x: list[float], y: list[float]) -> MeshArray:
        """Faces of a raster between breaks from ``data(iy, ix, *dims, value)``, row by row."""
        from gridloom.operators.mesh import from_breaks

        wide = len(x) - 1
        others = [c for c in data.columns if c not in ("iy", "ix", "value")]
        return cls(from_breaks(spark, x, y), "face", data.select((F.col("iy").cast("long") * wide + F.col("ix")).alias("id"), *others, "value"))

    def to_dataframe(self) -> DataFrame:
        return self.df

    def to_dataset(self, folder: str, optional: bool = False) -> None:
        """Write the grid and the values."""
        tables.write_mesh(self.grid, folder, {self.name: self.df.withColumn("_facet", F.lit(self.facet))}, optional)

    def to_geodataframe(self) -> DataFrame:
        """``(id, *dims, value, wkt)``."""
        return self.df.join(wkt.to_wkt(self.grid, self.facet), "id").withColumnRenamed("value", self.name)

    # coordinates

    def _coords(self, facet: str) -> DataFrame:
        if facet not in self.facets:
            raise TypeError(f"{type(self.grid).__name__} has no facet {facet}")
        if facet != self.facet:
            return self.df
        named = geometry.facet_points(self.grid, facet).withColumnsRenamed({"x": f"{self.grid.name}_{facet}_x", "y": f"{self.grid.name}_{facet}_y"})
        return self.df.join(named, "id")

    def assign_node_coords(self) -> DataFrame:
        """The values with the coordinates of their nodes; values of other facets as they are."""
        return self._coords("node")

    def assign_edge_coords(self) -> DataFrame:
        return self._coords("edge")

    def assign_face_coords(self) -> DataFrame:
        return self._coords("face")

    def set_node_coords(self, nodes: DataFrame, projected: bool = True) -> MeshArray:
        """Other coordinates ``(node_id, x, y)`` for the same nodes."""
        return replace(self, grid=set_node_coords(self.grid, nodes, projected))

    # values

    def _aligned(self, other) -> tuple[DataFrame, Column, Column]:
        if not isinstance(other, MeshArray):
            return self.df, F.col("value"), F.lit(other)
        if other.facet != self.facet or not (other.grid is self.grid or topology.equals(self.grid, other.grid)):
            raise ValueError("arrays must be of one grid and facet")
        both = [d for d in self.dims if d in other.dims]
        return self.df.join(other.df.withColumnRenamed("value", "_other"), ["id", *both]), F.col("value"), F.col("_other")

    def binary(self, other, function: Callable[[Column, Column], Column]) -> MeshArray:
        """A function of two arrays where both have values, or of an array and a constant."""
        df, a, b = self._aligned(other)
        return self._with(df.withColumn("value", function(a, b)).drop("_other"))

    def unary(self, function: Callable[[Column], Column]) -> MeshArray:
        return self._with(self.df.withColumn("value", function(F.col("value"))))

    def __add__(self, other): return self.binary(other, operator.add)
    def __sub__(self, other): return self.binary(other, operator.sub)
    def __mul__(self, other): return self.binary(other, operator.mul)
    def __truediv__(self, other): return self.binary(other, F.try_divide)
    def __mod__(self, other): return self.binary(other, operator.mod)
    def __pow__(self, other): return self.binary(other, F.pow)
    def __gt__(self, other): return self.binary(other, operator.gt)
    def __ge__(self, other): return self.binary(other, operator.ge)
    def __lt__(self, other): return self.binary(other, operator.lt)
    def __le__(self, other): return self.binary(other, operator.le)
    def equal(self, other): return self.binary(other, operator.eq)
    def unequal(self, other): return self.binary(other, operator.ne)
    def __and__(self, other): return self.binary(other, operator.and_)
    def __or__(self, other): return self.binary(other, operator.or_)
    def __invert__(self): return self.unary(operator.inv)
    def __neg__(self): return self.unary(operator.neg)
    def __abs__(self): return self.unary(F.abs)
    def isnull(self): return self.unary(lambda v: v.isNull())
    def notnull(self): return self.unary(lambda v: v.isNotNull())
    def isin(self, values): return self.unary(lambda v: v.isin(list(values)))
    def astype(self, kind: str): return self.unary(lambda v: v.cast(kind))
    def round(self, digits: int = 0): return self.unary(lambda v: F.round(v, digits))

    def clip(self, low=None, high=None) -> MeshArray:
        value = F.col("value")
        value = value if low is None else F.when(value < low, F.lit(low)).otherwise(value)
        return self._with(self.df.withColumn("value", value if high is None else F.when(value > high, F.lit(high)).otherwise(value)))

    def where(self, condition: MeshArray, other=None) -> MeshArray:
        """Values where the condition holds, else ``other``."""
        return self.binary(condition, lambda v, c: F.when(c, v).otherwise(F.lit(other)))

    def fillna(self, value) -> MeshArray:
        return self.binary(value, F.coalesce)

    def combine_first(self, other: MeshArray) -> MeshArray:
        """Own values, and those of the other where there is none; ids of both."""
        keys = ["id", *self.dims]
        df = self.df.join(other.df.withColumnRenamed("value", "_other"), keys, "full")
        return self._with(df.select(*keys, F.coalesce("value", "_other").alias("value")))

    def full_like(self, value: float) -> MeshArray:
        return self.unary(lambda v: F.lit(value))

    def zeros_like(self) -> MeshArray:
        return self.full_like(0.0)

    def ones_like(self) -> MeshArray:
        return self.full_like(1.0)

    def apply(self, function: Callable, schema: str, by: list[str] | None = None, together: bool = False) -> DataFrame:
        """A pandas function of each group of ids (or of ``by``).

        A call costs about a millisecond.  With ``together`` the function gets blocks of many whole groups, one
        table a block, and groups their rows itself.
        """
        keys = by or ["id"]
        if not together:
            return self.df.groupBy(*keys).applyInPandas(function, schema)
        blocks = self.df.count() // BLOCK + 1
        return self.df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(blocks)).alias("_block")).applyInPandas(function, schema)

    # along the other dimensions

    def reduce(self, how: str, dims: Iterable[str] = ()) -> MeshArray | DataFrame:
        """A reduction over dimensions, ``id`` among them; nulls are left out.  Without ``id`` left, a table."""
        dims = tuple(dims) or ("id", *self.dims)
        missing = set(dims) - {"id", *self.dims}
        if missing:
            raise ValueError(f"no dimensions {sorted(missing)}")
        left = [c for c in ("id", *self.dims) if c not in dims]
        df = self.df.groupBy(*left).agg(REDUCERS[how](F.col("value")).alias("value"))
        return self._with(df) if "id" in left else df

    def quantile(self, q: float, dims: Iterable[str]) -> MeshArray | DataFrame:
        left = [c for c in ("id", *self.dims) if c not in tuple(dims)]
        df = self.df.groupBy(*left).agg(F.percentile("value", q).alias("value"))
        return self._with(df) if "id" in left else df

    def arg(self, how: str, dim: str) -> MeshArray | DataFrame:
        """The place along ``dim`` of the least (``min``) or largest (``max``) value, the first of several."""
        left = [c for c in ("id", *self.dims) if c != dim]
        known = self.df.where("value is not null")
        if how == "min":
            best = F.min(F.struct("value", dim))[dim]
        else:
            best = F.min(F.struct((-F.col("value")).alias("less"), dim))[dim]
        df = known.groupBy(*left).agg(best.alias("value"))
        return self._with(df) if "id" in left else df

    def _along(self, dim: str) -> Window:
        return Window.partitionBy(*(c for c in ("id", *self.dims) if c != dim)).orderBy(dim)

    def over(self, dim: str, function: Callable[[Column, Window], Column]) -> MeshArray:
        """A window function along a dimension."""
        return self._with(self.df.withColumn("value", function(F.col("value"), self._along(dim))))

    def cumsum(self, dim: str) -> MeshArray:
        return self.over(dim, lambda v, w: F.sum(F.coalesce(v, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def cumprod(self, dim: str) -> MeshArray:
        return self.over(dim, lambda v, w: F.product(F.coalesce(v, F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def diff(self, dim: str) -> MeshArray:
        """Differences to the value before; the first of each is left out."""
        place = F.row_number().over(self._along(dim))
        out = self.df.withColumn("_place", place).withColumn("value", F.col("value") - F.lag("value").over(self._along(dim)))
        return self._with(out.where("_place > 1").drop("_place"))

    def shift(self, dim: str, by: int = 1) -> MeshArray:
        return self.over(dim, lambda v, w: F.lag(v, by).over(w) if by >= 0 else F.lead(v, -by).over(w))

    def ffill(self, dim: str) -> MeshArray:
        return self.over(dim, lambda v, w: F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def bfill(self, dim: str) -> MeshArray:
        backward = self._along(dim).orderBy(F.desc(dim))  # a frame that begins at the row would be added up anew for every row
        return self.over(dim, lambda v, _: F.last(v, ignorenulls=True).over(backward.rowsBetween(Window.unboundedPreceding, 0)))

    def rolling(self, dim: str, window: int, how: str = "mean") -> MeshArray:
        """Of each value and those before it; null until the window is full of values."""

        def roll(v: Column, w: Window) -> Column:
            rows = w.rowsBetween(1 - window, 0)
            return F.when(F.count(v).over(rows) == window, REDUCERS[how](v).over(rows))

        return self.over(dim, roll)

    def rank(self, dim: str) -> MeshArray:
        """From 1, ties share the mean of their ranks."""
        others = [c for c in ("id", *self.dims) if c != dim]
        by = Window.partitionBy(*others).orderBy("value")
        same = Window.partitionBy(*others, "value")
        rank = F.when(F.col("value").isNotNull(), F.rank().over(by) + (F.count("*").over(same) - 1) / 2 - F.sum(F.col("value").isNull().cast("int")).over(Window.partitionBy(*others)))
        return self._with(self.df.withColumn("value", rank))

    def coarsen(self, dim: str, by: int, how: str = "mean") -> MeshArray:
        """A reduction of ``by`` neighbours along a dimension of whole numbers; a part at the end must be full."""
        place = (F.row_number().over(self._along(dim)) - 1) / by
        blocks = self.df.withColumn(dim, F.floor(place).cast("long"))
        keys = ["id", *self.dims]
        return self._with(blocks.groupBy(*keys).agg(REDUCERS[how](F.col("value")).alias("value"), F.count("*").alias("_n")).where(F.col("_n") == by).drop("_n"))

    def groupby(self, key: Column, how: str = "mean", name: str = "group") -> MeshArray:
        """A reduction over the groups that an expression of the dimensions makes."""
        return self._with(self.df.groupBy("id", key.alias(name)).agg(REDUCERS[how](F.col("value")).alias("value")))

    def groupby_bins(self, edges: list[float], how: str = "count") -> DataFrame:
        """``(bin, value)``: a reduction of the values between edges, each bin with its upper edge."""
        inside = F.when((F.col("value") > edges[0]) & (F.col("value") <= edges[-1]), F.size(F.filter(F.array(*map(F.lit, map(float, edges))), lambda e: e < F.col("value"))) - 1)
        return self.df.withColumn("bin", inside).where("bin is not null").groupBy("bin").agg(REDUCERS[how](F.col("value")).alias("value"))

    def resample(self, dim: str, unit: str, how: str = "mean") -> MeshArray:
        return self._with(self.df.withColumn(dim, F.date_trunc(unit, dim)).groupBy("id", *self.dims).agg(REDUCERS[how](F.col("value")).alias("value")))

    def interp(self, dim: str, at: float) -> MeshArray:
        """Linear between neighbours along a dimension of numbers; null outside."""
        w = self._along(dim)
        pair = self.df.withColumns({"_d": F.lead(dim).over(w), "_v": F.lead("value").over(w)})
        keys = [c for c in ("id", *self.dims) if c != dim]
        share = F.coalesce(F.try_divide(F.lit(at) - F.col(dim), F.col("_d") - F.col(dim)), F.lit(0.0))
        hit = (F.col(dim) == at) | ((F.col(dim) < at) & (F.col("_d") > at))
        value = F.when(F.col(dim) == at, F.col("value")).otherwise(F.col("value") + share * (F.col("_v") - F.col("value")))
        return self._with(pair.groupBy(*keys).agg(F.max(F.when(hit, value)).alias("value")))

    def differentiate(self, dim: str) -> MeshArray:
        """Differences of neighbours on both sides over their distance, one-sided at the ends."""
        w = self._along(dim)
        low = lambda c: F.coalesce(F.lag(c).over(w), F.col(c))
        high = lambda c: F.coalesce(F.lead(c).over(w), F.col(c))
        return self._with(self.df.withColumn("value", F.try_divide(high("value") - low("value"), (high(dim) - low(dim)).cast("double"))))

    def dot(self, other: MeshArray, dims: Iterable[str]) -> MeshArray | DataFrame:
        return (self * other).reduce("sum", dims)

    def weighted_mean(self, weights: MeshArray, dims: Iterable[str]) -> MeshArray | DataFrame:
        both = self.binary(weights, lambda v, w: F.struct((v * w).alias("vw"), F.when(v.isNotNull(), w).alias("w")))
        left = [c for c in ("id", *both.dims) if c not in tuple(dims)]
        df = both.df.groupBy(*left).agg(F.try_divide(F.sum("value.vw"), F.sum("value.w")).alias("value"))
        return self._with(df) if "id" in left else df

    def sel_dims(self, **at) -> MeshArray:
        """Rows of one value of each named dimension, which is dropped."""
        df = self.df
        for d, v in at.items():
            df = df.where(F.col(d) == F.lit(v)).drop(d)
        return self._with(df)

    def unstack(self, dim: str, values: list) -> DataFrame:
        """A column for each value of a dimension."""
        return self.df.groupBy(*(c for c in ("id", *self.dims) if c != dim)).pivot(dim, values).agg(F.first("value"))

    def expand_dims(self, **to) -> MeshArray:
        return self._with(self.df.withColumns({d: F.lit(v) for d, v in to.items()}))

    def sortby(self, *columns: str) -> DataFrame:
        return self.df.orderBy(*columns)

    # selection with the grid

    def _indexed(self, grid: Grid, index: topology.Index | None) -> MeshArray:
        if index is None:
            return self
        df = self.df.join(index[self.facet], "id").drop("id").withColumnRenamed("new", "id")
        return replace(self, grid=grid, df=df.select("id", *self.dims, "value"))

    def isel(self, **indexers) -> MeshArray:
        return self._indexed(*topology.isel(self.grid, **indexers))

    def aligned(self) -> MeshArray:
        """After rows were dropped: the grid of the ids that are left, renumbered; of one that does not exist ``ValueError``."""
        return self.isel(**{self.facet: self.df.select("id").distinct()})

    def dropna(self) -> MeshArray:
        """Ids of which all values are there, and their grid."""
        whole = self.df.groupBy("id").agg(F.count_if(F.col("value").isNull()).alias("n")).where("n = 0").select("id")
        return self._with(self.df.join(whole, "id", "left_semi")).aligned()

    def clip_box(self, xmin: float, ymin: float, xmax: float, ymax: float) -> MeshArray:
        return self._indexed(*topology.clip_box(self.grid, xmin, ymin, xmax, ymax))

    def sel(self, x=None, y=None, step: float | None = None) -> MeshArray | DataFrame:
        """By what x and y are: two ranges ``(from, to)`` a box, one range and a number a line, two lists all their crossings.

        Ranges with a ``step`` become lists.  A missing one is the whole range.
        """
        x, y = (None, None) if x is None else x, (None, None) if y is None else y
        if step is not None and isinstance(x, tuple) and isinstance(y, tuple):
            xmin, ymin, xmax, ymax = self.total_bounds
            ends = [[a if a is not None else b for a, b in zip(r, known)] for r, known in ((x, (xmin, xmax)), (y, (ymin, ymax)))]
            x, y = ([a + k * step for k in range(int((b - a) / step) + 1) if a + k * step < b] for a, b in ends)
        if isinstance(x, tuple) and isinstance(y, tuple):
            ids = topology.box(self.grid, x, y).withColumnRenamed(f"{self.core}_id", "id")
            return self.isel(**{self.core: ids})
        if isinstance(x, tuple) != isinstance(y, tuple):
            return self.section(select.line(self.grid, x, y))
        xs, ys = ([v] if isinstance(v, (int, float)) else list(v) for v in (x, y))
        spark = self.df.sparkSession
        points = [(j * len(xs) + i, float(a), float(b)) for j, b in enumerate(ys) for i, a in enumerate(xs)]
        return self.sel_points(spark.createDataFrame(points, "point_id long, x double, y double"))

    def sel_points(self, points: DataFrame, **options) -> DataFrame:
        """``(point_id, x, y, *dims, value)``."""
        return select.sel_points(self.grid, points, self.df, self.facet, dims=self.dims, **options)

    def section(self, segments: DataFrame) -> DataFrame:
        """``(line_id, id, x, y, s, *dims, value)`` along lines."""
        if self.facet != self.core:
            raise ValueError(f"sections are of {self.core} values")
        rows = select.intersect_linestring(self.grid, segments).withColumnRenamed(f"{self.core}_id", "id")
        return rows.join(self.df, "id")

    def intersect_line(self, start: tuple[float, float], end: tuple[float, float]) -> DataFrame:
        return self.section(select.polyline(self.df.sparkSession, [start, end]))

    def intersect_linestring(self, vertices: list[tuple[float, float]]) -> DataFrame:
        return self.section(select.polyline(self.df.sparkSession, vertices))

    def _raster(self, cells: DataFrame) -> DataFrame:
        """``(row, col, x, y, *dims, value)``; null outside."""
        cells = cells.withColumnRenamed("face_id", "id")
        if not self.dims:
            return cells.join(self.df, "id", "left").drop("id")
        others = self.df.select(*self.dims).distinct()
        return cells.join(others).join(self.df, ["id", *self.dims], "left").drop("id")  # a cell for each of them

    def rasterize(self, resolution: float, bounds=None) -> DataFrame:
        return self._raster(select.rasterize(self.grid, resolution, bounds))

    def rasterize_like(self, x: DataFrame, y: DataFrame) -> DataFrame:
        return self._raster(select.rasterize_like(self.grid, x, y))

    def reindex_like(self, other: Grid | MeshArray, tolerance: float = 0.0) -> MeshArray:
        """The values in the order of another grid that has the same nodes, edges and faces in other orders."""
        grid = other.grid if isinstance(other, MeshArray) else other
        if type(grid) is not type(self.grid):
            raise TypeError(f"expected a {type(self.grid).__name__}, not {type(grid).__name__}")
        like = connectivity.index_like(geometry.facet_points(self.grid, self.facet), geometry.facet_points(grid, self.facet), tolerance)
        df = self.df.withColumnRenamed("id", "like").join(like, "like").select("id", *self.dims, "value")
        return replace(self, grid=grid, df=df)

    # between facets, graph and partitions

    def to_facet(self, facet: str) -> DataFrame:
        """``(target_id, *dims, source_id, value)``: the values around each of another facet."""
        return facets.to_facet(self.grid, self.df, self.facet, facet, self.dims)

    def to_node(self) -> DataFrame:
        return self.to_facet("node")

    def to_edge(self) -> DataFrame:
        return self.to_facet("edge")

    def to_face(self) -> DataFrame:
        return self.to_facet("face")

    def _only_faces(self) -> None:
        if self.facet != "face" or self.dims:
            raise ValueError("this needs face values without other dimensions")

    def _binary(self, iterate, iterations: int, mask: DataFrame | None, border_value: bool) -> MeshArray:
        self._only_faces()
        if dict(self.df.dtypes)["value"] != "boolean":
            raise ValueError("dilation and erosion need values that are true or false")
        exterior = connectivity.exterior_faces(self.grid).withColumnRenamed("face_id", "id")
        return self._with(iterate(connectivity.face_faces(self.grid), self.df, iterations=iterations, mask=mask, exterior=exterior, border_value=border_value))

    def binary_dilation(self, iterations: int = 1, mask: DataFrame | None = None, border_value: bool = False) -> MeshArray:
        return self._binary(graph.binary_dilation, iterations, mask, border_value)

    def binary_erosion(self, iterations: int = 1, mask: DataFrame | None = None, border_value: bool = False) -> MeshArray:
        return self._binary(graph.binary_erosion, iterations, mask, border_value)

    def connected_components(self) -> MeshArray:
        """The label of each face's component."""
        ids = self.grid.faces.select(F.col("face_id").alias("id"))
        return replace(self, facet="face", df=graph.component_labels(ids, connectivity.face_faces(self.grid)).withColumnRenamed("label", "value"))

    def reverse_cuthill_mckee(self) -> MeshArray:
        """The faces, and their values, in an order in which neighbours stand near each other."""
        if self.facet != "face":
            raise ValueError("this needs face values")
        ids = self.grid.faces.select(F.col("face_id").alias("id"))
        order = cut(graph.reverse_cuthill_mckee(ids, connectivity.face_faces(self.grid)))
        faces = self.grid.faces.join(order.withColumnRenamed("id", "face_id"), "face_id").select(F.col("rank").alias("face_id"), "nodes")
        df = self.df.join(order, "id").select(F.col("rank").alias("id"), *self.dims, "value")
        return replace(self, grid=replace(self.grid, faces=faces), df=df)

    def interpolate_na(self, method: str = "nearest", max_distance: float | None = None) -> MeshArray:
        """Nulls take the nearest value: in the plane on a mesh, along the edges on a network."""
        if method != "nearest":
            raise ValueError(f"unknown method {method}")
        if isinstance(self.grid, Network):
            if self.facet != "node" or self.dims:
                raise ValueError("on a network only node values without other dimensions are filled")
            e = geometry.edge_geometry(self.grid.edges, self.grid.nodes)
            ways = e.select(F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "length"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "length"))))
            return self._with(graph.nearest_on_network(ways, self.df, max_distance))
        return self._with(graph.fill_nearest(geometry.facet_points(self.grid, self.facet), self.df, max_distance, self.dims))

    def laplace_interpolate(self, xy_weights: bool = True, tolerance: float = 1e-8, max_iterations: int = 500) -> MeshArray:
        """Nulls become weighted means of their neighbours."""
        if self.dims:
            raise ValueError("select one value of the other dimensions first")
        places, _ = stored(geometry.facet_points(self.grid, self.facet))  # read several times
        if self.facet == "face":
            pairs = connectivity.face_pairs(self.grid)
            pairs = connectivity.adjacency_weights(pairs, places) if xy_weights else pairs
        else:
            pairs = connectivity.connectivity_matrix(self.grid, self.facet, xy_weights)
        return self._with(graph.laplace_fill(pairs, self.df, tolerance, max_iterations, places))

    def interp(self, dim: str, places, method: str = "linear") -> MeshArray:
        """Values at other ``places`` along a dimension; ``nearest``, ``ffill`` and ``bfill`` as of a reindex.

        ``places`` is a table with a column ``dim``, a list, or one place, which drops the dimension.
        """
        keys = [c for c in self.df.columns if c not in (dim, "value")]
        if not isinstance(places, DataFrame):
            one, kind = not isinstance(places, (list, tuple)), dict(self.df.dtypes)[dim]
            rows = self.df.sparkSession.createDataFrame([(p,) for p in ([places] if one else places)], [dim])
            got = self.interp(dim, rows.withColumn(dim, F.col(dim).cast(kind)) if kind in ("timestamp", "timestamp_ntz", "date") else rows, method)
            return got._with(got.df.drop(dim)) if one else got
        wanted = self.df.select(*keys).distinct().join(F.broadcast(places.select(dim).distinct()) if places.limit(100_001).count() <= 100_000 else places.select(dim).distinct())  # the result itself has a row for each
        return self._with(ordered.interpolated(self.df, wanted, keys, dim, method).select(*self.df.columns))

    def interp_like(self, other: MeshArray, dim: str, method: str = "linear") -> MeshArray:
        return self.interp(dim, other.df.select(dim).distinct(), method)

    def rolling_exp(self, dim: str, window: float, window_type: str = "span") -> MeshArray:
        """Exponentially weighted means along a dimension; the window is a span, com, halflife or alpha."""
        kinds = {"span": lambda w: 2 / (w + 1), "com": lambda w: 1 / (w + 1), "halflife": lambda w: 1 - 0.5 ** (1 / w), "alpha": lambda w: w}
        if window_type not in kinds:
            raise ValueError(f"window_type must be one of {', '.join(kinds)}, not {window_type}")
        keys = [c for c in self.df.columns if c not in (dim, "value")]
        return self._with(ordered.exponential_mean(self.df, keys, [dim], "value", kinds[window_type](window)))

    def to_crs(self, crs: str | int | None = None, epsg: int | None = None) -> MeshArray:
        return replace(self, grid=to_crs(self.grid, crs, epsg))

    def to_periodic(self) -> MeshArray:
        return self._indexed(*periodic.to_periodic(self.grid)) if isinstance(self.grid, Mesh) else self

    def to_nonperiodic(self, xmax: float) -> MeshArray:
        return self._indexed(*periodic.to_nonperiodic(self.grid, xmax)) if isinstance(self.grid, Mesh) else self

    def polygonize(self) -> DataFrame:
        self._only_faces()
        return vector.polygonize(self.grid, self.df.withColumnRenamed("id", "face_id"))

    def label_partitions(self, parts: int) -> DataFrame:
        """Labels of parts of about equal sums of the values, which are whole numbers of the core facet."""
        if self.facet != self.core or self.dims:
            raise ValueError(f"this needs {self.core} values without other dimensions")
        return partition.label_partitions(self.grid, parts, self.df.withColumnRenamed("value", "weight"))

    def partition_by_label(self, labels: DataFrame) -> list[MeshArray]:
        return [self._indexed(g, index) for g, index in partition.split(self.grid, labels)]

    def partition(self, parts: int) -> list[MeshArray]:
        return self.partition_by_label(partition.label_partitions(self.grid, parts))


def set_crs(grid: Grid, crs: str | int | None = None, epsg: int | None = None, allow_override: bool = False) -> Grid:
    """The grid with a CRS; another one than it has needs ``allow_override``."""
    new = roles.crs_of(crs, epsg)
    if new is None:
        raise ValueError("give a crs or an epsg code")
    if grid.crs is not None and grid.crs != new.name and not allow_override:
        raise ValueError(f"the grid has the CRS {grid.crs} already")
    return replace(grid, crs=new.name, projected=roles.validate_crs(new, None if allow_override else grid.projected))


def to_crs(grid: Grid, crs: str | int | None = None, epsg: int | None = None) -> Grid:
    """The grid in another system; its own must be set.  The same system gives the same grid."""
    new = roles.crs_of(crs, epsg)
    if new is None:
        raise ValueError("give a crs or an epsg code")
    if grid.crs is None:
        raise ValueError("the grid has no CRS: set it first")
    if grid.crs == new.name:
        return grid
    old = roles.crs_of(grid.crs)
    if old.epsg is None or new.epsg is None:
        raise ValueError("both systems need an EPSG code")
    return replace(grid, nodes=transform(grid.nodes, "x", "y", old.epsg, new.epsg), crs=new.name, projected=system(new.epsg).projected)


def set_node_coords(grid: Grid, nodes: DataFrame, projected: bool = True) -> Grid:
    """The grid with other coordinates ``(node_id, x, y)``, one pair for each node."""
    known = grid.nodes.select("node_id")
    if topology.differ(known, nodes.select("node_id")):
        raise ValueError("there must be one pair of coordinates for each node")
    return replace(grid, nodes=nodes.select("node_id", "x", "y"), projected=projected)


@dataclass(frozen=True)
class MeshDataset:
    """Named arrays, on one or more grids of different names."""

    arrays: dict[str, MeshArray] = field(default_factory=dict)
    more: tuple[Grid, ...] = ()

    def __post_init__(self) -> None:
        by_name: dict[str, Grid] = {}
        for g in (*(a.grid for a in self.arrays.values()), *self.more):
            if by_name.setdefault(g.name, g) is not g and not topology.equals(by_name[g.name], g):
                raise ValueError(f"two different grids are named {g.name}")

    @property
    def grids(self) -> list[Grid]:
        out: dict[str, Grid] = {}
        for g in (*(a.grid for a in self.arrays.values()), *self.more):
            out.setdefault(g.name, g)
        return list(out.values())

    @property
    def names(self) -> list[str]:
        return [g.name for g in self.grids]

    @property
    def topology(self) -> dict[str, Grid]:
        return {g.name: g for g in self.grids}

    @property
    def grid(self) -> Grid:
        if len(self.grids) != 1:
            raise TypeError(f"the dataset has {len(self.grids)} grids, not one")
        return self.grids[0]

    @property
    def name(self) -> str:
        return self.grid.name

    @property
    def crs(self) -> dict[str, str | None]:
        return {g.name: g.crs for g in self.grids}

    @property
    def bounds(self) -> dict[str, tuple[float, float, float, float]]:
        return {g.name: topology.node_bounds(g) for g in self.grids}

    @property
    def total_bounds(self) -> tuple[float, float, float, float]:
        b = list(self.bounds.values())
        return min(v[0] for v in b), min(v[1] for v in b), max(v[2] for v in b), max(v[3] for v in b)

    def __getitem__(self, name: str) -> MeshArray:
        return self.arrays[name]

    def assign(self, **arrays: MeshArray) -> MeshDataset:
        return MeshDataset({**self.arrays, **{n: replace(a, name=n) for n, a in arrays.items()}}, self.more)

    def drop_vars(self, *names: str) -> MeshDataset:
        return MeshDataset({n: a for n, a in self.arrays.items() if n not in names}, self.more)

    def map(self, function: Callable[[MeshArray], object]) -> dict[str, object]:
        """A function of each array."""
        return {n: function(a) for n, a in self.arrays.items()}

    def _mapped(self, function: Callable[[MeshArray], MeshArray]) -> MeshDataset:
        """An operation that changes grids, done once a grid and applied to its arrays."""
        return MeshDataset(self.map(function))

    def rename(self, names: str | dict[str, str]) -> MeshDataset:
        """Other names of the grids."""
        names = {self.name: names} if isinstance(names, str) else names
        unknown = set(names) - set(self.names)
        if unknown:
            raise ValueError(f"no grids named {sorted(unknown)}")
        return MeshDataset({n: a.rename(names.get(a.grid.name, a.grid.name)) for n, a in self.arrays.items()}, tuple(replace(g, name=names.get(g.name, g.name)) for g in self.more))

    def set_crs(self, crs=None, epsg=None, allow_override: bool = False, topology: str | None = None) -> MeshDataset:
        """Of all grids, or of the one named."""
        new = {g.name: set_crs(g, crs, epsg, allow_override) if topology in (None, g.name) else g for g in self.grids}
        return MeshDataset({n: replace(a, grid=new[a.grid.name]) for n, a in self.arrays.items()}, tuple(new[g.name] for g in self.more))

    def set_node_coords(self, nodes: DataFrame, topology: str | None = None) -> MeshDataset:
        """Of the only grid, or of the one named."""
        name = topology if topology is not None else self.name
        if name not in self.names:
            raise ValueError(f"no grid named {name}")
        new = set_node_coords(self.topology[name], nodes)
        return MeshDataset({n: replace(a, grid=new) if a.grid.name == name else a for n, a in self.arrays.items()}, tuple(new if g.name == name else g for g in self.more))

    def assign_node_coords(self) -> dict[str, DataFrame]:
        return self.map(MeshArray.assign_node_coords)

    def assign_edge_coords(self) -> dict[str, DataFrame]:
        return self.map(MeshArray.assign_edge_coords)

    def assign_face_coords(self) -> dict[str, DataFrame]:
        return self.map(MeshArray.assign_face_coords)

    def sel(self, x=None, y=None) -> MeshDataset | dict[str, DataFrame]:
        """A box keeps a dataset; lines and points give a table for each array."""
        found = self.map(lambda a: a.sel(x, y))
        return MeshDataset(found) if all(isinstance(v, MeshArray) for v in found.values()) else found

    def clip_box(self, xmin: float, ymin: float, xmax: float, ymax: float) -> MeshDataset:
        return self._mapped(lambda a: a.clip_box(xmin, ymin, xmax, ymax))

    def isel(self, **indexers) -> MeshDataset:
        return self._mapped(lambda a: a.isel(**indexers))

    def sel_points(self, points: DataFrame, **options) -> dict[str, DataFrame]:
        return self.map(lambda a: a.sel_points(points, **options))

    def intersect_line(self, start, end) -> dict[str, DataFrame]:
        return self.map(lambda a: a.intersect_line(start, end))

    def intersect_linestring(self, vertices) -> dict[str, DataFrame]:
        return self.map(lambda a: a.intersect_linestring(vertices))

    def rasterize(self, resolution: float) -> dict[str, DataFrame]:
        """Each array on one raster over the bounds of all grids."""
        return self.map(lambda a: a.rasterize(resolution, self.total_bounds))

    def rasterize_like(self, x: DataFrame, y: DataFrame) -> dict[str, DataFrame]:
        return self.map(lambda a: a.rasterize_like(x, y))

    def reindex_like(self, other: MeshDataset, tolerance: float = 0.0) -> MeshDataset:
        missing = set(self.names) - set(other.names)
        if missing:
            raise ValueError(f"the other dataset has no grids {sorted(missing)}")
        return self._mapped(lambda a: a.reindex_like(other.topology[a.grid.name], tolerance))

    def to_crs(self, crs: str | int | None = None, epsg: int | None = None, topology: str | None = None) -> MeshDataset:
        """All grids, or the one named ``topology``, in another system."""
        if topology is not None and topology not in self.names:
            raise ValueError(f"no grid is named {topology}")
        new = {g.name: to_crs(g, crs, epsg) if topology in (None, g.name) else g for g in self.grids}
        return MeshDataset({n: replace(a, grid=new[a.grid.name]) for n, a in self.arrays.items()}, tuple(new[g.name] for g in self.more))

    def to_periodic(self) -> MeshDataset:
        return self._mapped(MeshArray.to_periodic)

    def to_nonperiodic(self, xmax: float) -> MeshDataset:
        return self._mapped(lambda a: a.to_nonperiodic(xmax))

    def to_geodataframe(self) -> DataFrame:
        """Arrays of each grid beside each other by facet and id, grids below each other; with ``grid``, ``facet``, ``wkt``."""
        out = None
        for g in self.grids:
            for facet in ("node", "edge", "face"):
                own = [a for a in self.arrays.values() if a.grid.name == g.name and a.facet == facet and not a.dims]
                if not own:
                    continue
                rows = wkt.to_wkt(g, facet).select(F.lit(g.name).alias("grid"), F.lit(facet).alias("facet"), "id", "wkt")
                for a in own:
                    rows = rows.join(a.df.withColumnRenamed("value", a.name), "id", "left")
                out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def to_dataset(self, folder: str, optional: bool = False) -> None:
        """A folder for each grid, with its arrays."""
        for g in self.grids:
            own = {n: a.df.withColumn("_facet", F.lit(a.facet)) for n, a in self.arrays.items() if a.grid.name == g.name}
            tables.write_mesh(g, f"{folder}/{g.name}", own, optional)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, grids: dict[str, list[str]]) -> MeshDataset:
        """Read what ``to_dataset`` wrote: the names of the grids, and of the arrays of each."""
        arrays, more = {}, []
        for g, names in grids.items():
            grid = tables.read_grid(spark, f"{folder}/{g}")
            more.append(grid)
            for n in names:
                df = tables.read_table(spark, f"{folder}/{g}", f"{n}_data")
                facet = df.select("_facet").first()._facet
                arrays[n] = MeshArray(grid, facet, df.drop("_facet"), n)
        return cls(arrays, tuple(more))

    @classmethod
    def from_geodataframe(cls, geometry_table: DataFrame) -> MeshDataset:
        """Grid of ``(id, wkt, columns...)`` polygons or lines, and an array of each column."""
        grid = wkt.grid_from_wkt(geometry_table.select("id", "wkt"))
        facet = "face" if isinstance(grid, Mesh) else "edge"
        columns = [c for c in geometry_table.columns if c not in ("id", "wkt")]
        return cls({c: MeshArray(grid, facet, geometry_table.select("id", F.col(c).alias("value")), c) for c in columns}, (grid,))

    def partition_by_label(self, labels: DataFrame) -> list[MeshDataset]:
        if len(self.grids) != 1:
            raise TypeError("only datasets of one grid are partitioned")
        parts = partition.split(self.grid, labels)
        arrays = {n: replace(a, df=stored(a.df)[0]) for n, a in self.arrays.items()}  # each part reads them
        return [MeshDataset({n: a._indexed(g, index) for n, a in arrays.items()}, (g,)) for g, index in parts]

    def partition(self, parts: int) -> list[MeshDataset]:
        return self.partition_by_label(partition.label_partitions(self.grid, parts))


def merge_partitions(parts: list[MeshDataset]) -> MeshDataset:
    """One dataset of the partitions: grids of one name are merged, and the arrays on them.

    A single partition comes back as it is, none raises ``ValueError``.  An array must be in all partitions that
    have its grid, on one facet and with the same dimensions, else ``ValueError``.
    """
    if not parts:
        raise ValueError("cannot merge no partitions")
    if len(parts) == 1:
        return parts[0]
    arrays, grids = {}, []
    for name in dict.fromkeys(n for p in parts for n in p.names):
        own = [p for p in parts if name in p.names]
        grid, index = partition.merge_grids([p.topology[name] for p in own])
        grids.append(grid)
        for n in dict.fromkeys(n for p in own for n, a in p.arrays.items() if a.grid.name == name):
            if any(n not in p.arrays for p in own):
                raise ValueError(f"the array {n} is not in all partitions")
            found = [p.arrays[n] for p in own]
            if len({(a.facet, a.dims) for a in found}) > 1:
                raise ValueError(f"the array {n} has different dimensions in the partitions")
            if found[0].facet not in index:  # edges that only the faces define
                raise ValueError(f"the first partition has no edge table for {n}")
            df = partition.merge_data([a.df for a in found], index[found[0].facet])
            arrays[n] = MeshArray(grid, found[0].facet, df.select("id", *found[0].dims, "value"), n)
    return MeshDataset(arrays, tuple(grids))


def concat(arrays: list[MeshArray], dim: str, values: list) -> MeshArray:
    """Arrays of one grid and facet below each other, told apart by a dimension."""
    first = arrays[0]
    for a in arrays[1:]:
        if a.facet != first.facet or not (a.grid is first.grid or topology.equals(a.grid, first.grid)):
            raise ValueError("only arrays of one grid and facet are concatenated")
    out = None
    for a, v in zip(arrays, values, strict=True):
        df = a.df.withColumn(dim, F.lit(v)).select("id", *first.dims, dim, "value")
        out = df if out is None else out.unionByName(df)
    return replace(first, df=out)


def merge(*sets: MeshDataset | MeshArray) -> MeshDataset:
    """One dataset of several; arrays of one name raise ``ValueError``."""
    arrays, more = {}, []
    for s in sets:
        s = MeshDataset({s.name: s}) if isinstance(s, MeshArray) else s
        both = set(arrays) & set(s.arrays)
        if both:
            raise ValueError(f"several arrays are named {sorted(both)}")
        arrays |= s.arrays
        more += s.more
    return MeshDataset(arrays, tuple(topology.unique_grids(more)))
