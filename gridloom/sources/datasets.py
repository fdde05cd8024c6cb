"""Mesh datasets in files: topologies by the public conventions, over the arrays of ``sources.arrays``.

``write_dataset`` writes grids, their data and the coordinates of other dimensions to a NetCDF or Zarr
folder; ``open_dataset`` finds the topologies of any such file by their attributes and gives lazy tables:
nothing but headers is read before a query runs, and a query reads the chunks it needs.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.data import MeshArray, MeshDataset
from gridloom.operators import topology
from gridloom.operators.joins import lookup
from gridloom.operators.mesh import Grid, Mesh, dense_ids
from gridloom.sources import roles
from gridloom.sources.arrays import Column, Stored, finish_arrays, open_arrays, read_arrays, write_arrays, write_scalar
from gridloom.sources.tables import from_file_tables, to_file_tables

LEAST = -(1 << 63)
#: How Spark's types are stored.
STORED = {"double": "f8", "float": "f4", "bigint": "i8", "int": "i4", "smallint": "i2", "tinyint": "i1", "timestamp": "i8", "timestamp_ntz": "i8", "date": "i8"}
SINCE = "microseconds since 1970-01-01 00:00:00"


def _storable(df: DataFrame, name: str, kind: str, attrs: dict[str, object] | None = None) -> tuple[DataFrame, Column]:
    """The column as it is stored, and what it is; times as microseconds."""
    if kind not in STORED:
        raise ValueError(f"{name} of type {kind} cannot be stored")
    attrs = dict(attrs or {})
    if kind in ("timestamp", "timestamp_ntz", "date"):
        df = df.withColumn(name, F.unix_micros(F.col(name).cast("timestamp")))
        attrs |= {"units": SINCE, "calendar": "standard"}
    if STORED[kind][0] == "i":
        attrs["_FillValue"] = -(1 << (8 * int(STORED[kind][1]) - 1))
    return df, Column(STORED[kind], attrs)


def _packed(grid: Grid) -> tuple[Grid, dict[str, DataFrame] | None]:
    """The grid with ids from 0 without gaps, and the old ids by facet if they changed."""
    core, key = (grid.faces, "face_id") if isinstance(grid, Mesh) else (grid.edges, "edge_id")
    full = lambda df, k: (r := df.agg(F.count("*").alias("n"), F.min(k).alias("lo"), F.max(k).alias("hi")).first()).n == 0 or (r.lo, r.hi) == (0, r.n - 1)
    if full(core, key) and full(grid.nodes, "node_id"):
        return grid, None
    return topology.subset(grid, core.select(key)) if isinstance(grid, Mesh) else topology.subset_network(grid, core.select(key))


def write_dataset(data: MeshDataset, path: str, form: str = "zarr", chunks: dict[str, int] | None = None) -> None:
    """Write a dataset's grids, arrays and coordinates; ids with gaps are renumbered in their order.

    ``chunks``: places of a chunk by dimension, such as ``{"mesh2d_nFaces": 100_000, "time": 10}``.
    """
    spark = data.grids[0].nodes.sparkSession
    axes: dict[str, DataFrame] = {}  # places of the values of other dimensions
    kinds = {d: kind for a in data.arrays.values() for d, kind in a.df.dtypes if d in a.dims}
    lengths: dict[str, int] = {}
    for d, kind in kinds.items():
        values = [a.df.select(d) for a in data.arrays.values() if d in a.dims]
        whole = values[0]
        for v in values[1:]:
            whole = whole.unionByName(v)
        axes[d] = dense_ids(whole.where(F.col(d).isNotNull()), [d], f"_at_{d}")
        lengths[d] = axes[d].count()
        stored, column = _storable(axes[d], d, kind)
        if lengths[d]:
            write_arrays(stored.select(F.col(f"_at_{d}").alias(f"_{d}"), d).withColumnsRenamed({d: f"{d}__v", f"_{d}": d}).withColumnsRenamed({f"{d}__v": f"{d}_value"}), path, {d: lengths[d]}, {f"{d}_value": column}, form, chunks)
    for grid in data.grids:
        packed, index = _packed(grid)
        found, attrs = to_file_tables(packed)
        sizes = {"node": packed.nodes.count(), "edge": packed.edges.count()} | ({"face": packed.faces.count()} if isinstance(packed, Mesh) else {})
        dims = {f: f"{grid.name}_n{f.capitalize()}s" for f in sizes}
        names = ("longitude", "latitude") if grid.projected is False else ("projection_x_coordinate", "projection_y_coordinate")
        xy = {f"{grid.name}_node_{c}": Column("f8", {"standard_name": s}) for c, s in zip("xy", names)}
        write_arrays(packed.nodes.select(F.col("node_id").alias(dims["node"]), *[F.col(c).alias(f"{grid.name}_node_{c}") for c in "xy"]), path, {dims["node"]: sizes["node"]}, xy, form, chunks)
        for facet in ("edge", "face") if "face" in sizes else ("edge",):
            name = str(attrs[f"{facet}_node_connectivity"])
            width = 2 if facet == "edge" else found[name].agg(F.max(F.size("members"))).first()[0] or 1
            column = Column("i8", {"_FillValue": -1, "start_index": 0, "cf_role": f"{facet}_node_connectivity"}, (f"{name}_max" if facet == "face" else "Two", width))
            write_arrays(found[name].select(F.col(f"{facet}_id").alias(dims[facet]), F.col("members").alias(name)), path, {dims[facet]: sizes[facet]}, {name: column}, form, chunks)
        kept = {k: v for k, v in attrs.items() if k not in ("_FillValue", "start_index", "Conventions", "edge_coordinates", "face_coordinates")}
        write_scalar(path, grid.name, kept | ({"crs": grid.crs} if grid.crs else {}), form)
        for name, a in data.arrays.items():
            if a.grid.name != grid.name:
                continue
            df, at = a.df, dims[a.facet]
            for d in a.dims:
                df = lookup(df, axes[d], [d], "inner").drop(d).withColumnRenamed(f"_at_{d}", d)
            if index is not None:
                df = df.join(index[a.facet], "id").drop("id").withColumnRenamed("new", "id")
            df, column = _storable(df.withColumnsRenamed({"id": at, "value": name}), name, dict(a.df.dtypes)["value"], {"mesh": grid.name, "location": a.facet})
            write_arrays(df, path, {at: sizes[a.facet]} | {d: max(1, lengths[d]) for d in a.dims}, {name: column}, form, chunks)
    finish_arrays(path, {"Conventions": "CF-1.9 UGRID-1.0"}, form)


def _members(spark: SparkSession, path: str, name: str, v: Stored, facet_dim: str, key: str) -> DataFrame:
    """``(key, members)`` of a connectivity, whichever of its dimensions comes first."""
    if v.dims[0] == facet_dim:
        return read_arrays(spark, path, name, nested=1).select(F.col(facet_dim).alias(key), F.col(name).cast("array<bigint>").alias("members"))
    rows = read_arrays(spark, path, name).select(F.col(facet_dim).alias(key), F.struct(F.col(v.dims[0]).alias("pos"), F.col(name).cast("long").alias("v")).alias("m"))
    return rows.groupBy(key).agg(F.sort_array(F.collect_list("m")).alias("m")).select(key, F.col("m.v").alias("members"))


def open_dataset(spark: SparkSession, path: str) -> MeshDataset:
    """The grids and arrays of a NetCDF file or folder, or a Zarr folder; files without a topology raise ``ValueError``."""
    arrays, _ = open_arrays(path)
    variables = {n: roles.Variable(v.dims, v.shape, v.attrs) for n, v in arrays.items()}
    found = roles.topologies(variables)
    if not found:
        raise ValueError(f"{path} holds no mesh topology")
    places, links, facets = roles.coordinates(variables), roles.connectivity(variables), roles.dimensions(variables)
    used = {n for t in found for xy in places[t].values() for names in xy for n in names} | {n for t in found for n in links[t].values()} | set(found)
    out: dict[str, MeshArray] = {}
    grids = []
    for t in found:
        (x, *_), (y, *_) = places[t]["node_coordinates"]
        node_dim = facets[t]["node_dimension"]
        nodes = read_arrays(spark, path, x, y).select(F.col(node_dim).alias("node_id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        attrs: dict[str, object] = {"cf_role": "mesh_topology", "topology_dimension": variables[t].attrs["topology_dimension"], "node_dimension": f"{t}_nNodes"}
        files, starts = {f"{t}_nodes": nodes}, {}
        for role in ("face_node_connectivity", "edge_node_connectivity"):
            if role in links[t]:
                facet, name = role.partition("_")[0], links[t][role]
                files[name] = _members(spark, path, name, arrays[name], facets[t][f"{facet}_dimension"], f"{facet}_id")
                attrs[role], starts[facet] = name, int(arrays[name].attrs.get("start_index", 0))
        attrs["start_index"] = starts.get("face", 0)
        grid = from_file_tables(files, attrs, starts.get("edge"))
        crs = variables[t].attrs.get("crs")
        grid = replace(grid, name=t, crs=str(crs) if crs else None, projected=variables[x].attrs.get("standard_name") != "longitude")
        grids.append(grid)
        for name, v in arrays.items():
            own = [(f, d) for f in ("node", "edge", "face") if (d := facets[t].get(f"{f}_dimension")) in v.dims]
            if name in used or len(own) != 1:
                continue
            (facet, dim), = own
            df = read_arrays(spark, path, name).withColumnsRenamed({dim: "id", name: "value"})
            for d in v.dims:
                value = f"{d}_value" if f"{d}_value" in arrays else d
                if d != dim and value in arrays and arrays[value].dims == (d,):
                    axis = read_arrays(spark, path, value).select(F.col(d).alias("_at"), F.col(value).alias("_value"))
                    df = lookup(df.withColumnRenamed(d, "_at"), axis, ["_at"]).drop("_at").withColumnRenamed("_value", d)
            out[name] = MeshArray(grid, facet, df.select("id", *[d for d in v.dims if d != dim], "value"), name)
    return MeshDataset(out, tuple(grids))
