"""Sources and sinks: table folders, mesh table sets, dense file forms, and weights."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.connectivity import boundary_edges, edge_faces, face_edges, face_faces, prior_edges, to_dense, to_sparse
from gridloom.operators.mesh import Grid, Mesh, Network, face_nodes
from gridloom.sources import roles


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_data_array(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with exactly one value column, named ``value``."""
    df = spark.read.parquet(path)
    if df.columns.count("value") != 1:
        raise ValueError("a data array has exactly one value column")
    return df


def load(df: DataFrame) -> DataFrame:
    """Read now and keep in memory, where later queries take it from."""
    df = df.cache()
    df.count()
    return df


def write_grid(grid: Grid, folder: str, optional: bool = False) -> None:
    """Write a grid as ``node``, ``face`` and ``edge`` tables, and its facts.

    A mesh's edges are written if it has a table of them.  ``optional`` adds the derived connectivities.
    """
    facts = {"kind": type(grid).__name__, "name": grid.name, "crs": grid.crs, "projected": grid.projected}
    grid.nodes.sparkSession.createDataFrame([(json.dumps(facts),)], "facts string").write.parquet(f"{folder}/facts.parquet")
    grid.nodes.write.parquet(f"{folder}/node.parquet")
    if isinstance(grid, Network) or grid.edge_table is not None or optional:
        grid.edges.write.parquet(f"{folder}/edge.parquet")
    if isinstance(grid, Mesh):
        grid.faces.write.parquet(f"{folder}/face.parquet")
        if optional:
            for name, table in (("face_edge", face_edges(grid)), ("edge_face", edge_faces(grid)), ("face_face", face_faces(grid)), ("boundary_node", boundary_edges(grid))):
                table.write.parquet(f"{folder}/{name}.parquet")


def write_mesh(mesh: Grid, folder: str, data: dict[str, DataFrame] | None = None, optional: bool = False) -> None:
    """``write_grid``, and for each name in ``data`` a table ``<name>_data``."""
    write_grid(mesh, folder, optional)
    for name, df in (data or {}).items():
        df.write.parquet(f"{folder}/{name}_data.parquet")


def read_grid(spark: SparkSession, folder: str) -> Grid:
    """Read a grid that ``write_grid`` wrote; a folder without one raises ``ValueError``."""
    from pyspark.errors import AnalysisException

    try:
        facts = json.loads(read_table(spark, folder, "facts").first().facts)
    except AnalysisException as error:
        raise ValueError(f"{folder} holds no mesh topology") from error
    more = {k: facts[k] for k in ("name", "crs", "projected")}
    if facts["kind"] == "Network":
        return Network(read_table(spark, folder, "node"), read_table(spark, folder, "edge"), **more)
    try:
        edge = read_table(spark, folder, "edge")
    except AnalysisException:
        edge = None
    return Mesh(read_table(spark, folder, "node"), read_table(spark, folder, "face"), edge, **more)


def read_mesh(spark: SparkSession, folder: str) -> Mesh:
    """Read a mesh that ``write_mesh`` wrote."""
    return read_grid(spark, folder)


def read_many(spark: SparkSession, folders: list[str], name: str) -> tuple[Grid, DataFrame]:
    """The grid of the first folder, and the rows of the data table ``name`` of all of them."""
    if not folders:
        raise ValueError("no folders to open")
    return read_grid(spark, folders[0]), spark.read.parquet(*(f"{f}/{name}_data.parquet" for f in folders))


# dense forms, as mesh files have them: ids with a start index, rows filled to one width


def to_file_tables(grid: Grid, fill: int = -1, start_index: int = 0, optional: bool = False) -> tuple[dict[str, DataFrame], dict[str, object]]:
    """Tables ``{name: (id, ...)}`` under default names, and the attributes of the topology variable.

    Connectivities are arrays of one width with ``start_index`` and ``fill``.
    """
    two = isinstance(grid, Mesh)
    attrs = roles.default_attrs(grid.name, 2 if two else 1) | {"start_index": start_index, "_FillValue": fill, "Conventions": "CF-1.9 UGRID-1.0"}
    shift = lambda table, key: table.select(key, F.transform("members", lambda v: F.when(v == -1, F.lit(fill)).otherwise(v + start_index)).alias("members"))
    dense = lambda table, key, member, width=None: shift(to_dense(table, key, member, width), key)
    ends = grid.edges.select("edge_id", F.posexplode(F.array("a", "b")).alias("pos", "node_id"))
    out = {f"{grid.name}_nodes": grid.nodes.select("node_id", "x", "y"), str(attrs["edge_node_connectivity"]): dense(ends, "edge_id", "node_id", 2)}
    if two:
        out[str(attrs["face_node_connectivity"])] = dense(face_nodes(grid), "face_id", "node_id")
        if optional:
            out[str(attrs["face_edge_connectivity"])] = dense(face_edges(grid), "face_id", "edge_id")
            pairs = edge_faces(grid).select("edge_id", F.posexplode(F.array("f1", "f2")).alias("pos", "face_id")).where("face_id is not null")
            out[str(attrs["edge_face_connectivity"])] = dense(pairs, "edge_id", "face_id", 2)
            border = boundary_edges(grid).select("edge_id", F.posexplode(F.array("a", "b")).alias("pos", "node_id"))
            out[str(attrs["boundary_node_connectivity"])] = dense(border, "edge_id", "node_id", 2)
    if not optional:
        for role in ("face_edge_connectivity", "edge_face_connectivity", "face_face_connectivity", "boundary_node_connectivity"):
            attrs.pop(role, None)
    return out, attrs


def from_file_tables(tables: dict[str, DataFrame], attrs: dict[str, object], edge_start_index: int | None = None) -> Grid:
    """The grid of tables and attributes as ``to_file_tables`` gives them; ids from 0, without fill.

    The edge table may have a start index of its own.  Three-dimensional topologies raise ``NotImplementedError``.
    """
    if attrs.get("cf_role") != "mesh_topology":
        raise ValueError("no mesh topology")
    dimension = int(attrs["topology_dimension"])
    if dimension not in (1, 2):
        raise NotImplementedError("only topologies of one or two dimensions")
    name = str(attrs["node_dimension"]).removesuffix("_nNodes")
    fill, start = int(attrs.get("_FillValue", -1)), int(attrs.get("start_index", 0))
    nodes = tables[f"{name}_nodes"].select(F.col("node_id").cast("long").alias("node_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    edge = tables.get(str(attrs.get("edge_node_connectivity")))
    if edge is not None:
        ends = to_sparse(edge, "edge_id", "node_id", fill, start if edge_start_index is None else edge_start_index)
        edge = ends.groupBy("edge_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id"))).alias("c")).select("edge_id", F.get("c.node_id", F.lit(0)).alias("a"), F.get("c.node_id", F.lit(1)).alias("b"))
    if dimension == 1:
        return Network(nodes, edge, name=name)
    corner = to_sparse(tables[str(attrs["face_node_connectivity"])], "face_id", "node_id", fill, start)
    faces = corner.groupBy("face_id").agg(F.array_sort(F.collect_list(F.struct("pos", "node_id"))).alias("c")).select("face_id", F.col("c.node_id").alias("nodes"))
    mesh = Mesh(nodes, faces, name=name)
    return mesh if edge is None else replace(prior_edges(mesh, edge), name=name)


def write_weights(weights: DataFrame, folder: str) -> None:
    """Keep regridding weights for later sessions."""
    weights.select("target_id", "source_id", "weight").write.parquet(folder)


def read_weights(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("target_id long, source_id long, weight double").parquet(folder)
