"""Subsets of meshes and networks, with the mapping of their ids, and comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.geometry import edge_geometry, with_geometry
from gridloom.operators.mesh import Grid, Mesh, Network, dense_ids
from gridloom.session import cut

#: For each facet ``(id, new)``: the old ids that are kept, and their new ones.
Index = dict[str, DataFrame]


class LateEdges(dict):
    """An index whose edges are found when they are asked for, as they take most of the work."""

    def __init__(self, edge: Callable[[], DataFrame], **known: DataFrame):
        super().__init__(known)
        self._edge = edge

    def __missing__(self, facet: str) -> DataFrame:
        if facet != "edge":
            raise KeyError(facet)
        self["edge"] = self._edge()
        return self["edge"]


def as_index(grid: Grid, facet: str, ids: DataFrame | Iterable[int]) -> DataFrame:
    """``(id)`` of a facet, from a list, a table of ``id``, or one of ``(id, keep)`` flags.

    Repeated ids, and ids that the facet does not have, raise ``ValueError``.
    """
    table = {"node": grid.nodes, "edge": grid.edges} | ({"face": grid.faces} if isinstance(grid, Mesh) else {})
    if facet not in table:
        raise ValueError(f"{type(grid).__name__} has no facet {facet}")
    known = table[facet].select(F.col(f"{facet}_id").alias("id"))
    if not isinstance(ids, DataFrame):
        ids = known.sparkSession.createDataFrame([(int(k),) for k in ids], "id long")
    if "keep" in ids.columns:
        ids = ids.where("keep")
    ids = cut(ids.select("id"))
    if ids.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("an index must not repeat values")
    if ids.join(known, "id", "left_anti").limit(1).count():
        raise ValueError(f"an index holds values that are no {facet} ids")
    return ids


def _placed(corner: DataFrame, nodes: DataFrame, by: str) -> DataFrame:
    """``(by, nodes)``: corners ``(by, pos, node_id)`` with the new ids of ``nodes(id, new)``."""
    new = corner.join(nodes.select(F.col("id").alias("node_id"), "new"), "node_id")
    return new.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("c")).select(by, F.col("c.new").alias("nodes"))


def _ends(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    one, two = (nodes.select(F.col("id").alias(k), F.col("new").alias(f"n{k}")) for k in "ab")
    return edge.join(one, "a").join(two, "b").select("edge_id", F.col("na").alias("a"), F.col("nb").alias("b"))


def subset(mesh: Mesh, faces: DataFrame) -> tuple[Mesh, Index]:
    """Mesh of the faces in ``faces(face_id)``, which has none twice, and the index of kept ids.

    Used nodes, edges and faces are renumbered in ascending order of their old ids.
    """
    return renumbered(mesh, cut(mesh.faces.join(faces.select("face_id"), "face_id", "left_semi")))  # read five times, and may come from a search


def renumbered(mesh: Mesh, kept: DataFrame) -> tuple[Mesh, Index]:
    """As ``subset``, of faces ``kept(face_id, nodes)`` that are written already."""
    corner = kept.select("face_id", F.posexplode("nodes").alias("pos", "node_id"))
    node = dense_ids(corner, ["node_id"], "new").withColumnRenamed("node_id", "id")
    face = dense_ids(kept, ["face_id"], "new", unique=True).withColumnRenamed("face_id", "id")
    placed = _placed(corner, node, "face_id").join(face.withColumnRenamed("id", "face_id"), "face_id")
    nodes = mesh.nodes.join(node.withColumnRenamed("id", "node_id"), "node_id").select(F.col("new").alias("node_id"), "x", "y")
    new = replace(mesh, nodes=nodes, faces=placed.select(F.col("new").alias("face_id"), "nodes"), edge_table=None)

    def used() -> DataFrame:
        side = kept.select("nodes", F.posexplode("nodes").alias("pos", "p")).withColumn("q", F.get("nodes", (F.col("pos") + 1) % F.size("nodes")))
        pair = side.where("p <> q").select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct()
        return mesh.edges.withColumns({"u": F.least("a", "b"), "v": F.greatest("a", "b")}).join(pair, ["u", "v"], "left_semi").select("edge_id", "a", "b")

    index = LateEdges(lambda: dense_ids(used(), ["edge_id"], "new").withColumnRenamed("edge_id", "id"), node=node, face=face)
    if mesh.edge_table is not None:
        table = _ends(used(), node).join(index["edge"].withColumnRenamed("id", "edge_id"), "edge_id").select(F.col("new").alias("edge_id"), "a", "b")
        new = replace(new, edge_table=table)
    return new, index


def subset_network(network: Network, edges: DataFrame) -> tuple[Network, Index]:
    """Network of the edges in ``edges(edge_id)``, and the index of kept ids; renumbered in ascending order."""
    kept = cut(network.edges.join(edges.select("edge_id"), "edge_id", "left_semi"))
    node = dense_ids(kept.select(F.explode(F.array("a", "b")).alias("id")), ["id"], "new")
    edge = dense_ids(kept, ["edge_id"], "new").withColumnRenamed("edge_id", "id")
    table = _ends(kept, node).join(edge.withColumnRenamed("id", "edge_id"), "edge_id").select(F.col("new").alias("edge_id"), "a", "b")
    nodes = network.nodes.join(node.withColumnRenamed("id", "node_id"), "node_id").select(F.col("new").alias("node_id"), "x", "y")
    return replace(network, nodes=nodes, edges=table), {"node": node, "edge": edge}


def isel(grid: Grid, **indexers: DataFrame | Iterable[int]) -> tuple[Grid, Index]:
    """Select by ids of node, edge or face; several facets must name the same part.

    Nodes and edges select the faces (of a network, the edges) that touch them; if those have other nodes or
    edges than were asked for, no grid holds just these, and ``ValueError`` is raised.
    """
    if not indexers:
        raise ValueError("isel needs an indexer")
    wanted = {f: as_index(grid, f, ids) for f, ids in indexers.items()}
    core = "face" if isinstance(grid, Mesh) else "edge"
    chosen = []
    for facet, ids in wanted.items():
        if facet == core:
            chosen.append(ids)
        elif facet == "node":
            link = grid.faces.select(F.col("face_id").alias("id"), F.explode("nodes").alias("of")) if core == "face" else grid.edges.select(F.col("edge_id").alias("id"), F.explode(F.array("a", "b")).alias("of"))
            chosen.append(link.join(ids.withColumnRenamed("id", "of"), "of", "left_semi").select("id").distinct())
        else:
            from gridloom.operators.connectivity import face_edges

            link = face_edges(grid).select(F.col("face_id").alias("id"), F.col("edge_id").alias("of"))
            chosen.append(link.join(ids.withColumnRenamed("id", "of"), "of", "left_semi").select("id").distinct())
    first = cut(chosen[0])
    if any(differ(first, other) for other in chosen[1:]):
        raise ValueError("the indexers name different parts of the grid")
    new, index = (subset if core == "face" else subset_network)(grid, first.withColumnRenamed("id", f"{core}_id"))
    for facet, ids in wanted.items():
        if facet != core and differ(index[facet].select("id"), ids):
            raise ValueError(f"no grid holds just these {facet}s: the indexer is invalid")
    return new, index


def differ(one: DataFrame, two: DataFrame) -> bool:
    """Whether two tables of the same columns hold different rows."""
    two = two.select(*one.columns)
    return bool(one.exceptAll(two).limit(1).count() or two.exceptAll(one).limit(1).count())


def equals(one: Grid, two: Grid) -> bool:
    """Whether two grids have the same kind, name, projection and tables."""
    if type(one) is not type(two) or (one.name, one.crs, one.projected) != (two.name, two.crs, two.projected):
        return False
    tables = [(one.nodes, two.nodes)] + ([(one.faces, two.faces)] if isinstance(one, Mesh) else []) + [(one.edges, two.edges)]
    return not any(differ(a.select(*sorted(a.columns)), b) for a, b in tables)


def unique_grids(grids: list[Grid]) -> list[Grid]:
    """Grids without those that equal an earlier one."""
    out: list[Grid] = []
    for g in grids:
        if not any(g is o or equals(g, o) for o in out):
            out.append(g)
    return out


def node_bounds(grid: Grid) -> tuple[float, float, float, float]:
    """``xmin, ymin, xmax, ymax`` on the driver."""
    return tuple(grid.nodes.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first())


def box(grid: Grid, x: tuple[float | None, float | None], y: tuple[float | None, float | None]) -> DataFrame:
    """Ids of faces (of a network, edges) whose centroid (midpoint) lies in the half-open box.

    Open ends of a mesh's box take the bounds of its nodes; a network's box must have all its ends.
    """
    if isinstance(grid, Network):
        if None in (*x, *y):
            raise ValueError("the slices of a network must have a start and a stop")
        ends, core = (x[0], y[0], x[1], y[1]), edge_geometry(grid.edges, grid.nodes).select("edge_id", F.col("x").alias("cx"), F.col("y").alias("cy"))
    else:
        known = node_bounds(grid) if None in (*x, *y) else (None,) * 4
        ends, core = tuple(a if a is not None else b for a, b in zip((x[0], y[0], x[1], y[1]), known)), with_geometry(grid)
    x0, y0, x1, y1 = ends
    return core.where((F.col("cx") >= x0) & (F.col("cx") < x1) & (F.col("cy") >= y0) & (F.col("cy") < y1)).select("edge_id" if isinstance(grid, Network) else "face_id")


def clip_box(grid: Grid, xmin: float, ymin: float, xmax: float, ymax: float) -> tuple[Grid, Index | None]:
    """The part of the grid in a box; a mesh within the box comes back as it is, without an index."""
    if isinstance(grid, Mesh):
        a, b, c, d = node_bounds(grid)
        if xmin <= a and ymin <= b and xmax >= c and ymax >= d:
            return grid, None
        return subset(grid, box(grid, (xmin, xmax), (ymin, ymax)))
    return subset_network(grid, box(grid, (xmin, xmax), (ymin, ymax)))
