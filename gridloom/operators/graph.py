"""Neighbourhood iteration, ordering and filling on adjacency tables ``(src, dst)``."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import condense, multigrid
from gridloom.operators.components import connected_components
from gridloom.operators.mesh import Network, dense_ids
from gridloom.session import Round, cut


def binary_iterate(adjacency: DataFrame, data: DataFrame, value: bool, iterations: int = 1, mask: DataFrame | None = None, exterior: DataFrame | None = None, border_value: bool = False) -> DataFrame:
    """``(id, value)`` after spreading ``value`` to neighbours.

    ``mask(id)``: ids forced to the opposite of ``value`` after each step.  ``exterior(id)`` is set to
    ``value`` in the first step only, if ``border_value`` equals ``value``.
    """
    state = data.select("id", F.col("value").cast("boolean").alias("value"))
    masked = None if mask is None else mask.select("id", F.lit(True).alias("masked")).distinct()
    for step in range(iterations):
        reached = adjacency.join(state.where(F.col("value") == value), F.col("src") == F.col("id")).select(F.col("dst").alias("id"))
        if step == 0 and exterior is not None and border_value == value:
            reached = reached.unionAll(exterior.select("id"))
        reached = reached.distinct().withColumn("hit", F.lit(True))
        new = F.when(F.col("hit"), F.lit(value)).otherwise(F.col("value"))
        state = state.join(reached, "id", "left").select("id", new.alias("value"))
        if masked is not None:
            state = state.join(masked, "id", "left").select("id", F.when(F.col("masked"), F.lit(not value)).otherwise(F.col("value")).alias("value"))
        if step % 4 == 3:
            state = cut(state)
    return state


def binary_dilation(adjacency: DataFrame, data: DataFrame, **options) -> DataFrame:
    return binary_iterate(adjacency, data, True, **options)


def binary_erosion(adjacency: DataFrame, data: DataFrame, border_value: bool = False, **options) -> DataFrame:
    return binary_iterate(adjacency, data, False, border_value=border_value, **options)


def component_labels(ids: DataFrame, adjacency: DataFrame) -> DataFrame:
    """``(id, label)``: components numbered from 0 by their lowest id; ids without neighbours stand alone."""
    found = connected_components(adjacency)
    lowest = ids.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("lowest"))
    lowest = cut(lowest)
    return lowest.join(dense_ids(lowest, ["lowest"], "label"), "lowest").select("id", "label")


def topological_levels(edges: DataFrame) -> DataFrame:
    """``(id, level)`` of a directed graph ``(a, b)``: the longest path from a source; a cycle raises ``ValueError``."""
    pairs = cut(edges.select("a", "b").distinct())
    left = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    done, level = None, 0
    while True:
        open_pairs = pairs if done is None else pairs.join(done.select(F.col("id").alias("a")), "a", "left_anti")
        ready = cut(left.join(open_pairs.select(F.col("b").alias("id")), "id", "left_anti").withColumn("level", F.lit(level)))
        if not ready.limit(1).count():
            if left.limit(1).count():
                raise ValueError("the graph has a cycle")
            return done if done is not None else left.withColumn("level", F.lit(0))
        done = ready if done is None else cut(done.unionAll(ready))
        left = cut(left.join(ready, "id", "left_anti"))
        level += 1


def topological_order(edges: DataFrame) -> DataFrame:
    """``(id, rank)``: an order in which every edge goes forward, by level and then id."""
    return dense_ids(topological_levels(edges), ["level", "id"], "rank").select("id", "rank")


def is_cyclic(edges: DataFrame) -> bool:
    try:
        topological_levels(edges)
    except ValueError:
        return True
    return False


def remove_self_loops(network: Network) -> Network:
    """Drop edges from a node to itself; used nodes and kept edges are renumbered."""
    kept = network.edges.where("a <> b")
    node_ids = dense_ids(kept.select(F.explode(F.array("a", "b")).alias("node_id")), ["node_id"], "new")
    edge_ids = dense_ids(kept, ["edge_id"], "new_edge")
    one, two = (node_ids.select(F.col("node_id").alias(k), F.col("new").alias(f"new_{k}")) for k in "ab")
    edges = kept.join(one, "a").join(two, "b").join(edge_ids, "edge_id").select(F.col("new_edge").alias("edge_id"), F.col("new_a").alias("a"), F.col("new_b").alias("b"))
    return Network(network.nodes.join(node_ids, "node_id").select(F.col("new").alias("node_id"), "x", "y"), edges)


def contract_vertices(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Distinct ``(a, b)``: kept nodes joined if a directed path through removed nodes alone leads from a to b."""
    kept = keep.select(F.col("id").alias("k")).distinct()
    walks, known = Round(edges.sparkSession), Round(edges.sparkSession)
    walk = walks.put(edges.join(kept, edges.a == kept.k, "left_semi").select("a", F.col("b").alias("at")).distinct())
    seen, found = known.put(walk), None
    while walk.limit(1).count():
        ends = cut(walk.join(kept, walk["at"] == kept.k, "left_semi").select("a", F.col("at").alias("b")))
        found = ends if found is None else found.unionAll(ends)
        inner = walk.join(kept, walk["at"] == kept.k, "left_anti")
        step = inner.join(edges.select(F.col("a").alias("at"), "b"), "at").select("a", F.col("b").alias("at")).distinct()
        walk = walks.put(step.join(seen, ["a", "at"], "left_anti"))
        seen = known.put(seen.unionAll(walk))
    out = found if found is not None else edges.select("a", "b").limit(0)
    return out.where("a <> b").distinct()


def reverse_cuthill_mckee(ids: DataFrame, adjacency: DataFrame) -> DataFrame:
    """``(id, rank)``: an order in which neighbours stand near each other.

    Each component is walked in levels from its node of least degree; a level's nodes are ordered by the first
    of their neighbours before them, then by degree and id; the whole order is reversed.  A job chain a level.
    """
    spark = ids.sparkSession
    pairs = cut(adjacency.select("src", "dst").distinct())
    degree = pairs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    labels = component_labels(ids, pairs)
    todo = cut(ids.join(degree, "id", "left").join(labels, "id").select("id", "label", F.coalesce("degree", F.lit(0)).alias("degree")))
    start = todo.groupBy("label").agg(F.min(F.struct("degree", "id")).alias("m")).select("m.id")
    fronts, walked = Round(spark), Round(spark)
    front, done = fronts.put(start.select("id", F.lit(0).alias("level"), F.lit(0).cast("long").alias("before"))), None
    while True:
        found = front.join(todo, "id").select("label", "level", "before", "degree", "id")
        placed = cut(found.join(dense_ids(found, ["label", "level", "before", "degree", "id"], "place"), ["label", "level", "before", "degree", "id"]))
        done = walked.put(placed if done is None else done.unionByName(placed))
        near = pairs.join(placed.select(F.col("id").alias("src"), "level", "place"), "src").groupBy(F.col("dst").alias("id")).agg((F.max("level") + 1).alias("level"), F.min("place").alias("before"))
        front = fronts.put(near.join(done.select("id"), "id", "left_anti"))
        if not front.limit(1).count():
            break
    order = dense_ids(done, ["label", "level", "place"], "at").join(done, ["label", "level", "place"])
    last = order.agg(F.max("at").alias("last"))
    return order.crossJoin(F.broadcast(last)).select("id", (F.col("last") - F.col("at")).alias("rank"))  # joined with one row


def fill_nearest(points: DataFrame, data: DataFrame, max_distance: float | None = None, dims: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *dims, value)``: nulls take the value at the nearest place ``points(id, x, y)`` that has one.

    Places farther than or at ``max_distance`` stay null; for each of the other dimensions on its own.  Where
    the same places have values the search is made once.  Data without any value raise ``ValueError``.
    """
    from gridloom.operators.select import nearest

    data = cut(data.select("id", *dims, F.nanvl("value", F.lit(None).cast("double")).alias("value")))
    points = cut(points.select("id", "x", "y"))
    known = data.where("value is not null")
    if not known.limit(1).count():
        raise ValueError("all values are null")
    if not dims:
        return _filled(points, data, data, max_distance, nearest)
    sets = known.groupBy(*dims).agg(F.sum(F.xxhash64("id").cast("decimal(38,0)")).cast("string").alias("h"), F.count("*").alias("n"))
    sets = cut(sets.select(*dims, F.concat_ws(":", "h", "n").alias("places")))
    out = data.join(sets.select(*dims), list(dims), "left_anti").select("id", *dims, "value")  # without any value
    for r in sets.groupBy("places").agg(F.min(F.struct(*dims)).alias("first")).collect():  # a search for each set of places
        own = data.join(F.broadcast(sets.where(F.col("places") == r.places).select(*dims)), list(dims), "left_semi")
        one = own
        for d in dims:
            one = one.where(F.col(d).eqNullSafe(F.lit(r.first[d])))
        out = out.unionByName(_filled(points, one, own, max_distance, nearest, dims))
    return out


def _filled(points: DataFrame, one: DataFrame, own: DataFrame, max_distance: float | None, nearest, dims: tuple[str, ...] = ()) -> DataFrame:
    """``own`` filled from the places that ``one`` has values for; rows that have a value are not joined."""
    if not one.where("value is null").limit(1).count():
        return own.select("id", *dims, "value")
    holes = points.join(one.where("value is null").select("id"), "id", "left_semi").withColumnRenamed("id", "point_id")
    known = points.join(one.where("value is not null").select("id"), "id", "left_semi")
    near = nearest(holes, known, max_distance=max_distance).select(F.col("point_id").alias("id"), F.col("id").alias("origin"))
    source = own.where("value is not null").select(*dims, F.col("id").alias("origin"), F.col("value").alias("near"))
    filled = own.where("value is null").select("id", *dims).join(near, "id", "left").join(source, [*dims, "origin"], "left")
    return own.where("value is not null").select("id", *dims, "value").unionByName(filled.select("id", *dims, F.col("near").alias("value")))


def refine_by_vertices(network: Network, vertices: DataFrame, tolerance: float = 1e-9) -> Network:
    """Insert ``vertices(vertex_id, x, y)`` into the edges they lie on; one that lies on none raises when run.

    New nodes are numbered after the old ones by vertex id; vertices at existing nodes add nothing; new
    edges are numbered by old edge and place along it.
    """
    old = network.nodes
    new = vertices.join(old.select("x", "y"), ["x", "y"], "left_anti")
    one, two = (old.select(F.col("node_id").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y")) for k in "ab")
    segment = network.edges.join(one, "a").join(two, "b")
    from gridloom.operators.bins import as_boxes, box_join

    boxes = segment.withColumns({"xmin": F.least("ax", "bx"), "xmax": F.greatest("ax", "bx"), "ymin": F.least("ay", "by"), "ymax": F.greatest("ay", "by")})
    pairs = box_join(as_boxes(new), boxes)
    dx, dy = F.col("r_bx") - F.col("r_ax"), F.col("r_by") - F.col("r_ay")
    px, py = F.col("l_x") - F.col("r_ax"), F.col("l_y") - F.col("r_ay")
    length = F.sqrt(dx * dx + dy * dy)
    on = pairs.where(F.abs(dx * py - dy * px) <= tolerance * length).select("l_vertex_id", F.col("l_x").alias("x"), F.col("l_y").alias("y"), F.col("r_edge_id").alias("edge_id"), F.sqrt(px * px + py * py).alias("t"))
    on = on.groupBy(F.col("l_vertex_id").alias("vertex_id")).agg(F.min(F.struct("edge_id", "t", "x", "y")).alias("m")).select("vertex_id", "m.*")
    placed = new.select("vertex_id", "x", "y").join(on.drop("x", "y"), "vertex_id", "left")
    placed = placed.withColumn("edge_id", F.when(F.col("edge_id").isNull(), F.raise_error(F.concat(F.lit("vertex on no edge: "), F.col("vertex_id").cast("string"))).cast("long")).otherwise(F.col("edge_id")))
    count = old.agg((F.max("node_id") + 1).alias("n"))
    ids = placed.join(dense_ids(placed, ["vertex_id"], "rank"), "vertex_id").crossJoin(F.broadcast(count)).select((F.col("rank") + F.col("n")).alias("node_id"), "x", "y", "edge_id", "t")  # joined with one row
    stops = segment.select("edge_id", F.inline(F.array(F.struct(F.lit(-1.0).alias("t"), F.col("a").alias("node_id")), F.struct(F.lit(float("inf")).alias("t"), F.col("b").alias("node_id")))))
    stops = stops.unionByName(ids.select("edge_id", "t", "node_id"))
    along = Window.partitionBy("edge_id").orderBy("t")
    parts = stops.withColumn("b", F.lead("node_id").over(along)).where("b is not null").select("edge_id", "t", F.col("node_id").alias("a"), "b")
    edge_ids = dense_ids(parts, ["edge_id", "t"], "new")
    return Network(old.unionByName(ids.select("node_id", "x", "y")), parts.join(edge_ids, ["edge_id", "t"]).select(F.col("new").alias("edge_id"), "a", "b"))


def nearest_on_network(adjacency: DataFrame, data: DataFrame, max_distance: float | None = None) -> DataFrame:
    """``(id, value)``: nulls take the value of the node nearest along ``adjacency(src, dst, length)``, ties to the lowest id."""
    known = data.where("value is not null").select("id", F.lit(0.0).alias("d"), F.col("id").alias("origin"))
    fronts, bests = Round(data.sparkSession), Round(data.sparkSession)
    best, front = bests.put(known), known
    limit = max_distance if max_distance is not None else float("inf")
    while True:
        step = adjacency.join(front, adjacency.src == front.id).select(F.col("dst").alias("id"), (F.col("d") + F.col("length")).alias("d"), "origin").where(F.col("d") <= limit)
        step = step.groupBy("id").agg(F.min(F.struct("d", "origin")).alias("s")).select("id", "s.d", "s.origin")
        better = step.join(best.select("id", F.struct("d", "origin").alias("old")), "id", "left").where(F.col("old").isNull() | (F.struct("d", "origin") < F.col("old"))).select("id", "d", "origin")
        front = fronts.put(better)
        if not front.limit(1).count():
            break
        best = bests.put(best.join(front, "id", "left_anti").unionByName(front))
    source = data.select(F.col("id").alias("origin"), F.col("value").alias("near"))
    return data.join(best.select("id", "origin"), "id", "left").join(source, "origin", "left").select("id", F.coalesce("value", "near").alias("value"))


PLAIN = 200


def laplace_fill(adjacency: DataFrame, data: DataFrame, tolerance: float = 1e-8, max_iterations: int = 500, places: DataFrame | None = None) -> DataFrame:
    """``(id, value)``: nulls become the weighted mean of their neighbours (``weight`` of ``adjacency``, else 1).

    Solved by conjugate gradients on the unknowns with vectors as tables: scaled by the diagonal for few
    unknowns, else with multigrid, as plain rounds would grow with the mesh's width; with ``places(id, x, y)``
    many unknowns are eliminated block by block instead (see ``condense``).  A component without any
    value stays null; data without any value raises ``ValueError``.  If the residual is not below
    ``tolerance`` times the first one after ``max_iterations``, a warning is given.
    """
    if not data.where("value is not null").limit(1).count():
        raise ValueError("all values are null")
    pairs = adjacency.select("src", "dst", F.col("weight") if "weight" in adjacency.columns else F.lit(1.0).alias("weight")).where("src <> dst")
    data = cut(data.select("id", "value"))
    # the neighbours of the unknowns; known ones go into sums at once
    rows = pairs.join(data.where("value is null").select(F.col("id").alias("src")), "src", "left_semi")
    rows = cut(rows.join(data.select(F.col("id").alias("dst"), "value"), "dst"))
    sums = cut(rows.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("diag"), F.sum(F.col("weight") * F.col("value")).alias("b"), F.max(F.col("value").isNull()).alias("coupled")))
    single = sums.where("not coupled").select("id", (F.col("b") / F.col("diag")).alias("filled"))  # their mean is the solution
    fill = lambda found: data.join(single.unionByName(found), "id", "left").select("id", F.coalesce("value", "filled").alias("value"))
    inner = rows.where("value is null").select("src", "dst", "weight")
    coupled = sums.where("coupled").select("id")
    if places is not None and coupled.limit(PLAIN + 1).count() > PLAIN:
        matrix = inner.select(F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("weight")).alias("a"))
        matrix = matrix.unionAll(sums.where("coupled").select(F.col("id").alias("i"), F.col("id").alias("j"), F.col("diag").alias("a")))
        right = sums.where("coupled and b is not null").select(F.col("id").alias("i"), F.col("b").alias("v"))
        found, converged = condense.solve(matrix, right, places.join(coupled, "id", "left_semi").select(F.col("id").alias("i"), "x", "y"), tolerance, max_iterations)
        if not converged:
            warnings.warn(f"the fill has not converged after {max_iterations} iterations", stacklevel=2)
        return fill(found.select(F.col("i").alias("id"), F.col("v").alias("filled")))
    label = component_labels(coupled, inner.select("src", "dst"))
    label = label.join(sums.select("id", "b"), "id")
    alive = label.groupBy("label").agg(F.count("b").alias("n")).where("n > 0")
    unknown = cut(label.join(alive, "label", "left_semi").select("id"))
    if not unknown.limit(1).count():
        return fill(single.limit(0))
    diagonal, right = sums.select("id", "diag"), sums.where("b is not null").join(unknown, "id", "left_semi").select("id", "b")
    inner = cut(inner.join(unknown.select(F.col("id").alias("src")), "src", "left_semi"))
    if unknown.limit(PLAIN + 1).count() > PLAIN:
        matrix = inner.select(F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("weight")).alias("a")).groupBy("i", "j").agg(F.sum("a").alias("a"))
        matrix = cut(matrix.unionAll(diagonal.join(unknown, "id", "left_semi").select(F.col("id").alias("i"), F.col("id").alias("j"), F.col("diag").alias("a"))))
        found, _, converged = multigrid.solve(matrix, right.select(F.col("id").alias("i"), F.col("b").alias("v")), tolerance, max_iterations)
        if not converged:
            warnings.warn(f"the fill has not converged after {max_iterations} iterations", stacklevel=2)
        return fill(found.select(F.col("i").alias("id"), F.col("v").alias("filled")))
    scale = F.sqrt("diag")
    state = unknown.join(diagonal, "id").join(right, "id", "left").select("id", scale.alias("s"), F.lit(0.0).alias("u"), (F.coalesce("b", F.lit(0.0)) / scale).alias("r"))
    state = cut(state.withColumn("p", F.col("r")))
    rr = state.agg(F.sum(F.col("r") * F.col("r")).alias("v")).first().v
    goal = tolerance * tolerance * max(rr, 1e-300)
    carried = Round(data.sparkSession)
    for _ in range(max_iterations):
        if rr <= goal:
            break
        spread = inner.join(state.select(F.col("id").alias("dst"), (F.col("p") / F.col("s")).alias("q")), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("weight") * F.col("q")).alias("near"))
        moved = carried.put(state.join(spread, "id", "left").withColumn("ap", F.col("p") - F.coalesce("near", F.lit(0.0)) / F.col("s")).drop("near"))
        alpha = rr / moved.agg(F.sum(F.col("p") * F.col("ap")).alias("v")).first().v
        moved = moved.select("id", "s", (F.col("u") + alpha * F.col("p")).alias("u"), (F.col("r") - alpha * F.col("ap")).alias("r"), "p")
        new = moved.agg(F.sum(F.col("r") * F.col("r")).alias("v")).first().v
        state, rr = moved.withColumn("p", F.col("r") + (new / rr) * F.col("p")), new
    if rr > goal:
        warnings.warn(f"the fill has not converged after {max_iterations} iterations", stacklevel=2)
    return fill(state.select("id", (F.col("u") / F.col("s")).alias("filled")))
