"""Connected components of an undirected edge table.

Labels are the smallest id that can be reached.  Each round every node points to the neighbour (or itself)
that comes first in an order by hash, then to where that one points; nodes that point to one become one, and
edges within it vanish.  So what is left shrinks by a factor from round to round, whatever way ids run along
chains, and all rounds together move little more than the first.  Tables of rounds are in the folder the
cluster names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import compact, cut, remove, stored


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", few: int = 200_000) -> DataFrame:
    """Return ``(id, component)`` for every id that occurs in ``edges``.

    Self loops keep their id; repeated and reversed edges change nothing; rows
    with a null end are ignored; an empty table gives an empty result.  With at most ``few`` edges the
    tables of a round are broadcast; with more, joins are shuffled.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    rest, n = compact(pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    nodes = rest.select(F.col("u").alias("id"), F.col("u").alias("low")).distinct()  # the least id of what became one
    rounds, paths = [], []
    while n or not rounds:
        side = F.broadcast if n <= few else lambda df: df
        first = lambda c: F.struct(F.xxhash64(c, F.lit(len(rounds))).alias("hash"), F.col(c).alias("id"))
        near = rest.groupBy(F.col("u").alias("id")).agg(F.min(first("v")).alias("near"))
        point, path = stored(near.select("id", F.least(first("id"), F.col("near"))["id"].alias("to")))
        jump = point.select(F.col("id").alias("to"), F.col("to").alias("far"))
        into, other = stored(nodes.join(point.join(side(jump), "to").select("id", F.col("far").alias("to")), "id"))
        remove(edges.sparkSession, path)
        end = lambda c: into.select(F.col("id").alias(c), F.col("to").alias(f"{c}_to"))
        left = rest.join(side(end("u")), "u").join(side(end("v")), "v").where("u_to <> v_to")
        rest, n = compact(left.select(F.col("u_to").alias("u"), F.col("v_to").alias("v")).distinct())
        nodes = into.groupBy(F.col("to").alias("id")).agg(F.min("low").alias("low"))
        rounds.append((into.select("id", "to"), nodes))
        paths.append(other)
    labels = None
    for into, merged in reversed(rounds):
        ends = merged.select(F.col("id").alias("to"), F.col("low").alias("component"))
        if labels is not None:  # of those that went on to the next round
            later = labels.select(F.col("id").alias("to"), F.col("component").alias("later"))
            ends = ends.join(later, "to", "left").select("to", F.coalesce("later", "component").alias("component"))
        labels = cut(into.join(ends, "to").select("id", "component"))
    for path in paths:
        remove(edges.sparkSession, path)
    return labels
