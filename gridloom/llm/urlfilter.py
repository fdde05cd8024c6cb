"""URL filter: explicit rules, and a path-template tree judged by smoothed labelled purity.

Distinct paths are counted by host, runs of digits and long hexadecimal runs
generalised to classes; the tree of each host is built on these counts, a branching
level at a time (what all paths of a node have in common is skipped at once).  A
child with a small share of its node's URLs is rare; where a node has many rare
children they become one wildcard, while its frequent ones keep their names.
Sibling branches are merged if they do not differ: labelled ones by their shares of
blocked URLs and by what follows them, and unlabelled ones are added to the labelled
branch that they are most like in what follows.  So a URL that no rule fits is
judged by the template that it shares with labelled ones.

A template's purity is the blocked share of its URLs, drawn towards its parent's
purity as by ``strength`` further URLs; a URL without a label counts as ``unknown``
of an allowed one, so that a few blocked URLs do not reject the many others of a
template.  Templates with a purity of at least ``threshold`` are rejected.  Labels
are the verdicts of the explicit rules, or given in a column.

Everything is DataFrame functions.  A node has a bounded number of named children
and of names that follow them, so nothing is gathered that grows with a host.

A null url, or one without ``://``, has an empty host and path.  Each row of
``pages`` gives one row, repeated ones too; an empty table gives an empty result;
very long urls are parsed whole, to their last segment.  Other columns of ``pages``,
whatever their names, are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.joins import lookup
from gridloom.session import compact, cut

#: Fixed values of the contract: (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NODE = ["host", "template"]
END, REST = "", "*"
SUMS = ("n", "bad", "good")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and raw path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct ``(size, rule, verdict)`` of the longest rule that fits, else null."""
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def shape(path: Column) -> Column:
    """The path with classes for hexadecimal runs and digits, without empty segments."""
    classed = F.regexp_replace(F.regexp_replace(path, r"[0-9a-fA-F]{16,}", "{hex}"), r"[0-9]+", "{n}")
    return F.array_join(F.filter(F.split(classed, "/"), lambda s: s != ""), "/")


def _summed(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(*(F.sum(c).alias(c) for c in SUMS))


def _purity(unknown: float, strength: float, parent: Column) -> Column:
    """Blocked share of the rows of a group, drawn towards ``parent``."""
    bad, good = F.sum("bad"), F.sum("good")
    return (bad + strength * parent) / (bad + good + unknown * (F.sum("n") - bad - good) + strength)


def _distance(a: Column, na: Column, b: Column, nb: Column) -> tuple[Column, Column]:
    """Total variation distance of two histograms, and how much of it chance alone may give."""
    of = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0)).cast("double")
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    apart = F.aggregate(keys, F.lit(0.0), lambda acc, k: acc + F.abs(of(a, k) / na - of(b, k) / nb)) / 2

    def spread(acc: Column, k: Column) -> Column:
        share = (of(a, k) + of(b, k)) / (na + nb)
        return acc + F.sqrt(F.greatest(F.lit(0.0), share * (1 - share) * (1 / na + 1 / nb)))

    return apart, F.aggregate(keys, F.lit(0.0), spread) / 2


def _merged(branch: DataFrame, tolerance: float, z: float, least: int) -> DataFrame:
    """``(host, template, name, label)`` of branches that are merged; ``branch`` has sums and ``follow``, a histogram."""
    size = lambda c: F.col(c).cast("double")
    inner = branch.where(F.col("name") != END)
    known = inner.where("bad + good > 0").withColumn("share", (F.col("bad") + 0.5) / (F.col("bad") + F.col("good") + 1))
    known = known.withColumn("error", F.sqrt(F.col("share") * (1 - F.col("share")) / (F.col("bad") + F.col("good") + 1)))
    siblings = Window.partitionBy(*NODE).orderBy("share", "name")  # a bounded number of children
    known = known.withColumns({f"p_{c}": F.lag(c).over(siblings) for c in ("share", "error", "follow", "n")})
    far, chance = _distance(F.col("follow"), size("n"), F.col("p_follow"), size("p_n"))
    unlike = (F.col("share") - F.col("p_share") > tolerance + z * F.sqrt(F.col("error") ** 2 + F.col("p_error") ** 2)) | (far > tolerance + z * chance)
    known = known.withColumn("apart", F.when(F.col("p_share").isNull(), 0).when(unlike, 1).otherwise(0))
    known = known.withColumn("group", F.sum("apart").over(siblings)).select(*NODE, "name", "group", "n", "follow")
    bins = known.select(*NODE, "group", F.explode("follow").alias("bin", "m")).groupBy(*NODE, "group", "bin").agg(F.sum("m").alias("m"))
    pooled = bins.groupBy(*NODE, "group").agg(F.map_from_entries(F.collect_list(F.struct("bin", "m"))).alias("g_follow"), F.sum("m").alias("g_n"))
    free = inner.where(f"bad + good = 0 and n >= {least}").join(pooled, NODE)  # a bounded number of groups a node
    far, chance = _distance(F.col("follow"), size("n"), F.col("g_follow"), size("g_n"))
    near = free.withColumns({"far": far, "chance": chance}).where(F.col("far") <= tolerance + z * F.col("chance"))
    near = near.groupBy(*NODE, "name").agg(F.min(F.struct("far", "group")).alias("to")).select(*NODE, "name", F.col("to.group").alias("group"))
    member = known.select(*NODE, "name", "group").unionByName(near)
    groups = member.groupBy(*NODE, "group").agg(F.sort_array(F.collect_set("name")).alias("members")).where("size(members) > 1")
    label = F.concat(F.lit("{"), F.array_join("members", "|"), F.lit("}"))
    return groups.select(*NODE, F.explode("members").alias("name"), label.alias("label"))


def templates(counted: DataFrame, few: int = 16, tolerance: float = 0.05, z: float = 1.96, least: int = 8, strength: float = 2.0, unknown: float = 0.1) -> DataFrame:
    """``(host, shape, n, template, purity)`` of distinct ``(host, shape)`` with sums ``n, bad, good``.

    A child is rare with less than 1 / ``few`` of its node's URLs; more than ``few`` rare children become
    one wildcard.  Branches are alike if shares differ by no more than ``tolerance`` and ``z`` standard
    errors; an unlabelled branch is merged only with at least ``least`` URLs.
    """
    step = lambda a, k: F.slice(a, k + 1, F.greatest(F.size(a) - k, F.lit(0)))
    rest = F.concat(F.filter(F.split("shape", "/"), lambda s: s != ""), F.array(F.lit(END)))
    root = counted.groupBy("host").agg(_purity(unknown, strength, F.lit(0.5)).alias("purity"), F.count("*").alias("rows"))
    paths = lookup(counted, cut(root), ["host"], size="rows").drop("rows").withColumns({"rest": rest, "template": F.lit("")})
    paths, done = cut(paths), []
    while paths.limit(1).count():
        # skip what all paths of a node have in common, to its end if there is one path
        ends = paths.groupBy(*NODE).agg(F.min("rest").alias("first"), F.max("rest").alias("last"), F.count("*").alias("rows"), F.sum("n").alias("visits"), F.max("purity").alias("purity"))
        differs = F.array_position(F.zip_with("first", "last", lambda a, b: a.eqNullSafe(b)), False)
        ends = ends.withColumn("common", F.when(differs > 0, differs - 1).otherwise(F.size("first")).cast("int"))
        along = F.array_join(F.transform(F.filter(F.slice("first", 1, F.col("common")), lambda s: s != END), lambda s: F.concat(F.lit("/"), s)), "")
        ends, _ = compact(ends.withColumns({"to": F.concat("template", along), "over": F.col("common") == F.size("first")}).drop("first", "last"))
        paths = lookup(paths, ends.drop("visits", "purity", "over"), NODE, size="rows")
        paths = cut(paths.select("host", "shape", *SUMS, "purity", F.col("to").alias("template"), step(F.col("rest"), F.col("common")).alias("rest")))
        nodes = ends.where("not over").select("host", F.col("to").alias("template"), "visits", "purity", "rows")
        done.append(paths.where(F.size("rest") == 0))
        paths = paths.where(F.size("rest") > 0)
        # children, and what follows them
        here = paths.select(*NODE, *SUMS, F.get("rest", F.lit(0)).alias("name"), F.coalesce(F.get("rest", F.lit(1)), F.lit(END)).alias("bin"))
        cell, _ = compact(_summed(here, *NODE, "name", "bin"))
        visits = nodes.select(*NODE, "visits")
        rare = (F.col("n") * few < F.col("visits")) & (F.col("name") != END)
        child = lookup(_summed(cell, *NODE, "name"), visits, NODE).withColumn("rare", rare)
        child = child.groupBy(*NODE).agg((F.sum(F.col("rare").cast("int")) > few).alias("wild"), F.collect_list(F.when(~F.col("rare"), F.col("name"))).alias("named"))  # at most few + 1
        often = lookup(_summed(cell, *NODE, "bin"), visits, NODE).where(F.col("n") * few >= F.col("visits"))
        often = often.groupBy(*NODE).agg(F.collect_list("bin").alias("bins"))  # at most few
        shown, _ = compact(child.join(often, NODE, "left"))
        name = lambda: F.when(F.col("wild") & ~F.array_contains("named", F.col("name")), REST).otherwise(F.col("name"))
        known_bin = F.when(F.array_contains("bins", F.col("bin")), F.col("bin")).otherwise(REST)
        follow = _summed(lookup(cell, shown, NODE).select(*NODE, name().alias("name"), known_bin.alias("bin"), *SUMS), *NODE, "name", "bin")
        branch = follow.groupBy(*NODE, "name").agg(*(F.sum(c).alias(c) for c in SUMS), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("follow"))
        branch, _ = compact(branch)  # at most 2 * few + 2 a node
        labels = lookup(branch.drop("follow"), cut(_merged(branch, tolerance, z, least)), [*NODE, "name"]).withColumn("label", F.coalesce("label", "name"))
        pure = lookup(labels, nodes.select(*NODE, F.col("purity").alias("parent")), NODE).groupBy(*NODE, "label").agg(_purity(unknown, strength, F.max("parent")).alias("purity"), F.collect_list("name").alias("names"))
        entries = F.flatten(F.collect_list(F.transform("names", lambda v: F.struct(v.alias("name"), F.struct("label", "purity").alias("move")))))
        moves = pure.groupBy(*NODE).agg(F.map_from_entries(entries).alias("to"))
        moves, _ = compact(lookup(lookup(moves, shown.drop("bins"), NODE), nodes.select(*NODE, "rows"), NODE))
        paths = lookup(paths.drop("purity").withColumn("name", F.get("rest", F.lit(0))), moves, NODE, size="rows").withColumn("move", F.try_element_at("to", name()))
        into = F.when(F.col("move.label") == END, F.col("template")).otherwise(F.concat("template", F.lit("/"), "move.label"))
        paths = cut(paths.select("host", "shape", *SUMS, F.col("move.purity").alias("purity"), step(F.col("rest"), F.lit(1)).alias("rest"), into.alias("template")))
        done.append(paths.where(F.size("rest") == 0))
        paths = paths.where(F.size("rest") > 0)
    if not done:
        return counted.select("host", "shape", "n", F.lit("").alias("template"), F.lit(0.5).alias("purity"))
    return reduce(DataFrame.unionByName, [d.select("host", "shape", "n", "template", "purity") for d in done])


def filter_urls(pages: DataFrame, rules=RULES, threshold: float = 0.8, label: str | None = None, **options) -> DataFrame:
    """``(page_id, host, path, rule, verdict, template, purity)`` for every row.

    ``label`` names a column of ``pages`` that is true for URLs known as bad and false for good ones (null
    if unknown), which teaches the tree beside the rules' verdicts.
    """
    host, path = host_and_path(F.col("url"))
    known = F.col(label).cast("boolean") if label else F.lit(None).cast("boolean")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), known.alias("known"))
    rows = rows.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "fit.rule", F.col("fit.verdict").alias("ruled"), "known", shape(F.col("path")).alias("shape"))
    bad = F.coalesce(F.col("ruled") == "block", F.col("known"))
    counted = rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.count_if(~bad).alias("good"))
    tree = templates(cut(counted), **options)
    judged = lookup(rows, tree, ["host", "shape"], size="n")
    verdict = F.coalesce("ruled", F.when(F.col("purity") >= threshold, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
