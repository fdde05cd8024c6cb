"""Filter interaction audit by inclusion-exclusion.

Each document carries one failure flag a filter.  One aggregation sums, for every
subset of the filters, the product of its flags (the joint failures of the subset),
plain and weighted with further 0/1 columns.  All other numbers are linear in these
``2**n`` sums: a Moebius inversion gives the survivors of every set of filters, their
differences what a filter removes at its place in an order, the alternating sum over
the sets that hold a filter what it alone catches, and the Harsanyi dividends
``(-1)**(|T|+1) * joint(T)`` of the game "documents removed", shared equally in ``T``,
the Shapley value.  So documents are read once, whatever the number of orders.

``failures`` treats null text as empty, reads very long texts whole, and calls a text a
copy if a row with a smaller ``doc_id`` holds the identical one; a null ``doc_id`` is
smaller or larger than none.  Rows that repeat a ``doc_id`` count each; a document whose
label rows disagree has a label if one of them says so.  A null ``lang`` is the part
``''``.  An empty table has no parts and gives no rows; without labels nothing is good
or toxic.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.joins import lookup
from gridloom.session import cut, remove, stored

SPACES = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, A, B, C, D, E, good, toxic)``, a row a document, all but ``part`` 0 or 1."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("t"))
    rows = rows.withColumn("w", F.filter(F.split("t", SPACES), lambda x: x != ""))
    rows = rows.select(
        "doc_id",
        "part",
        (F.size("w") < 200).alias("A"),
        (F.size(F.array_distinct("w")) * 100 < F.size("w") * 50).alias("B"),
        ((F.length("t") - F.length(F.translate("t", CAPITALS, ""))) * 100 > F.length("t") * 3).alias("C"),
        F.col("t").rlike(r"[#$%&*|]").alias("D"),
        F.sha2(F.col("t").cast("binary"), 256).alias("digest"),
    )
    rows, path = stored(rows)  # texts are read once
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = lookup(rows, cut(first), ["digest"], size="n").withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null")
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    marks = cut(marks.groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic")))
    flags = [F.col(c).cast("int").alias(c) for c in "ABCDE"]
    known = lookup(rows.where("doc_id is not null").select("doc_id", "part", *flags), marks, ["doc_id"])
    lost = rows.where("doc_id is null").select("part", *flags, F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    out = known.select("part", *"ABCDE", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    out, again = stored(out.unionAll(lost).groupBy("part", *"ABCDE", "good", "toxic").agg(F.count("*").alias("n")))
    remove(spark, path)
    return out


def joint_failures(rows: DataFrame, filters: list[str], part: str, weights: dict[str, Column]) -> DataFrame:
    """``(part, <weight>)``: for each weight an array of the ``2**n`` sums of flag products.

    Place ``s`` of an array is the sum over rows of the weight times the flags of the filters in the
    bit set ``s``; the flags are 0/1 columns.
    """
    n = len(filters)
    flag = lambda k, f: F.when(F.getbit("s", F.lit(k)) == 1, F.col(f)).otherwise(1)
    product = reduce(mul, [flag(k, f) for k, f in enumerate(filters)])
    rows = rows.select(part, *filters, *[w.alias(f"_{name}") for name, w in weights.items()], F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))).alias("s"))
    sums = rows.groupBy(part, "s").agg(*[F.sum(product * F.col(f"_{name}")).cast("long").alias(name) for name in weights])
    whole = sums.groupBy(part).agg(F.sort_array(F.collect_list(F.struct("s", *weights))).alias("j"))  # 2**n rows a part
    return whole.select(part, *[F.col(f"j.{name}").alias(name) for name in weights])


def _inverted(joint: str, n: int) -> Column:
    """Survivors of each set of filters: the alternating sum of the joint failures of its subsets."""
    signs = F.array(*[F.lit((-1) ** s.bit_count()).cast("long") for s in range(1 << n)])
    inside = lambda p, s: s.bitwiseAND(F.bitwise_not(p)) == 0
    sets = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    term = lambda p: lambda acc, s: acc + F.when(inside(p, s), F.get(signs, s) * F.get(joint, s)).otherwise(F.lit(0).cast("long"))
    return F.transform(sets, lambda p: F.aggregate(sets, F.lit(0).cast("long"), term(p)))


def _over_sets(joint: str, n: int, k: int, factor) -> Column:
    """Sum over the sets that hold filter ``k`` of ``factor(set) * joint failures``."""
    factors = F.array(*[F.lit(factor(s) if s >> k & 1 else 0).cast("long") for s in range(1 << n)])
    return F.aggregate(F.zip_with(factors, joint, lambda a, b: a * b), F.lit(0).cast("long"), lambda a, b: a + b)


def audit(joint: DataFrame, filters: list[str], part: str, orders: list[str] | None = None) -> DataFrame:
    """One row a part, order and step: what the step's filter does there.

    ``joint`` has the arrays ``n``, ``good`` and ``toxic`` of :func:`joint_failures`; ``filters`` are single
    letters; ``orders`` are strings of them, by default all permutations.
    """
    n, count = len(filters), factorial(len(filters))
    orders = orders or ["".join(p) for p in permutations(filters)]
    dividend = lambda s: (-1) ** (s.bit_count() + 1) * count // s.bit_count()
    single = lambda s: (-1) ** (s.bit_count() + 1)
    of_filter = [
        F.struct(
            F.lit(f).alias("name"),
            F.lit(1 << k).alias("bit"),
            F.get("n", F.lit(1 << k)).alias("fails"),
            _over_sets("n", n, k, single).alias("alone"),
            _over_sets("n", n, k, dividend).alias("shapley"),
        )
        for k, f in enumerate(filters)
    ]
    rows = joint.select(part, *[_inverted(c, n).alias(f"left_{c}") for c in ("n", "good", "toxic")], F.array(*of_filter).alias("of"))
    # the filters applied before each step, as bit sets
    sets = lambda o: F.array(*[F.lit(sum(1 << filters.index(f) for f in o[:k])) for k in range(len(o) + 1)])
    rows = rows.withColumn("o", F.explode(F.array(*[F.struct(F.lit(o).alias("filter_order"), sets(o).alias("sets")) for o in orders])))
    rows = rows.select(part, "left_n", "left_good", "left_toxic", "of", "o.*").withColumn("step", F.explode(F.sequence(F.lit(1), F.length("filter_order"))))
    rows = rows.withColumn("before", F.get("sets", F.col("step") - 1)).withColumn("after", F.get("sets", "step"))
    rows = rows.withColumn("f", F.element_at(F.filter("of", lambda f: f.bit == F.col("after") - F.col("before")), 1))
    gone = lambda c: F.get(f"left_{c}", "before") - F.get(f"left_{c}", "after")
    return rows.select(
        part,
        "filter_order",
        "step",
        F.get("left_n", "after").alias("kept"),
        gone("n").alias("removed"),
        (F.col("f.fails") - gone("n")).alias("redundant"),
        F.col("f.alone").alias("unique_fails"),
        gone("good").alias("good_lost"),
        gone("toxic").alias("toxic_lost"),
        F.col("f.shapley").alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters of :func:`failures`, by language."""
    rows = failures(docs, labels)
    n = F.col("n")
    joint = joint_failures(rows, list("ABCDE"), "part", {"n": n, "good": n * F.col("good"), "toxic": n * F.col("toxic")})
    return audit(cut(joint), list("ABCDE"), "part")
