"""The lookup join, and where shared tables go."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import joins
from gridloom.operators.joins import lookup, perhaps
from gridloom.session import remove, shared_dir, spread, stored


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_is_a_join_with_hot_keys_too(spark, how):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).cast("long").alias("k"), "id")
    table = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    want = sorted(map(tuple, rows.join(table, ["k"], how).collect()), key=repr)
    sized = table.join(rows.groupBy("k").agg(F.count("*").alias("n")), "k", "left").fillna(0)
    assert sorted(map(tuple, lookup(rows, table, ["k"], how).collect()), key=repr) == want
    assert sorted(map(tuple, lookup(rows, table, ["k"], how, few=0).collect()), key=repr) == want
    assert sorted(map(tuple, lookup(rows, sized, ["k"], how, size="n", few=0).drop("n").collect()), key=repr) == want


@pytest.mark.parametrize("few", [0, 1000])
def test_rows_whose_key_may_be_wanted_without_a_shuffle(spark, few):
    rows = spark.range(20_000).select((F.col("id") * 7 - 500).alias("k"), F.concat(F.lit("text "), "id").alias("t"))
    ids = spark.range(300).select((F.col("id") * 21).alias("k"), F.lit(1).alias("more"))
    found = perhaps(rows.unionAll(rows.limit(5)), ids, "k", few)
    assert found.columns == rows.columns
    want = rows.join(ids, "k", "left_semi")
    assert not want.exceptAll(found).count() and found.count() < want.count() + 50
    plan = perhaps(rows, ids, "k", few)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "hashpartitioning" not in plan


def test_near_duplicates_of_many_ids(spark, monkeypatch):
    """With no table small enough to be broadcast; ids that repeat, null ids and texts."""
    from gridloom.llm.minhash import near_duplicates

    text = lambda k, cut: " ".join(f"w{k}x{i}" for i in range(60) if i != cut)
    data = [(k * 3 + j, text(k, None if j == 0 else 2 * j - 2)) for k in range(30) for j in range(3)] + [(4, text(29, None)), (500, None), (None, text(1, None)), (501, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    want = sorted(map(tuple, near_duplicates(docs, 85).collect()), key=repr)
    monkeypatch.setattr(joins, "FEW", 0)
    monkeypatch.setattr(joins.lookup, "__defaults__", (*joins.lookup.__defaults__[:-1], 0))
    assert sorted(map(tuple, near_duplicates(docs, 85).collect()), key=repr) == want


def test_shared_folder(spark):
    table, path = stored(spark.range(10))
    assert path.startswith(shared_dir(spark)) and table.count() == 10
    remove(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path)


def test_a_cluster_needs_a_named_folder():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError):
        shared_dir(Session)
    Session.conf = {"spark.checkpoint.dir": "hdfs://x/y/"}
    assert shared_dir(Session) == "hdfs://x/y"
    Session.conf, Context.master = {}, "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        shared_dir(Session)


def test_components_shrink_from_round_to_round(spark, monkeypatch):
    from gridloom.operators import components

    left, plain = [], components.compact
    monkeypatch.setattr(components, "compact", lambda df: (left.append(plain(df)), left[-1])[1])
    chain = spark.range(3000).selectExpr("id as src", "id + 1 as dst").where("src % 1000 <> 999")
    got = {r.id: r.component for r in components.connected_components(chain, few=100).collect()}
    assert got == {k: k // 1000 * 1000 for k in range(3000)}
    sizes = [n for _, n in left]
    assert sizes[-1] == 0 and sum(sizes) < 2 * sizes[0]


def test_groups_over_as_many_tasks_as_rows_need(spark):
    rows = spark.range(1000).select((F.col("id") % 100).alias("id"), (F.col("id") % 7).alias("line"), "id")
    rows = rows.toDF("id", "line", "value")
    wide = spread(rows, "id", rows_per_task=50)
    assert wide.rdd.getNumPartitions() == 21 and spread(rows, "id") is rows
    groups = wide.groupBy("id", "line").agg(F.sum("value").alias("value")).groupBy("id").agg(F.count("*").alias("n"))
    assert groups._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1
    assert groups.count() == 100


def test_rows_of_parts_are_made_once(spark):
    from gridloom.operators.partition import _merged

    made = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame(spark.sparkContext.parallelize([(k // 4, k % 4, float(k % 5)) for k in range(8)], 2).map(lambda r: (made.add(1), r)[1]), "part int, node_id long, x double")
    found = {(r.part, r.node_id): (r.new, r.kept) for r in _merged(rows, ["x"], "node_id").collect()}
    assert made.value == 8
    assert found == {(k // 4, k % 4): (k % 5, k < 5) for k in range(8)}
