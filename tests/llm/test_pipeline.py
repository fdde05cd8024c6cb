"""The pipeline's stages on the smallest tables, and on odd ones."""

import os

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import ODD, docs_of, prose

corpus_pipeline = pytest.importorskip("corpus_pipeline")
FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]
    packed = corpus_pipeline.run(spark, FOLDER)
    ids = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    assert ids < {r.doc_id for r in docs.select("doc_id").collect()} and len(ids) > 0.6 * docs.count()
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def odd_tables(spark, folder, texts, labels, items):
    docs_of(spark, texts).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").withColumn("text2", F.lit(1)).withColumn("doc_id", F.lit("x")).write.parquet(f"{folder}/benchmark.parquet")


def after_each_stage(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/out-{name}")
        docs = spark.read.parquet(f"{folder}/out-{name}")
        assert name == "packing" or docs.columns == columns
        out[name] = docs.collect()
    return out


def test_odd_rows(spark, tmp_path):
    import random

    rng = random.Random(41)
    item = prose(rng, 30)
    clean = [(100 + k, prose(rng, 60)) for k in range(12)]
    texts = ODD + clean + [(200, f"{prose(rng, 20)} {item} {prose(rng, 20)}"), (201, clean[0][1]), (100, "another text under a used id, mail a@b.org"), clean[3]]
    odd_tables(spark, str(tmp_path), texts, [], [(1, item), (None, "x"), (2, None), (3, "")])
    out = after_each_stage(spark, str(tmp_path))
    assert len(out["toxicity"]) == len(texts)  # no labels reject nothing
    kept = sorted((r.doc_id, r.text) for r in out["near_dedup"] if r.doc_id is not None and r.doc_id >= 100)
    assert kept == sorted([*clean, texts[-4], texts[-2]])
    assert 200 not in {r.doc_id for r in out["decontamination"]} and len(out["decontamination"]) == len(out["near_dedup"]) - 1
    assert {r.text for r in out["pii"] if r.doc_id == 100} == {clean[0][1], "another text under a used id, mail [EMAIL]"}
    assert sum(r.length > 0 for r in out["packing"]) == len(out["packing"]) >= len(out["pii"])
    assert sum(r.doc_id is None for r in out["pii"]) == 2 and {r.n_chars for r in out["pii"] if r.text is None} == {None}


def test_empty_tables(spark, tmp_path):
    odd_tables(spark, str(tmp_path), [], [], [])
    assert all(rows == [] for rows in after_each_stage(spark, str(tmp_path)).values())


def test_run_leaves_only_the_last_table(spark, tmp_path):
    odd_tables(spark, str(tmp_path), ODD[3:5] + [(9, "some words of a text")], [(9, 0, 0)], [(1, "nothing like it at all")])
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in packed.collect()) == [4, 9]
    (path,) = {os.path.dirname(f) for f in packed.inputFiles()}
    assert os.listdir(os.path.dirname(path.removeprefix("file:").replace("///", "/"))) == [os.path.basename(path)]
