"""Filter audit and importance resampling against plain versions, and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from gridloom.llm import importance, interactions
from tests.llm.test_operators import ODD, docs_of, prose


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def brute_audit(rows, labels):
    """``rows``: (doc_id, text, lang)."""
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, t in labels if t == 1} - {None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, t, lang in rows:
        t = t or ""
        w = words_of(t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        fails.append((lang or "", i, f))
    out = {}
    total = Counter()
    for part in {p for p, _, _ in fails}:
        for order in map("".join, permutations("ABCDE")):
            left = [(i, f) for p, i, f in fails if p == part]
            everyone = left
            for step, c in enumerate(order, 1):
                gone = [i for i, f in left if f[c]]
                left = [(i, f) for i, f in left if not f[c]]
                failing = sum(f[c] for _, f in everyone)
                alone = sum(f[c] and sum(f.values()) == 1 for _, f in everyone)
                out[part, order, step] = (len(left), len(gone), failing - len(gone), alone, sum(i in good for i in gone), sum(i in toxic for i in gone))
                total[part, c] += len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows():
    rng = random.Random(8)
    rows = []
    for i in range(60):
        t = prose(rng, rng.choice([20, 250, 400]))
        if rng.random() < 0.4:
            t += rng.choice([" # tag", " SHOUTED " * 20, " again" * 500])
        rows.append((i, t, rng.choice(["en", "de", None])))
    rows += [(100 + i, rows[7][1], "en") for i in range(5)] + [(3, rows[7][1], "")]
    return rows + [(i, t, "en") for i, t in ODD]


def test_audit_equals_brute_force(spark):
    rows = audit_rows()
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 80)] + [(9, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in ("part", "A", "good", "digest", "n")})
    got = interactions.audit_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got.collect()} == brute_audit(rows, labels)


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.audit_documents(docs, labels).count() == 0
    one = interactions.audit_documents(spark.createDataFrame([(1, None, None)], docs.schema), labels).collect()
    assert len(one) == 600 and {(r.part, r.good_lost, r.toxic_lost) for r in one} == {("", 0, 0)}


def test_shapley_values_share_all_removed(spark):
    rows = interactions.failures(spark.createDataFrame(audit_rows(), "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    n = F.col("n")
    joint = interactions.joint_failures(rows, list("AD"), "part", {"n": n, "good": n, "toxic": n})
    got = interactions.audit(joint, list("AD"), "part").collect()
    for part in {r.part for r in got}:
        mine = [r for r in got if r.part == part and r.filter_order == "AD"]
        assert sum(r.shapley for r in mine) == 2 * sum(r.removed for r in mine)


def features(text, n):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute_resample(docs, target, n, percent=10, least=20, buckets=importance.BUCKETS):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    found = [(i, *features(t, n)) for i, t in docs]
    s = Counter(bucket(f) for _, _, fs in found for f in fs)
    t = Counter(bucket(f) for x in target for f in features(x, n)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    rows = []
    for i, w, fs in found:
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), w))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k for k, r in enumerate(fit[: len(fit) * percent // 100], 1)}
    return sorted(((*r[:4], ranks.get(id(r))) for r in rows), key=str)


@pytest.mark.parametrize("n, percent", [(1, 10), (3, 40)])
def test_resample_equals_brute_force(spark, monkeypatch, n, percent):
    monkeypatch.setattr(importance, "CHUNK_BYTES", 300)
    monkeypatch.setattr(importance.chunks, "__defaults__", (300,))
    rng = random.Random(4)
    docs = [(i, prose(rng, rng.randrange(5, 200)) + rng.choice(["", " Ünï wörds", "--x y\tz9"])) for i in range(80)] + ODD
    docs += [(200, docs[3][1] * 5), (201, "é" * 2000 + " tail of a very long word"), (202, "a" * 299 + " b c")]
    target = [prose(rng, 60) for _ in range(5)] + [None, ""]
    got = importance.resample(docs_of(spark, docs), spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string"), n=n, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_resample(docs, target, n, percent)


def test_repeated_long_rows_have_sums_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(importance, "CHUNK_BYTES", 300)
    monkeypatch.setattr(importance.chunks, "__defaults__", (300,))
    text = prose(random.Random(1), 300)
    docs = [(1, text), (1, text), (2, text), (None, text), (None, text)]
    got = importance.resample(docs_of(spark, docs), spark.createDataFrame([("en",)], "text string"), percent=60).collect()
    assert len(got) == 5 and {r.n_features for r in got} == {300} and len({r.weight for r in got}) == 1
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == [1, 2, 3]


def test_resample_of_nothing(spark):
    none = docs_of(spark, ODD).limit(0)
    texts = spark.createDataFrame([], "text string")
    assert importance.resample(none, texts).count() == 0
    assert importance.resample(docs_of(spark, ODD), texts).where("rank is null").count() == len(ODD)


@pytest.mark.parametrize("n", [1, 2, 4])
def test_chunks_own_every_feature_once(n):
    rng = random.Random(n)
    text = (prose(rng, 400) + "  ...  " + "w" * 500 + " " + prose(rng, 5)).encode()
    find = importance.Buckets(n, 1 << 30)
    whole = Counter(find(text, len(text))[0].tolist())
    for most in (1, 7, 64, 300):
        parts = list(importance.chunks(text, n, most))
        assert sum((Counter(find(c, o)[0].tolist()) for c, o in parts), Counter()) == whole
        assert sum(find(c, o)[1] for c, o in parts) == 406
