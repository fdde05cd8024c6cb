"""Repeated passages against a plain version, the arrays of a shard, and odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import suffixes
from tests.llm.test_operators import ODD, docs_of, prose


def brute_repeats(texts, width):
    data = [(t or "").encode() for _, t in texts]
    count = Counter(d[p : p + width] for d in data for p in range(len(d) - width + 1))
    out = []
    for (i, _), d in zip(texts, data):
        gone = np.zeros(len(d) + 1, bool)
        for p in range(len(d) - width + 1):
            if count[d[p : p + width]] > 1:
                gone[p : p + width] = True
        gone = gone[:-1]
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(d) else 0
        out.append((i, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(spark, texts, width, **options):
    got = suffixes.repeats(docs_of(spark, texts), width, **options)
    assert got.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((tuple(r)[:5] for r in got.collect()), key=str)


def passages():
    rng = random.Random(13)
    shared = [prose(rng, 40) for _ in range(4)]
    texts = [(i, prose(rng, rng.randrange(5, 120))) for i in range(40)]
    for i in range(40, 80):  # passages at any offset, whole or in part, with letters of two bytes beside them
        p = rng.choice(shared)
        texts.append((i, prose(rng, rng.randrange(30)) + rng.choice(["", " é", "ñ"]) + p[rng.randrange(60) : len(p) - rng.randrange(60)] + prose(rng, rng.randrange(30))))
    texts += [(90 + i, texts[5][1]) for i in range(3)] + [(95, texts[6][1][:-1] + "#"), (96, "ab" * 300), (97, "z" * 400), (98, shared[0] + shared[1] + shared[0]), (99, texts[5][1] + shared[2])]
    texts += [(90, texts[5][1]), (None, shared[3] + "\0\0\0"), (None, "\0" * 90 + shared[3])]
    return texts


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 500, "together": 1, "piece": 1 << 18}, {"shard_bytes": 300, "together": 2, "piece": 100}])
def test_repeats_equal_brute_force(spark, options):
    texts = passages()
    assert found(spark, texts, 80, **options) == brute_repeats(texts, 80)


def test_repeats_of_odd_rows(spark):
    texts = [*ODD, (7, "x" * 900), (8, "y" * 399), (9, "y" * 399), (10, "é" * 200), (10, "é" * 200)]
    assert found(spark, texts, 400) == brute_repeats(texts, 400)
    assert found(spark, [(1, None), (2, "")], 400) == brute_repeats([(1, None), (2, "")], 400)
    assert suffixes.repeats(docs_of(spark, ODD).limit(0)).count() == 0


def test_removed_spans(spark):
    one, two = prose(random.Random(1), 30), prose(random.Random(2), 30)
    got = suffixes.removed_spans(docs_of(spark, [(1, one + two), (2, "- " + one), (3, "nothing")]), 50).collect()
    n = len(one.encode())
    assert sorted(tuple(r) for r in got) == [(1, 0, n), (2, 2, 2 + n)]


def sample(rng, letters, n):
    out = np.array([rng.choice(letters) for _ in range(n)] + [255], np.uint8)
    out[np.array([rng.randrange(n) for _ in range(3)])] = 255
    return out


@pytest.mark.parametrize("letters, n", [([0, 1], 300), ([97], 200), (list(range(97, 123)), 2000), ([0, 97, 254], 5000)])
def test_suffix_array_and_prefixes(letters, n, monkeypatch):
    monkeypatch.setattr(suffixes, "LANES", 7)
    s = sample(random.Random(n), letters, n)
    raw = s.tobytes()
    key = suffixes.packed(s)
    order = suffixes.suffix_array(key, len(s))
    # a suffix that ends is smaller than one that goes on
    assert order.tolist() == sorted(range(len(s)), key=lambda i: raw[i:])
    got = suffixes.common_prefixes(key, order, 40)

    def shared(a, b):
        k = 0
        while k < 40 and max(a, b) + k < len(raw) and raw[a + k] == raw[b + k]:
            k += 1
        return k

    assert [got[i] for i in order[1:]] == [shared(a, b) for a, b in zip(order[:-1], order[1:])] and got[order[0]] == 0


def test_each_string_has_its_anchor():
    rng = random.Random(3)
    parts = [prose(rng, 60).encode(), b"q" * 150, prose(rng, 3).encode(), prose(rng, 200).encode()]
    s = np.frombuffer(b"".join(parts), np.uint8)
    at = np.cumsum([0] + [len(p) for p in parts])
    places, hashes = suffixes.anchors(s, np.repeat(at[1:], np.diff(at)), 100, 50)
    for lo, hi in zip(at[:-1], at[1:]):
        for p in range(lo, hi - 99):
            inside = (places >= p) & (places <= p + 50)
            assert inside.any() and (places[inside] + 50 <= hi).all()
    again, same = suffixes.anchors(np.frombuffer(parts[3], np.uint8), np.full(len(parts[3]), len(parts[3])), 100, 50)
    assert (again + at[3]).tolist() == places[places >= at[3]].tolist() and same.tolist() == hashes[places >= at[3]].tolist()
