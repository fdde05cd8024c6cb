"""Three-dimensional overlap against all pairs of layers."""

import random

import pytest

from gridloom.operators.voxels import regrid_voxels, voxel_weights


def columns(rng, n, gaps):
    out = []
    for c in range(n):
        z = rng.randrange(5)
        for k in range(rng.randrange(1, 6)):
            top = z + rng.randrange(0 if gaps else 1, 4)
            out.append((c, k, float(z), float(top)))
            z = top + (rng.randrange(3) if gaps else 0)
    return out


@pytest.mark.parametrize("gaps", [False, True])
@pytest.mark.parametrize("relative", [False, True])
def test_weights_equal_all_pairs(spark, gaps, relative):
    rng = random.Random(4)
    s, t = columns(rng, 6, gaps), columns(rng, 4, gaps)
    w = [(j, i, float(rng.randrange(1, 5))) for i in range(6) for j in range(4) if rng.random() < 0.7]
    frame = lambda rows, key: spark.createDataFrame([*rows, (0, 99, None, 5.0), (0, 98, float("nan"), 5.0)], f"{key} long, layer int, bottom double, top double")
    weights = spark.createDataFrame(w, "target_id long, source_id long, weight double")
    got = {tuple(r)[:4]: r.weight for r in voxel_weights(weights, frame(s, "source_id"), frame(t, "target_id"), relative).collect()}
    want = {}
    for j, i, x in w:
        for sc, sk, a, b in s:
            for tc, tk, c, d in t:
                if (sc, tc) == (i, j) and min(b, d) > max(a, c):
                    want[j, tk, i, sk] = x * (min(b, d) - max(a, c)) / ((b - a) if relative else 1)
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_regrid_voxels(spark):
    weights = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0)], "target_id long, source_id long, weight double")
    source = spark.createDataFrame([(0, 0, 0.0, 2.0), (0, 1, 2.0, 4.0), (1, 0, 1.0, 3.0)], "source_id long, layer int, bottom double, top double")
    target = spark.createDataFrame([(0, 0, 0.0, 1.0), (0, 1, 1.0, 3.0), (0, 2, 9.0, 10.0)], "target_id long, layer int, bottom double, top double")
    data = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 5.0)], "source_id long, layer int, value double")
    got = {(r.target_id, r.layer): r.value for r in regrid_voxels(weights, source, target, data).collect()}
    assert got == {(0, 0): 1.0, (0, 1): pytest.approx((1 * 1 + 1 * 2 + 6 * 5) / 8), (0, 2): None}
