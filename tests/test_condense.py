"""The direct solution of fills, block by block."""

import numpy as np
from pyspark.sql import functions as F

from gridloom.data import MeshArray
from gridloom.operators import condense
from gridloom.operators.mesh import structured
from gridloom.operators.voronoi import tessellation


def test_fill_of_a_plane_needs_no_rounds(spark):
    m = structured(spark, 20, 30)
    q = F.col("face_id")
    x, y = q % 20, F.floor(q / 20)
    plane = (3 * x + 2 * y).cast("double")
    d = m.faces.select(q.alias("id"), F.when((x == 0) | (x == 19) | (y == 0) | (y == 29), plane).alias("value"))
    got = MeshArray(m, "face", d).laplace_interpolate(max_iterations=1).df.join(m.faces.select(q.alias("id"), plane.alias("want")), "id")
    assert got.where(F.abs(F.col("value") - F.col("want")) < 1e-9).count() == 600


def test_blocks_and_components_without_values(spark):
    n, entries, dense = 12, [], np.zeros((144, 144))
    for i in range(n * n):
        x, y = i % n, i // n
        near = [j for j, ok in ((i - 1, x > 0), (i + 1, x < n - 1), (i - n, y > 0), (i + n, y < n - 1)) if ok]
        dense[i, near], dense[i, i] = -1.0, 4.0
        entries += [(i, i, 4.0), (i + 1000, i + 1000, float(len(near)))] + [(i + o, j + o, -1.0) for j in near for o in (0, 1000)]
    right = np.where(np.arange(n * n) % 5 == 0, np.arange(n * n) / 7, 0.0)
    want = np.linalg.solve(dense, right)
    matrix = spark.createDataFrame(entries, "i long, j long, a double")
    b = spark.createDataFrame([(k, float(v)) for k, v in enumerate(right) if v], "i long, v double")
    places = spark.range(n * n).select(F.explode(F.array("id", F.col("id") + 1000)).alias("i"), (F.col("id") % n).cast("double").alias("x"), F.floor(F.col("id") / n).cast("double").alias("y"))
    for front in (1500, 8):  # all by blocks; the rest by conjugate gradients
        found, good = condense.solve(matrix, b, places, 1e-12, block=16, front=front)
        found = {r.i: r.v for r in found.collect()}
        assert good and sorted(found) == list(range(n * n))
        assert max(abs(found[k] - want[k]) for k in found) < 1e-9


def test_cells_read_centroids_once(spark):
    plan = tessellation(structured(spark, 3, 3), add_exterior=True).vertices._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # the rings of the faces are not made again
