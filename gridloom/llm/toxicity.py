"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are its distinct character n-grams (bytes of the text, A-Z
lower-cased), hashed to ``2**BITS`` numbers.  From labelled texts come the
smoothed log-count ratios of the two classes; each feature's presence is scaled
by its ratio, the vector by its length, and a logistic regression is fitted by
rounds of stochastic descent on each shard of the sample and averaging of the
shards' weights.  Scores need one pass over the texts and no shuffle.

The sample is bounded: at most ``max_each`` labelled rows of each class, those
whose ids have the smallest hashes; the bias is set right for their shares.  Labels with a null id or value count for nothing; of
several labels of an id the largest counts.  Without labels of both classes (an
empty table, or one class alone) nothing tells texts apart: every score is the
smoothed share of toxic labels, at most ``BLIND``, so that nothing is rejected.
Null text counts as empty; an empty text is scored by the fitted bias alone; a very
long one is read whole.  Repeated rows get equal scores, an empty table of documents
an empty result, and a null ``doc_id`` stays null and is not held out.  Columns with
other names are carried by ``without_toxic`` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.textops import LOWER, mix, powers, slices, utf8
from gridloom.session import cut

BITS = 18
ORDERS = (3, 4, 5, 6)
SHARDS = 8
BLIND = 0.25


def feature_rows(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct feature numbers of each row."""
    raw, offsets = utf8(column)
    for lo, hi in slices(offsets):
        part, at = LOWER[raw[offsets[lo] : offsets[hi]]], (offsets[lo : hi + 1] - offsets[lo]).tolist()
        n = len(part)
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        hashed = [((sums[k:] - sums[:-k]) * (down[: n + 1 - k] * np.uint64(2 * k + 1)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int32) if n >= k else np.zeros(0, np.int32) for k in ORDERS]
        place = np.zeros(1 << BITS, np.int32)
        for a, b in zip(at[:-1], at[1:]):
            x = np.concatenate([h[a : max(a, b - k + 1)] for h, k in zip(hashed, ORDERS)])
            order = np.arange(len(x), dtype=np.int32)
            place[x] = order  # the last occurrence stays, and stands for the feature
            yield x[place[x] == order]


@dataclass
class Model:
    """Weights by feature (ratio and regression weight multiplied), the ratios, and the bias."""

    weight: np.ndarray
    ratio: np.ndarray
    bias: float

    def margin(self, x: np.ndarray) -> float:
        if not len(x):
            return self.bias
        norm = float(np.sqrt((self.ratio[x] ** 2).sum()))
        return self.bias + (float(self.weight[x].sum()) / norm if norm else 0.0)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for documents that are never learnt from: crc32 of the id as text leaves 0 by five."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _dense(rows: list, size: int) -> np.ndarray:
    return sum((np.frombuffer(r[0], np.float32) for r in rows), np.zeros(size))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_each: int = 4000, rounds: int = 4, epochs: int = 3, rate: float = 8.0, decay: float = 1e-5, clear: float = 3.0) -> Model:
    """Learn from the labelled documents that are not held out.

    Ratios of less than ``clear`` standard errors count as 0, so that rare n-grams add no noise.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg((F.max("y") > 0).cast("int").alias("y"))
    shares = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    order = (F.xxhash64("doc_id"), "doc_id")
    known = known.where("y = 1").orderBy(*order).limit(max_each).unionAll(known.where("y = 0").orderBy(*order).limit(max_each))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")

    rows = cut(sample.select("doc_id", "y", "text").repartition(SHARDS, "doc_id").sortWithinPartitions("doc_id", "text"))
    rows = rows.coalesce(SHARDS)  # as many vectors reach the driver, whatever the number of partitions

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * (1 << BITS) + 2, np.float32)
        for b in batches:
            for y, x in zip(b.column(1).to_pylist(), feature_rows(b.column(2))):
                total[(int(y > 0) << BITS) + x] += 1
                total[-1 - int(y > 0)] += 1
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    total = _dense(rows.mapInArrow(counts, "total binary").collect(), 2 * (1 << BITS) + 2)  # a vector of fixed size from each shard
    none, some = total[-1], total[-2]
    size = 1 << BITS
    odds = lambda a, b: float(np.log((a + 1) / (b + 1)))
    if not none or not some:
        share = min(BLIND, (shares.get(1, 0) + 1) / (sum(shares.values()) + 2))
        return Model(np.zeros(size), np.zeros(size), float(np.log(share / (1 - share))))
    prior, shift = odds(some, none), odds(shares.get(1, 0), shares.get(0, 0)) - odds(some, none)
    p, q = total[size : 2 * size] + 1, total[:size] + 1
    ratio = np.log((p / (some + 2)) / (q / (none + 2)))
    ratio[np.abs(ratio) < clear * np.sqrt(1 / p + 1 / q)] = 0
    kept = np.flatnonzero(ratio)  # the clear features, numbered anew from here on
    number = np.full(size, -1, np.int32)
    number[kept] = np.arange(len(kept))
    clear_ratio = ratio[kept]
    weight, bias = np.zeros(len(kept)), prior

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([n[n >= 0].tobytes() for n in (number[f] for f in feature_rows(b.column(2)))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), x], ["doc_id", "y", "x"])

    rows = cut(rows.mapInArrow(featured, "doc_id long, y int, x binary")).coalesce(SHARDS)

    for turn in range(rounds):
        step, start, offset = rate / (1 + turn), weight, bias

        def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, b0 = start.copy(), offset
            data = []
            for b in batches:
                for y, x in zip(b.column(1).to_pylist(), b.column(2)):
                    f = np.frombuffer(x.as_buffer(), np.int32)
                    v = clear_ratio[f]
                    norm = np.sqrt((v * v).sum())
                    if norm:
                        data.append((int(y > 0), f.copy(), (v / norm).astype(np.float32)))
            for _ in range(epochs):
                for y, f, v in data:
                    wrong = y - 1 / (1 + np.exp(-np.clip(b0 + (w[f] * v).sum(), -30, 30)))
                    w[f] += step * (wrong * v - decay * w[f])
                    b0 += 0.05 * wrong
            yield pa.RecordBatch.from_arrays([pa.array([np.append(w, [b0, 1.0]).astype(np.float32).tobytes()] if data else [], pa.binary())], ["w"])

        mixed = _dense(rows.mapInArrow(descend, "w binary").collect(), len(kept) + 2)
        if not mixed[-1]:  # no text of the sample has a clear feature
            break
        mixed = mixed / mixed[-1]
        weight, bias = mixed[:-2], float(mixed[-2])
    full = np.zeros(size, np.float32)
    full[kept] = weight * clear_ratio
    return Model(full, ratio.astype(np.float32), bias + shift)  # the sample holds other shares of the classes than the labels do


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` for every row, from the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.array([model.margin(x) for x in feature_rows(b.column(1))], float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(m, -500, 500))), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``."""
    scored = score(docs, fit(docs, labels, **options))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that do not score over 1/2, all columns as they are; null texts stay."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(place)
            clean = [model.margin(x) <= 0 for x in feature_rows(texts)]
            yield b.filter(pa.array([c or not v for c, v in zip(clean, texts.is_valid().to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
