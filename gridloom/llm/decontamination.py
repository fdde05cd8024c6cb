"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, lower-cased.  The benchmark's n-grams are
its seeds, and are counted over all documents.  Where a seed occurs in a
document, the item is aligned with the words around it, and the score is the
best local alignment divided by the item's best possible one.  A document with
a rare seed of the item (few documents, or the rarest part of the item's seeds
that occur) is aligned at once.  Beside common seeds alone, an item is aligned
unless too few of its words stand around them to reach the threshold whatever
their order, so that rarity saves work and drops nothing.

The benchmark is handled in blocks of a bounded number of words, each shipped to
the tasks; every block reads all documents twice and shuffles only seed counts.
Items and documents that are null or without words match nothing; items shorter
than a seed are a seed by themselves.  Repeated rows give repeated results; equal
items are aligned once, and each of their ids has a row.  Very long texts are read
whole.  Rows without an id are matched like others, and ``decontaminated`` keeps
them.  Without documents or without a benchmark nothing is found.  Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.textops import grams, words
from gridloom.session import without_ids

MATCH, MISS, GAP = 2, -1, -1
FOUND = "doc_id long, item_id long, score double, n_seeds int, word_start int, word_end int"


@dataclass
class Block:
    """Items of the benchmark, their seeds by hash, and where seeds stand in items."""

    ids: list[int]
    words: list[np.ndarray]
    sizes: list[int]
    keys: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    size: np.ndarray


def block_of(items: list[tuple[int, bytes]], n: int) -> Block:
    rows, lists = [], [np.frombuffer(w, np.uint64) for _, w in items]
    for i, w in enumerate(lists):
        k = min(n, len(w))
        if k:
            rows.append((grams(w, k), np.full(len(w) - k + 1, i), np.arange(len(w) - k + 1), np.full(len(w) - k + 1, k)))
    parts = [np.concatenate(x) for x in zip(*rows)] if rows else [np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3]
    order = np.argsort(parts[0], kind="stable")
    keys, owner, place, size = (p[order] for p in parts)
    return Block([i for i, _ in items], lists, sorted({int(x) for x in size}), keys, owner, place, size)


class Finder:
    """Finds a block's seeds in runs of words."""

    def __init__(self, block: Block, bits: int = 20):
        self.block, self.shift = block, np.uint64(64 - bits)
        self.unique, self.first = np.unique(block.keys, return_index=True)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(block.keys >> self.shift).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word position and number (in ``unique``) of every seed that lies in one row."""
        at, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in self.block.sizes:
            g = grams(hashes, k)
            p = np.flatnonzero(self.seen[(g >> self.shift).astype(np.int64)])
            if not len(p) or not len(self.unique):
                continue
            w = np.minimum(np.searchsorted(self.unique, g[p]), len(self.unique) - 1)
            ok = (self.unique[w] == g[p]) & (rows[p] == rows[p + k - 1])
            at.append(p[ok])
            which.append(w[ok])
        return np.concatenate(at), np.concatenate(which)


def smith_waterman(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Score of the best local alignment and the end of it in ``window``."""
    steps = np.arange(len(window) + 1) * -GAP
    before = np.zeros(len(window) + 1, np.int64)
    best, end = 0, 0
    for x in item:
        row = np.maximum(before + GAP, 0)
        row[1:] = np.maximum(row[1:], before[:-1] + np.where(window == x, MATCH, MISS))
        row = np.maximum.accumulate(row + steps) - steps
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
        before = row
    return best, end


def _aligned(block: Block, doc: np.ndarray, i: int, shifts: np.ndarray, least: float = 0.0) -> tuple[float, int, int]:
    """Best score of item ``i`` near the given shifts of its start in ``doc``, and the words it covers.

    Places where the item's words cannot score ``least`` in any order are passed over.
    """
    item = block.words[i]
    size, slack = len(item), max(4, len(item) // 3)
    best = (0.0, 0, 0)
    shifts = np.unique(shifts)
    for group in np.split(shifts, np.flatnonzero(np.diff(shifts) > slack) + 1):
        lo, hi = max(0, int(group[0]) - slack), min(len(doc), int(group[-1]) + size + slack)
        exact = [int(s) for s in group if s >= 0 and s + size <= len(doc) and (doc[s : s + size] == item).all()]
        if exact:
            return 1.0, exact[0], exact[0] + size
        if least and np.isin(item, doc[lo:hi]).sum() < least * size:
            continue
        score, end = smith_waterman(item, doc[lo:hi])
        if score > best[0] * MATCH * size:
            _, back = smith_waterman(item[::-1], doc[lo : lo + end][::-1])
            best = (score / (MATCH * size), lo + end - back, lo + end)
    return best


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.5, rare_share: float = 1e-4, block_words: int = 1_000_000) -> DataFrame:
    """A row for each document and item whose alignment scores at least ``threshold``.

    ``rare_share``: a seed is rare if at most this share of the documents (and in any case 10) has it, or
    if it is among the rarest half of its item's seeds that occur.
    """

    def as_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [w.hash[w.first[k] : w.first[k + 1]].tobytes() for w in words(b.column(1), marks=False) for k in range(w.hi - w.lo)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.binary())], ["item_id", "words"])

    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null")
    items = items.mapInArrow(as_words, "item_id long, words binary").where("length(words) > 0").withColumn("key", F.xxhash64("words"))
    ids, items = items.select("key", "item_id"), items.select(F.col("key").alias("item_id"), "words").dropDuplicates(["item_id"])  # equal items once
    total = items.agg(F.sum(F.length("words"))).first()[0] or 0
    blocks = max(1, -(-total // (8 * block_words)))
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k).orderBy("item_id").collect()  # at most about block_words words
        found = _in_block(texts, block_of([(r.item_id, bytes(r.words)) for r in part], n), threshold, rare_share)
        out = found if out is None else out.unionAll(found)
    columns = out.columns
    return out.withColumnRenamed("item_id", "key").join(ids, "key").select(columns)


def _in_block(texts: DataFrame, block: Block, threshold: float, rare_share: float) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(block)
        total, docs = np.zeros(len(finder.unique), np.int64), 0
        for b in batches:
            docs += b.num_rows
            for w in words(b.column(0), marks=False):
                rows = np.searchsorted(w.first, np.arange(len(w.hash)), "right")
                at, which = finder.hits(w.hash, rows)
                total += np.bincount(np.unique(rows[at] * np.int64(len(total) + 1) + which) % (len(total) + 1), minlength=len(total))
        seed = np.append(np.flatnonzero(total), -1)
        yield pa.RecordBatch.from_arrays([pa.array(seed), pa.array(np.append(total[seed[:-1]], docs))], ["seed", "n"])

    seeds = texts.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toPandas()  # a row a seed
    spread = np.zeros(len(np.unique(block.keys)), np.int64)
    docs = int(seeds.loc[seeds.seed < 0, "n"].sum())
    seeds = seeds[seeds.seed >= 0]
    spread[seeds.seed.to_numpy()] = seeds.n.to_numpy()
    number = np.searchsorted(np.unique(block.keys), block.keys)
    frame = pd.DataFrame({"owner": block.owner, "n": spread[number]})
    rank = frame.n.where(frame.n > 0).groupby(frame.owner).rank(method="min", pct=True).to_numpy() if len(frame) else np.zeros(0)
    rare = (frame.n.to_numpy() <= max(10, rare_share * docs)) | (rank <= 0.5)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(block)
        ends = np.append(finder.first, len(block.keys))
        for b in batches:
            ids, found = b.column(0).to_pylist(), []
            for w in words(b.column(1), marks=False):
                rows = np.searchsorted(w.first, np.arange(len(w.hash)), "right") - 1
                at, which = finder.hits(w.hash, rows)
                if not len(at):
                    continue
                many = ends[which + 1] - ends[which]  # a seed may stand in several items
                seed = np.repeat(ends[which] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                at = np.repeat(at, many)
                row, item = rows[at], block.owner[seed]
                shift = at - w.first[row] - block.place[seed]
                order = np.lexsort((shift, item, row))
                row, item, shift, few = row[order], item[order], shift[order], rare[seed[order]]
                for group in np.split(np.arange(len(row)), np.flatnonzero((np.diff(row) != 0) | (np.diff(item) != 0)) + 1):
                    r, i = int(row[group[0]]), int(item[group[0]])
                    score, a, z = _aligned(block, w.hash[w.first[r] : w.first[r + 1]], i, shift[group], 0.0 if few[group].any() else threshold)
                    if score >= threshold:
                        found.append((ids[w.lo + r], block.ids[i], round(score, 6), len(group), a, z))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            columns = zip(*found) if found else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], [x.split()[0] for x in FOUND.split(", ")])

    return texts.mapInArrow(search, FOUND)


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark item; documents with null id stay."""
    return without_ids(docs, contamination(docs, benchmark, **options).select("doc_id"))
