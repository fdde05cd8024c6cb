"""Sum-of-squares packing of token sequences.

Documents become pieces of at most ``capacity`` tokens.  Pieces are dealt to
shards by a hash of their place in the written table, tens of thousands to a shard, and each shard is packed in a
task of its own: pieces by falling length, each into the open bin whose choice
makes the sum of the squared counts of open bins per residual gap smallest; a
new bin is opened only if no open bin has room.  The state of a shard is its
pieces' lengths and one count a gap.

A null or empty text is its end token; very long texts are read whole and cut into
pieces.  Rows with a null or repeated ``doc_id`` are documents like others; an empty
table stays empty.  Other columns of ``docs``, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.tokens import ChunkTokenizer, default_tokenizer
from gridloom.session import cut

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(length: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: all full, but for the first."""
    head = length % capacity or min(length, capacity)
    return [(0, head)] + [(s, capacity) for s in range(head, length, capacity)]


def tokenised_pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """A row for each piece of each document: ids of the text, then ``end_id``; null text counts as empty."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ChunkTokenizer(path)
        for b in batches:
            owner, rows = [], []
            for i, ids in enumerate(tokens.rows(b.column(1))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, (s, n) in enumerate(pieces_of(len(ids), capacity)):
                    owner.append(i)
                    rows.append((k, s, n, zlib.crc32(ids[s : s + n])))
            kind = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kind)] if rows else [pa.array([], t) for t in kind]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), *columns], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, in the given order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)
    opened: list[list[int]] = [[] for _ in range(capacity + 1)]
    never, made = np.int64(1) << 60, 0
    for i, s in enumerate(lengths.tolist()):
        change = count[: capacity - s + 1] - count[s:]  # by residual gap after placing
        change[0] -= count[0]
        change[count[s:] == 0] = never
        left = int(change.argmin())
        if change[left] < never:
            gap = left + s
            count[gap] -= 1
            b = opened[gap].pop()
        else:
            gap, b, made = capacity, made, made + 1
            left = capacity - s
        bins[i], offsets[i] = b, capacity - gap
        if left:
            count[left] += 1
            opened[left].append(b)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 2048, shard_pieces: int = 32768) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table with ``doc_id, piece, length``.

    Equal lengths go by ``doc_id`` and ``piece``; repeated rows are packed as often as they occur; an
    empty table stays empty.  ``shard_pieces``: pieces of a shard, on average.
    """
    shards = max(1, -(-pieces.count() // shard_pieces))
    names = pieces.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, rows["offset"] = sum_of_squares(rows["length"].to_numpy(), capacity)
        rows["sequence_id"] = (np.int64(key[0]) << np.int64(40)) + bins
        return rows[[*names, "sequence_id", "offset"]]

    # by row, as ids may be null or repeated; the pieces are written, so a row keeps its number
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(lambda key, rows: run(key, rows.drop(columns="shard")), f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """Tokenise ``docs`` and pack them; one row a piece."""
    return pack(cut(tokenised_pieces(docs, capacity, tokenizer)), capacity)
