"""Removal of repeated passages by suffix arrays.

A byte goes if a string of ``width`` bytes that covers it also starts anywhere else,
in the same document too.  Documents are UTF-8 bytes, and strings lie inside of one.

1. Anchors narrow the search without loss: of the strings of half of
   ``width`` bytes inside of each longer one the one with the smallest hash is an anchor, so equal strings
   have equal anchors.  Only strings around anchors that occur in several texts, or
   several times in one, can repeat; the pieces of text that hold them go on.
2. Pieces are dealt to shards of about ``shard_bytes``, by the least of their text's
   anchors, so that texts with much in common mostly meet; a frequent anchor is dealt
   over salts, and the pieces of a long text go to several shards.
3. Each shard's suffix array is built by Larsson-Sadakane refinement: suffixes are sorted
   by eight bytes, then groups of equal ones by the ranks of what follows them, twice as
   far in each round, until no group is left.  Kasai's walk in text order, in many lanes
   at once, gives the common prefixes of neighbours: strings that repeat in the shard.
4. Shards are merged for the strings around anchors that are in several shards: each
   shard sends one string of each class of equal ones, as sorted hashes cut into ranges.
   A range's task merges the shards' lists and looks strings up by binary search; places
   found in another shard go back to theirs.  A hash has 64 bits beside the range, which
   another hash gives.

Texts that are wholly equal are one text that occurs several times.  A null text is an
empty one; texts shorter than ``width`` bytes stay as they are; very long texts are read
whole, and worked on in pieces.  Each row of ``docs`` gives one row; rows that repeat a
``doc_id`` or have none are documents like others; an empty table gives an empty result.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.textops import distinct, mix, powers, slices, utf8
from gridloom.operators.joins import lookup
from gridloom.session import cut, remove, stored

WIDTH = 400
PIECE = 1 << 18
LANES = 4096
TASKS = 50_000
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
_OTHER = mix(np.arange(1, 257, dtype=np.uint64))


# arrays of one shard


def packed(s: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros after the end; eight places more than bytes."""
    long = np.zeros(len(s) + 15, np.uint8)
    long[: len(s)] = s
    out = np.zeros(len(s) + 8, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | long[k : k + len(out)]
    return out


def suffix_array(key: np.ndarray, n: int) -> np.ndarray:
    """Order of the ``n`` suffixes by Larsson-Sadakane refinement; ``key`` are their packed first bytes.

    The last byte must be 0xFF, which is in no text, so that suffixes differ.
    """
    order = np.argsort(key[:n]).astype(np.int64)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    value = key[order]
    new = np.ones(n, bool)
    new[1:] = value[1:] != value[:-1]
    at = np.arange(n)
    place = np.maximum.accumulate(np.where(new, at, 0))
    rank[order] = place
    alone = new & np.append(new[1:], True)
    at = at[~alone]  # places in the order whose groups hold several suffixes
    depth = 8
    while len(at):
        some = order[at]
        pair = (rank[some].astype(np.uint64) << np.uint64(32)) | (rank[np.minimum(some + depth, n)] + 1).astype(np.uint64)
        by = np.argsort(pair)
        some, pair = some[by], pair[by]
        order[at] = some
        new = np.ones(len(at), bool)
        new[1:] = pair[1:] != pair[:-1]
        rank[some] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        at = at[~(new & np.append(new[1:], True))]
        depth *= 2
    return order


def common_prefixes(key: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each place of the text: bytes that its suffix shares with the one before it in the order, up to ``most``.

    Kasai's walk: a suffix shares at least one byte less than the one that begins a byte before it.  The
    text is cut into lanes that walk at the same time, eight bytes a step.
    """
    n = len(order)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = n
    out = np.zeros(n, np.int32)
    size = max(1, -(-n // LANES))
    i = np.arange(0, n, size)
    end = np.minimum(i + size, n)
    h = np.zeros(len(i), np.int64)
    while len(i):
        j = before[i]
        x = key[np.minimum(i + h, n)] ^ key[np.minimum(j + h, n)]
        full = x == 0
        h += np.where(full, 8, 0)
        # leading zero bytes of the difference
        short = ~full
        y = x[short]
        zeros = np.zeros(len(y), np.int64)
        for shift, width in ((32, 4), (48, 2), (56, 1)):
            top = (y >> np.uint64(shift)) == 0
            zeros += top * width
            y = np.where(top, y << np.uint64(8 * width), y)
        h[short] += zeros
        left = np.minimum(n - np.maximum(i, j), most)
        done = short | (h >= left)
        h = np.minimum(h, left)
        out[i[done]] = h[done]
        h[done] = np.maximum(h[done] - 1, 0)
        i = i + done
        if (i >= end).any():
            going = i < end
            i, end, h = i[going], end[going], h[going]
    return out


def window_hashes(s: np.ndarray, width: int, symbols: np.ndarray | None = None) -> np.ndarray:
    """Hash of each string of ``width`` bytes, by place."""
    if len(s) < width:
        return np.zeros(0, np.uint64)
    up, down = powers(len(s) + 1)
    sums = np.zeros(len(s) + 1, np.uint64)
    value = s.astype(np.uint64) + np.uint64(1) if symbols is None else symbols[s]
    np.cumsum(value * up[: len(s)], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[: len(s) - width + 1])


def _least(x: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """``best`` of each run of ``width`` values, by the place where the run begins."""
    n = len(x)
    whole = np.resize(x, -(-n // width) * width).reshape(-1, width)
    left = best.accumulate(whole, axis=1).ravel()[:n]
    right = best.accumulate(whole[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return best(right[: n - width + 1], left[width - 1 :])


def anchors(s: np.ndarray, ends: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors; ``ends`` has the end of each place's text."""
    h = window_hashes(s, gram)
    span = width - gram + 1
    if len(h) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(len(h))
    h = np.maximum(h, np.uint64(1))
    h[at + gram > ends[: len(h)]] = _LAST
    low = _least(h, span)
    low[np.arange(len(low)) + width > ends[: len(low)]] = 0  # no string of a text
    edge = np.zeros(span - 1, np.uint64)
    high = _least(np.concatenate([edge, low, edge]), span, np.maximum)
    found = np.flatnonzero((high == h) & (h != _LAST))
    return found, h[found]


def runs_of(places: np.ndarray) -> np.ndarray:
    """``[first, last, first, last, ...]`` of sorted distinct places."""
    if not len(places):
        return np.zeros(0, np.int64)
    step = np.flatnonzero(np.diff(places) > 1)
    return np.stack([places[np.append(0, step + 1)], places[np.append(step, len(places) - 1)]], axis=1).ravel()


def _covered(runs: np.ndarray, n: int) -> np.ndarray:
    """Flags of the places inside of ``runs``."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, runs[::2], 1)
    np.add.at(change, runs[1::2] + 1, -1)
    return np.cumsum(change[:n]) > 0


# tasks


def _list(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(v) for v in values], dtype=np.int64)]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.int64), *values]) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat).cast(kind))


def _find_anchors(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # sixteen bytes a text of this task
        for b in batches:
            digests = b.column(0).to_pylist()
            raw, offsets = utf8(b.column(1))
            for lo, hi in slices(offsets):
                part, at = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                places, hashes = anchors(part, np.repeat(at[1:], np.diff(at)), width, gram)
                cuts = np.searchsorted(places, at)
                rows = []
                for i in range(hi - lo):
                    if digests[lo + i] in seen:
                        continue
                    seen.add(digests[lo + i])
                    p, h = places[cuts[i] : cuts[i + 1]] - at[i], hashes[cuts[i] : cuts[i + 1]]
                    _, which, size = np.unique(h, return_inverse=True, return_counts=True)
                    rows.append((digests[lo + i], h.view(np.int64), p, (size[which] > 1).astype(np.int64)))
                if rows:
                    d, h, p, t = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), _list(list(h), pa.int64()), _list(list(p), pa.int32()), _list(list(t), pa.int32())], ["digest", "hash", "pos", "twice"])

    return run


def _cut_pieces(width: int, gram: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for digest, text, copies, lead, lead_n, marks in zip(*(b.column(k).to_pylist() for k in range(6))):
                data = text.encode()
                n = len(data) - width + 1  # strings of this text
                pos = np.array([m["pos"] for m in marks], np.int64)
                across = np.array([m["across"] for m in marks], bool)
                around = lambda q: _covered(np.stack([np.maximum(q + gram - width, 0), np.minimum(q, n - 1)], axis=1).ravel(), n)  # noqa: E731, B023
                held, sent = runs_of(np.flatnonzero(around(pos))), around(pos[across])
                for first, last in zip(held[::2].tolist(), held[1::2].tolist()):
                    while first <= last:
                        stop = min(last, (first // piece + 1) * piece - 1)
                        rows.append({"digest": digest, "lead": lead, "lead_n": lead_n, "chunk": first // piece, "start": first, "copies": copies,
                                     "bytes": data[first : stop + width], "sent": runs_of(np.flatnonzero(sent[first : stop + 1])).tolist()})
                        first = stop + 1
            yield pa.RecordBatch.from_pylist(rows, schema=_PIECES)

    return run


_PIECES = pa.schema([("digest", pa.binary()), ("lead", pa.int64()), ("lead_n", pa.int64()), ("chunk", pa.int32()), ("start", pa.int32()), ("copies", pa.int64()), ("bytes", pa.binary()), ("sent", pa.list_(pa.int32()))])
_SHARD = "shard long, digest binary, start int, place int, size int, copies long, runs array<int>, range int, keys binary, places binary"
_SHARD_ARROW = pa.schema([("shard", pa.int64()), ("digest", pa.binary()), ("start", pa.int32()), ("place", pa.int32()), ("size", pa.int32()), ("copies", pa.int64()), ("runs", pa.list_(pa.int32())), ("range", pa.int32()), ("keys", pa.binary()), ("places", pa.binary())])


def _work_shard(width: int, ranges: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        rows = rows.sort_by([("digest", "ascending"), ("start", "ascending")])
        pieces = [np.frombuffer(x, np.uint8) for x in rows.column("bytes").to_pylist()]
        end = np.array([255], np.uint8)
        s = np.concatenate([x for p in pieces for x in (p, end)])
        first = np.concatenate([[0], np.cumsum([len(p) + 1 for p in pieces])])[:-1]
        key8 = packed(s)
        order = suffix_array(key8, len(s))
        alike = common_prefixes(key8, order, width)[order] >= width  # with the suffix before
        starts = np.zeros(len(s), bool)  # strings of a text begin here
        asked, sent = np.zeros(len(s), bool), np.zeros(len(s), bool)
        copies, across = rows.column("copies").to_pylist(), rows.column("sent").to_pylist()
        for at, p, c, r in zip(first.tolist(), pieces, copies, across):
            n = len(p) - width + 1
            starts[at : at + n] = True
            sent[at : at + n] = _covered(np.array(r, np.int64), n)
            asked[at : at + n] = c == 1
        again = np.zeros(len(s), bool)
        again[order] = alike | np.append(alike[1:], False)
        again &= starts
        one = np.zeros(len(s), bool)  # the first of each class of equal strings
        one[order] = ~alike
        one &= sent
        out = []
        digests, begins = rows.column("digest").to_pylist(), rows.column("start").to_pylist()
        for d, b, at, p, c in zip(digests, begins, first.tolist(), pieces, copies):
            n = len(p) - width + 1
            runs = runs_of(np.flatnonzero(again[at : at + n])) + b if c == 1 else np.zeros(0, np.int64)
            out.append({"shard": shard, "digest": d, "start": b, "place": at, "size": n, "copies": c, "runs": runs.tolist()})
        at = np.flatnonzero(one)
        if len(at):
            keys, where = window_hashes(s, width)[at], (window_hashes(s, width, _OTHER)[at] % np.uint64(ranges)).astype(np.int64)
            wants = asked[at] & ~again[at]
            by = np.lexsort((keys, ~wants, where))  # in each range those that ask come first, sorted
            keys, where, wants, at = keys[by], where[by], wants[by], at[by]
            edges = np.searchsorted(where, np.arange(ranges + 1))
            for r in np.flatnonzero(np.diff(edges)).tolist():
                lo, hi = edges[r], edges[r + 1]
                out.append({"shard": shard, "range": r, "keys": keys[lo:hi].tobytes(), "places": at[lo:hi][wants[lo:hi]].astype(np.int32).tobytes()})
        return pa.Table.from_pylist(out, schema=_SHARD_ARROW)

    return run


def _merge_range(key: tuple, rows: pa.Table) -> pa.Table:
    lists = [np.frombuffer(x, np.uint64) for x in rows.column("keys").to_pylist()]
    places = [np.frombuffer(x, np.int32) for x in rows.column("places").to_pylist()]
    merged = np.sort(np.concatenate([distinct(x) for x in lists]))
    shared = distinct(merged[1:][merged[1:] == merged[:-1]])  # strings that several shards have
    shards, found = [], []
    for shard, keys, at in zip(rows.column("shard").to_pylist(), lists, places):
        if len(at) and len(shared):
            mine = keys[: len(at)]
            hit = at[shared[np.minimum(np.searchsorted(shared, mine), len(shared) - 1)] == mine]
            if len(hit):
                shards.append(shard)
                found.append(hit.tobytes())
    return pa.table({"shard": pa.array(shards, pa.int64()), "places": pa.array(found, pa.binary())})


def _answer(rows: pa.Table, replies: pa.Table) -> pa.Table:
    at = np.sort(np.concatenate([np.zeros(0, np.int32), *[np.frombuffer(x, np.int32) for x in replies.column("places").to_pylist()]]))
    out = {"digest": [], "runs": []}
    columns = [rows.column(c).to_pylist() for c in ("digest", "start", "place", "size", "copies", "runs")]
    for digest, start, place, size, copies, runs in zip(*columns):
        if copies == 1:
            mine = at[np.searchsorted(at, place) : np.searchsorted(at, place + size)].astype(np.int64) - place + start
            runs = np.concatenate([np.array(runs, np.int64), runs_of(distinct(mine)) if len(mine) else mine])
            if len(runs):
                out["digest"].append(digest)
                out["runs"].append(runs.tolist())
    return pa.table({"digest": pa.array(out["digest"], pa.binary()), "runs": pa.array(out["runs"], pa.list_(pa.int32()))})


def _cut_out(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for digest, text, lists in zip(*(b.column(k).to_pylist() for k in range(3))):
                data = text.encode()
                runs = np.array([x for one in lists for x in one], np.int64).reshape(-1, 2)
                runs = runs[np.argsort(runs[:, 0], kind="stable")]
                stop = np.maximum.accumulate(runs[:, 1] + width)
                new = np.append(True, runs[1:, 0] > stop[:-1])
                begin, end = runs[new, 0], stop[np.append(new[1:], True)]
                kept, at = hashlib.sha256(), 0
                for lo, hi in zip(begin.tolist(), end.tolist()):
                    kept.update(data[at:lo])
                    at = hi
                kept.update(data[at:])
                out.append({"digest": digest, "n_removed": int((end - begin).sum()), "n_spans": len(begin), "kept_sha256": kept.hexdigest(), "spans": np.stack([begin, end], axis=1).ravel().tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=_RESULT)

    return run


_RESULT = pa.schema([("digest", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int32()))])


# the job


def repeats(docs: DataFrame, width: int = WIDTH, shard_bytes: int = 1 << 20, piece: int = PIECE, together: int = 256) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans)``, a row for each row of ``docs``.

    ``spans`` are the removed runs as starts and ends in bytes.  ``together``: about how many texts with the
    same least anchor share a shard.
    """
    gram = width // 2
    text = F.coalesce("text", F.lit(""))
    sha = F.sha2(text.cast("binary"), 256)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"), sha.alias("sha"))
    rows = rows.withColumn("digest", F.substring(F.unhex("sha"), 1, 16))
    long = rows.where(F.col("n_bytes") >= width)
    many = cut(long.groupBy("digest").agg(F.count("*").alias("size")).where("size > 1"))
    # anchors that several texts have, or one has several times
    found, path = stored(long.select("digest", "text").mapInArrow(_find_anchors(width, gram), "digest binary, hash array<long>, pos array<int>, twice array<int>"))
    paths = [path]
    each = found.select("digest", F.inline(F.arrays_zip("hash", "pos", "twice")))
    name = F.xxhash64("digest")
    shared = each.groupBy("hash").agg(F.min(name).alias("lo"), F.max(name).alias("hi"), F.max("twice").alias("twice"), F.count("*").alias("n"))
    shared, path = stored(shared.where("lo <> hi or twice > 0").select("hash", "n"))
    paths.append(path)
    each, path = stored(lookup(each, shared, ["hash"], "inner", size="n").groupBy("digest").agg(F.collect_set(F.struct("pos", "hash")).alias("marks"), F.min(F.struct("hash", "n")).alias("lead")))
    paths.append(path)
    each = each.select("digest", "marks", F.col("lead.hash").alias("lead"), F.col("lead.n").alias("lead_n"))
    n_marks = each.agg(F.coalesce(F.sum(F.size("marks")), F.lit(0)).alias("n")).first().n
    shards = max(1, n_marks * (width - gram) // 2 // shard_bytes)
    salt = F.pmod(F.xxhash64("digest"), F.ceil(F.col("lead_n") / together))
    shard = lambda chunk: F.pmod(F.xxhash64("lead", salt, chunk), F.lit(shards))
    # anchors that several shards have
    of = lambda place: shard(F.floor(F.greatest(place, F.lit(0)) / piece).cast("int"))
    single = each.select("digest", "lead", "lead_n", F.explode("marks").alias("m"))
    single = single.select(F.col("m.hash").alias("hash"), of(F.col("m.pos")).alias("a"), of(F.col("m.pos") - (width - gram)).alias("b"))
    across = single.groupBy("hash").agg(F.min(F.least("a", "b")).alias("lo"), F.max(F.greatest("a", "b")).alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    across = cut(across.select("hash", "size", F.lit(True).alias("across")))
    marks = each.select("digest", "lead", "lead_n", F.inline("marks"))
    marks = lookup(marks, across, ["hash"], size="size").groupBy("digest").agg(F.first("lead").alias("lead"), F.first("lead_n").alias("lead_n"), F.collect_list(F.struct("pos", F.coalesce("across", F.lit(False)).alias("across"))).alias("marks"))
    # one row a text
    texts = long.select("digest", "text")
    few = each.limit(100_001).count() <= 100_000
    if few:  # else all texts are dealt out anyway
        texts = texts.join(F.broadcast(each.select("digest")), "digest", "left_semi")
    texts = texts.groupBy("digest").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    texts, path = stored(texts.join(marks, "digest").select("digest", "text", "copies", "lead", "lead_n", "marks"))
    paths.append(path)
    pieces = texts.mapInArrow(_cut_pieces(width, gram, piece), "digest binary, lead long, lead_n long, chunk int, start int, copies long, bytes binary, sent array<int>")
    pieces = pieces.select(shard(F.col("chunk")).alias("shard"), "digest", "start", "copies", "bytes", "sent")
    ranges = max(8, shards // 8)
    pieces = pieces.repartition(min(shards, TASKS), "shard")  # small in bytes, not in work
    worked, path = stored(pieces.groupBy("shard").applyInArrow(_work_shard(width, ranges), _SHARD))
    paths.append(path)
    replies = worked.where("digest is null").select("range", "shard", "keys", "places").groupBy("range").applyInArrow(_merge_range, "shard long, places binary")
    mine = worked.where("digest is not null").select("shard", "digest", "start", "place", "size", "copies", "runs")
    runs = mine.groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(_answer, "digest binary, runs array<int>")
    runs = runs.groupBy("digest").agg(F.collect_list("runs").alias("runs"))
    single = texts.where("copies = 1").select("digest", "text").join(runs, "digest").select("digest", "text", "runs")
    result = single.mapInArrow(_cut_out(width), "digest binary, n_removed long, n_spans long, kept_sha256 string, spans array<int>")
    whole = many.select("digest", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256().hexdigest()).alias("kept_sha256"), F.lit(None).cast("array<int>").alias("spans"), "size")
    result = cut(result.withColumn("size", F.lit(1).cast("long")).unionAll(whole))
    for path in paths:
        remove(docs.sparkSession, path)
    out = lookup(rows.select("doc_id", "n_bytes", "sha", "digest"), result, ["digest"], size="size")
    hit = F.col("size").isNotNull()
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(hit, F.coalesce("n_removed", "n_bytes")).otherwise(0).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.when(hit, F.col("kept_sha256")).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(hit, F.coalesce("spans", F.array(F.lit(0), F.col("n_bytes").cast("int")))).otherwise(F.array().cast("array<int>")).alias("spans"),
    )


def removed_spans(docs: DataFrame, width: int = WIDTH, **options) -> DataFrame:
    """The removed runs themselves: ``(doc_id, start, stop)`` in bytes, a row a run."""
    rows = repeats(docs, width, **options).where("n_spans > 0").select("doc_id", "spans", F.explode(F.expr("sequence(0, size(spans) div 2 - 1)")).alias("k"))
    at = lambda k: F.get("spans", k)
    return rows.select("doc_id", at(F.col("k") * 2).alias("start"), at(F.col("k") * 2 + 1).alias("stop"))
