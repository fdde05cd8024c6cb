"""WARC 1.1: a deterministic sharded writer and a reader.

Rows are dealt to range shards of ``page_id`` of about ``shard_bytes`` of payload
each, one shard a task, and sorted; the task rolls its files by compressed size, a
gzip member a record.  Headers and digests are regenerated from the payloads alone,
so the same rows give the same bytes in any attempt.  A file is written under a temporary name of its attempt and renamed
when whole; it counts only once the manifest, a table that is committed after all
tasks, lists it.  Files go through the file system that the folder's URI names.

Of pages with equal payloads of at least ``least_bytes`` bytes, the one with the
largest ``page_id`` is a response and the others revisit it.  A null html is an
empty payload, a null url is left out of the record, a null ``page_id`` is kept
as null (and is a revisit if its payload has a holder).  Rows of one ``page_id``
stay in one shard, those without in the first; repeated rows are written as often as
they occur; a very long payload is one record; an empty table gives no file.  Other
columns of ``pages``, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.ranges import LEAST, range_bounds, range_shard
from gridloom.operators.joins import lookup
from gridloom.session import cut, shared_dir

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
OVERHEAD = 600


def _id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _base32(hexdigest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexdigest)).decode()


def _headers(first: str, fields: list[tuple[str, object]]) -> bytes:
    return "".join([first, "\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, holder: int | None, date: str) -> bytes:
    """One record: a response, or a revisit of ``holder`` if that is given."""
    http = _headers("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))])
    block = http if holder is not None else http + payload
    fields = [("WARC-Type", "response" if holder is None else "revisit"), ("WARC-Record-ID", _id(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~")))
    if holder is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _id(holder))]
    fields += [("WARC-Payload-Digest", _base32(digest)), ("WARC-Block-Digest", _base32(hashlib.sha1(block).hexdigest()))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return _headers("WARC/1.1", fields) + block + b"\r\n\r\n"


def _info(name: str, date: str) -> bytes:
    block = b"software: gridloom\r\nformat: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-file:{name}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(block))]
    return _headers("WARC/1.1", fields) + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    return gzip.compress(data, level, mtime=0)


class _Roll:
    """Writes one shard's files in turn."""

    def __init__(self, folder: str, shard: int, most: int, level: int, date: str):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(folder)
        self.shard, self.most, self.level, self.date = shard, most, level, date
        self.number, self.out, self.done = 0, None, []

    def add(self, record: bytes) -> None:
        if self.out is not None and self.size >= self.most:
            self.close()
        if self.out is None:
            self.name = f"shard-{self.shard:05d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.path}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.temporary), 0, 0, hashlib.sha256()
            self._put(_info(self.name, self.date))
        self._put(record)
        self.records += 1

    def _put(self, data: bytes) -> None:
        packed = _member(data, self.level)
        self.out.write(packed)
        self.sha.update(packed)
        self.size += len(packed)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.path}/data/{self.name}")
            self.done.append((self.name, self.records, self.size, self.sha.hexdigest()))
            self.out, self.number = None, self.number + 1


def _files(done: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    columns = zip(*done) if done else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], [x.split()[0] for x in MANIFEST.split(", ")])


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 1000, file_bytes: int = 64 << 20, level: int = 5, shard_bytes: int = 32 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` below ``folder`` and return the manifest: ``file, records, bytes, sha256``."""
    from pyarrow import fs

    spark = pages.sparkSession
    store, path = fs.FileSystem.from_uri(folder)
    for d in ("_temporary", "data"):
        store.create_dir(f"{path}/{d}", recursive=True)
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("size"))
    slim = cut(rows.select("page_id", "digest", "size"))
    same = slim.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.count("*").alias("n"), F.max("page_id").alias("holder"))
    same = cut(same.where("n > 1 and holder is not null"))

    def held(df: DataFrame) -> DataFrame:
        df = lookup(df, same, ["digest", "size"], size="n").drop("n")
        return df.withColumn("holder", F.when(F.col("page_id").eqNullSafe(F.col("holder")), F.lit(None)).otherwise(F.col("holder")))

    bounds = range_bounds(held(slim), "page_id", F.when(F.col("holder").isNull(), F.col("size")).otherwise(0) + OVERHEAD, shard_bytes)
    rows = held(rows).withColumn("shard", range_shard(F.col("page_id"), bounds))
    rows = rows.select("shard", "page_id", "url", F.when(F.col("holder").isNull(), F.col("html")).otherwise("").alias("html"), "digest", "size", "holder")
    rows = rows.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", F.coalesce("page_id", F.lit(LEAST)), "url", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = None
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                for r in b.slice(lo, 256).to_pylist():
                    if roll is None or roll.shard != r["shard"]:
                        if roll is not None:
                            roll.close()
                            yield _files(roll.done)
                        roll = _Roll(folder, r["shard"], file_bytes, level, date)
                    body = r["html"].encode() if r["holder"] is None else bytes(0)
                    roll.add(_sized(r, body, date))
        if roll is not None:
            roll.close()
            yield _files(roll.done)

    rows.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


class _Length:
    """Stands for a payload that is not carried, of known length."""

    def __init__(self, n: int):
        self.n = n

    def __len__(self) -> int:
        return self.n


def _sized(r: dict, body: bytes, date: str) -> bytes:
    return record_bytes(r["page_id"], r["url"], body if r["holder"] is None else _Length(r["size"]), r["digest"], r["holder"], date)


def members(stream, step: int = 1 << 20) -> Iterator[bytes]:
    """The unpacked gzip members of a stream, one at a time."""
    data = b""
    while True:
        packed, parts = zlib.decompressobj(31), []
        while not packed.eof:
            data = data or stream.read(step)
            if not data:
                if parts:
                    raise ValueError("the archive ends inside a record")
                return
            parts.append(packed.decompress(data))
            data = packed.unused_data
        yield b"".join(parts)


def parse(record: bytes) -> tuple | None:
    """Columns of ``RECORD`` and the payload; None for other records.  Digests are verified."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    f = dict(line.split(": ", 1) for line in lines[1:])
    if f["WARC-Type"] not in ("response", "revisit"):
        return None
    block = rest[: int(f["Content-Length"])]
    if _base32(hashlib.sha1(block).hexdigest()) != f["WARC-Block-Digest"]:
        raise ValueError(f"wrong block digest in {f['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = base64.b32decode(f["WARC-Payload-Digest"][5:]).hex()
    if f["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"wrong payload in {f['WARC-Record-ID']}")
    page, holder = (None if x is None or x == "none" else int(x) for x in (f.get(k, "<::none>")[1:-1].split(":")[2] for k in ("WARC-Record-ID", "WARC-Refers-To")))
    url = unquote(f["WARC-Target-URI"]) if "WARC-Target-URI" in f else None
    return page, url, size, digest, f["WARC-Type"], holder, payload


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """``RECORD`` columns of every record in the files that the manifest lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for b in batches:
            for name, count in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                with store.open_input_stream(f"{path}/data/{name}", compression=None) as stream:
                    for m in members(stream):
                        if (r := parse(m)) is not None:
                            rows.append(r[:-1])
                if len(rows) != count:
                    raise ValueError(f"{name} holds {len(rows)} records, its manifest says {count}")
                columns = zip(*rows) if rows else [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], [x.split()[0] for x in RECORD.split(", ")])

    files = spark.read.parquet(f"{folder}/manifest").select("file", "records")
    return files.repartition(min(50_000, max(1, files.count()))).mapInArrow(run, RECORD)


def new_folder(spark: SparkSession) -> str:
    """An unused folder for archives in the shared folder, as a URI."""
    base = shared_dir(spark)
    return f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/warc-{uuid.uuid4().hex}"
