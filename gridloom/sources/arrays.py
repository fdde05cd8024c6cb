"""Arrays in files as tables: NetCDF classic (all three versions) and Zarr version 2.

A table of arrays has a ``long`` column for each dimension, the place along it, and one column for each
variable on these dimensions.  ``read_arrays`` is a Python data source: the schema comes from the file's
header, a partition is a chunk (Zarr) or a run of rows (NetCDF), and filters on places leave out what they
do not need before anything is read.  ``write_arrays`` deals rows to chunks with one shuffle; a task writes
its chunks whole, and the description of the arrays comes last, so that unfinished folders hold none.

Fill values are null; scales, offsets and times since a date are decoded.  NetCDF in a folder is for each table one file a
chunk along the first dimension, each complete by itself.  Chunks may be raw or packed by zlib, gzip, bz2,
lzma or zstd; others raise.  Paths may have any scheme that Arrow's file systems know.
"""

from __future__ import annotations

import bz2
import gzip
import json
import lzma
import math
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from itertools import product

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

#: Types of NetCDF classic, by their codes.
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
#: Tags of the lists in a header.
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
#: Microseconds of the units of times.
UNITS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}
ROWS = 1 << 16


@dataclass(frozen=True)
class Stored:
    """An array in files: what it is, and where its numbers are."""

    dims: tuple[str, ...]
    shape: tuple[int, ...]
    dtype: str
    attrs: dict[str, object]
    chunks: tuple[int, ...]
    place: dict[str, object] = field(default_factory=dict)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _bytes(path: str) -> bytes | None:
    system, at = file_system(path)
    if system.get_file_info(at).type != fs.FileType.File:
        return None
    with system.open_input_file(at) as f:
        return f.read()


def _put(path: str, data: bytes) -> None:
    """A file written under another name first: a task that is run twice leaves one whole file."""
    system, at = file_system(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    with system.open_output_stream(temporary := f"{at}.{uuid.uuid4().hex}") as f:
        f.write(data)
    system.move(temporary, at)


# NetCDF classic


class _Header:
    """Reads a header's parts one after another, fetching more of the file as needed."""

    def __init__(self, file):
        self.file, self.data, self.at, self.wide = file, b"", 0, False

    def take(self, n: int) -> bytes:
        while len(self.data) < self.at + n:
            more = self.file.read(max(1 << 16, n))
            if not more:
                raise ValueError("the header ends early")
            self.data += more
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        return struct.unpack(">q" if self.wide else ">i", self.take(8 if self.wide else 4))[0]

    def tag(self) -> int:
        return struct.unpack(">i", self.take(4))[0]

    def padded(self, n: int) -> bytes:
        return self.take(n + -n % 4)[:n]

    def name(self) -> str:
        return self.padded(self.number()).decode()

    def attributes(self) -> dict[str, object]:
        _, n = self.tag(), self.number()
        out = {}
        for _ in range(n):
            name, kind, size = self.name(), np.dtype(TYPES[self.tag()]), self.number()
            raw = self.padded(size * kind.itemsize)
            values = raw.decode(errors="replace").rstrip("\0") if kind == "S1" else np.frombuffer(raw, kind).tolist()
            out[name] = values[0] if isinstance(values, list) and len(values) == 1 else values
        return out


def netcdf_header(path: str) -> tuple[dict[str, Stored], dict[str, object]]:
    """Variables and attributes of a NetCDF classic file."""
    system, at = file_system(path)
    with system.open_input_file(at) as f:
        h = _Header(f)
        magic = h.take(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise ValueError(f"{path} is not NetCDF classic")
        h.wide = magic[3] == 5
        records = h.number()
        _, n = h.tag(), h.number()
        dims = [(h.name(), h.number()) for _ in range(n)]
        attrs = h.attributes()
        _, n = h.tag(), h.number()
        found = []
        for _ in range(n):
            name = h.name()
            ids = [h.number() for _ in range(h.number())]
            own, kind = h.attributes(), TYPES[h.tag()]
            h.number()  # the size, which large variables do not fit
            found.append((name, ids, own, kind, struct.unpack(">i" if magic[3] == 1 else ">q", h.take(4 if magic[3] == 1 else 8))[0]))
    inner = {name: math.prod(dims[i][1] for i in ids if dims[i][1]) * np.dtype(kind).itemsize for name, ids, _, kind, _ in found}
    recorded = [name for name, ids, *_ in found if ids and not dims[ids[0]][1]]
    step = sum(inner[n] + -inner[n] % 4 for n in recorded) if len(recorded) > 1 else sum(inner[n] for n in recorded)
    out = {}
    for name, ids, own, kind, begin in found:
        shape = tuple(dims[i][1] or records for i in ids)
        row = inner[name] if name in recorded else inner[name] // max(1, shape[0]) if shape else inner[name]
        out[name] = Stored(tuple(dims[i][0] for i in ids), shape, kind, own, shape, {"form": "netcdf", "path": path, "begin": begin, "row": row, "step": step if name in recorded else row})
    return out, attrs


def netcdf_file(variables: dict[str, tuple[tuple[str, ...], np.ndarray, dict[str, object]]], attrs: dict[str, object]) -> bytes:
    """A NetCDF classic file of whole arrays; 64-bit integers make it version 5, else it is version 2."""
    wide = any(v.dtype.kind in "iu" and v.dtype.itemsize == 8 or v.dtype.kind == "u" for _, v, _ in variables.values())
    codes = {np.dtype(t).newbyteorder("="): c for c, t in TYPES.items()}
    number = lambda n: struct.pack(">q" if wide else ">i", n)
    tag = lambda n: struct.pack(">i", n)
    padded = lambda b: b + b"\0" * (-len(b) % 4)
    name = lambda s: number(len(s.encode())) + padded(s.encode())
    lengths: dict[str, int] = {}
    for dims, v, _ in variables.values():
        lengths |= dict(zip(dims, v.shape))
    order = list(lengths)

    def attribute(value: object) -> bytes:
        if isinstance(value, str):
            return tag(2) + number(len(value.encode())) + padded(value.encode())
        v = np.atleast_1d(np.asarray(value))
        v = v.astype(np.float64 if v.dtype.kind == "f" and v.dtype.itemsize > 4 else v.dtype)
        if v.dtype == np.int64 and not wide:
            v = v.astype(np.int32)
        code = codes[v.dtype.newbyteorder("=")]
        return tag(code) + number(v.size) + padded(v.astype(TYPES[code]).tobytes())

    listed = lambda kind, items: (tag(kind) if items else tag(0)) + number(len(items)) + b"".join(items)
    attributes = lambda a: listed(ATTRIBUTE, [name(k) + attribute(v) for k, v in a.items()])
    head = b"CDF" + bytes([5 if wide else 2]) + number(0) + listed(DIMENSION, [name(d) + number(lengths[d]) for d in order]) + attributes(attrs)
    parts = []
    for n, (dims, v, own) in variables.items():
        code = codes[v.dtype.newbyteorder("=")]
        data = padded(v.astype(TYPES[code]).tobytes())
        text = name(n) + number(len(dims)) + b"".join(number(order.index(d)) for d in dims) + attributes(own) + tag(code) + number(len(data))
        parts.append((text, data))
    begin = len(head) + 4 + len(number(0)) + sum(len(t) + 8 for t, _ in parts)
    texts, blocks = [], []
    for text, data in parts:
        texts.append(text + struct.pack(">q", begin))
        blocks.append(data)
        begin += len(data)
    return head + listed(VARIABLE, texts) + b"".join(blocks)


# Zarr


def _unpacked(data: bytes, compressor: dict | None) -> bytes:
    kind = compressor["id"] if compressor else None
    if kind is None:
        return data
    known = {"zlib": zlib.decompress, "gzip": gzip.decompress, "bz2": bz2.decompress, "lzma": lzma.decompress}
    if kind == "zstd":
        with pa.input_stream(pa.BufferReader(data), compression="zstd") as f:
            return f.read()
    if kind not in known:
        raise ValueError(f"chunks packed by {kind} cannot be read")
    return known[kind](data)


def _zarr(folder: str) -> tuple[dict[str, Stored], dict[str, object]]:
    system, at = file_system(folder)
    out = {}
    for item in system.get_file_info(fs.FileSelector(at)):
        if item.type == fs.FileType.Directory and (raw := _bytes(f"{folder}/{item.base_name}/.zarray")):
            a, attrs = json.loads(raw), json.loads(_bytes(f"{folder}/{item.base_name}/.zattrs") or b"{}")
            if a.get("filters"):
                raise ValueError(f"filters of {item.base_name} cannot be read")
            dims = attrs.pop("_ARRAY_DIMENSIONS", [f"{item.base_name}_{k}" for k in range(len(a["shape"]))])
            place = {"form": "zarr", "path": f"{folder}/{item.base_name}", "compressor": a["compressor"], "fill": a["fill_value"], "order": a["order"], "separator": a.get("dimension_separator", ".")}
            out[item.base_name] = Stored(tuple(dims), tuple(a["shape"]), a["dtype"], attrs, tuple(a["chunks"]), place)
    return out, json.loads(_bytes(f"{folder}/.zattrs") or b"{}")


# any form


def open_arrays(path: str) -> tuple[dict[str, Stored], dict[str, object]]:
    """Arrays and attributes of a NetCDF file, a folder of them that ``write_arrays`` wrote, or a Zarr folder."""
    path = path.rstrip("/")
    system, at = file_system(path)
    if system.get_file_info(at).type == fs.FileType.File:
        return netcdf_header(path)
    if raw := _bytes(f"{path}/layout.json"):
        layout = json.loads(raw)
        return {n: Stored(tuple(v["dims"]), tuple(v["shape"]), v["dtype"], v["attrs"], tuple(v["chunks"]), {"form": "parts", "path": path, "table": v["table"]}) for n, v in layout["variables"].items()}, layout["attrs"]
    if _bytes(f"{path}/.zgroup"):
        return _zarr(path)
    raise ValueError(f"{path} holds no arrays")


def read_block(name: str, v: Stored, box: list[tuple[int, int]]) -> np.ndarray:
    """The numbers of a box of places: one chunk, or rows of a NetCDF file."""
    form, path = v.place["form"], str(v.place["path"])
    if form == "parts":
        k = box[0][0] // v.chunks[0] if box else 0
        part = netcdf_header(file := f"{path}/{v.place['table']}/{k:06d}.nc")[0][name]
        return read_block(name, Stored(part.dims, part.shape, part.dtype, part.attrs, part.chunks, part.place | {"path": file}), [(lo - k * v.chunks[0], hi - k * v.chunks[0]) if i == 0 else (lo, hi) for i, (lo, hi) in enumerate(box)])
    if form == "netcdf":
        system, at = file_system(path)
        lo, hi = box[0] if box else (0, 1)
        row, step = int(v.place["row"]), int(v.place["step"])
        with system.open_input_file(at) as f:
            if row == step:
                f.seek(int(v.place["begin"]) + lo * row)
                raw = f.read((hi - lo) * row)
            else:  # records lie among those of other variables
                parts = []
                for k in range(lo, hi):
                    f.seek(int(v.place["begin"]) + k * step)
                    parts.append(f.read(row))
                raw = b"".join(parts)
        out = np.frombuffer(raw, v.dtype).reshape((hi - lo, *v.shape[1:]) if box else ())
        return out[tuple([slice(None)] + [slice(a, b) for a, b in box[1:]])] if box else out
    key = str(v.place["separator"]).join(str(lo // c) for (lo, _), c in zip(box, v.chunks)) or "0"
    raw = _bytes(f"{path}/{key}")
    if raw is None:
        fill = v.place["fill"]
        block = np.full(v.chunks, float(fill) if isinstance(fill, str) else 0 if fill is None else fill, v.dtype)
    else:
        block = np.frombuffer(_unpacked(raw, v.place["compressor"]), v.dtype).reshape(v.chunks, order=str(v.place["order"]))
    return block[tuple(slice(lo % c, lo % c + hi - lo) for (lo, hi), c in zip(box, v.chunks))]


def _since(attrs: dict[str, object]) -> tuple[int, int] | None:
    """Microseconds of the unit and of the epoch of a time variable."""
    m = re.fullmatch(r"\s*(\w+?)s?\s+since\s+(\S+)(?:[ T](\S+))?.*", str(attrs.get("units", "")))
    if not m or m[1].lower() not in UNITS or str(attrs.get("calendar", "standard")) not in ("standard", "gregorian", "proleptic_gregorian"):
        return None
    start = datetime.fromisoformat(f"{m[2]}T{(m[3] or '00:00:00').removesuffix('Z')}").replace(tzinfo=timezone.utc)
    return UNITS[m[1].lower()], round(start.timestamp() * 1_000_000)


def _kind(v: Stored) -> pa.DataType:
    d = np.dtype(v.dtype)
    if d.kind == "S":
        return pa.string()
    if _since(v.attrs):
        return pa.timestamp("us")
    if d.kind == "f" or "scale_factor" in v.attrs or "add_offset" in v.attrs:
        return pa.float64() if d.itemsize > 4 or d.kind != "f" else pa.float32()
    return pa.from_numpy_dtype(d.newbyteorder("=")) if d.kind == "i" else pa.int64()


def decoded(block: np.ndarray, v: Stored) -> pa.Array:
    """A block as one flat column: fill values null, scales, offsets and times applied."""
    if np.dtype(v.dtype).kind == "S":
        rows = block.reshape(-1, v.shape[-1]) if v.shape else block.reshape(1, 1)
        return pa.array([b"".join(r.tolist()).rstrip(b"\0 ").decode(errors="replace") for r in rows], pa.string())
    flat = np.ascontiguousarray(block).reshape(-1)
    flat = flat.astype(flat.dtype.newbyteorder("="))
    gone = np.zeros(len(flat), bool)
    for key in ("_FillValue", "missing_value"):
        if key in v.attrs:
            fill = float(v.attrs[key]) if isinstance(v.attrs[key], str) else v.attrs[key]
            gone |= np.isnan(flat) if isinstance(fill, float) and math.isnan(fill) else flat == fill
    if (since := _since(v.attrs)) is not None:
        unit, start = since
        gone |= np.isnan(flat) if flat.dtype.kind == "f" else False
        steps = np.where(gone, 0, flat).astype(np.float64 if flat.dtype.kind == "f" else np.int64) * unit
        return pa.array(steps.round().astype(np.int64) + start, pa.int64(), mask=gone).cast(pa.timestamp("us"))
    if "scale_factor" in v.attrs or "add_offset" in v.attrs:
        flat = flat * float(v.attrs.get("scale_factor", 1)) + float(v.attrs.get("add_offset", 0))
    return pa.array(flat, mask=gone if gone.any() else None).cast(_kind(v))


@dataclass
class Box(InputPartition):
    bounds: list[tuple[int, int]]


class ArrayReader(DataSourceReader):
    def __init__(self, names: list[str], arrays: dict[str, Stored], schema: StructType, nested: int, rows: int):
        self.names, self.arrays, self.nested, self.rows = names, arrays, nested, rows
        self.schema = to_arrow_schema(schema)
        self.first = arrays[names[0]]
        self.bounds = [(0, n) for n in self.first.shape[: self.depth]]

    @property
    def depth(self) -> int:
        """Dimensions that are columns: all, or without those inside of array columns or strings."""
        return len(self.first.shape) - self.nested - (np.dtype(self.first.dtype).kind == "S" and len(self.first.shape) > 0)

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            at = [k for k, d in enumerate(self.first.dims[: self.depth]) if (d,) == getattr(f, "attribute", None)]
            if at:
                lo, hi = self.bounds[at[0]]
                if isinstance(f, EqualTo):
                    lo, hi = max(lo, f.value), min(hi, f.value + 1)
                elif isinstance(f, GreaterThan):
                    lo = max(lo, f.value + 1)
                elif isinstance(f, GreaterThanOrEqual):
                    lo = max(lo, f.value)
                elif isinstance(f, LessThan):
                    hi = min(hi, f.value)
                elif isinstance(f, LessThanOrEqual):
                    hi = min(hi, f.value + 1)
                elif isinstance(f, In) and len(f.value):
                    lo, hi = max(lo, min(f.value)), min(hi, max(f.value) + 1)
                self.bounds[at[0]] = lo, hi
            yield f  # Spark looks at the rows again: bounds only leave out what cannot match

    def partitions(self) -> list[Box]:
        if any(lo >= hi for lo, hi in self.bounds):
            return []
        v, steps = self.first, []
        for k, (lo, hi) in enumerate(self.bounds):
            size = v.chunks[k] if v.place["form"] != "netcdf" else max(1, self.rows // max(1, math.prod(v.shape[1:]))) if k == 0 else v.shape[k]
            steps.append([(max(lo, c), min(hi, c + size)) for c in range(lo // size * size, hi, size)])
        return [Box(list(b)) for b in product(*steps)]

    def read(self, partition: Box) -> Iterator[pa.RecordBatch]:
        inner = [(0, n) for n in self.first.shape[self.depth :]]
        columns: list[pa.Array] = []
        shape = [hi - lo for lo, hi in partition.bounds]
        for k, (lo, _) in enumerate(partition.bounds):
            at = np.arange(lo, lo + shape[k]).reshape([-1 if i == k else 1 for i in range(len(shape))])
            columns.append(pa.array(np.broadcast_to(at, shape).reshape(-1), pa.int64()))
        for n in self.names:
            flat = decoded(read_block(n, self.arrays[n], partition.bounds + inner), self.arrays[n])
            if self.nested:
                width = math.prod(self.first.shape[self.depth :])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), flat)
            columns.append(flat)
        table = pa.table(columns, schema=pa.schema([f.with_nullable(True) for f in self.schema]))
        yield from table.to_batches(ROWS)


class ArraySource(DataSource):
    """``format("arrays")`` with the options ``path``, ``variables``, ``nested`` and ``rows``."""

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def _found(self) -> tuple[list[str], dict[str, Stored], int]:
        arrays, _ = open_arrays(self.options["path"])
        names = [n.strip() for n in self.options["variables"].split(",")]
        for n in names:
            if n not in arrays:
                raise ValueError(f"there is no array {n}; known are {', '.join(sorted(arrays))}")
            if (arrays[n].dims, arrays[n].chunks) != (arrays[names[0]].dims, arrays[names[0]].chunks):
                raise ValueError("arrays of one table have the same dimensions and chunks")
        return names, {n: arrays[n] for n in names}, int(self.options.get("nested", "0"))

    def schema(self) -> StructType:
        names, arrays, nested = self._found()
        reader = ArrayReader(names, arrays, StructType(), nested, 1)
        kinds = [pa.list_(_kind(arrays[n])) if nested else _kind(arrays[n]) for n in names]
        return from_arrow_schema(pa.schema([(d, pa.int64()) for d in reader.first.dims[: reader.depth]] + list(zip(names, kinds))), prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> DataSourceReader:
        names, arrays, nested = self._found()
        return ArrayReader(names, arrays, schema, nested, int(self.options.get("rows", 1 << 20)))


def read_arrays(spark: SparkSession, path: str, *variables: str, nested: int = 0, rows: int = 1 << 20) -> DataFrame:
    """``(*dimensions, *variables)``; the last ``nested`` dimensions make array columns.  ``rows``: numbers a partition of NetCDF."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArraySource)
    return spark.read.format("arrays").option("path", path).option("variables", ",".join(variables)).option("nested", nested).option("rows", rows).load()


# writing


@dataclass(frozen=True)
class Column:
    """A column to write: its type, the size of its arrays if it has some with the name of their dimension, and attributes."""

    dtype: str
    attrs: dict[str, object] = field(default_factory=dict)
    inner: tuple[str, int] | None = None


def _filled(c: Column) -> object:
    fill = c.attrs.get("_FillValue", math.nan if np.dtype(c.dtype).kind == "f" else None)
    if fill is None:
        raise ValueError("a whole number needs a _FillValue")
    return fill


def write_arrays(df: DataFrame, path: str, dims: dict[str, int], columns: dict[str, Column], form: str = "zarr", chunks: dict[str, int] | None = None) -> None:
    """Write ``(*dims, *columns)`` as arrays of the given sizes; places without a row, and nulls, get the fill value.

    Several tables can be written to one folder; ``finish_arrays`` completes it.  A chunk, at most ``chunks``
    places along each dimension (a million numbers by default), is gathered in one task; NetCDF has chunks
    along the first dimension only.
    """
    if form not in ("zarr", "netcdf"):
        raise ValueError("the form is zarr or netcdf")
    names = list(dims)
    rest = math.prod(list(dims.values())[1:]) * max((c.inner[1] for c in columns.values() if c.inner), default=1)
    sizes = {d: max(1, min(n, (chunks or {}).get(d, max(1, (1 << 20) // max(1, rest)) if k == 0 else n))) for k, (d, n) in enumerate(dims.items())}
    if form == "netcdf":
        sizes = {d: size if d == names[0] else max(1, dims[d]) for d, size in sizes.items()}
    keys = [f"_c{k}" for k in range(len(names))]

    def put(key: tuple, rows: pa.Table) -> pa.Table:
        at = [k.as_py() for k in key]
        low = [a * sizes[d] for a, d in zip(at, names)]
        high = [min(lo + sizes[d], dims[d]) for lo, d in zip(low, names)]
        shape = [sizes[d] if form == "zarr" else hi - lo for d, lo, hi in zip(names, low, high)]
        where = tuple(rows.column(d).to_numpy() - lo for d, lo in zip(names, low))
        blocks = {}
        for n, c in columns.items():
            inner = [c.inner[1]] if c.inner else []
            block = np.full([*shape, *inner], _filled(c), c.dtype)
            values = rows.column(n).combine_chunks()
            if c.inner:
                flat = values.flatten()
                lengths = values.value_lengths().fill_null(0).to_numpy()
                row = np.repeat(np.arange(len(lengths)), lengths)
                pos = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                ok = flat.is_valid().to_numpy(zero_copy_only=False)
                block[tuple(w[row[ok]] for w in where) + (pos[ok],)] = flat.drop_null().to_numpy(zero_copy_only=False)
            else:
                ok = values.is_valid().to_numpy(zero_copy_only=False)
                block[tuple(w[ok] for w in where)] = values.drop_null().to_numpy(zero_copy_only=False)
            blocks[n] = ((*names, c.inner[0]) if c.inner else tuple(names), block, c.attrs)
        if form == "netcdf":
            _put(f"{path}/{next(iter(columns))}/{at[0]:06d}.nc", netcdf_file(blocks, {"first_row": low[0]}))
        else:
            for n, (_, block, _) in blocks.items():
                _put(f"{path}/{n}/{'.'.join(map(str, at + [0] * bool(columns[n].inner)))}", zlib.compress(block.tobytes(), 1))
        return pa.table({"n": pa.array([rows.num_rows], pa.int64())})

    dealt = df.select(*names, *columns, *[F.floor(F.col(d) / sizes[d]).alias(k) for d, k in zip(names, keys)])
    inside = [F.col(d).between(0, n - 1) for d, n in dims.items()]
    beyond = dealt.where(~F.coalesce(*[F.lit(True) if not inside else inside[0]], F.lit(False)) if len(inside) < 2 else F.expr(" or ".join(f"coalesce(`{d}` not between 0 and {n - 1}, true)" for d, n in dims.items())))
    if beyond.limit(1).count():
        raise ValueError("places outside of the dimensions")
    if form == "netcdf":  # a chunk without a row is a file too
        empty = df.sparkSession.range(-(-dims[names[0]] // sizes[names[0]])).select(F.lit(None).cast("long").alias(names[0]), F.col("id").alias(keys[0]))
        dealt = dealt.unionByName(empty, allowMissingColumns=True).na.fill(0, keys[1:])
        inner_put = put
        put = lambda key, rows: inner_put(key, rows.filter(rows.column(names[0]).is_valid()))
    dealt.groupBy(*keys).applyInArrow(put, "n long").agg(F.sum("n")).collect()
    for n, c in columns.items():
        shape = [*dims.values(), *([c.inner[1]] if c.inner else [])]
        size = [*sizes.values(), *([c.inner[1]] if c.inner else [])]
        fill = _filled(c)
        about = {"table": next(iter(columns)), "dims": [*names, *([c.inner[0]] if c.inner else [])], "shape": shape, "chunks": size, "dtype": np.dtype(c.dtype).str if form == "zarr" else c.dtype, "attrs": c.attrs | ({} if np.dtype(c.dtype).kind == "f" else {"_FillValue": fill})}
        _describe(path, n, about, form, fill)


def _describe(path: str, name: str, about: dict, form: str, fill: object) -> None:
    if form == "netcdf":
        _put(f"{path}/variables/{name}.json", json.dumps(about).encode())
        return
    fill = "NaN" if isinstance(fill, float) and math.isnan(fill) else fill
    array = {"zarr_format": 2, "shape": about["shape"], "chunks": about["chunks"], "dtype": about["dtype"], "compressor": {"id": "zlib", "level": 1}, "fill_value": fill, "order": "C", "filters": None}
    _put(f"{path}/{name}/.zattrs", json.dumps(about["attrs"] | {"_ARRAY_DIMENSIONS": about["dims"]}).encode())
    _put(f"{path}/{name}/.zarray", json.dumps(array).encode())


def write_scalar(path: str, name: str, attrs: dict[str, object], form: str = "zarr") -> None:
    """A variable without dimensions, which carries attributes."""
    if form == "netcdf":
        _put(f"{path}/{name}/000000.nc", netcdf_file({name: ((), np.zeros((), np.int32), attrs)}, {}))
    else:
        _put(f"{path}/{name}/0", zlib.compress(np.zeros(1, "<i4").tobytes()))
    _describe(path, name, {"table": name, "dims": [], "shape": [], "chunks": [], "dtype": "<i4" if form == "zarr" else "i4", "attrs": attrs}, form, 0)


def finish_arrays(path: str, attrs: dict[str, object], form: str = "zarr") -> None:
    """Complete a folder: from now on it can be opened."""
    if form == "zarr":
        _put(f"{path}/.zattrs", json.dumps(attrs).encode())
        _put(f"{path}/.zgroup", b'{"zarr_format": 2}')
        return
    system, at = file_system(f"{path}/variables")
    found = {i.base_name.removesuffix(".json"): json.loads(_bytes(f"{path}/variables/{i.base_name}")) for i in system.get_file_info(fs.FileSelector(at))}
    _put(f"{path}/layout.json", json.dumps({"attrs": attrs, "variables": found}).encode())
