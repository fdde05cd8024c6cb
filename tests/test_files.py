"""NetCDF classic and Zarr as data sources and sinks: bytes by hand, round trips, pruned chunks, mesh datasets."""

import datetime as dt
import json
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.data import MeshArray, MeshDataset
from gridloom.operators.mesh import Mesh, Network
from gridloom.sources import arrays, datasets
from gridloom.sources.arrays import Column
from tests.test_mesh import FACES, XY, rows


def by_hand():
    """A version 1 file, byte by byte: dimensions t (records, 2 of them) and x (3); c(x) short, d(t) int and v(t, x) short by records."""
    i = lambda *v: struct.pack(f">{len(v)}i", *v)
    name = lambda s: i(len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    dims = i(10, 2) + name("t") + i(0) + name("x") + i(3)
    scale = i(12, 2) + name("scale_factor") + i(6, 1) + struct.pack(">d", 0.5) + name("_FillValue") + i(3, 1) + struct.pack(">hh", -1, 0)
    units = i(12, 1) + name("units") + i(2, 16) + b"days since 2000-"[:16]
    units = i(12, 1) + name("units") + i(2, 21) + b"days since 2000-01-02" + b"\0" * 3
    variables = lambda at: (i(11, 3) + name("c") + i(1, 1) + i(0, 0) + i(3, 8, at) + name("d") + i(1, 0) + units + i(4, 4, at + 8) + name("v") + i(2, 0, 1) + scale + i(3, 8, at + 12))
    head = lambda at: b"CDF\x01" + i(2) + dims + i(12, 1) + name("title") + i(2, 2) + b"hi\0\0" + variables(at)
    at = len(head(0))
    data = struct.pack(">3h", 7, 8, 9) + b"\0\0"
    for t, row in enumerate([(1, 2, 3), (4, -1, 6)]):
        data += i(t * 10) + struct.pack(">3h", *row) + b"\0\0"
    return head(at) + data


def test_records_read_from_bytes(spark, tmp_path):
    (tmp_path / "a.nc").write_bytes(by_hand())
    found, attrs = arrays.open_arrays(str(tmp_path / "a.nc"))
    assert attrs == {"title": "hi"} and {n: (v.dims, v.shape) for n, v in found.items()} == {"c": (("x",), (3,)), "d": (("t",), (2,)), "v": (("t", "x"), (2, 3))}
    read = lambda *n, **o: arrays.read_arrays(spark, f"file:{tmp_path}/a.nc", *n, **o)
    assert [tuple(r) for r in read("v", rows=1).orderBy("t", "x").collect()] == [(0, 0, 0.5), (0, 1, 1.0), (0, 2, 1.5), (1, 0, 2.0), (1, 1, None), (1, 2, 3.0)]
    assert [tuple(r) for r in read("v", nested=1).orderBy("t").collect()] == [(0, [0.5, 1.0, 1.5]), (1, [2.0, None, 3.0])]
    assert [r.c for r in read("c").orderBy("x").collect()] == [7, 8, 9]
    assert [r.d for r in read("d").orderBy("t").collect()] == [dt.datetime(2000, 1, 2), dt.datetime(2000, 1, 12)]
    with pytest.raises(Exception, match="no array"):
        read("z")
    with pytest.raises(ValueError, match="holds no arrays"):
        arrays.open_arrays(str(tmp_path))


def test_netcdf_bytes_round_trip(tmp_path):
    for kind in ("i8", "f4", "i2"):
        v = np.arange(12).reshape(3, 4).astype(kind)
        (tmp_path / kind).write_bytes(arrays.netcdf_file({"v": (("a", "b"), v, {"n": 3, "x": 0.5, "s": "text"}), "w": (("b",), v[0], {})}, {"k": [1, 2]}))
        found, attrs = arrays.netcdf_header(str(tmp_path / kind))
        assert attrs == {"k": [1, 2]} and found["v"].attrs == {"n": 3, "x": 0.5, "s": "text"}
        assert arrays.read_block("v", found["v"], [(1, 3), (2, 4)]).tolist() == v[1:, 2:].tolist()
        assert arrays.read_block("w", found["w"], [(0, 4)]).tolist() == v[0].tolist()
    assert (tmp_path / "i2").read_bytes()[:4] == b"CDF\x02" and (tmp_path / "i8").read_bytes()[:4] == b"CDF\x05"


@pytest.mark.parametrize("form", ["zarr", "netcdf"])
def test_chunks_round_trip_and_prune(spark, tmp_path, form):
    path = str(tmp_path / form)
    df = spark.range(35).select(F.floor(F.col("id") / 5).alias("a"), (F.col("id") % 5).alias("b"), F.when(F.col("id") != 7, F.col("id") * 1.5).alias("v"), F.array("id", F.col("id") + 1).alias("w")).where("a <> 4")
    arrays.write_arrays(df, path, {"a": 7, "b": 5}, {"v": Column("f8"), "w": Column("i4", {"_FillValue": -9}, ("k", 3))}, form, {"a": 2, "b": 2})
    with pytest.raises(ValueError):
        arrays.open_arrays(path)
    arrays.finish_arrays(path, {"title": "x"}, form)
    want = {(i // 5, i % 5): (None if i == 7 or i // 5 == 4 else i * 1.5) for i in range(35)}
    got = arrays.read_arrays(spark, path, "v")
    assert {(r.a, r.b): r.v if r.v is None or not math.isnan(r.v) else None for r in got.collect()} == want
    wide = arrays.read_arrays(spark, path, "w", nested=1)
    assert {(r.a, r.b): r.w for r in wide.collect()} == {(i // 5, i % 5): [None] * 3 if i // 5 == 4 else [i, i + 1, None] for i in range(35)}
    part = got.where("a >= 3 and a < 4 and b in (0, 1)")
    assert sorted((r.a, r.b, r.v) for r in part.collect()) == [(3, 0, 22.5), (3, 1, 24.0)]
    reader = arrays.ArrayReader(["v"], arrays.open_arrays(path)[0], arrays.ArraySource({"path": path, "variables": "v"}).schema(), 0, 1)
    whole = len(reader.partitions())
    list(reader.pushFilters([arrays.GreaterThanOrEqual(("a",), 3), arrays.LessThan(("a",), 4), arrays.In(("b",), (0, 1))]))
    assert (whole, len(reader.partitions())) == ((12, 1) if form == "zarr" else (4, 1))
    list(reader.pushFilters([arrays.EqualTo(("a",), 99)]))
    assert reader.partitions() == []
    with pytest.raises(ValueError, match="outside"):
        arrays.write_arrays(df, f"{path}-b", {"a": 3, "b": 5}, {"v": Column("f8")}, form)


def test_packed_chunks_of_others(spark, tmp_path):
    """Chunks in Fortran order, packed by zstd or not at all, with a slash in their names."""
    import zstandard

    for n, (name, compressor, pack) in enumerate([("a", {"id": "zstd"}, zstandard.compress), ("b", None, bytes), ("c", {"id": "zlib"}, zlib.compress)]):
        (tmp_path / name / "0").mkdir(parents=True)
        v = np.arange(6, dtype="<i2").reshape(2, 3) + n
        (tmp_path / name / "0" / "0").write_bytes(pack(v.tobytes(order="F")))
        (tmp_path / name / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [2, 4], "chunks": [2, 3], "dtype": "<i2", "compressor": compressor, "fill_value": 5, "order": "F", "filters": None, "dimension_separator": "/"}))
        (tmp_path / name / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": ["y", "x"]}))
    (tmp_path / ".zgroup").write_text("{}")
    got = arrays.read_arrays(spark, str(tmp_path), "a", "b", "c").orderBy("y", "x").collect()
    assert [(r.a, r.b, r.c) for r in got] == [(k, k + 1, k + 2) if x < 3 else (5, 5, 5) for y in range(2) for x in range(4) for k in [3 * y + x]]


@pytest.mark.parametrize("form", ["zarr", "netcdf"])
def test_datasets_of_meshes_and_networks(spark, tmp_path, form):
    nodes = spark.createDataFrame([(10 * i, float(x), float(y)) for i, (x, y) in enumerate(XY)], "node_id long, x double, y double")
    mesh = Mesh(nodes, spark.createDataFrame([(2 * i + 1, [10 * v for v in f]) for i, f in enumerate(FACES)], "face_id long, nodes array<long>"))
    line = Network(spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 2.0)], "node_id long, x double, y double"), spark.createDataFrame([(0, 0, 1)], "edge_id long, a long, b long"), projected=False)
    times = [dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 3, 6)]
    values = [(2 * i + 1, t, float(i) + k) for i in range(4) for k, t in enumerate(times) if (i, k) != (2, 1)]
    data = MeshDataset({"h": MeshArray(mesh, "face", spark.createDataFrame(values, "id long, time timestamp_ntz, value double"), "h"), "kind": MeshArray(line, "node", spark.createDataFrame([(1, 7)], "id long, value int"), "kind")})
    datasets.write_dataset(data, path := str(tmp_path / form), form, {"mesh2d_nFaces": 3})
    again = datasets.open_dataset(spark, path)
    assert sorted(again.names) == ["mesh2d", "network1d"] and again["h"].grid.projected and not again["kind"].grid.projected
    assert rows(again["h"].grid.nodes, "node_id") == [(i, float(x), float(y)) for i, (x, y) in enumerate(XY)]
    assert [r.nodes for r in again["h"].grid.faces.orderBy("face_id").collect()] == FACES
    assert {(r.id, r.time): r.value for r in again["h"].df.where("value is not null and not isnan(value)").collect()} == {((i - 1) // 2, t): v for i, t, v in values}
    assert [tuple(r) for r in again["kind"].df.orderBy("id").collect()] == [(0, None), (1, 7)]
    with pytest.raises(ValueError, match="no mesh topology"):
        arrays.write_arrays(spark.createDataFrame([(0, 1.0)], "a long, v double"), f"{path}-n", {"a": 1}, {"v": Column("f8")}, form)
        arrays.finish_arrays(f"{path}-n", {}, form)
        datasets.open_dataset(spark, f"{path}-n")
