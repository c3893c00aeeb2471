import struct
import zlib

import brute
import numpy as np
import pytest
from brute import found, network
from pyspark.sql import functions as F

from thalweg.network import GridHeader, Network
from thalweg.sources import geotiff
from thalweg.sources.interval_rasters import _publish, aligned, dfs_interval_geotiff
from thalweg.sources.outlets import outlets_of, read_outlets
from thalweg.sources.synthetic import synthetic_d8

DEGREES = (10.0, 0.5, 0.0, 50.0, 0.0, -0.5)


def frame(spark, values, kind="long"):
    flat = np.asarray(values).ravel()
    return spark.createDataFrame([(k, v.item()) for k, v in enumerate(flat)], f"idx long, value {kind}")


def grid(df, n):
    out = np.empty(n)
    for k, v in df.collect():
        out[k] = v
    return out


@pytest.mark.parametrize(("dtype", "nodata", "compression"), [("uint8", 247, "deflate"), ("int32", -1, "zstd"), ("float32", -9999.0, "deflate"), ("int64", -1, "deflate"), ("uint16", 65535, "zstd")])
def test_round_trip(spark, tmp_path, dtype, nodata, compression):
    values = np.arange(600 * 7).reshape(600, 7) % 200
    header = GridHeader(7, 600, dtype, nodata, DEGREES, "EPSG:4326", True)
    path = str(tmp_path / "a.tif")
    cells = frame(spark, values.astype(float if dtype.startswith("f") else int), "double" if dtype.startswith("f") else "long").filter("idx <> 5")
    geotiff.write_geotiff(cells, header, path, compression)
    got, head = geotiff.read_geotiff(spark, path)
    want = values.ravel().astype(float)
    want[5] = nodata
    assert np.array_equal(grid(got, 4200), want)
    assert (head.shape, head.dtype, head.nodata, head.transform, head.crs, head.latlon) == ((600, 7), dtype, nodata, DEGREES, "EPSG:4326", True)
    with pytest.raises(FileExistsError):
        geotiff.write_geotiff(cells, header, path)
    assert [p.name for p in tmp_path.iterdir()] == ["a.tif"]


def test_metres_and_no_coordinates(spark, tmp_path):
    for crs, latlon in (("EPSG:32633", False), ("", True)):
        header = GridHeader(2, 1, "uint8", 247, (0.0, 30.0, 0.0, 60.0, 0.0, -30.0), crs, latlon)
        path = str(tmp_path / f"m{latlon}.tif")
        geotiff.write_geotiff(frame(spark, [1, 0]), header, path)
        _, head = geotiff.read_geotiff(spark, path)
        assert (head.crs, head.latlon) == (crs, latlon)


def tiff(path, tags, blocks, order="<"):
    """A small classic file: tags as (tag, kind, values), strips of bytes."""
    at, data = 8, b""
    where = []
    for b in blocks:
        where.append(at + len(data))
        data += b
    tags = [*tags, (273, 4, where), (279, 4, [len(b) for b in blocks])]
    first = at + len(data)
    extra_at, extra, entries = first + 2 + 12 * len(tags) + 4, b"", b""
    for tag, kind, values in sorted(tags):
        raw = values if kind == 2 else struct.pack(order + geotiff.FIELDS[kind] * len(values), *values)
        if len(raw) > 4:
            cell, extra = struct.pack(order + "I", extra_at + len(extra)), extra + raw
        else:
            cell = raw.ljust(4, b"\0")
        entries += struct.pack(order + "HHI", tag, kind, len(values)) + cell
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, first)
    path.write_bytes(head + data + struct.pack(order + "H", len(tags)) + entries + struct.pack(order + "I", 0) + extra)
    return str(path)


def base_tags(w, h, bits=8, kind=1, compression=1, rows=None, **more):
    out = [(256, 4, [w]), (257, 4, [h]), (258, 3, [bits] * more.get("samples", 1)), (259, 3, [compression]), (277, 3, [more.get("samples", 1)]), (278, 4, [rows or h]), (339, 3, [kind])]
    return out + more.get("tags", [])


@pytest.mark.parametrize("order", ["<", ">"])
def test_strips_byte_orders_and_differences(spark, tmp_path, order):
    values = np.arange(12, dtype=np.uint16).reshape(4, 3) * 7
    steps = np.diff(values, axis=1, prepend=np.uint16(0)).astype(np.dtype(np.uint16).newbyteorder(order))
    blocks = [zlib.compress(steps[k : k + 3].tobytes()) for k in (0, 3)]
    path = tiff(tmp_path / "s.tif", base_tags(3, 4, 16, compression=8, rows=3, tags=[(317, 3, [2])]), blocks, order)
    got, head = geotiff.read_geotiff(spark, path)
    assert np.array_equal(grid(got, 12), values.ravel()) and head.nodata == 247.0 and head.latlon


def test_lzw():
    # the codes 256, 1, 2, 258 (1 2), 260 (1 2 1), 257, in nine bits each
    bits = "".join(f"{c:09b}" for c in (256, 1, 2, 258, 260, 257))
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert geotiff._lzw(data) == bytes([1, 2, 1, 2, 1, 2, 1])


def test_an_alpha_sample_is_a_mask(spark, tmp_path):
    block = np.array([[[1, 255], [0, 0]], [[4, 255], [0, 255]]], np.uint8)
    path = tiff(tmp_path / "a.tif", base_tags(2, 2, samples=2, tags=[(338, 3, [2])]), [block.tobytes()])
    got, _ = geotiff.read_geotiff(spark, path)
    assert grid(got, 4).tolist() == [1, 247, 4, 0]


def test_rasters_that_are_refused(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        geotiff.read_geotiff(spark, str(tmp_path / "none.tif"))
    (tmp_path / "text.tif").write_text("no raster")
    with pytest.raises(ValueError, match="could not be read"):
        geotiff.read_geotiff(spark, str(tmp_path / "text.tif"))
    turned = [(34264, 12, [1, 0.1, 0, 0, 0, -1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1])]
    grads = [(34735, 3, [1, 1, 0, 2, 1024, 0, 1, 2, 2054, 0, 1, 9105])]
    feet = [(34735, 3, [1, 1, 0, 2, 1024, 0, 1, 1, 3076, 0, 1, 9003])]
    for tags, said in ((turned, "rotated"), (grads, "degrees"), (feet, "metres")):
        with pytest.raises(ValueError, match=said):
            geotiff.read_geotiff(spark, tiff(tmp_path / f"{said}.tif", base_tags(1, 1, tags=tags), [b"\0"]))


def test_a_network_from_a_raster(spark, tmp_path):
    path = str(tmp_path / "d8.tif")
    geotiff.write_geotiff(frame(spark, [1, 1, 0, 247]), GridHeader(2, 2, "uint8", 247, DEGREES, "EPSG:4326", True), path)
    net = Network.from_raster(spark, path)
    assert found(net.edges, "ds") == {0: 1, 1: 1, 2: 2} and net.crs == "EPSG:4326"


# outlets

HEAD = "id,basin_cell_count,local_outlet_col,local_outlet_row\n"


def test_outlets(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes(HEAD.replace("\n", "\r\n").encode() + b"a b,7,+2,0001\r\n\r\nx\"y,3," + b"0" * 4300 + b"1,0,more\r\n")
    assert found(read_outlets(spark, str(path), 5, 4), "cells") == {6: 7, 1: 3}
    assert set(found(outlets_of(spark, [0, 1], [1, 2], 5, 4).withColumn("x", F.lit(1)), "x")) == {1, 6}
    for bad in (([0], [1, 2]), ([9], [0]), ([0.5], [0])):
        with pytest.raises(ValueError):
            outlets_of(spark, *bad, 5, 4)


@pytest.mark.parametrize(
    ("body", "said"),
    [(b"1,2", "line 2 .*too few"), (b"1,x,0,0", "line 2 .*basin_cell_count"), (b"1,2,0,0\n1,9223372036854775808,0,0", "line 3 .*basin_cell_count"), (b"1,2,0,7", "line 2"), (b"1, 2,0,0", "integer"), (b'1,"2",0,0', "integer"), (b"1,1_0,0,0", "integer"), ("1,٣,0,0".encode(), "integer"), (b"1,2\0,0,0", "integer"), (b"1,2,0,0\r\r", "integer"), (b"\n\n1,2,a,0", "line 4 .*local_outlet_col")],
)
def test_outlets_that_are_refused(spark, tmp_path, body, said):
    path = tmp_path / "t.csv"
    path.write_bytes(HEAD.encode() + body + b"\n")
    with pytest.raises(ValueError, match=said):
        read_outlets(spark, str(path), 5, 4)
    path.write_bytes(b"a,b\n" + body)
    with pytest.raises(ValueError, match="no column"):
        read_outlets(spark, str(path), 5, 4)


# the interval job

def test_interval_rasters(spark, tmp_path):
    ds, shape = brute.terrain(9, 8, seed=1, holes=3), (9, 8)
    net = network(spark, ds, shape)
    at = lambda name: str(tmp_path / name)
    head = GridHeader(8, 9, "int32", -1, DEGREES, "EPSG:4326", True)
    geotiff.write_geotiff(net.ordering("dfs", "u2d").select("idx", F.col("pos").alias("value")), head, at("seq.tif"))
    # the counts lie in a larger raster, two columns and one row further
    wide = GridHeader(12, 11, "uint64", 0, (9.0, 0.5, 0.0, 50.5, 0.0, -0.5), "EPSG:4326", True)
    moved = net.base.select((F.expr("idx div 8 + 1") * 12 + F.expr("idx % 8 + 2")).alias("idx"), F.col("size").alias("value"))
    geotiff.write_geotiff(moved, wide, at("upg.tif"))
    pits = [v for v in brute.cells(ds) if ds[v] == v]
    n = dfs_interval_geotiff(spark, at("seq.tif"), at("upg.tif"), at("in.tif"), at("out.tif"), ([v // 8 for v in pits], [v % 8 for v in pits]))
    want = found(net.dfs_interval(), "dfs_in", "dfs_out")
    got = [grid(geotiff.read_geotiff(spark, at(f))[0], 72) for f in ("in.tif", "out.tif")]
    assert n == len(want) and all((got[0][v], got[1][v]) == want.get(v, (-1, -1)) for v in range(72))
    sizes = found(net.base, "size")
    table = tmp_path / "t.csv"
    table.write_text("local_outlet_row,local_outlet_col,basin_cell_count\n" + "".join(f"{v // 8},{v % 8},{sizes[v]}\n" for v in pits))
    assert dfs_interval_geotiff(spark, at("seq.tif"), at("upg.tif"), at("in2.tif"), at("out2.tif"), str(table)) == n
    table.write_text(table.read_text().replace(f",{sizes[pits[0]]}\n", f",{sizes[pits[0]] + 1}\n", 1))
    for outlets, said in ((str(table), "table and raster disagree"), (([0], [0]), None), (7, "table of basins")):
        with pytest.raises(ValueError, match=said):
            dfs_interval_geotiff(spark, at("seq.tif"), at("upg.tif"), at("in3.tif"), at("out3.tif"), outlets)
    with pytest.raises(FileExistsError):
        dfs_interval_geotiff(spark, at("seq.tif"), at("upg.tif"), at("in.tif"), at("out4.tif"), str(table))
    with pytest.raises(ValueError):
        dfs_interval_geotiff(spark, at("seq.tif"), at("upg.tif"), at("same.tif"), at("same.tif"), str(table))
    assert not [p.name for p in tmp_path.iterdir() if "3" in p.name or "4" in p.name or p.name.endswith(".part")]


def test_both_outputs_or_none(tmp_path):
    parts = {str(tmp_path / f"{n}.part"): str(tmp_path / n) for n in "ab"}
    for part in parts:
        open(part, "w").close()
    (tmp_path / "b").write_text("older")
    with pytest.raises(FileExistsError):
        _publish(parts)
    assert not (tmp_path / "a").exists() and (tmp_path / "b").read_text() == "older"
    (tmp_path / "b").unlink()
    _publish(parts)
    assert (tmp_path / "a").exists() and (tmp_path / "b").exists()


def test_alignment():
    world = GridHeader(720, 360, "int32", 0, (-180.0, 0.5, 0.0, 90.0, 0.0, -0.5))
    inner = lambda x, y, side=0.5: GridHeader(4, 4, "int32", 0, (x, side, 0.0, y, 0.0, -side))
    assert aligned(inner(179.0, 10.0), world) == (160, 718, True)
    assert aligned(inner(181.0, 10.0), world) == (160, 2, True)
    for bad in (inner(0.0, 10.0, 0.25), inner(0.1, 10.0), inner(0.0, 91.0)):
        with pytest.raises(ValueError):
            aligned(bad, world)
    north = GridHeader(720, 100, "int32", 0, (-180.0, 0.5, 0.0, 50.0, 0.0, -0.5))
    for bad in (inner(0.0, 51.0), inner(0.0, 1.0)):
        with pytest.raises(ValueError, match="cover"):
            aligned(bad, north)
    with pytest.raises(ValueError, match="cover"):
        aligned(inner(219.0, 10.0), GridHeader(100, 100, "int32", 0, (170.0, 0.5, 0.0, 20.0, 0.0, -0.5)))


def test_synthetic_grids_repeat_and_reach_pits(spark):
    a, b, c = (synthetic_d8(spark, 20, 24, seed=s, smooth=2) for s in (1, 1, 2))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(a) == rows(b) != rows(c) and a.count() == 480
    net = Network.from_d8(a, (20, 24))
    assert net.base.filter("stranded").count() == 0 and 1 < net.nbasins < 120
