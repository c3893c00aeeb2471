"""Single-band GeoTIFF as a source and a sink, without a raster library.

Reading: the driver reads the directory of the file, executors read and decode its strips or tiles,
each on its own. Writing: cells are grouped into tiles, executors compress them, and the driver
appends the tiles, one after another, to a file that gets its name when it is complete.

Read: classic and big TIFF, either byte order, strips and tiles; no compression, LZW, deflate and
ZSTD; predictors 1 to 3; integers of 8 to 64 bits and floats; an alpha sample or an internal mask.
"""

from __future__ import annotations

import math
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.network import GridHeader

# Fixed values of the TIFF and GeoTIFF formats.
WIDTH, HEIGHT, BITS, COMPRESSION, SAMPLES, PREDICTOR, FORMAT = 256, 257, 258, 259, 277, 317, 339
STRIP_AT, STRIP_ROWS, STRIP_BYTES, TILE_W, TILE_H, TILE_AT, TILE_BYTES = 273, 278, 279, 322, 323, 324, 325
SUBFILE, EXTRA, PLANAR, SCALE, TIEPOINT, MATRIX, GEOKEYS, NODATA = 254, 338, 284, 33550, 33922, 34264, 34735, 42113
NONE, LZW, DEFLATE, OLD_DEFLATE, ZSTD = 1, 5, 8, 32946, 50000
FIELDS = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
MODEL_KEY, RASTER_KEY, GEOGRAPHIC_KEY, ANGLE_KEY, PROJECTED_KEY, LENGTH_KEY = 1024, 1025, 2048, 2054, 3072, 3076
PROJECTED, GEOGRAPHIC, POINTS, DEGREES, METRES = 1, 2, 2, (9102, 9122), 9001

#: Side of a written tile.
TILE = 512


def open_binary(path: str):
    """A readable file: of this machine, or of a store that pyarrow knows by its URI."""
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        return store.open_input_file(inner)
    return open(path.removeprefix("file://"), "rb")


class Directory:
    """The tags of the images of a TIFF file."""

    def __init__(self, path: str):
        with open_binary(path) as f:
            head = f.read(16)
            if head[:2] not in (b"II", b"MM"):
                raise ValueError(f"{path} could not be read as a raster: no TIFF file")
            self.order = "<" if head[:2] == b"II" else ">"
            magic = struct.unpack(self.order + "H", head[2:4])[0]
            if magic not in (42, 43):
                raise ValueError(f"{path} could not be read as a raster: no TIFF file")
            self.big = magic == 43
            at = struct.unpack(self.order + ("Q" if self.big else "I"), head[8:16] if self.big else head[4:8])[0]
            self.images: list[dict[int, tuple]] = []
            while at and len(self.images) < 64:
                tags, at = self._image(f, at)
                self.images.append(tags)

    def _image(self, f, at: int) -> tuple[dict[int, tuple], int]:
        f.seek(at)
        n = struct.unpack(self.order + ("Q" if self.big else "H"), f.read(8 if self.big else 2))[0]
        size = 20 if self.big else 12
        raw, inline = f.read(n * size), 8 if self.big else 4
        after = struct.unpack(self.order + ("Q" if self.big else "I"), f.read(inline))[0]
        tags = {}
        for k in range(n):
            entry = raw[k * size : (k + 1) * size]
            tag, kind = struct.unpack(self.order + "HH", entry[:4])
            count = struct.unpack(self.order + ("Q" if self.big else "I"), entry[4 : 4 + inline])[0]
            if kind not in FIELDS:
                continue
            code = FIELDS[kind]
            length = struct.calcsize("=" + code) * count
            data = entry[4 + inline : 4 + 2 * inline]
            if length > inline:
                f.seek(struct.unpack(self.order + ("Q" if self.big else "I"), data)[0])
                data = f.read(length)
            data = data[:length]
            tags[tag] = (data.split(b"\0")[0].decode("latin-1"),) if kind == 2 else struct.unpack(self.order + code * count, data)
        return tags, after


def _dtype(tags: dict, path: str) -> np.dtype:
    bits, kind = tags.get(BITS, (1,))[0], tags.get(FORMAT, (1,))[0]
    name = {1: "uint", 2: "int", 3: "float"}.get(kind)
    if name is None or bits not in (8, 16, 32, 64) or (name == "float" and bits < 32):
        raise ValueError(f"{path} could not be read as a raster: {bits} bits of sample format {kind}")
    return np.dtype(f"{name}{bits}")


def header_of(directory: Directory, path: str) -> GridHeader:
    """Shape, type, no data, transform and coordinates; refuses what lengths can't be measured on."""
    tags = directory.images[0]
    if MATRIX in tags:
        m = tags[MATRIX]
        a, b, c, d, e, f = m[0], m[1], m[3], m[4], m[5], m[7]
    elif SCALE in tags and TIEPOINT in tags:
        (sx, sy), (i, j, _, x, y) = tags[SCALE][:2], tags[TIEPOINT][:5]
        a, b, c, d, e, f = sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy
    else:
        a, b, c, d, e, f = 1.0, 0.0, 0.0, 0.0, 1.0, 0.0
    if b or d:
        raise ValueError(f"{path} is rotated; north-up grids are read")
    keys = {}
    for k in range(1, len(tags.get(GEOKEYS, ())) // 4):
        key, where, _, value = tags[GEOKEYS][4 * k : 4 * k + 4]
        if where == 0:
            keys[key] = value
    if keys.get(RASTER_KEY) == POINTS:  # the tie point is a centre
        c, f = c - a / 2, f - e / 2
    crs, latlon = "", True
    if keys.get(MODEL_KEY) == GEOGRAPHIC:
        if keys.get(ANGLE_KEY, DEGREES[0]) not in DEGREES:
            raise ValueError(f"{path} is geographic in another unit than degrees; it has to be given in degrees first")
        crs = f"EPSG:{keys[GEOGRAPHIC_KEY]}" if GEOGRAPHIC_KEY in keys else "geographic"
    elif keys.get(MODEL_KEY) == PROJECTED:
        if keys.get(LENGTH_KEY, METRES) != METRES:
            raise ValueError(f"{path} is projected in another unit than metres; it has to be reprojected first")
        crs, latlon = (f"EPSG:{keys[PROJECTED_KEY]}" if PROJECTED_KEY in keys else "projected"), False
    said = tags.get(NODATA, ("",))[0].strip()
    return GridHeader(tags[WIDTH][0], tags[HEIGHT][0], str(_dtype(tags, path)), float(said) if said else 247.0, (c, a, 0.0, f, 0.0, e), crs, latlon)


def _lzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, most significant bit first, as TIFF writes it."""
    start = [bytes([k]) for k in range(256)] + [b"", b""]
    table, width, out, last = list(start), 9, [], b""
    bits = held = 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = list(start), 9, b""
            continue
        word = table[code] if code < len(table) else last + last[:1]
        out.append(word)
        if last:
            table.append(last + word[:1])
        last = word
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def _plain(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if compression == ZSTD:
        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if compression == LZW:
        return _lzw(data)
    raise ValueError(f"compression {compression} is not read")


def _undo(block: np.ndarray, raw: bytes, predictor: int, dtype: np.dtype, order: str) -> np.ndarray:
    """A block (rows, columns, samples) after its predictor."""
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype)
    if predictor == 3:
        h, w, s = block.shape
        planes = np.frombuffer(raw, np.uint8)[: h * w * s * dtype.itemsize].reshape(h, w * s * dtype.itemsize)
        bytes_ = np.cumsum(planes.reshape(h, -1, s), axis=1, dtype=np.uint8).reshape(h, dtype.itemsize, w * s)
        return np.ascontiguousarray(bytes_.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(h, w, s).astype(dtype)
    return block


def _layout(tags: dict) -> list[tuple[int, int, int, int, int, int]]:
    """(offset, bytes, first row, first column, rows, columns) of each block as stored."""
    w, h = tags[WIDTH][0], tags[HEIGHT][0]
    if TILE_AT in tags:
        tw, th = tags[TILE_W][0], tags[TILE_H][0]
        across = -(-w // tw)
        return [(at, n, k // across * th, k % across * tw, th, tw) for k, (at, n) in enumerate(zip(tags[TILE_AT], tags[TILE_BYTES], strict=True)) if k < across * -(-h // th)]
    rows = min(tags.get(STRIP_ROWS, (h,))[0], h)
    return [(at, n, k * rows, 0, min(rows, h - k * rows), w) for k, (at, n) in enumerate(zip(tags[STRIP_AT], tags[STRIP_BYTES], strict=True)) if k * rows < h]


def _cells(path: str, tags: dict, order: str, mask: dict | None, fill: float, blocks: pd.DataFrame) -> Iterator[pd.DataFrame]:
    dtype, samples = _dtype(tags, path), tags.get(SAMPLES, (1,))[0]
    if samples > 1 and tags.get(PLANAR, (1,))[0] != 1:
        raise ValueError(f"{path}: samples in separate planes are not read")
    alpha = samples - 1 if samples > 1 and tags.get(EXTRA, (0,))[-1] in (1, 2) else None
    w, h = tags[WIDTH][0], tags[HEIGHT][0]
    with open_binary(path) as f:
        for at, n, row, col, bh, bw, mask_at, mask_n in blocks.itertuples(index=False):
            wide, tall = min(bw, w - col), min(bh, h - row)
            if n == 0:  # a block that wasn't written
                values, valid = np.full((tall, wide), fill, np.float64 if dtype.kind == "f" else np.int64), np.ones((tall, wide), bool)
            else:
                f.seek(at)
                raw = _plain(f.read(n), tags.get(COMPRESSION, (NONE,))[0])
                block = np.frombuffer(raw, dtype.newbyteorder(order), bh * bw * samples).astype(dtype).reshape(bh, bw, samples)
                block = _undo(block, raw, tags.get(PREDICTOR, (1,))[0], dtype, order)[:tall, :wide]
                values, valid = block[:, :, 0], np.ones((tall, wide), bool) if alpha is None else block[:, :, alpha] != 0
                if mask is not None:
                    f.seek(mask_at)
                    bits = np.frombuffer(_plain(f.read(mask_n), mask.get(COMPRESSION, (NONE,))[0]), np.uint8)
                    if mask.get(BITS, (1,))[0] == 1:
                        bits = np.unpackbits(bits.reshape(bh, -1), axis=1)[:, :bw]
                    valid = valid & (bits.reshape(bh, -1)[:tall, :wide] != 0)
            if dtype.kind == "u" and dtype.itemsize == 8:
                values = np.minimum(values, np.uint64((1 << 63) - 1))
            if not valid.all():
                values = np.where(valid, values.astype(np.float64 if dtype.kind == "f" or not float(fill).is_integer() else np.int64), fill)
            idx = (np.arange(row, row + tall)[:, None] * w + np.arange(col, col + wide)[None, :]).ravel()
            yield pd.DataFrame({"idx": idx.astype(np.int64), "value": values.ravel().astype(np.float64 if dtype.kind == "f" else np.int64)})


def read_geotiff(spark: SparkSession, path: str) -> tuple[DataFrame, GridHeader]:
    """((idx, value), header) of a single-band file; value is LONG or DOUBLE.

    Masked cells have the file's no-data value, 247 if it names none. A file without coordinates is
    read as degrees; rotated grids and other units than degrees and metres are refused.
    """
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(f"no such raster: {path}")
    directory = Directory(path)
    header, tags, order = header_of(directory, path), directory.images[0], directory.order
    mask = next((t for t in directory.images[1:] if t.get(SUBFILE, (0,))[0] & 4 and t[WIDTH] == tags[WIDTH] and t[HEIGHT] == tags[HEIGHT]), None)
    blocks = _layout(tags)
    others = _layout(mask) if mask is not None else [(0, 0)] * len(blocks)
    if len(others) != len(blocks):
        raise ValueError(f"{path}: the mask is laid out otherwise than the image")
    rows = [(*map(int, b), int(m[0]), int(m[1])) for b, m in zip(blocks, others, strict=True)]
    slim = {k: v for k, v in tags.items() if k not in (STRIP_AT, STRIP_BYTES, TILE_AT, TILE_BYTES)}
    slim_mask = None if mask is None else {k: v for k, v in mask.items() if k not in (STRIP_AT, STRIP_BYTES, TILE_AT, TILE_BYTES)}
    kind = "double" if header.dtype.startswith("float") else "long"
    listed = spark.createDataFrame(rows, "at long, n long, row long, col long, h long, w long, mask_at long, mask_n long")
    listed = listed.repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield from _cells(path, slim, order, slim_mask, header.nodata, frame)

    return listed.mapInPandas(run, f"idx long, value {kind}"), header


def _filled(header: GridHeader) -> np.ndarray:
    return np.full((TILE, TILE), header.nodata, np.dtype(header.dtype))


def write_geotiff(cells: DataFrame, header: GridHeader, path: str, compression: str = "deflate") -> None:
    """Write (idx, value) as a tiled single-band file; cells without a row are no data. An existing
    path is refused; the file appears when it is complete."""
    if os.path.lexists(path):
        raise FileExistsError(f"there is a file named {path} already; nothing is written over it")
    part = f"{path}.part"
    if os.path.lexists(part):
        raise FileExistsError(f"there is a file named {part} already; nothing is written over it")
    try:
        _write(cells, header, part, compression)
        if os.path.lexists(path):
            raise FileExistsError(f"another file took the name {path} meanwhile")
        os.replace(part, path)
    except BaseException:
        if os.path.lexists(part):
            os.remove(part)
        raise


def _write(cells: DataFrame, header: GridHeader, path: str, compression: str) -> None:
    ncol, nrow, dtype = header.ncol, header.nrow, np.dtype(header.dtype)
    across, down = max(1, -(-ncol // TILE)), max(1, -(-nrow // TILE))
    pack = (lambda b: zlib.compress(b, 6)) if compression == "deflate" else (lambda b: zstandard.ZstdCompressor(level=9).compress(b))
    fill = header.nodata

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        tile = int(frame["tile"].iat[0])
        block = np.full((TILE, TILE), fill, dtype)
        idx = frame["idx"].to_numpy()
        block[idx // ncol - tile // across * TILE, idx % ncol - tile % across * TILE] = frame["value"].to_numpy().astype(dtype)
        return pd.DataFrame({"tile": [tile], "data": [pack(block.tobytes())]})

    tile = (F.expr(f"idx div {ncol} div {TILE}") * across + F.expr(f"idx % {ncol} div {TILE}")).cast("long")
    tiles = cells.select("idx", "value", tile.alias("tile")).groupBy("tile").applyInPandas(packed, "tile long, data binary").orderBy("tile")
    empty = pack(_filled(header).tobytes())
    at, size = [0] * (across * down), [0] * (across * down)
    with open(path, "wb") as f:
        f.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0))
        blank = None
        for row in tiles.toLocalIterator():
            at[row["tile"]], size[row["tile"]] = f.tell(), len(row["data"])
            f.write(row["data"])
        for k, n in enumerate(size):
            if not n:
                if blank is None:
                    blank = f.tell()
                    f.write(empty)
                at[k], size[k] = blank, len(empty)
        _directory(f, header, dtype, at, size, ZSTD if compression == "zstd" else DEFLATE)


def _directory(f, header: GridHeader, dtype: np.dtype, at: list[int], size: list[int], compression: int) -> None:
    x0, a, _, y0, _, e = header.transform
    keys = [1, 1, 0, 0]
    code = header.crs.rpartition(":")[2]
    if header.crs and code.isdigit() and int(code) < 65536:
        named = [(MODEL_KEY, GEOGRAPHIC if header.latlon else PROJECTED), (RASTER_KEY, 1), (GEOGRAPHIC_KEY if header.latlon else PROJECTED_KEY, int(code))]
        named += [] if header.latlon else [(LENGTH_KEY, METRES)]
        for key, value in sorted(named):
            keys += [key, 0, 1, value]
            keys[3] += 1
    said = (repr(int(header.nodata)) if float(header.nodata).is_integer() else repr(header.nodata)) if math.isfinite(header.nodata) else "nan"
    tags = [
        (WIDTH, 4, [header.ncol]), (HEIGHT, 4, [header.nrow]), (BITS, 3, [dtype.itemsize * 8]), (COMPRESSION, 3, [compression]), (262, 3, [1]), (SAMPLES, 3, [1]), (PLANAR, 3, [1]),
        (TILE_W, 4, [TILE]), (TILE_H, 4, [TILE]), (TILE_AT, 16, at), (TILE_BYTES, 16, size), (FORMAT, 3, [{"u": 1, "i": 2, "f": 3}[dtype.kind]]),
        (NODATA, 2, (said + "\0").encode("ascii")),
    ]
    tags += [(SCALE, 12, [a, -e, 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, x0, y0, 0.0])] if a > 0 > e else [(MATRIX, 12, [a, 0, 0, x0, 0, e, 0, y0, 0, 0, 0, 0, 0, 0, 0, 1])]
    if keys[3]:
        tags.append((GEOKEYS, 3, keys))
    entries = b""
    for tag, kind, values in sorted(tags, key=lambda t: t[0]):
        data = bytes(values) if kind == 2 else struct.pack("<" + FIELDS[kind] * len(values), *values)
        if len(data) <= 8:
            where = data.ljust(8, b"\0")
        else:
            where = struct.pack("<Q", f.tell())
            f.write(data)
        entries += struct.pack("<HHQ", tag, kind, len(values)) + where
    here = f.tell()
    f.write(struct.pack("<Q", len(tags)) + entries + struct.pack("<Q", 0))
    f.seek(8)
    f.write(struct.pack("<Q", here))
