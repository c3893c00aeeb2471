"""Registered queries of the sources, sinks and checks over the terrain network, and their DuckDB twins.

Rasters and tables are written to the shared folder and read again, so a twin says what came back.
"""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.network import GridHeader, Network, checked_shape, checked_transform
from thalweg.operators import kernels, locality
from thalweg.operators.store import cut, dealt, shared_dir
from thalweg.plans.network_queries import _INTERVAL
from thalweg.plans.terrain import CLOSURE_SQL, EDGES_SQL, METRES, codes, network, shape
from thalweg.sources.geotiff import read_geotiff, write_geotiff
from thalweg.sources.interval_rasters import dfs_interval_geotiff, window
from thalweg.sources.outlets import outlets_of, read_outlets

#: By how many rows and columns the raster of counts goes past the raster of the sequence, north and west.
NORTH, WEST = 3, 5


def _folder(spark: SparkSession) -> str:
    at = os.path.join(re.sub("^file:(//)?", "", shared_dir(spark)), f"thalweg-rasters-{uuid.uuid4().hex}")
    os.makedirs(at)
    return at


def _directions(spark: SparkSession, sf_dir: str) -> str:
    """The terrain's direction codes as a GeoTIFF."""
    nrow, ncol = shape(spark, sf_dir)
    path = f"{_folder(spark)}/directions.tif"
    write_geotiff(codes(spark, sf_dir).select("idx", F.col("code").cast("long").alias("value")), GridHeader(ncol, nrow, "uint8", 247.0, METRES, "EPSG:32632", False), path)
    return path


def geotiff_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_geotiff(spark, _directions(spark, sf_dir))[0]


def geotiff_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = read_geotiff(spark, _directions(spark, sf_dir))[1]
    row = (h.ncol, h.nrow, h.dtype, float(h.nodata), *map(float, h.transform), h.crs, h.latlon)
    return spark.createDataFrame([row], "ncol long, nrow long, dtype string, nodata double, t0 double, t1 double, t2 double, t3 double, t4 double, t5 double, crs string, latlon boolean")


def network_of_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Network.from_raster(spark, _directions(spark, sf_dir)).edges


def network_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = network(spark, sf_dir)
    return spark.createDataFrame([(net.nrow, net.ncol, net.ncells, net.nbasins)], "nrow long, ncol long, ncells long, nbasins long")


def dense_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = network(spark, sf_dir)
    return net.dense(net.rank, "rank").select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "rank")


def _outlet_rows(net: Network) -> list[tuple[int, int, int]]:
    """Outlets in no special order, as a caller's table would have them."""
    pits = net.base.filter("par is null").select((F.expr(f"idx div {net.ncol}")).alias("r"), (F.col("idx") % net.ncol).alias("c"), "size")
    return sorted((tuple(r) for r in pits.toLocalIterator()), key=lambda r: (r[2], -r[0], r[1]))


def _outlet_table(net: Network, folder: str) -> str:
    path = f"{folder}/outlets.csv"
    with open(path, "w", encoding="ascii") as f:
        f.write("basin,basin_cell_count,local_outlet_row,local_outlet_col\n")
        f.writelines(f"b{k},{n},{r},{c}\n" for k, (r, c, n) in enumerate(_outlet_rows(net)))
    return path


def outlets_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = network(spark, sf_dir)
    return read_outlets(spark, _outlet_table(net, _folder(spark)), net.nrow, net.ncol).select("idx", "cells")


def outlets_of_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = network(spark, sf_dir)
    rows = _outlet_rows(net)
    return outlets_of(spark, [r[0] for r in rows], [r[1] for r in rows], net.nrow, net.ncol).select("idx")


def _wide(net: Network, cells: DataFrame) -> tuple[DataFrame, GridHeader]:
    """Cells (idx, value) in a raster that goes further north and west, and its header."""
    outer = GridHeader(net.ncol + WEST + 2, net.nrow + NORTH + 1, "uint64", 0.0, (METRES[0] - WEST * METRES[1], METRES[1], 0.0, METRES[3] - NORTH * METRES[5], 0.0, METRES[5]), "EPSG:32632", False)
    at = (F.expr(f"idx div {net.ncol}") + NORTH) * outer.ncol + F.col("idx") % net.ncol + WEST
    return cells.select(at.alias("idx"), "value"), outer


def aligned_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of a larger raster that lies under a smaller one; the larger one has cells around it, too."""
    net = network(spark, sf_dir)
    _, outer = _wide(net, net.edges.select("idx", F.col("ds").alias("value")))
    everywhere = spark.range(outer.nrow * outer.ncol).select(F.col("id").alias("idx"), (F.col("id") * 7).alias("value"))
    return window(everywhere, outer, GridHeader(net.ncol, net.nrow, "int32", -1.0, METRES, "EPSG:32632", False))


def interval_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster job: sequence and counts written as rasters, outlets as a table, and both results read again."""
    net, folder = network(spark, sf_dir), _folder(spark)
    inner = GridHeader(net.ncol, net.nrow, "int32", -1.0, METRES, "EPSG:32632", False)
    write_geotiff(net.ordering("dfs", "u2d").select("idx", F.col("pos").alias("value")), inner, f"{folder}/seq.tif")
    counts, outer = _wide(net, net.base.select("idx", F.col("size").alias("value")))
    write_geotiff(counts, outer, f"{folder}/upg.tif")
    dfs_interval_geotiff(spark, f"{folder}/seq.tif", f"{folder}/upg.tif", f"{folder}/in.tif", f"{folder}/out.tif", _outlet_table(net, folder))
    first, last = (read_geotiff(spark, f"{folder}/{n}.tif")[0] for n in ("in", "out"))
    both = first.join(dealt(last.select(F.col("idx").alias("_i"), F.col("value").alias("dfs_out"))), F.col("idx") == F.col("_i"))
    return both.filter("value >= 0").select("idx", F.col("value").alias("dfs_in"), "dfs_out")


#: What the checks of plain arguments must say to some of them: (name, whether it is refused).
CASES = {
    "shape of three": (lambda: checked_shape((1, 2, 3)), True),
    "shape with a fraction": (lambda: checked_shape((2.5, 2)), True),
    "shape with NaN": (lambda: checked_shape((float("nan"), 2)), True),
    "shape with a truth value": (lambda: checked_shape((True, 2)), True),
    "negative shape": (lambda: checked_shape((-1, 2)), True),
    "shape of text": (lambda: checked_shape("22"), True),
    "whole floats": (lambda: checked_shape((2.0, 3)), False),
    "empty shape": (lambda: checked_shape((0, 0)), False),
    "transform of five": (lambda: checked_transform((0, 1, 0, 0, 0)), True),
    "rotated transform": (lambda: checked_transform((0, 1, 0.5, 0, 0, -1)), True),
    "cells without width": (lambda: checked_transform((0, 0, 0, 0, 0, -1)), True),
    "infinite transform": (lambda: checked_transform((float("inf"), 1, 0, 0, 0, -1)), True),
    "north-up transform": (lambda: checked_transform((0, 1, 0, 0, 0, -1)), False),
    "no-data of NaN": (lambda: kernels.check_nodata(float("nan")), True),
    "positive no-data": (lambda: kernels.check_nodata(5.0), True),
    "no-data beyond FLOAT": (lambda: kernels.check_nodata(-1e300, "float"), True),
    "usual no-data": (lambda: kernels.check_nodata(-9999.0, "float"), False),
    "unknown manner": (lambda: kernels.check_manner("sideways"), True),
    "pull": (lambda: kernels.check_manner("pull"), False),
    "elements of no bytes": (lambda: locality.check_elem_bytes(0), True),
    "elements of four bytes": (lambda: locality.check_elem_bytes(4), False),
}


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which arguments the checks refuse."""
    rows = []
    for name, (call, _) in CASES.items():
        try:
            call()
            rows.append((name, False))
        except ValueError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "name string, refused boolean")


def refused_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tables of edges are refused: the terrain's own, and ones with a fault in one row."""
    net = network(spark, sf_dir)
    size = net.nrow * net.ncol
    first = net.edges.agg(F.min("idx")).first()[0]
    faults = {"as it is": None, "a receiver outside": (first, size), "a cell outside": (size, 0), "a negative cell": (-1, 0), "a cell twice": (first, first), "a receiver of -2": (first, -2)}
    rows = []
    for name, row in faults.items():
        edges = net.edges
        if row:
            one = spark.createDataFrame([row], "idx long, ds long")
            edges = (edges if name == "a cell twice" else edges.filter(F.col("idx") != first)).unionByName(one)
        try:
            Network(edges, net.shape)
            rows.append((name, False))
        except ValueError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "name string, refused boolean")


def queries() -> dict:
    return {
        "geotiff_values": geotiff_values, "geotiff_header": geotiff_header, "network_of_raster": network_of_raster, "network_size": network_size, "dense_ranks": dense_ranks,
        "outlets_of_table": outlets_of_table, "outlets_of_pair": outlets_of_pair, "aligned_window": aligned_window, "interval_rasters": interval_rasters, "refusals": refusals, "refused_tables": refused_tables,
    }


_GRID = "q AS (SELECT i.idx, i.idx // ncol AS r, i.idx % ncol AS c FROM n, unnest(range(0, ((n + ncol - 1) // ncol) * ncol)) AS i(idx))"
_REFUSED = "SELECT * FROM (VALUES {}) AS v(name, refused)"


def oracle_sql() -> dict[str, str]:
    return {
        "geotiff_values": EDGES_SQL + f", {_GRID} SELECT q.idx, (CASE WHEN g.idx IS NULL THEN 247 ELSE coalesce(p.code, 0) END)::BIGINT AS value FROM q LEFT JOIN g ON g.idx = q.idx LEFT JOIN p ON p.idx = q.idx AND p.k = 1",
        "geotiff_header": EDGES_SQL + f"SELECT ncol, (n + ncol - 1) // ncol AS nrow, 'uint8' AS dtype, 247.0::DOUBLE AS nodata, {', '.join(f'{v}::DOUBLE AS t{k}' for k, v in enumerate(METRES))}, 'EPSG:32632' AS crs, false AS latlon FROM n",
        "network_of_raster": EDGES_SQL + "SELECT idx, ds FROM e",
        "network_size": EDGES_SQL + "SELECT (n + ncol - 1) // ncol AS nrow, ncol, (SELECT count(*) FROM e) AS ncells, (SELECT count(*) FROM e WHERE idx = ds) AS nbasins FROM n",
        "dense_ranks": CLOSURE_SQL + f", {_GRID} SELECT q.r AS row, q.c AS col, coalesce(rk.rank, -9999)::INT AS rank FROM q LEFT JOIN rk USING (idx)",
        "outlets_of_table": CLOSURE_SQL + "SELECT sz.idx, size AS cells FROM sz JOIN e USING (idx) WHERE idx = ds",
        "outlets_of_pair": EDGES_SQL + "SELECT idx FROM e WHERE idx = ds",
        "aligned_window": EDGES_SQL + f", {_GRID} SELECT idx, ((r + {NORTH}) * (ncol + {WEST + 2}) + c + {WEST}) * 7 AS value FROM q, n",
        "interval_rasters": _INTERVAL + "SELECT idx, dfs_in, dfs_out FROM itv",
        "refusals": _REFUSED.format(", ".join(f"('{name}', {str(no).lower()})" for name, (_, no) in CASES.items())),
        "refused_tables": _REFUSED.format("('as it is', false), ('a receiver outside', true), ('a cell outside', true), ('a negative cell', true), ('a cell twice', true), ('a receiver of -2', true)"),
    }
