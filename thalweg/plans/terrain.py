"""A drainage network made of the table of orders: steepest descent over a tilted price terrain.

Order keys are 0..n-1; they are laid row by row on a raster of isqrt(n) columns. A cell's height is
its price in cents plus a tilt per row; every 97th cell has no data. Each cell drains into the
strictly lower neighbour of the steepest slope (of equal ones the smallest direction code).
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.functions.d8 import NODATA, STEPS
from thalweg.network import Network
from thalweg.operators.store import cut

TILT, HOLES = 40_000_000, 97
#: A projected raster of 100 m cells.
METRES = (0.0, 100.0, 0.0, 0.0, 0.0, -100.0)
#: The same in degrees, off the equator.
DEGREES = (5.0, 1 / 1200, 0.0, 47.0, 0.0, -1 / 1200)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def shape(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    n = orders(spark, sf_dir).count()
    ncol = max(isqrt(n), 1)
    return -(-n // ncol), ncol


def heights(spark: SparkSession, sf_dir: str, ncol: int) -> DataFrame:
    """idx, z, cents of the cells that have data."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    got = orders(spark, sf_dir).select(F.col("o_orderkey").alias("idx"), cents.alias("cents"))
    return got.filter(F.col("idx") % HOLES != 0).withColumn("z", F.col("cents") + TILT * F.expr(f"idx div {ncol}"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, code) of every cell of the raster: the direction, 0 at a pit, 247 without data. Each cell
    offers its height to itself and its eight neighbours, so one aggregation by cell decides, and nothing
    is joined: a join of offers looks small to the optimizer, which would send them all to the driver."""
    nrow, ncol = shape(spark, sf_dir)
    z = heights(spark, sf_dir, ncol).select("idx", "z")
    row, col = F.expr(f"idx div {ncol}"), F.col("idx") % ncol
    # a cell is seen by the neighbour from which it lies in direction `code`, and by itself
    seen = F.array(*[F.struct(F.lit(c).alias("code"), (row - dr).alias("r"), (col - dc).alias("c")) for c, (dr, dc) in {0: (0, 0), **STEPS}.items()])
    offers = z.select("z", F.explode(seen).alias("s")).filter((F.col("s.c") >= 0) & (F.col("s.c") < ncol) & (F.col("s.r") >= 0) & (F.col("s.r") < nrow))
    offers = offers.select((F.col("s.r") * ncol + F.col("s.c")).alias("idx"), "s.code", "z")
    grid = spark.range(nrow * ncol).select(F.col("id").alias("idx"), F.lit(None).cast("int").alias("code"), F.lit(None).cast("long").alias("z"))
    met = offers.unionByName(grid).groupBy("idx").agg(*[F.min(F.when(F.col("code") == c, F.col("z"))).alias(f"z{c}") for c in (0, *STEPS)])
    falls = [F.when(F.col(f"z{c}") < F.col("z0"), F.struct(((F.col("z0") - F.col(f"z{c}")) / F.sqrt(F.lit(float(dr * dr + dc * dc)))).alias("slope"), F.lit(-c).alias("code"))) for c, (dr, dc) in STEPS.items()]
    best = -F.greatest(*falls)["code"]
    return met.select("idx", F.when(F.col("z0").isNull(), NODATA).otherwise(F.coalesce(best, F.lit(0))).cast("short").alias("code"))


def network(spark: SparkSession, sf_dir: str, transform: tuple = METRES, latlon: bool = False) -> Network:
    nrow, ncol = shape(spark, sf_dir)
    return Network.from_d8(cut(codes(spark, sf_dir), "codes"), (nrow, ncol), transform, latlon)


#: The same edges in DuckDB: tables n, g (cells), e (idx, ds) and w (u, v, h): v lies h steps below u.
EDGES_SQL = f"""
WITH RECURSIVE n AS (SELECT count(*) AS n, greatest(floor(sqrt(count(*))), 1)::BIGINT AS ncol FROM orders),
g AS MATERIALIZED (
  SELECT o_orderkey AS idx, o_orderkey // ncol AS r, o_orderkey % ncol AS c, round(o_totalprice * 100)::BIGINT AS cents,
    round(o_totalprice * 100)::BIGINT + {TILT} * (o_orderkey // ncol) AS z
  FROM orders, n WHERE o_orderkey % {HOLES} <> 0
),
st(code, dr, dc) AS (VALUES {', '.join(f'({c}, {dr}, {dc})' for c, (dr, dc) in STEPS.items())}),
a AS (SELECT idx, z, r + dr AS r2, c + dc AS c2, code, sqrt((dr * dr + dc * dc)::DOUBLE) AS d FROM g, st),
p AS (
  SELECT a.idx, b.idx AS ds, a.code, row_number() OVER (PARTITION BY a.idx ORDER BY (a.z - b.z) / a.d DESC, a.code) AS k
  FROM a JOIN g b ON b.r = a.r2 AND b.c = a.c2 WHERE b.z < a.z
),
e AS MATERIALIZED (SELECT g.idx, coalesce(p.ds, g.idx) AS ds FROM g LEFT JOIN p ON p.idx = g.idx AND p.k = 1)
"""
CLOSURE_SQL = (
    EDGES_SQL
    + """,
w AS (SELECT idx AS u, idx AS v, 0 AS h FROM e UNION ALL SELECT w.u, e.ds, w.h + 1 FROM w JOIN e ON w.v = e.idx WHERE e.ds <> e.idx),
rk AS MATERIALIZED (SELECT u AS idx, max(h) AS rank, max_by(v, h) AS root FROM w GROUP BY u),
sz AS MATERIALIZED (SELECT v AS idx, count(*) AS size, max(h) AS depth, max(struct_pack(h := h, i := u)) AS far FROM w GROUP BY v)
"""
)
