"""A synthetic grid of direction codes: steepest descent over smoothed noise.

The noise is seeded per row and column by hashing, so a grid of any size is made in place by
executors; smoothing is a sum over neighbours in two passes, along rows and along columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thalweg.functions.d8 import STEPS
from thalweg.operators.store import cut, dealt

#: Resolution of the noise.
UNIT = 1 << 40


def _smoothed(z: DataFrame, line: str, along: str, n: int, smooth: int) -> DataFrame:
    """Mean over ``smooth`` places to both sides along a line; the rim is continued by its last value."""
    order = Window.partitionBy(line).orderBy(along)
    near = order.rowsBetween(-smooth, smooth)
    every = Window.partitionBy(line)
    first, last = F.min_by("z", along).over(every), F.max_by("z", along).over(every)
    short = F.greatest(F.lit(smooth) - F.col(along), F.lit(0)) * first + F.greatest(F.col(along) + smooth - (n - 1), F.lit(0)) * last
    return z.withColumn("z", (F.sum("z").over(near) + short) / (2 * smooth + 1))


def synthetic_d8(spark: SparkSession, nrow: int, ncol: int | None = None, seed: int = 0, smooth: int = 12, passes: int = 3) -> DataFrame:
    """(idx, code) of a grid without missing data; equal arguments give equal grids. A cell with no
    lower neighbour has code 0; of equally steep directions the smallest code counts."""
    ncol = nrow if ncol is None else ncol
    noise = lambda salt: F.pmod(F.xxhash64("idx", F.lit(seed), F.lit(salt)), F.lit(UNIT)) / float(UNIT)
    z = spark.range(nrow * ncol).select(F.col("id").alias("idx"))
    z = z.select("idx", F.expr(f"idx div {ncol}").alias("r"), (F.col("idx") % ncol).alias("c"), noise(0).alias("z"))
    for _ in range(passes):
        z = _smoothed(_smoothed(z, "r", "c", ncol, smooth), "c", "r", nrow, smooth)
    z = cut(z.withColumn("z", F.col("z") + noise(1) * 1e-6), "noise")
    seen = F.array(*[F.struct(F.lit(k).alias("code"), (F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), F.lit(float(dr * dr + dc * dc)).alias("d2")) for k, (dr, dc) in STEPS.items()])
    offers = z.select(F.col("z").alias("z2"), F.explode(seen).alias("s")).filter((F.col("s.r") >= 0) & (F.col("s.c") >= 0) & (F.col("s.c") < ncol))
    offers = offers.select((F.col("s.r") * ncol + F.col("s.c")).alias("_to"), "z2", "s.code", "s.d2")
    met = z.join(dealt(offers), F.col("idx") == F.col("_to")).filter("z2 < z")
    best = met.groupBy(F.col("idx").alias("_b")).agg(F.max(F.struct(((F.col("z") - F.col("z2")) / F.sqrt("d2")).alias("slope"), (-F.col("code")).alias("code"))).alias("b"))
    return z.join(dealt(best), F.col("idx") == F.col("_b"), "left").select("idx", F.coalesce(-F.col("b.code"), F.lit(0)).cast("short").alias("code"))
