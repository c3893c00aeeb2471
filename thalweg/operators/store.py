"""Cut points, and sums and numbers along a global order without a single task that sees all rows."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Used where the session names no shared folder (tests on one machine).
FALLBACK_DIR = "/tmp/checkpoints/thalweg"


_WRITTEN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local folder does if
    all runs on this machine; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or FALLBACK_DIR


def _own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is removed when the application ends."""
    own = f"{shared_dir(spark).rstrip('/')}/thalweg-{spark.sparkContext.applicationId}-network"
    if own not in _WRITTEN:
        _WRITTEN.add(own)
        atexit.register(_remove, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), own)
    return own


def _remove(jvm, conf, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have gone first
        to = jvm.org.apache.hadoop.fs.Path(path)
        to.getFileSystem(conf).delete(to, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: what follows starts from files
    that outlive any executor, and the plan stays short."""
    return cut_with(df, name)[0]


def cut_with(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """As ``cut``; the aggregates ``measures`` are taken while the rows are written."""
    path = f"{_own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    seen = Observation()
    watched = df.observe(seen, *[c.alias(k) for k, c in measures.items()]) if measures else df
    watched.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get if measures else {}


def dealt(df: DataFrame) -> DataFrame:
    """``df`` for a join in which both sides are dealt out by a key that few rows share. Without this the optimizer
    takes the size of compressed files for that of the rows, and sends tables whole that the driver can't hold."""
    return df.hint("merge")


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` in ranges of ``order``, the number of the range frozen in ``_range``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def running_sum(df: DataFrame, order: list[Column], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows that precede in ``order``, which must be total.

    Rows are dealt by ranges; one sum per range (as many rows as ranges) is added up in one small
    window, and each range is summed by itself.
    """
    if not df.columns:
        raise ValueError("no columns")
    ranged = _ranged(df, order)
    totals = ranged.groupBy("_range").agg(F.sum(value).alias("_total"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(F.broadcast(totals), "_range").select(*df.columns, (F.col("_in") + F.col("_base")).alias(out))


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Add ``out``: the place of the row in ``order``, from 0; the order must be total."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return running_sum(one, order, "_one", out).drop("_one")


def at_ranks(values: DataFrame, value: str, ranks: dict[str, int]) -> dict[str, float | int | None]:
    """The values at the given places (from 0) of the sorted column.

    Equal values are counted first, so what is put in order is one row per distinct value.
    """
    counts = values.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_sum(counts, [F.col(value)], "_n", "_before")
    picks = [F.max(F.when((F.col("_before") <= r) & (F.col("_before") + F.col("_n") > r), F.col(value))).alias(k) for k, r in ranks.items()]
    return placed.agg(*picks).first().asDict()
