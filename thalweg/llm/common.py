"""What the operators of this package share: tables, the shared folder, salted running sums,
the order of neighbours, and tidy Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word: what stands between blanks of ASCII. bytes.split() and this class agree.
WORD = r"[^\x20\x09-\x0D]+"
#: The same for DuckDB's engine.
WORD_SQL = r"[^\x20\x09-\x0D]+"

#: Rows of one Arrow batch. Texts are long, so the default of 10,000 would be far too many.
BATCH_ROWS = 256

#: Bits of the map that tells which ids are asked for; a power of two.
ID_BITS = 1 << 25

#: Used where the session names no shared folder (tests on one machine).
FALLBACK_DIR = "/tmp/checkpoints/thalweg"
_CUTS: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small; only lowers the session's setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local folder does if
    all runs on this machine; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or FALLBACK_DIR


def _remove(jvm, conf, path: str) -> None:
    """Delete a folder through Spark's own file system, also after the session has stopped."""
    with contextlib.suppress(Exception):  # the JVM may have gone first
        to = jvm.org.apache.hadoop.fs.Path(path)
        to.getFileSystem(conf).delete(to, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: later steps start from files
    that outlive any executor, and nothing above is computed twice. All that an application has
    written so lies in one folder, which is removed when the application ends."""
    spark = df.sparkSession
    own = f"{shared_dir(spark).rstrip('/')}/thalweg-{spark.sparkContext.applicationId}"
    if own not in _CUTS:
        _CUTS.add(own)
        atexit.register(_remove, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), own)
    path = f"{own}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have: ``name``, with underscores before it if need be."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def held_out(doc_id: Column, n: int, r: int) -> Column:
    """Whether crc32 of the id as text is r modulo n: how the contracts hold rows out. False without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n == r, F.lit(False))


def running(df: DataFrame, group: list[str], order: list[str], value: str, out: str, salt: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the group that precede this row.

    Rows are ordered by ``salt`` and then by ``order``. A window runs only within (group, salt);
    sums per salt are gathered first and carried over, so that a hot group spreads over as many
    tasks as it has salts.
    """
    sums = df.groupBy(*group, salt).agg(F.sum(value).alias("_part"))
    before = Window.partitionBy(*group).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_part").over(before), F.lit(0))).drop("_part")
    inside = Window.partitionBy(*group, salt).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    part = df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    sums = sums.select(*[F.col(k).alias(f"_{k}_") for k in [*group, salt]], "_base")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in [*group, salt]]
    return part.join(sums, on, "inner").select(*df.columns, (F.col("_in") + F.col("_base")).alias(out))


def successors(keys: DataFrame, order: list[str], within: list[str] | None = None) -> DataFrame:
    """For distinct narrow rows ``keys``, add ``next``: a struct of the columns of the row that
    follows in the global order (null at the end, or where ``within`` changes).

    No task sees more than its range: rows are range-partitioned, the partition number is frozen
    by writing, a window runs per range, and the first row of each range (one per partition, a
    bounded table) closes the gaps.
    """
    cols = keys.columns
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keys.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())
    ranged = cut(ranged, "ranges")
    row = F.struct(*cols)
    firsts = ranged.groupBy("_range").agg(F.min_by(row, F.struct(*order)).alias("_row"))
    firsts = firsts.withColumn("_first", F.lead("_row").over(Window.orderBy("_range"))).drop("_row")
    inside = F.lead(row).over(Window.partitionBy("_range").orderBy(*order))
    out = ranged.withColumn("next", inside).join(F.broadcast(firsts), "_range", "left")
    out = out.withColumn("next", F.coalesce("next", "_first"))
    if within:
        same = F.lit(True)
        for k in within:
            same = same & F.col(k).eqNullSafe(F.col(f"next.{k}"))
        out = out.withColumn("next", F.when(same, F.col("next")))
    return out.select(*cols, "next")


def id_bit(key: str | Column) -> Column:
    """The place of an id in an id map."""
    return F.pmod(F.xxhash64(key), F.lit(ID_BITS))


def id_map(ids: DataFrame, key: str = "id") -> np.ndarray:
    """A map of ID_BITS bits of the hashed ids. Of fixed size whatever their number; it
    lets through all that are asked for, and the more others the fuller it is."""
    at = ids.select(id_bit(key).alias("at"))
    words = at.groupBy(F.expr("at div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    out = np.zeros(ID_BITS // 64, np.int64)
    got = words.toArrow()
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out


def hits(bits: np.ndarray, at: pa.Array) -> np.ndarray:
    """Which places of the map are set."""
    h = at.to_numpy(zero_copy_only=False)
    return (bits[h >> 6] >> (h & 63) & 1).astype(bool)


def slices(batches: Iterator, most_bytes: int = 16_000_000) -> Iterator:
    """Arrow batches cut so that none holds much more than ``most_bytes`` (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * most_bytes / max(batch.nbytes, 1)))
        for at in range(0, n, step):
            yield batch.slice(at, step)
