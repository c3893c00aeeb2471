"""Tables of basin outlets: a strict reader of comma-separated lines, and pairs of rows and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thalweg.sources.geotiff import open_binary

#: The columns that are read.
COLUMNS = ("local_outlet_row", "local_outlet_col", "basin_cell_count")


def _whole(field: Column) -> Column:
    """The number of a plain integer within 64 bits, else null; leading zeros don't count."""
    digits = F.regexp_replace(field, "^[+-]?0*", "")
    sign = F.when(field.startswith("-"), "-").otherwise("")
    ok = field.rlike(r"\A[+-]?[0-9]+\z") & (F.length(digits) <= 19)
    return F.when(ok, F.concat(sign, F.when(digits == "", "0").otherwise(digits)).try_cast("long"))


def _numbered(lines: DataFrame) -> DataFrame:
    """Add ``line``, from 1. Parts of a file keep their order, so counts per part are enough."""
    placed = lines.select("value", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_in"))
    counts = lines.select(F.spark_partition_id().alias("_part")).groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))  # one row a part
    return placed.join(F.broadcast(counts), "_part").select("value", (F.col("_base") + F.col("_in") + 1).alias("line"))


def read_outlets(spark: SparkSession, path: str, nrow: int, ncol: int) -> DataFrame:
    """(idx, cells) of the outlets in a table: fields are split at every comma and are plain integers,
    without blanks or quotes; line ends may be CRLF; empty lines are skipped. Errors name the line."""
    with open_binary(path) as f:
        head = f.readline()
    head = head.removesuffix(b"\n").removesuffix(b"\r").split(b",")
    for name in COLUMNS:
        if name.encode() not in head:
            raise ValueError(f"{path} has no column {name}")
    at = {name: head.index(name.encode()) for name in COLUMNS}
    lines = _numbered(spark.read.option("lineSep", "\n").text(path)).filter("line > 1")
    lines = lines.withColumn("value", F.regexp_replace("value", r"\r\z", "")).filter("value <> ''")
    fields = lines.withColumn("f", F.split("value", ",", -1))
    rows = fields.select("line", F.size("f").alias("n"), *[_whole(F.get("f", F.lit(at[c]))).alias(c) for c in COLUMNS])
    row, col = F.col(COLUMNS[0]), F.col(COLUMNS[1])
    problem = F.lit(None).cast("string")
    outside = (row < 0) | (row >= nrow) | (col < 0) | (col >= ncol)
    problem = F.when(outside, "outside").otherwise(problem)
    for c in sorted(COLUMNS, key=at.__getitem__, reverse=True):  # the first field of a line speaks first
        problem = F.when(F.col("n") <= at[c], "short").when(F.col(c).isNull(), c).otherwise(problem)
    bad = rows.withColumn("problem", problem).filter("problem is not null").agg(F.min(F.struct("line", "problem")).alias("b")).first()["b"]
    if bad is not None:
        if bad["problem"] == "short":
            raise ValueError(f"line {bad['line']} of {path} has too few fields")
        if bad["problem"] == "outside":
            raise ValueError(f"an outlet lies outside the grid (line {bad['line']} of {path})")
        raise ValueError(f"line {bad['line']} of {path} has no integer {bad['problem']}")
    return rows.select((row * ncol + col).alias("idx"), F.col(COLUMNS[2]).alias("cells"))


def outlets_of(spark: SparkSession, rows, cols, nrow: int, ncol: int) -> DataFrame:
    """(idx) of outlets given as two sequences."""
    rows, cols = list(rows), list(cols)
    if len(rows) != len(cols):
        raise ValueError("the rows and columns of the outlets differ in length")
    if any(isinstance(v, bool) or int(v) != v for v in (*rows, *cols)):
        raise ValueError("outlets must be integer rows and columns")
    if any(not (0 <= r < nrow and 0 <= c < ncol) for r, c in zip(rows, cols, strict=True)):
        raise ValueError("an outlet lies outside the grid")
    return spark.createDataFrame([(int(r) * ncol + int(c),) for r, c in zip(rows, cols, strict=True)], "idx long")
