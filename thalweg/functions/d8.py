"""D8 direction codes: cleaning, unknown codes, decoding into receivers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.operators.store import dealt

# Fixed values of the convention: powers of two clockwise from east; 0 and 255 end a path; 247 is
# no data. code: (step in rows, step in columns)
STEPS = {1: (0, 1), 2: (1, 1), 4: (1, 0), 8: (1, -1), 16: (0, -1), 32: (-1, -1), 64: (-1, 0), 128: (-1, 1)}
TERMINALS = (0, 255)
NODATA = 247


def _step(code: Column, axis: int) -> Column:
    down = [c for c, s in STEPS.items() if s[axis] == 1]
    up = [c for c, s in STEPS.items() if s[axis] == -1]
    return F.when(code.isin(*down), 1).when(code.isin(*up), -1).otherwise(0)


def clean_codes(grid: DataFrame, nodata: float | None = None) -> DataFrame:
    """``grid`` (idx, code of any numeric type) with code as SHORT and all no data as 247.

    No data is found on the column's own type before any cast. Other values must be whole numbers
    from 0 to 255; anything else, null included, is an error when the rows are computed.
    """
    raw = F.col("code")
    numeric = grid.schema["code"].dataType.typeName()
    is_float = numeric in ("float", "double")
    hole = F.lit(False)
    if nodata is not None:
        hole = (F.isnan(raw) if is_float else F.lit(False)) if math.isnan(float(nodata)) else raw == F.lit(nodata)
    whole = raw == F.floor(raw) if is_float else F.lit(True)
    bad = raw.isNull() | (F.isnan(raw) if is_float else F.lit(False)) | ~whole | (raw < 0) | (raw > 255)
    code = F.when(F.coalesce(hole, F.lit(False)), F.lit(NODATA)).when(bad, F.raise_error(F.lit("a flow direction is not a whole number in 0..255"))).otherwise(raw)
    return grid.withColumn("code", code.cast("short"))


def unknown_codes(grid: DataFrame, nodata: float | None = None) -> DataFrame:
    """(code, count) of codes that the convention doesn't define."""
    known = [*STEPS, *TERMINALS, NODATA]
    return clean_codes(grid, nodata).filter(~F.col("code").isin(*known)).groupBy("code").agg(F.count(F.lit(1)).alias("count"))


def receivers(grid: DataFrame, nrow: int, ncol: int, nodata: float | None = None) -> DataFrame:
    """edges (idx, ds) of a grid (idx, code): cells without data have no row; a cell whose step leaves
    the grid, enters no data or is no step at all is its own receiver. Columns don't wrap.

    One equi-join: each cell's target against the cells that have data.
    """
    cells = clean_codes(grid, nodata).filter(F.col("code") != NODATA)
    row, col = F.expr(f"idx div {ncol}") + _step(F.col("code"), 0), F.col("idx") % ncol + _step(F.col("code"), 1)
    inside = (row >= 0) & (row < nrow) & (col >= 0) & (col < ncol)
    aimed = cells.select("idx", F.when(inside, row * ncol + col).otherwise(F.col("idx")).cast("long").alias("aim"))
    there = cells.select(F.col("idx").alias("_there"))
    return aimed.join(dealt(there), F.col("aim") == F.col("_there"), "left").select("idx", F.coalesce("_there", "idx").alias("ds"))
