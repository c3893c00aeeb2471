"""Values carried along a drainage forest: area, lengths, stream order.

Manners name how a parallel machine would write the values. Serial, pull, atomic push and push
under the conflict-free layering all give one result, and share one plan here. A plain push under
another layering loses writes: of several donors that write to a receiver in one layer the last
one wins. That documented result is reproduced, because callers compare it.

``edges``: idx, ds (ds = idx at a pit), without cycles: ``Network`` cuts them. ``mask``: idx of the
cells that take part; an edge counts only if both of its ends do; cells outside have ``nodata``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.operators.blocks import LIMIT, donors_of, fold_down, fold_up
from thalweg.operators.forest import Wanted, solve
from thalweg.operators.store import dealt

NODATA = -9999.0
MANNERS = ("serial", "pull", "push", "atomic_push")
#: Stream orders are kept in one byte.
MOST_ORDER = 255


def check_nodata(nodata: float, kind: str = "double") -> float:
    """``nodata`` as the kernel holds it; must stay finite and negative there."""
    value = float(np.float32(nodata)) if kind == "float" else float(nodata)
    if math.isnan(float(nodata)):
        raise ValueError("nodata must be a number, not NaN")
    if not (math.isfinite(value) and value < 0):
        raise ValueError(f"nodata must be finite and negative, and stay so in {kind}; got {nodata:g}")
    return value


def check_manner(manner: str, allowed: tuple[str, ...] = MANNERS) -> None:
    if manner not in allowed:
        raise ValueError(f"manner {manner!r} is not available here; use one of {allowed}")


def masked_forest(edges: DataFrame, mask: DataFrame | None) -> DataFrame:
    """idx, par of the cells in the mask; an edge that leaves it is cut."""
    if mask is None:
        return edges.select("idx", F.when(F.col("ds") != F.col("idx"), F.col("ds")).alias("par"))
    inside = mask.select(F.col("idx").alias("_m")).distinct()
    held = edges.join(dealt(inside), F.col("idx") == F.col("_m"), "left_semi")
    return held.join(dealt(inside), F.col("ds") == F.col("_m"), "left").select("idx", F.when(F.col("ds") != F.col("idx"), F.col("_m")).alias("par"))


def surviving(forest: DataFrame, layering: DataFrame) -> DataFrame:
    """The forest after a plain push under ``layering``: of the donors of a receiver that write in one
    layer only the one with the largest index keeps its edge."""
    layers = layering.select(F.col("idx").alias("_i"), "layer")
    placed = forest.join(dealt(layers), F.col("idx") == F.col("_i"), "left").drop("_i")
    last = placed.filter("par is not null").groupBy(F.col("par").alias("_p"), F.col("layer").alias("_l")).agg(F.max("idx").alias("_last"))
    kept = placed.join(dealt(last), (F.col("par") == F.col("_p")) & (F.col("layer") == F.col("_l")) & (F.col("idx") == F.col("_last")), "left")
    return kept.select("idx", F.when(F.col("_last").isNotNull(), F.col("par")).alias("par"))


def _outside(edges: DataFrame, found: DataFrame, column: str, value, kind: str) -> DataFrame:
    """``found`` (idx, column) over all cells of ``edges``, ``value`` where it has none."""
    got = found.select(F.col("idx").alias("_i"), F.col(column).alias("_v"))
    return edges.select("idx").join(dealt(got), F.col("idx") == F.col("_i"), "left").select("idx", F.coalesce("_v", F.lit(value)).cast(kind).alias(column))


def upstream_area(edges: DataFrame, area: DataFrame, mask: DataFrame | None = None, layering: DataFrame | None = None, nodata: float = NODATA) -> DataFrame:
    """(idx, upa): ``area`` (idx, area) summed over a cell and all cells upstream.

    FLOAT areas give FLOAT (summed as DOUBLE), all others DOUBLE. ``layering``: emulate a plain push
    under it. A cell whose own area is the no-data value takes no part.
    """
    kind = "float" if area.schema["area"].dataType.typeName() == "float" else "double"
    nodata = check_nodata(nodata, kind)
    forest = masked_forest(edges, mask)
    if layering is not None:
        forest = surviving(forest, layering)
    own = area.select(F.col("idx").alias("_a"), F.col("area").cast("double").alias("area"))
    weighed = forest.join(dealt(own), F.col("idx") == F.col("_a")).filter(F.col("area") != nodata).select("idx", "par", "area")
    there = weighed.select(F.col("idx").alias("_there"))
    weighed = weighed.join(dealt(there), F.col("par") == F.col("_there"), "left").select("idx", F.col("_there").alias("par"), "area")
    got = solve(weighed, Wanted(sums=("area",)), "area").select("idx", F.col("sum_area").alias("upa"))
    return _outside(edges, got, "upa", nodata, kind)


def distance_to_outlet(edges: DataFrame, plen: DataFrame, mask: DataFrame | None = None, exact: bool = False, base: DataFrame | None = None, nodata: float = NODATA, limit: int = LIMIT) -> DataFrame:
    """(idx, ldn): FLOAT length of the path to the outlet. ``plen``: idx, plen.

    Summed as DOUBLE by doubling. ``exact``: added hop by hop in FLOAT, as a serial pass rounds it
    (needs ``base`` for the sizes of subtrees).
    """
    nodata = check_nodata(nodata, "float")
    forest = masked_forest(edges, mask)
    steps = plen.select(F.col("idx").alias("_a"), F.col("plen").cast("double").alias("plen"))
    weighed = forest.join(dealt(steps), F.col("idx") == F.col("_a")).select("idx", "par", "plen")
    if not exact:
        got = solve(weighed, Wanted(path=("plen",)), "length").select("idx", F.col("path_plen").cast("float").alias("ldn"))
    else:
        sizes = base.select(F.col("idx").alias("_b"), "root", "size", "rank")
        cells = weighed.join(dealt(sizes), F.col("idx") == F.col("_b")).drop("_b")
        got = fold_down(cells, ("plen",), "ldn float", _hop_by_hop, limit)
    return _outside(edges, got, "ldn", nodata, "float")


def _hop_by_hop(frame: pd.DataFrame) -> pd.DataFrame:
    at, _ = donors_of(frame)
    out, step = np.zeros(len(frame), np.float32), frame["plen"].to_numpy(np.float32)
    given = frame["given"].to_numpy(dtype="float64")
    par = frame["par"].isna().to_numpy()
    for v in range(len(frame)):  # sorted by rank: the receiver is there before
        if not par[v]:
            out[v] = (out[at[v]] if at[v] >= 0 else np.float32(given[v])) + step[v]
    return pd.DataFrame({"idx": frame["idx"], "ldn": out})


def _settled() -> Column:
    """The height above the cell itself; rounding below zero is zero."""
    value = F.col("_h") - F.col("_own")
    return F.when((value < 0) & (value > -1e-4), 0.0).otherwise(value)


def longest_upstream_path(edges: DataFrame, ldn: DataFrame, mask: DataFrame | None = None, layering: DataFrame | None = None, base: DataFrame | None = None, nodata: float = NODATA, limit: int = LIMIT) -> DataFrame:
    """(idx, lup): FLOAT length up to the farthest source: the largest ``ldn`` (idx, ldn) upstream less
    the own. ``layering`` (with ``base``): emulate a plain push, where the last donor of a layer that
    is longer than what the receiver had before the layer wins."""
    nodata = check_nodata(nodata, "float")
    own = ldn.select(F.col("idx").alias("_a"), F.col("ldn").cast("float").alias("ldn"))
    forest = masked_forest(edges, mask).join(dealt(own), F.col("idx") == F.col("_a")).filter(F.col("ldn") != nodata).select("idx", "par", "ldn")
    there = forest.select(F.col("idx").alias("_there"))
    forest = forest.join(dealt(there), F.col("par") == F.col("_there"), "left").select("idx", F.col("_there").alias("par"), "ldn")
    if layering is None:
        got = solve(forest, Wanted(most=("ldn",)), "longest").select(F.col("idx").alias("_i"), F.col("most_ldn").alias("_h"))
    else:
        more = base.select(F.col("idx").alias("_b"), "root", "size", "depth").join(dealt(layering.select("idx", "layer")), F.col("_b") == F.col("idx")).drop("idx")
        cells = forest.join(dealt(more), F.col("idx") == F.col("_b")).drop("_b")
        got = fold_up(cells, ("ldn", "layer"), "h float", _last_taker, limit).select(F.col("idx").alias("_i"), F.col("h").alias("_h"))
    got = got.join(dealt(own), F.col("_i") == F.col("_a")).select(F.col("_i").alias("idx"), "_h", F.col("ldn").alias("_own"))
    return _outside(edges, got.select("idx", _settled().cast("float").alias("lup")), "lup", nodata, "float")


def _last_taker(frame: pd.DataFrame) -> pd.DataFrame:
    _, donors = donors_of(frame)
    height = frame["ldn"].to_numpy(np.float32).copy()
    known, layer = frame["known_h"].to_numpy(dtype="float64"), frame["layer"].to_numpy()
    for v in range(len(frame)):
        if not np.isnan(known[v]):
            height[v] = known[v]
            continue
        for t in sorted({layer[u] for u in donors[v]}):
            before = height[v]
            for u in donors[v]:  # by rising index: the last one stays
                if layer[u] == t and height[u] > before:
                    height[v] = height[u]
    return pd.DataFrame({"idx": frame["idx"], "h": height})


def strahler_order(edges: DataFrame, base: DataFrame, mask: DataFrame | None = None, layering: DataFrame | None = None, limit: int = LIMIT) -> DataFrame:
    """(idx, strahler SHORT): the largest order of the donors, one more where two or more donors have
    it, at most 255; 1 at a source, 0 outside ``mask``. ``layering``: emulate a plain push."""
    forest = masked_forest(edges, mask)
    if layering is not None:
        forest = surviving(forest, layering)
    # the sizes of the whole forest bound those of the masked one, so blocks stay in their limit
    more = base.select(F.col("idx").alias("_b"), "size", "depth", "root")
    cells = forest.join(dealt(more), F.col("idx") == F.col("_b")).drop("_b")
    if mask is not None or layering is not None:  # roots of what is left
        own = solve(forest.select("idx", "par"), Wanted(), "orders").select(F.col("idx").alias("_o"), F.col("root").alias("_root"))
        cells = cells.join(dealt(own), F.col("idx") == F.col("_o")).withColumn("root", F.col("_root")).drop("_o", "_root")
    got = fold_up(cells, (), "strahler short", _orders, limit)
    return _outside(edges, got, "strahler", 0, "short")


def _orders(frame: pd.DataFrame) -> pd.DataFrame:
    _, donors = donors_of(frame)
    known = frame["known_strahler"].to_numpy(dtype="float64")
    out = np.ones(len(frame), np.int16)
    for v in range(len(frame)):
        if not np.isnan(known[v]):
            out[v] = known[v]
        elif donors[v]:
            above = [int(out[u]) for u in donors[v]]
            top = max(above)
            out[v] = min(top + (above.count(top) > 1), MOST_ORDER)
    return pd.DataFrame({"idx": frame["idx"], "strahler": out})


def channel_mask(upa: DataFrame, threshold_km2: float = 10.0) -> DataFrame:
    """(idx) of the cells whose area reaches the threshold, taken as FLOAT."""
    return upa.filter(F.col("upa") >= F.lit(threshold_km2).cast("float")).select("idx")
