"""Tree recursions that aren't associative, evaluated in blocks of bounded size.

Some results at a cell depend on its donors' results by a rule that doubling can't split (the
conflict-free layering, stream orders, writes that get lost, hop-by-hop rounding). They still
depend on nothing but the cell's subtree, so the forest is taken apart: subtrees of at most
``limit`` cells are blocks, many blocks share a bucket, and each bucket is one pandas group. The
cells above, each of which drains more than ``limit`` cells, form a thin skeleton per basin; it is
evaluated afterwards with the blocks' results as its leaves. Top-down recursions run in reverse.

A skeleton of more than SKELETON cells is taken apart in the same way, by the number of its own cells upstream,
and so on, so no group holds more than about SKELETON cells of one basin.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.operators.forest import Wanted, solve
from thalweg.operators.store import cut, dealt

#: Cells of a block at most, and of a bucket about; and of one basin's skeleton before it is taken apart itself.
LIMIT = SKELETON = 200_000


def _blocks(cells: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """``cells`` with ``block`` (the root of its block; null on the skeleton); is there a skeleton?"""
    most = cells.agg(F.max("size")).first()[0] or 0
    if most <= limit:
        return cells.withColumn("block", F.col("root")), False
    over = cells.select(F.col("idx").alias("_p"), F.col("size").alias("_p_size"))
    low = cells.filter(F.col("size") <= limit).select("idx", "par").join(dealt(over), F.col("par") == F.col("_p"), "left")
    low = low.select("idx", F.when(F.col("_p_size") <= limit, F.col("par")).alias("par"))
    found = solve(low, Wanted(), "blocks").select(F.col("idx").alias("_i"), F.col("root").alias("block"))
    return cut(cells.join(dealt(found), F.col("idx") == F.col("_i"), "left").drop("_i"), "blocks"), True


def _buckets(blocks: DataFrame, limit: int) -> DataFrame:
    n = max(1, -(-blocks.count() // limit), int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return blocks.withColumn("bucket", F.pmod(F.xxhash64("block"), F.lit(n)))


def _own_sizes(cells: DataFrame) -> DataFrame | None:
    """``cells`` with ``size`` counted among themselves, if any basin holds more than SKELETON of them; else None."""
    if not cells.groupBy("root").count().filter(F.col("count") > SKELETON).limit(1).count():
        return None
    cells = cut(cells, "skeleton")
    there = cells.select(F.col("idx").alias("_p"))
    forest = cells.join(dealt(there), F.col("par") == F.col("_p"), "left").select("idx", F.col("_p").alias("par"), F.lit(1).cast("long").alias("one"))
    found = solve(forest, Wanted(sums=("one",)), "sizes").select(F.col("idx").alias("_i"), F.col("sum_one").alias("_n"))
    return cells.join(dealt(found), F.col("idx") == F.col("_i")).withColumn("size", F.col("_n")).drop("_i", "_n")


def fold_up(cells: DataFrame, extras: tuple[str, ...], outputs: str, fn: Callable[[pd.DataFrame], pd.DataFrame], limit: int = LIMIT) -> DataFrame:
    """idx and ``outputs`` of every cell, leaf to root.

    ``cells``: idx, par, root, size, depth and ``extras``. ``fn`` gets whole trees, sorted by
    (depth, idx), with ``known_<output>`` set where a cell's result is there already (its donors
    are then left out), and returns idx and the outputs of all rows.
    """
    fields = [x.strip().split() for x in outputs.split(",")]
    known = [F.lit(None).cast(kind).alias(f"known_{n}") for n, kind in fields]
    return _fold_up(cells.select("idx", "par", "root", "size", "depth", *extras, *known), extras, outputs, [n for n, _ in fields], fn, limit)


def _fold_up(cells: DataFrame, extras: tuple[str, ...], outputs: str, names: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], limit: int) -> DataFrame:
    known = [f"known_{n}" for n in names]
    ask, schema = ["idx", "par", "depth", *extras, *known], f"idx long, {outputs}"
    run = lambda f: fn(f[ask].sort_values(["depth", "idx"], kind="stable", ignore_index=True))
    cells, tall = _blocks(cells, limit)
    low = _buckets(cells.filter("block is not null"), limit).groupBy("bucket").applyInPandas(run, schema)
    if not tall:
        return low
    low = cut(low, "low")
    got = low.select(F.col("idx").alias("_i"), *[F.col(n).alias(f"known_{n}") for n in names])
    leaves = cells.filter("idx = block").drop(*known).join(dealt(got), F.col("idx") == F.col("_i"))
    above = cells.filter("block is null")
    both = above.drop("block").unionByName(leaves.select(*above.drop("block").columns))
    smaller = _own_sizes(both)
    high = both.groupBy("root").applyInPandas(run, schema) if smaller is None else _fold_up(smaller, extras, outputs, names, fn, limit)
    # a block root's own outputs may be settled by its receiver, so the skeleton speaks for it
    high = cut(high, "high")
    return low.join(dealt(high.select("idx")), "idx", "left_anti").unionByName(high)


def fold_down(cells: DataFrame, extras: tuple[str, ...], output: str, fn: Callable[[pd.DataFrame], pd.DataFrame], limit: int = LIMIT) -> DataFrame:
    """idx and ``output`` (name and type) of every cell, root to leaf: skeletons first, then blocks.
    ``fn`` gets rows sorted by rank with ``given``: the receiver's result where it isn't in the frame."""
    name, kind = output.split()
    return _fold_down(cells.select("idx", "par", "root", "size", "rank", *extras), extras, name, kind, fn, limit)


def _fold_down(cells: DataFrame, extras: tuple[str, ...], name: str, kind: str, fn: Callable[[pd.DataFrame], pd.DataFrame], limit: int) -> DataFrame:
    ask, schema = ["idx", "par", "rank", *extras, "given"], f"idx long, {name} {kind}"
    run = lambda f: fn(f[ask].sort_values(["rank", "idx"], kind="stable", ignore_index=True))
    cells, tall = _blocks(cells, limit)
    none = F.lit(None).cast(kind)
    if not tall:
        return _buckets(cells.withColumn("given", none), limit).groupBy("bucket").applyInPandas(run, schema)
    above = cells.filter("block is null").drop("block")
    smaller = _own_sizes(above)
    high = above.withColumn("given", none).groupBy("root").applyInPandas(run, schema) if smaller is None else _fold_down(smaller, extras, name, kind, fn, limit)
    high = cut(high, "high")
    given = high.select(F.col("idx").alias("_p"), F.col(name).alias("given"))
    low = cells.filter("block is not null").join(dealt(given), F.col("par") == F.col("_p"), "left").drop("_p")
    return high.unionByName(_buckets(low, limit).groupBy("bucket").applyInPandas(run, schema))


def donors_of(frame: pd.DataFrame) -> tuple[np.ndarray, list[list[int]]]:
    """Place of each row's receiver in the frame (-1: none), and each row's donors, by rising index."""
    place = pd.Series(np.arange(len(frame)), index=frame["idx"].to_numpy())
    par = frame["par"].to_numpy(dtype="float64")
    at = np.full(len(frame), -1, np.int64)
    has = ~np.isnan(par)
    at[has] = place.reindex(par[has].astype(np.int64)).fillna(-1).to_numpy().astype(np.int64)
    donors: list[list[int]] = [[] for _ in range(len(frame))]
    for k in np.argsort(frame["idx"].to_numpy(), kind="stable"):
        if at[k] >= 0:
            donors[at[k]].append(int(k))
    return at, donors
