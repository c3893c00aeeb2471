"""Adjacency, labels, orderings, layerings and depth-first intervals of a drainage forest.

``base`` is the table that Network.base gives: idx, ds, par, looped, stranded, root, rank, size,
depth, head. Stranded cells reach no pit: they lie on a cycle (looped) or drain into one.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thalweg.operators.blocks import LIMIT, donors_of, fold_up
from thalweg.operators.forest import Wanted, solve
from thalweg.operators.store import cut, dealt, numbered, running_sum


# adjacency

def donor_counts(edges: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """(idx, n_up): donors of every cell; with ``mask`` (idx) only donors in it count."""
    donors = edges.filter("idx <> ds").select("idx", "ds")
    if mask is not None:
        donors = donors.join(dealt(mask.select("idx")), "idx", "left_semi")
    counts = donors.groupBy(F.col("ds").alias("_to")).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    return edges.select("idx").join(dealt(counts), F.col("idx") == F.col("_to"), "left").select("idx", F.coalesce("_n", F.lit(0)).alias("n_up"))


def donor_table(edges: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """(idx, donors array<long>), largest index first; with ``mask`` both ends must be in it."""
    donors = edges.filter("idx <> ds").select("idx", "ds")
    if mask is not None:
        inside = mask.select(F.col("idx").alias("_m"))
        donors = donors.join(dealt(inside), F.col("idx") == F.col("_m"), "left_semi").join(dealt(inside), F.col("ds") == F.col("_m"), "left_semi")
    lists = donors.groupBy(F.col("ds").alias("_to")).agg(F.sort_array(F.collect_list("idx"), asc=False).alias("_d"))
    none = F.array().cast("array<bigint>")
    return edges.select("idx").join(dealt(lists), F.col("idx") == F.col("_to"), "left").select("idx", F.coalesce("_d", none).alias("donors"))


# labels

def rank_to_pit(base: DataFrame) -> DataFrame:
    """(idx, rank): steps to the pit; -1 where there is none."""
    return base.select("idx", F.when(F.col("stranded"), -1).otherwise(F.col("rank")).alias("rank"))


def basins(base: DataFrame) -> DataFrame:
    """(idx, basin): pits are numbered from 1 by falling index; 0 where no pit is reached."""
    pits = base.filter("par is null and not looped").select(F.col("idx").alias("_pit"))
    pits = numbered(pits, [F.col("_pit").desc()], "_label").select("_pit", (F.col("_label") + 1).alias("_label"))
    return base.select("idx", "root").join(pits, F.col("root") == F.col("_pit"), "left").select("idx", F.coalesce("_label", F.lit(0)).cast("long").alias("basin"))


def main_stems(base: DataFrame, upa: DataFrame | None = None) -> DataFrame:
    """(idx, root): the cells of each basin's main stem, walked up from the pit: most cells upstream
    first, then (with ``upa``: idx, upa) the larger area, then the smaller index."""
    cells = base.filter("not stranded").select("idx", "par", "root", "size")
    best = [F.col("size").desc()]
    if upa is not None:
        cells = cells.join(dealt(upa.select("idx", F.col("upa").cast("float").alias("upa"))), "idx")
        best.append(F.col("upa").desc())
    first = F.row_number().over(Window.partitionBy("par").orderBy(*best, F.col("idx"))) == 1
    picked = cells.filter("par is not null").withColumn("_first", first).select(F.col("idx").alias("_i"), "_first")
    marked = cells.join(dealt(picked), F.col("idx") == F.col("_i"), "left").select("idx", "par", F.when(F.coalesce("_first", F.lit(True)), 0).otherwise(1).cast("long").alias("off"))
    return solve(marked, Wanted(path=("off",)), "stems").filter("path_off = 0").select("idx", "root")


# orderings

def sibling_offsets(base: DataFrame, upa: DataFrame | None = None) -> DataFrame:
    """Add ``off``: how many places after its receiver a cell comes in the depth-first order."""
    cells, order = base, [F.col("idx")]
    if upa is not None:
        areas = upa.select(F.col("idx").alias("_a"), F.col("upa").cast("float").alias("_upa"))
        cells = cells.join(dealt(areas), F.col("idx") == F.col("_a"), "left")
        usable = F.col("_upa").isNotNull() & ~F.isnan("_upa") & (F.col("_upa") > 0) & (F.col("_upa") < float("inf"))
        cells = cells.withColumn("_upa", F.when(usable, F.col("_upa")).otherwise(F.raise_error(F.lit("upa must be finite and positive on the network")).cast("float")))
        order = [F.col("_upa").desc(), F.col("idx")]
    # roots have no siblings; grouping them by their own index keeps them out of one window
    family = F.coalesce("par", F.lit(-1) - F.col("idx"))
    before = Window.partitionBy(family).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    off = F.coalesce(F.sum("size").over(before), F.lit(0)) + 1
    return cells.withColumn("off", off.cast("long")).drop("_a", "_upa")


def depth_first(base: DataFrame, upa: DataFrame | None = None) -> DataFrame:
    """(idx, pos, inner): downstream to upstream; pits by falling index, donors by index or, with
    ``upa``, by falling area. ``inner`` is the place within the basin."""
    cells = sibling_offsets(base.filter("not stranded"), upa)
    inner = solve(cells.select("idx", "par", "off"), Wanted(path=("off",)), "dfs").select(F.col("idx"), F.col("root"), F.col("path_off").alias("inner"))
    pits = base.filter("par is null and not looped").select(F.col("idx").alias("_pit"), "size")
    pits = running_sum(pits, [F.col("_pit").desc()], "size", "_base").select("_pit", "_base")
    # every root is a pit; an outer join keeps the cells from being the side that is sent whole
    return inner.join(pits, F.col("root") == F.col("_pit"), "left").select("idx", (F.col("_base") + F.col("inner")).cast("long").alias("pos"), F.col("inner").cast("long").alias("inner"))


def breadth_first(base: DataFrame) -> DataFrame:
    """(idx, pos): rings of equal rank; within one by pit, then by the depth-first place in the basin."""
    inner = depth_first(base).select(F.col("idx").alias("_i"), "inner")
    cells = base.filter("not stranded").select("idx", "rank", "root").join(dealt(inner), F.col("idx") == F.col("_i")).drop("_i")
    return numbered(cells, [F.col("rank"), F.col("root"), F.col("inner")], "pos").select("idx", "pos")


def from_sources(base: DataFrame) -> DataFrame:
    """(idx, pos), upstream to downstream: by the farthest source above, in steps, then by its index."""
    cells = base.filter("not looped").select("idx", "depth", "head")
    return numbered(cells, [F.col("depth"), F.col("head"), F.col("idx")], "pos").select("idx", "pos")


def reverse(ordering: DataFrame) -> DataFrame:
    n = ordering.count()
    return ordering.withColumn("pos", F.lit(n - 1) - F.col("pos"))


# layerings

def soonest(base: DataFrame) -> DataFrame:
    """(idx, layer): one past the last donor's layer; cells on a cycle have -1."""
    return base.select("idx", F.when(F.col("looped"), -1).otherwise(F.col("depth")).alias("layer"))


def latest(base: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(idx, layer): largest rank of the basin less the own; -1 where no pit is reached.
    ``labels`` (idx, basin; 0: none) may group the cells otherwise."""
    cells = base.select("idx", "root", "rank", "stranded")
    if labels is None:
        cells = cells.withColumn("basin", F.when(~F.col("stranded"), F.col("root")))
    else:
        given = labels.select(F.col("idx").alias("_i"), F.nullif(F.col("basin"), F.lit(0)).alias("basin"))
        cells = cells.join(dealt(given), F.col("idx") == F.col("_i"), "left").drop("_i")
    reached = cells.filter("basin is not null and not stranded")
    tops = reached.groupBy(F.col("basin").alias("_b")).agg(F.max("rank").alias("_top"))
    # every basin has a top; an outer join keeps the cells from being the side that is sent whole
    at = reached.join(tops, F.col("basin") == F.col("_b"), "left").select(F.col("idx").alias("_i"), (F.col("_top") - F.col("rank")).alias("layer"))
    return cells.select("idx").join(dealt(at), F.col("idx") == F.col("_i"), "left").select("idx", F.coalesce("layer", F.lit(-1)).alias("layer"))


def _claims(ready: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], int, int]:
    """When donors of one receiver claim it: [(donor, layer)], the receiver's own ready layer and its
    place in the queue. ``ready``: (first layer, queue place, donor).

    One donor a layer: of those waiting the one whose source comes first in the queue. A queue
    keeps the order of the sources it began with, because each entry is followed by at most one.
    """
    ready = sorted(ready)
    waiting: list[tuple[int, int]] = []
    out, at, t, place = [], 0, 0, 0
    while at < len(ready) or waiting:
        if not waiting:
            t = max(t, ready[at][0])
        while at < len(ready) and ready[at][0] <= t:
            heapq.heappush(waiting, (ready[at][1], ready[at][2]))
            at += 1
        place, donor = heapq.heappop(waiting)
        out.append((donor, t))
        t += 1
    return out, t, place


def _conflict_free(frame: pd.DataFrame) -> pd.DataFrame:
    at, donors = donors_of(frame)
    n = len(frame)
    ready, place, layer = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64)
    idx, looped = frame["idx"].to_numpy(), frame["looped"].to_numpy(bool)
    known = frame["known_ready"].to_numpy(dtype="float64")
    for v in range(n):
        if not np.isnan(known[v]):
            ready[v], place[v] = int(known[v]), int(frame["known_place"].iat[v])
        elif not donors[v]:
            place[v] = idx[v]
        else:
            claims, ready[v], place[v] = _claims([(int(ready[u]), int(place[u]), u) for u in donors[v]])
            for u, t in claims:
                layer[u] = t
        if at[v] < 0:
            layer[v] = -1 if looped[v] else ready[v]
    return pd.DataFrame({"idx": idx, "ready": ready, "place": place, "layer": layer})


def conflict_free(base: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(idx, layer): as soon as possible, but no two donors of a receiver in one layer; cells on a
    cycle have -1. A donor's layer is settled at its receiver, from its subtree alone."""
    got = fold_up(base, ("looped",), "ready long, place long, layer long", _conflict_free, limit)
    return got.select("idx", F.col("layer").cast("int").alias("layer"))


def layer_sizes(layering: DataFrame) -> DataFrame:
    """(layer, size, offset): members per layer and how many cells the layers before it hold. There
    are no more layers than steps in the longest path, so the window over them is small."""
    sizes = layering.filter("layer >= 0").groupBy("layer").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))


def decomposition(layering: DataFrame) -> DataFrame:
    """(idx, layer, pos): the cells by layer, then by index; cells without a layer are left out."""
    return numbered(layering.filter("layer >= 0").select("idx", "layer"), [F.col("layer"), F.col("idx")], "pos")


def reverse_layers(layering: DataFrame) -> DataFrame:
    """Layers counted from the other end, over the whole network; -1 stays."""
    top = layering.agg(F.coalesce(F.max("layer"), F.lit(-1)).alias("_top"))
    return layering.crossJoin(F.broadcast(top)).select("idx", F.when(F.col("layer") >= 0, F.col("_top") - F.col("layer")).otherwise(-1).alias("layer"))  # one row


def conflicts(edges: DataFrame, layering: DataFrame) -> DataFrame:
    """(layer, writes, conflicts): donors that write in a layer, and writes to a receiver that another
    donor of the layer writes to. Counted per (layer, receiver) first, so no layer meets in a task."""
    placed = edges.filter("idx <> ds").join(dealt(layering.filter("layer >= 0").select(F.col("idx").alias("_i"), "layer")), F.col("idx") == F.col("_i"))
    per = placed.groupBy("layer", "ds").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("layer").agg(F.sum("n").alias("writes"), F.sum(F.col("n") - 1).alias("conflicts"))


# depth-first intervals

def interval_blocks(outlets: DataFrame, n: int) -> DataFrame:
    """(first, last): the block of positions of each basin. ``outlets``: last (the outlet's position,
    upstream to downstream) and upg (cells of the basin). Blocks must tile 0..n-1 in order."""
    got = outlets.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("last") < 0).alias("off"), F.count_if((F.col("upg") < 1) | (F.col("upg") > n)).alias("odd"), F.count_distinct("last").alias("places")).first()
    if not got["rows"]:
        if n:
            raise ValueError(f"a sequence of {n} cells needs outlets, and there are none")
        return outlets.select((F.col("last") - F.col("upg") + 1).alias("first"), "last")
    if got["off"]:
        raise ValueError(f"{got['off']} of the outlets are cells without a place in the sequence")
    if got["odd"]:
        raise ValueError(f"{got['odd']} of the outlets have an upstream count that can't be: less than 1 or more than the {n} cells there are")
    if got["places"] < got["rows"]:
        raise ValueError("two outlets are one cell")
    summed = running_sum(outlets.select("last", F.col("upg").cast("long").alias("upg")), [F.col("last")], "upg", "before")
    first = F.col("last") - F.col("upg") + 1
    wrong = summed.filter(F.col("before") != first).agg(F.min("before").alias("at"), F.count(F.lit(1)).alias("n")).first()
    total = outlets.agg(F.sum("upg")).first()[0]
    if wrong["n"] or total != n:
        raise ValueError(f"the basins of these {got['rows']} outlets leave gaps in the {n} places of the sequence or overlap, first near place {wrong['at'] if wrong['n'] else n - 1}")
    return summed.select(first.alias("first"), "last")


def _block_of(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """Join each position to the block that holds it: an equi-join on coarse bins of positions.

    A block is listed in every bin it touches: at most (positions / bin + blocks) rows.
    """
    width = 1 << 16
    spread = blocks.withColumn("_bin", F.explode(F.sequence(F.expr(f"first div {width}"), F.expr(f"last div {width}"))))
    return cells.withColumn("_b", F.expr(f"seq div {width}")).join(dealt(spread), (F.col("_b") == F.col("_bin")) & (F.col("seq") >= F.col("first")) & (F.col("seq") <= F.col("last"))).drop("_b", "_bin")


def dfs_interval(cells: DataFrame, outlets: DataFrame) -> DataFrame:
    """(idx, dfs_in, dfs_out) of ``cells`` (idx, seq, upg): place in the depth-first sequence, upstream
    to downstream (-1 off the network), and cells upstream with itself. ``outlets``: idx.

    q drains through p exactly if dfs_in(p) <= dfs_in(q) <= dfs_out(p). Tables that don't belong
    together are refused: gaps, an outlet missing or given twice, counts that don't fit.
    """
    cells = cells.select("idx", F.col("seq").cast("long").alias("seq"), F.col("upg").cast("decimal(20,0)").alias("upg"))
    cells = cells.withColumn("upg", F.least("upg", F.lit((1 << 63) - 1).cast("decimal(20,0)")).cast("long"))
    on = cells.filter("seq >= 0")
    got = on.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("seq"), F.lit(-1)).alias("top")).first()
    n = got["n"]
    if n != got["top"] + 1:
        raise ValueError(f"the sequence has {n} cells but its last place is {got['top']}, so places are missing or taken twice")
    asked = outlets.select(F.col("idx").alias("_o"))
    ends = asked.join(dealt(cells), F.col("_o") == F.col("idx"), "left")
    if ends.filter("idx is null").limit(1).count():
        raise ValueError("one of the outlets is no cell of the grid")
    blocks = cut(interval_blocks(ends.select(F.col("seq").alias("last"), "upg"), n), "blocks")
    placed = _block_of(on, blocks)
    odd = placed.filter((F.col("upg") < 1) | (F.col("upg") > F.col("seq") - F.col("first") + 1)).limit(1).count()
    if odd:
        raise ValueError("a cell has an upstream count that can't be: less than 1, or more cells than come before it in its basin")
    twice = on.groupBy("seq").count().filter("count > 1").limit(1).count()
    if twice:
        missing = on.sparkSession.range(n).join(dealt(on.select(F.col("seq").alias("id"))), "id", "left_anti").agg(F.min("id")).first()[0]
        raise ValueError(f"no cell has place {missing} of the sequence, and another place is taken twice")
    start = F.col("first") + F.col("last") - F.col("seq")
    found = placed.select("idx", start.alias("dfs_in"), (start + F.col("upg") - 1).alias("dfs_out"))
    off = cells.filter("seq < 0 or seq is null").select("idx", F.lit(-1).cast("long").alias("dfs_in"), F.lit(-1).cast("long").alias("dfs_out"))
    return found.unionByName(off)


def drains_through(intervals: DataFrame, points: DataFrame) -> DataFrame:
    """(point, idx): all cells upstream of each point (idx), the point included, by interval
    containment; bins keep it an equi-join, and only the asked points are spread over bins."""
    width = 1 << 12
    asked = points.select(F.col("idx").alias("point")).join(dealt(intervals), F.col("point") == F.col("idx")).filter("dfs_in >= 0").select("point", F.col("dfs_in").alias("_in"), F.col("dfs_out").alias("_out"))
    asked = asked.withColumn("_bin", F.explode(F.sequence(F.expr(f"_in div {width}"), F.expr(f"_out div {width}"))))
    held = intervals.filter("dfs_in >= 0").select("idx", "dfs_in", F.expr(f"dfs_in div {width}").alias("_b"))
    return held.join(dealt(asked), F.col("_b") == F.col("_bin")).filter("dfs_in between _in and _out").select("point", "idx")

