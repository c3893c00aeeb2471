"""Memory locality of orderings and layerings: strides, reuse, footprints, simulated caches.

A traversal reads each cell and then its receiver. Neighbours in the order are found by an
equi-join on the position, order statistics from counts of distinct values, and the caches by
their sets, which don't influence each other; a set's accesses are cut into stretches of bounded
length, each of which starts from the lines that the stretches before it leave in the set.
"""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thalweg.operators.store import at_ranks, cut, dealt, running_sum
from thalweg.operators.structure import decomposition

LINE_BYTES = 64
#: Fixed values of the modelled caches: lines in all, and lines of a set.
CACHE_LEVELS = {"L1": (512, 8), "L2": (16384, 16), "L3": (585728, 11)}
#: Where the receivers' array begins, in bytes.
RECEIVERS_AT = 1 << 40
#: Slots of the table that remembers when a line was last touched.
REUSE_SLOTS = 1 << 20
#: Accesses of a set, on average, in one stretch.
STRETCH = 1 << 16


def check_elem_bytes(elem_bytes: int) -> int:
    if int(elem_bytes) <= 0:
        raise ValueError(f"elem_bytes must be positive, got {elem_bytes!r}")
    return int(elem_bytes)


def _number(x) -> float:
    return float(x) if x is not None else 0.0


def _statistics(values: DataFrame, value: str, ranks: dict[str, float]) -> dict:
    """n, mean, max, and the values at the given percentiles; "median": the upper one."""
    head = values.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max")).first().asDict()
    n = head["n"]
    if n:
        head |= at_ranks(values.select(value), value, {k: n // 2 if p is None else min(int(p / 100.0 * (n - 1) + 0.5), n - 1) for k, p in ranks.items()})
    return head


def _accesses(ordering: DataFrame, edges: DataFrame) -> DataFrame:
    """idx, pos and, where there is one, the receiver ds."""
    receivers = edges.filter("idx <> ds").select(F.col("idx").alias("_i"), "ds")
    return ordering.select("idx", "pos").join(dealt(receivers), F.col("idx") == F.col("_i"), "left").drop("_i")


def reuse_intervals(ordering: DataFrame, elem_bytes: int = 4) -> DataFrame:
    """(interval): accesses since the same line was touched, as a table of REUSE_SLOTS slots sees it:
    a line whose slot another line took in between has lost its past."""
    line = F.expr(f"(idx * {check_elem_bytes(elem_bytes)}) div {LINE_BYTES}")
    lines = ordering.select("pos", line.alias("line")).withColumn("slot", F.col("line").bitwiseAND(REUSE_SLOTS - 1))
    order = Window.partitionBy("slot").orderBy("pos")
    seen = lines.select((F.col("pos") - F.lag("pos").over(order)).alias("interval"), (F.lag("line").over(order) == F.col("line")).alias("same"))
    return seen.filter("same").select("interval")


def miss_rates(ordering: DataFrame, edges: DataFrame, elem_bytes: int = 4, levels: tuple[str, ...] = ("L1", "L2", "L3"), stretch: int = STRETCH) -> dict[str, float]:
    """Share of accesses that miss, for each level; 1.0 without accesses. ``ordering``: idx, pos."""
    elem_bytes = check_elem_bytes(elem_bytes)
    both = _accesses(ordering, edges)
    line = lambda c, at: F.shiftright(c * elem_bytes + at, 6)
    cells = both.select((F.col("pos") * 2).alias("t"), line(F.col("idx"), 0).alias("line"))
    reads = both.filter("ds is not null").select((F.col("pos") * 2 + 1).alias("t"), line(F.col("ds"), RECEIVERS_AT).alias("line"))
    stream = cut(cells.unionByName(reads), "accesses")
    return {name: _missed(stream, *CACHE_LEVELS[name], stretch) for name in levels}


def _missed(stream: DataFrame, lines: int, ways: int, stretch: int) -> float:
    sets = lines // ways
    held = stream.withColumn("set", F.col("line") % sets).withColumn("part", F.expr(f"t div {sets * stretch}"))
    # what a part leaves behind: its last distinct lines, most recent first
    last = held.groupBy("set", "part", "line").agg(F.max("t").alias("t"))
    recent = F.row_number().over(Window.partitionBy("set", "part").orderBy(F.col("t").desc()))
    last = last.withColumn("place", recent).filter(F.col("place") <= ways)
    left = last.groupBy("set", "part").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("lines"))
    # the parts before, newest first, until the ways are full
    before = Window.partitionBy("set").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    merged = F.aggregate(
        F.col("_past"), F.array().cast("array<bigint>"),
        lambda acc, x: F.slice(F.concat(F.transform(x, lambda y: y["line"]), F.array_except(acc, F.transform(x, lambda y: y["line"]))), 1, ways),
    )
    warm = left.withColumn("_past", F.collect_list("lines").over(before)).select("set", "part", merged.alias("lines"))
    warm = warm.select("set", "part", F.posexplode("lines").alias("place", "line")).select("set", "part", (-1 - F.col("place")).cast("long").alias("t"), "line")
    deal = F.pmod(F.xxhash64("set", "part"), F.lit(4 * int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = held.select("set", "part", "t", "line").unionByName(warm).withColumn("bucket", deal)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["set", "part", "t"], kind="stable")
        missed, now, cache = 0, None, OrderedDict()
        for s, p, t, x in zip(frame["set"].tolist(), frame["part"].tolist(), frame["t"].tolist(), frame["line"].tolist(), strict=True):
            if now != (s, p):
                now, cache = (s, p), OrderedDict()
            if x in cache:
                cache.move_to_end(x)
                continue
            missed += t >= 0
            if len(cache) >= ways:
                cache.popitem(last=False)
            cache[x] = None
        return pd.DataFrame({"missed": [missed], "n": [int((frame["t"] >= 0).sum())]})

    got = rows.groupBy("bucket", "part").applyInPandas(run, "missed long, n long").agg(F.sum("missed").alias("missed"), F.sum("n").alias("n")).first()
    return got["missed"] / got["n"] if got["n"] else 1.0


def serial_locality(ordering: DataFrame, edges: DataFrame, ncol: int, elem_bytes: int = 4, levels: tuple[str, ...] = ("L1", "L2", "L3")) -> dict:
    """Metrics of one ordering (idx, pos)."""
    elem_bytes = check_elem_bytes(elem_bytes)
    ordering = cut(ordering.select("idx", "pos"), "ordering")
    behind = ordering.select(F.col("idx").alias("prev"), (F.col("pos") + 1).alias("_pos"))
    steps = cut(ordering.join(dealt(behind), F.col("pos") == F.col("_pos")).select(F.abs(F.col("idx") - F.col("prev")).alias("stride"), F.expr(f"idx div {ncol} <> prev div {ncol}").alias("jump")), "steps")
    stride = _statistics(steps, "stride", {"median": None, "p95": 95, "p99": 99})
    jumps = steps.agg(F.avg(F.col("jump").cast("int"))).first()[0]
    reads = cut(_accesses(ordering, edges).filter("ds is not null").select(F.abs(F.col("idx") - F.col("ds")).alias("d")), "reads")
    down = _statistics(reads, "d", {"median": None})
    reuse = cut(reuse_intervals(ordering, elem_bytes), "reuse")
    again = _statistics(reuse, "interval", {"median": None})
    n = ordering.count()
    out = {
        "stride_mean": _number(stride["mean"]), "stride_median": _number(stride.get("median")), "stride_p95": _number(stride.get("p95")), "stride_p99": _number(stride.get("p99")), "stride_max": int(stride["max"] or 0),
        "row_jump_frac": _number(jumps),
        "reuse_interval_mean": float(again["mean"]) if again["n"] else float(n), "reuse_interval_median": float(again["median"]) if again["n"] else float(n),
        "ds_stride_mean": _number(down["mean"]), "ds_stride_median": _number(down.get("median")), "ds_stride_max": int(down["max"] or 0),
    }
    return out | {f"miss_rate_{k}": v for k, v in miss_rates(ordering, edges, elem_bytes, levels).items()}


def layer_locality(layering: DataFrame, elem_bytes: int = 4) -> DataFrame:
    """(layer, span, footprint, gap_median, gap_hits) of each layer with cells.

    Cells are put in one order of (layer, idx), dealt by ranges, so that a layer with most of the
    cells spreads over tasks; medians come from counts per (layer, gap).
    """
    elem_bytes = check_elem_bytes(elem_bytes)
    line = lambda c: F.expr(f"({c} * {elem_bytes}) div {LINE_BYTES}")
    placed = cut(decomposition(layering), "layers")
    layers = placed.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), (F.max("idx") - F.min("idx")).alias("span"))
    prints = placed.select("layer", line("idx").alias("line")).distinct().groupBy(F.col("layer").alias("_f")).agg(F.count(F.lit(1)).alias("footprint"))
    behind = placed.select(F.col("layer").alias("_l"), F.col("idx").alias("prev"), (F.col("pos") + 1).alias("_pos"))
    gaps = placed.join(dealt(behind), (F.col("pos") == F.col("_pos")) & (F.col("layer") == F.col("_l")))
    gaps = gaps.groupBy("layer", (F.col("idx") - F.col("prev")).alias("gap")).agg(F.count(F.lit(1)).alias("m"), F.count_if(line("idx") == line("prev")).alias("hits"))
    gaps = cut(gaps, "gaps")
    before = running_sum(gaps, [F.col("layer"), F.col("gap")], "m", "before")
    per = gaps.groupBy("layer").agg(F.sum("m").alias("all"), F.sum("hits").alias("hits"))
    base = Window.orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)  # one row a layer
    per = per.withColumn("base", F.coalesce(F.sum("all").over(base), F.lit(0)))
    per = per.withColumn("rank", F.col("base") + F.expr("all div 2"))
    held = before.join(per.select(F.col("layer").alias("_g"), "rank"), F.col("layer") == F.col("_g"))
    middle = held.filter((F.col("before") <= F.col("rank")) & (F.col("before") + F.col("m") > F.col("rank"))).select(F.col("layer").alias("_m"), F.col("gap").alias("gap_median"))
    hits = per.select(F.col("layer").alias("_h"), (F.col("hits") / F.col("all")).alias("gap_hits"))
    out = layers.join(prints, F.col("layer") == F.col("_f")).join(middle, F.col("layer") == F.col("_m"), "left").join(hits, F.col("layer") == F.col("_h"), "left")
    return out.select("layer", "n", "span", "footprint", F.coalesce("gap_median", F.lit(0)).alias("gap_median"), F.coalesce("gap_hits", F.lit(1.0)).alias("gap_hits"))


def parallel_locality(layering: DataFrame, edges: DataFrame, ncol: int, elem_bytes: int = 4, levels: tuple[str, ...] = ("L1", "L2", "L3")) -> dict:
    """Metrics of one layering (idx, layer); its order is layer by layer, by index within one."""
    layering = cut(layering.filter("layer >= 0").select("idx", "layer"), "layering")
    per = cut(layer_locality(layering, elem_bytes), "per-layer")
    sums = per.agg(
        F.max("layer").alias("top"), F.sum("n").alias("ncells"), F.sum("span").alias("span"), F.max("span").alias("span_max"),
        F.sum("gap_median").alias("gap"), F.sum("gap_hits").alias("hits"), F.sum("footprint").alias("prints"), F.max("footprint").alias("prints_max"), F.count(F.lit(1)).alias("rows"),
    ).first()
    n = 0 if sums["top"] is None else sums["top"] + 1
    # a layer without cells has span 0
    empty = n - sums["rows"]
    spans = per.groupBy("span").count().orderBy("span").collect() if n else []
    middle, seen = 0, empty
    for span, k in spans:
        if seen > n // 2:
            break
        middle, seen = span, seen + k
    reads = layering.join(dealt(edges.filter("idx <> ds").select(F.col("idx").alias("_i"), "ds")), F.col("idx") == F.col("_i")).select(F.abs(F.col("idx") - F.col("ds")).alias("d"))
    down = _statistics(cut(reads, "reads"), "d", {"median": None})
    mean = lambda x: float(x) / n if n else 0.0
    out = {
        "nlayers": n, "ncells": int(sums["ncells"] or 0), "span_mean": mean(sums["span"] or 0), "span_median": float(middle), "span_max": int(sums["span_max"] or 0),
        "gap_median_mean": mean(sums["gap"] or 0), "gap_cl_hit_frac": mean(sums["hits"] or 0),
        "cl_footprint_mean": mean(sums["prints"] or 0), "cl_footprint_max": int(sums["prints_max"] or 0), "cl_footprint_sum": int(sums["prints"] or 0),
        "ds_stride_mean": _number(down["mean"]), "ds_stride_median": _number(down.get("median")), "ds_stride_max": int(down["max"] or 0),
    }
    return out | {f"miss_rate_{k}": v for k, v in miss_rates(decomposition(layering), edges, elem_bytes, levels).items()}
