"""Path and subtree aggregates over a forest of cells, in tiles of consecutive cells and by pointer doubling.

A forest is a table with ``idx`` and ``par`` (the receiver; null at a root). Its state is, for each
cell, a jump and what lies on the way to it: steps and path weights; and what is known upstream: sums, largest
values, longest ways. Cells are dealt into tiles by their index. A tile settles the ways inside it at once, in
arrays; what is left are the cells from which a way leaves its tile, with jumps from one to the next. They are a
forest of the same kind, a small part of the cells on a raster, and are solved alike with wider tiles. Then
each tile takes what its ways meet further down and what flows into it, and settles its cells. So all cells are dealt
out twice, however long the paths, and no tile holds more than its share, however large the basin.

Where tiles leave too much over (indices without any order), pointer doubling goes on instead: in round k each cell
knows its 2^k-th receiver; values of a path are added root-ward along it, and values of a subtree
are sent to it. ceil(log2 of the longest path) rounds settle every cell, and each round is one aggregation and two
equi-joins on the cell index. Inside a tile the arrays are doubled in the same way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thalweg.operators.store import cut, cut_with, dealt

#: Consecutive cells of a tile, how many times wider tiles are on the next level, and the largest part of the cells that
#: may be left over for another level to be worth it.
TILE, WIDER, WORTH = 1 << 18, 8, 0.5
#: How tiles hold the types that they can.
KINDS = {"integer": np.int64, "long": np.int64, "short": np.int64, "float": np.float32, "double": np.float64}


class CyclicError(ValueError):
    """Some cells never reach a root."""


@dataclass(frozen=True)
class Wanted:
    """What ``solve`` computes besides ``root`` and ``rank``.

    path: weights summed over the cell's steps to the root (a root's own weight doesn't count);
    sums: values summed over the cell and all cells upstream; most: their largest value; longest: path
    weights whose largest sum from a cell upstream down to this cell is wanted; depth: also ``depth``,
    the steps from the farthest cell upstream, and ``head``, that cell (of equally far ones the
    largest index).
    """

    path: tuple[str, ...] = ()
    sums: tuple[str, ...] = ()
    most: tuple[str, ...] = ()
    longest: tuple[str, ...] = ()
    depth: bool = False


def solve(forest: DataFrame, want: Wanted = Wanted(), name: str = "forest") -> DataFrame:
    """idx, root, rank, path_<w>, sum_<w>, most_<w>, longest_<w>, depth, head for every cell of ``forest``.

    Raises CyclicError where a cell has no root; cut cycles first (``cycle_cells``). An empty
    forest gives an empty table.
    """
    paths = tuple(dict.fromkeys((*want.path, *want.longest)))
    root = F.col("par").isNull()
    zero = lambda c: F.lit(0).cast(forest.schema[c].dataType)
    state = forest.select(
        "idx", F.col("par").alias("jump"), F.coalesce("par", "idx").alias("root"), F.when(root, 0).otherwise(1).alias("rank"),
        *[F.when(root, zero(c)).otherwise(F.col(c)).alias(f"path_{c}") for c in paths],
        *[F.col(c).alias(f"sum_{c}") for c in want.sums],
        *[F.col(c).alias(f"most_{c}") for c in want.most],
        *[zero(c).alias(f"longest_{c}") for c in want.longest],
        *([F.struct(F.lit(0).alias("depth"), F.col("idx").alias("head")).alias("far")] if want.depth else []),
    )
    out = _settle(state, paths, want, name, TILE)
    return out.select(*[c for c in out.columns if c not in ("far", "jump")], *([F.col("far.depth"), F.col("far.head")] if want.depth else []))


def _settle(state: DataFrame, paths: tuple[str, ...], want: Wanted, name: str, span: int) -> DataFrame:
    """The state with every jump at its root, by tiles of ``span`` indices as long as they leave little over."""
    state, seen = cut_with(state, name, n=F.count(F.lit(1)), low=F.min("idx"), high=F.max("idx"), left=F.count_if(_leaves(span)))
    if not seen["n"]:
        return state
    if seen["left"] > WORTH * seen["n"] or seen["low"] < 0 or any(f.dataType.typeName() not in KINDS for f in state.schema if f.name != "far"):
        return _doubled(state, paths, want, name)
    tiles = Tiles(state, paths, want, span)
    inward = total = None
    if seen["left"]:
        inward, rest = tiles.contracted()
        total = _settle(rest, paths, want, name, span * WIDER)
    out, seen = cut_with(tiles.settled(inward, total), name, stuck=F.count_if(F.col("root") < 0))
    if seen["stuck"]:
        raise CyclicError("some cells drain into a cycle")
    return out


def _leaves(span: int) -> Column:
    """Whether a cell's jump goes to another tile."""
    return F.col("jump").isNotNull() & (F.expr(f"idx div {span}") != F.expr(f"jump div {span}"))


@dataclass(frozen=True)
class Layout:
    """What a tile must know: its width, the columns of what lies on the way and of what is upstream, and their types."""

    span: int
    ways: list[str]
    values: list[str]
    kind: dict[str, type]


class Tiles:
    """A state in tiles."""

    def __init__(self, state: DataFrame, paths: tuple[str, ...], want: Wanted, span: int):
        self.state, self.want, self.span = state, want, span
        self.ways = ["rank", *[f"path_{c}" for c in paths]]
        self.values = [*[f"sum_{c}" for c in want.sums], *[f"most_{c}" for c in want.most], *[f"longest_{c}" for c in want.longest], *(["depth", "head"] if want.depth else [])]
        self.flat = state.select("idx", "jump", "root", *self.ways, *[c for c in self.values if c not in ("depth", "head")], *([F.col("far.depth"), F.col("far.head")] if want.depth else []))
        self.schema = self.flat.schema
        self.layout = Layout(span, self.ways, self.values, {f.name: KINDS[f.dataType.typeName()] for f in self.schema})

    def _dealt(self, *parts: tuple[int, str, DataFrame]) -> DataFrame:
        """Rows of several kinds, each dealt to the tile of the index in the column that is named; columns that a kind doesn't have
        are null."""
        rows = None
        for kind, at, part in parts:
            part = part.select(F.expr(f"{at} div {self.span}").alias("tile"), F.lit(kind).alias("kind"), *[F.col(f.name) if f.name in part.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema])
            rows = part if rows is None else rows.unionByName(part)
        return rows

    def contracted(self) -> tuple[DataFrame, DataFrame]:
        """(inward, rest): the cells whose jump leaves their tile, as they are; and the state of what is left: such cells and the
        roots that their ways meet, each with a jump to the next of them."""
        inward = self.flat.filter(_leaves(self.span))
        layout, nothing = self.layout, [f for f in self.schema if f.name not in ("idx", "jump", *self.ways, *self.values)]
        schema = T.StructType([T.StructField("kind", T.IntegerType()), *[f for f in self.schema if f not in nothing]])
        names = schema.names

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            own, guests = frame[frame["kind"] == 0], frame[frame["kind"] == 1]
            cells = Cells(layout, own)
            last, way = cells.ways()
            if cells.stuck:
                return pd.DataFrame({"kind": [2]}).reindex(columns=names)
            at = cells.place(guests["jump"].to_numpy(np.int64))
            met = np.unique(last[at])
            out = np.unique(np.concatenate([met, np.flatnonzero(cells.leaves)]))
            values = cells.upstream()
            a = pd.DataFrame({"kind": 0, "idx": cells.idx[out], **{c: values[c][out] for c in layout.values}})
            b = pd.DataFrame({"kind": 1, "idx": guests["idx"].to_numpy(), "jump": cells.idx[last[at]], **{c: guests[c].to_numpy() + way[c][at] for c in layout.ways}})
            return pd.concat([a, b], ignore_index=True).reindex(columns=names)

        found, seen = cut_with(self._dealt((0, "idx", self.flat), (1, "jump", inward)).groupBy("tile").applyInPandas(run, schema), "left", stuck=F.count_if(F.col("kind") == 2))
        if seen["stuck"]:
            raise CyclicError("some cells drain into a cycle")
        on = found.filter("kind = 1").select(F.col("idx").alias("_i"), F.col("jump").alias("_jump"), *[F.col(c).alias(f"_{c}") for c in self.ways])
        rest = found.filter("kind = 0").join(dealt(on), F.col("idx") == F.col("_i"), "left")
        far = [F.struct("depth", "head").alias("far")] if self.want.depth else []
        rest = rest.select("idx", F.col("_jump").alias("jump"), F.coalesce("_jump", "idx").alias("root"), *[F.coalesce(f"_{c}", F.lit(0)).cast(self.schema[c].dataType).alias(c) for c in self.ways], *[c for c in self.values if c not in ("depth", "head")], *far)
        return inward, rest.select(*self.state.columns)

    def settled(self, inward: DataFrame | None, total: DataFrame | None) -> DataFrame:
        """The whole state. ``total``: the settled state of what was left over."""
        parts, layout = [(0, "idx", self.flat)], self.layout
        if total is not None:
            flat = total.select(*total.columns, *([F.col("far.depth"), F.col("far.head")] if self.want.depth else []))
            parts.append((2, "idx", flat))
            came = inward.select(F.col("idx").alias("_i"), F.col("jump").alias("_to"), *[F.col(c).alias(f"_{c}") for c in self.ways]).join(dealt(flat.select("idx", *self.values)), F.col("_i") == F.col("idx"))
            parts.append((1, "jump", came.select("idx", F.col("_to").alias("jump"), *[F.col(f"_{c}").alias(c) for c in self.ways], *self.values)))

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            cells = Cells(layout, frame[frame["kind"] == 0])
            last, way = cells.ways()
            cells.take(frame[frame["kind"] == 1])
            values = cells.upstream()
            further = frame[frame["kind"] == 2]
            root = cells.idx[last]
            if cells.stuck:
                root[:] = -1
            elif len(further):
                order = np.argsort(further["idx"].to_numpy(np.int64))
                known = further["idx"].to_numpy(np.int64)[order]
                at = np.minimum(np.searchsorted(known, root), len(known) - 1)
                hit = known[at] == root
                root = np.where(hit, further["root"].to_numpy(np.int64)[order][at], root)
                for c in layout.ways:
                    way[c] = way[c] + np.where(hit, further[c].to_numpy(way[c].dtype)[order][at], 0)
            return pd.DataFrame({"idx": cells.idx, "root": root, **way, **values})

        schema = T.StructType([f for f in self.schema if f.name != "jump"])
        names = schema.names
        out = self._dealt(*parts).groupBy("tile").applyInPandas(lambda f: run(f).reindex(columns=names), schema)
        far = [F.struct("depth", "head").alias("far")] if self.want.depth else []
        out = out.withColumn("jump", F.lit(None).cast(self.schema["jump"].dataType))
        return out.select("idx", "jump", "root", *self.ways, *[c for c in self.values if c not in ("depth", "head")], *far).select(*self.state.columns)


class Cells:
    """The cells of one tile in arrays, sorted by index."""

    def __init__(self, layout: Layout, frame: pd.DataFrame):
        frame = frame.sort_values("idx", ignore_index=True)
        self.layout, self.n, self.idx = layout, len(frame), frame["idx"].to_numpy(np.int64)
        jump = frame["jump"].fillna(-1).to_numpy(np.int64)
        self.leaves = (jump >= 0) & (jump // layout.span != self.idx // layout.span)
        self.hop = np.where((jump >= 0) & ~self.leaves, self.place(jump), -1)
        self.kind = layout.kind
        self.held = {c: frame[c].to_numpy(self.kind[c]) for c in (*layout.ways, *layout.values)}

    def place(self, idx: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.idx, idx), max(self.n - 1, 0))

    def ways(self) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """For each cell the place of the last cell of its way in this tile, and what lies between; ``levels`` keeps each doubling."""
        last = np.where(self.hop >= 0, self.hop, np.arange(self.n))
        way = {c: np.where(self.hop >= 0, self.held[c], 0).astype(self.kind[c]) for c in self.layout.ways}
        hop, self.levels, self.stuck = self.hop, [], 0
        while (hop >= 0).any():
            go = np.flatnonzero(hop >= 0)
            if 1 << len(self.levels) > 2 * self.n:  # no way inside is that long: whoever is left walks in circles
                self.stuck = len(go)
                break
            self.levels.append((go, hop[go], {c: way[c][go] for c in self.layout.ways}))
            new = np.full(self.n, -1)
            new[go] = hop[hop[go]]
            way = {c: x + x[last] for c, x in way.items()}
            last = last[last]
            hop = new
        return last, way

    def take(self, guests: pd.DataFrame) -> None:
        """Add what comes from cells of other tiles to the cells that they jump to."""
        self._send(self.place(guests["jump"].to_numpy(np.int64)), {c: guests[c].to_numpy(self.kind[c]) for c in (*self.layout.ways, *self.layout.values)}, self.held, self.held)

    def upstream(self) -> dict[str, np.ndarray]:
        """The values of each cell with all upstream of it in this tile."""
        now = {c: self.held[c].copy() for c in self.layout.values}
        for go, to, ways in self.levels:
            new = {c: x.copy() for c, x in now.items()}
            self._send(to, {**ways, **{c: now[c][go] for c in now}}, now, new)
            now = new
        return now

    def _send(self, to: np.ndarray, sent: dict[str, np.ndarray], before: dict[str, np.ndarray], out: dict[str, np.ndarray]) -> None:
        if not len(to):
            return
        for c in self.layout.values:
            what, _, of = c.partition("_")
            if what == "sum":
                if self.kind[c] is np.int64:
                    np.add.at(out[c], to, sent[c])
                else:
                    out[c] += np.bincount(to, sent[c], self.n).astype(self.kind[c])
            elif what == "most":
                np.fmax.at(out[c], to, sent[c])
            elif what == "longest":
                np.fmax.at(out[c], to, sent[c] + sent[f"path_{of}"])
        if "depth" in self.layout.values:
            depth, head = sent["depth"] + sent["rank"], sent["head"]
            top = before["depth"].copy()
            np.maximum.at(top, to, depth)
            best = np.where(before["depth"] == top, before["head"], -1)
            equal = depth == top[to]
            np.maximum.at(best, to[equal], head[equal])
            out["depth"], out["head"] = top, best


def _doubled(state: DataFrame, paths: tuple[str, ...], want: Wanted, name: str) -> DataFrame:
    """The state with every jump at its root, round by round."""
    left = None
    while True:
        state, seen = cut_with(state, name, active=F.count_if(F.col("jump").isNotNull()))
        if not seen["active"]:
            return state
        if seen["active"] == left:  # ranks leave no gaps: whoever is left walks in circles
            raise CyclicError(f"{left} cells drain into a cycle")
        left = seen["active"]
        state = _round(state, paths, want)


def _round(state: DataFrame, paths: tuple[str, ...], want: Wanted) -> DataFrame:
    """Send subtree values over the jump, then double the jumps.

    Only cells that still jump look ahead, so settled ones (whose jump is null) never meet under one
    key; what comes back is joined on the cell's own index.
    """
    sent = [F.sum(f"sum_{c}").cast(state.schema[f"sum_{c}"].dataType).alias(f"_sum_{c}") for c in want.sums]
    sent += [F.max(f"most_{c}").alias(f"_most_{c}") for c in want.most]
    sent += [F.max(F.col(f"longest_{c}") + F.col(f"path_{c}")).alias(f"_longest_{c}") for c in want.longest]
    if want.depth:
        sent.append(F.max(F.struct((F.col("far.depth") + F.col("rank")).alias("depth"), F.col("far.head").alias("head"))).alias("_far"))
    active = state.filter("jump is not null")
    ahead = state.select(F.col("idx").alias("_at"), F.col("jump").alias("_jump"), F.col("root").alias("_root"), F.col("rank").alias("_rank"), *[F.col(f"path_{c}").alias(f"_path_{c}") for c in paths])
    looked = active.select(F.col("idx").alias("_from"), F.col("jump").alias("_by")).join(dealt(ahead), F.col("_by") == F.col("_at")).drop("_by", "_at")
    now = state.join(dealt(looked), F.col("idx") == F.col("_from"), "left")
    if sent:
        got = active.groupBy(F.col("jump").alias("_to")).agg(*sent)
        now = now.join(dealt(got), F.col("idx") == F.col("_to"), "left")
    zero = lambda c: F.lit(0).cast(state.schema[c].dataType)
    return now.select(
        "idx", F.col("_jump").alias("jump"), F.coalesce("_root", "root").alias("root"), (F.col("rank") + F.coalesce("_rank", F.lit(0))).alias("rank"),
        *[(F.col(f"path_{c}") + F.coalesce(f"_path_{c}", zero(f"path_{c}"))).alias(f"path_{c}") for c in paths],
        *[(F.col(f"sum_{c}") + F.coalesce(f"_sum_{c}", zero(f"sum_{c}"))).alias(f"sum_{c}") for c in want.sums],
        *[F.greatest(f"most_{c}", f"_most_{c}").alias(f"most_{c}") for c in want.most],
        *[F.greatest(f"longest_{c}", f"_longest_{c}").alias(f"longest_{c}") for c in want.longest],
        *([F.greatest("far", "_far").alias("far")] if want.depth else []),
    )


def cycle_cells(edges: DataFrame) -> DataFrame:
    """(idx): the cells that lie on a cycle of more than one cell; ``edges``: idx, ds (ds = idx: a pit).

    Jumps double until no more cells leave the network through a pit, then until the image of the
    jumps no longer shrinks: what is left of the image is periodic.
    """
    state = edges.filter("idx <> ds").select("idx", F.col("ds").alias("jump"))
    left = images = None
    while True:
        # a jump onto a cell without an entry is a jump to a pit: it leaves
        ahead = state.select(F.col("idx").alias("_at"), F.col("jump").alias("_jump"))
        state = state.join(dealt(ahead), F.col("jump") == F.col("_at")).select("idx", F.col("_jump").alias("jump"))
        state, seen = cut_with(state, "cycles", n=F.count(F.lit(1)))
        if not seen["n"]:
            return state.select("idx")
        if seen["n"] == left:
            image = state.select("jump").distinct()
            n = image.count()
            if n == images:
                return image.select(F.col("jump").alias("idx"))
            images = n
        left = seen["n"]


def forest_of(edges: DataFrame, loops: DataFrame | None = None) -> DataFrame:
    """idx, par and ``looped`` (on a cycle): pits and cells on cycles have no ``par``."""
    if loops is None:
        return edges.select("idx", F.when(F.col("ds") != F.col("idx"), F.col("ds")).alias("par"), F.lit(False).alias("looped"))
    marked = edges.join(dealt(loops.select(F.col("idx").alias("_loop"))), F.col("idx") == F.col("_loop"), "left")
    looped = F.col("_loop").isNotNull()
    return marked.select("idx", F.when(~looped & (F.col("ds") != F.col("idx")), F.col("ds")).alias("par"), looped.alias("looped"))


def prepared(edges: DataFrame, want: Wanted, weigh=None) -> tuple[DataFrame, DataFrame]:
    """(forest, solved) of ``edges``; cycles are looked for only if the first try meets one.

    ``weigh`` adds the weights that ``want`` names to a forest.
    """
    weigh = weigh or (lambda f: f)
    try:
        forest = weigh(forest_of(edges))
        return forest, solve(forest, want)
    except CyclicError:
        forest = weigh(cut(forest_of(edges, cycle_cells(edges)), "forest"))
        return forest, solve(forest, want)
