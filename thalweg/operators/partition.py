"""Balanced, contiguous parts of a drainage network that can run apart from each other.

Cells are handled in DataFrames: basins, main stems, tributaries, and which of these touch on the
raster. What is collected is the graph of basins and tributaries (one row a basin of two cells or
more, and one a tributary of an opened basin), which is small beside the cells; it is divided on
the driver and the parts are joined back to the cells.

Graph: components of at least half a share are land; others are islands and go with the nearest
land. Parts are dealt to the lands, each land is bisected again and again by growing regions from
its rim, and nodes then move between neighbouring parts while that evens the loads. No part is cut
in two by a move: what a move would cut off travels along.

Level "basin" keeps basins whole. Level "subbasin" opens up to MOST_OPENED basins along their main
stems while that helps: tributaries become nodes, and the stem, from the first cell that a
tributary of another part enters, is held back to a second stage (part MAINSTEM).
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.operators.forest import Wanted, solve
from thalweg.operators.store import cut, dealt
from thalweg.operators.structure import main_stems

#: Part of the cells of an opened stem that wait for the second stage.
MAINSTEM = -2
MOST_OPENED, TRIALS, LEAST_GAIN = 4, 4, 0.01
#: The heaviest basins that may be opened.
OPENABLE = 32
#: Rounds in which weights follow from where the stems were cut.
STEM_ROUNDS = 4
#: Groups of nodes that are bisected, for each part.
GROUPS = 48
#: Links of a component where all are islands.
NEAREST = 4
#: More nodes than this aren't collected.
MOST_NODES = 5_000_000


@dataclass
class Graph:
    """Nodes 0..n-1: weight, row and column of the centre; links: (a, b) -> length of the boundary."""

    weight: np.ndarray
    row: np.ndarray
    col: np.ndarray
    links: dict[tuple[int, int], float]

    def __post_init__(self) -> None:
        self.near: list[dict[int, float]] = [{} for _ in self.weight]
        for (a, b), w in self.links.items():
            self.near[a][b] = self.near[a].get(b, 0) + w
            self.near[b][a] = self.near[b].get(a, 0) + w

    def __len__(self) -> int:
        return len(self.weight)

    def contracted(self, group: np.ndarray) -> Graph:
        """One node a group (0..m-1): weights added, centres averaged, links summed."""
        m = int(group.max()) + 1 if len(group) else 0
        total, cells = np.bincount(group, self.weight, m), np.bincount(group, np.maximum(self.weight, 1e-9), m)
        centre = lambda x: np.bincount(group, x * np.maximum(self.weight, 1e-9), m) / np.maximum(cells, 1e-12)
        return Graph(total, centre(self.row), centre(self.col), merged([(group[a], group[b], w) for (a, b), w in self.links.items()]))

    def pieces(self, nodes: set[int]) -> list[set[int]]:
        """Connected pieces of the nodes, the heaviest first."""
        left, out = set(nodes), []
        while left:
            seed = min(left)
            left.discard(seed)
            piece, todo = {seed}, deque([seed])
            while todo:
                for u in self.near[todo.popleft()]:
                    if u in left:
                        left.discard(u)
                        piece.add(u)
                        todo.append(u)
            out.append(piece)
        return sorted(out, key=lambda p: (-sum(self.weight[list(p)]), min(p)))


def merged(pairs) -> dict[tuple[int, int], float]:
    """Undirected links: loops dropped, equal ones added up."""
    out: dict[tuple[int, int], float] = {}
    for a, b, w in pairs:
        if a != b:
            key = (int(min(a, b)), int(max(a, b)))
            out[key] = out.get(key, 0) + w
    return out


def apportion(shares: np.ndarray, capacity: np.ndarray, n_parts: int) -> np.ndarray:
    """Parts for each mass, one at least, so that the heaviest part is as light as can be; no mass gets
    more parts than it has nodes, and what no mass can use is left over."""
    parts = np.minimum(1, capacity).astype(int)
    while parts.sum() < n_parts and (parts < capacity).any():
        per = np.where(parts < capacity, shares / np.maximum(parts, 1), -1)
        parts[int(np.argmax(per))] += 1
    return parts


def nearest(graph: Graph, node: int, others: np.ndarray, k: int = 1) -> np.ndarray:
    """The k of ``others`` nearest to the node; equal distances by index."""
    d = (graph.row[others] - graph.row[node]) ** 2 + (graph.col[others] - graph.col[node]) ** 2
    return others[np.lexsort((others, d))[:k]]


def coarsened(graph: Graph, most: int) -> np.ndarray:
    """A group for each node, at most about ``most`` of them: the lightest join their neighbour of the
    longest boundary, round after round."""
    group, now = np.arange(len(graph)), graph
    while len(now) > most:
        taken, to = np.zeros(len(now), bool), np.arange(len(now))
        spare = len(now) - most
        for v in np.lexsort((np.arange(len(now)), now.weight)):
            if spare <= 0:
                break
            if taken[v] or not now.near[v]:
                continue
            free = [u for u in now.near[v] if not taken[u]]
            if not free:
                continue
            u = max(free, key=lambda x: (now.near[v][x], -now.weight[x], -x))
            to[v], taken[v], taken[u] = u, True, True
            spare -= 1
        _, to = np.unique(to, return_inverse=True)
        if to.max() + 1 == len(now):
            break
        group, now = to[group], now.contracted(to)
    return group


def _ring(graph: Graph, nodes: set[int], start: int) -> list[int]:
    """Nodes by steps from the start; the last one is far from it."""
    seen, todo, out = {start}, deque([start]), []
    while todo:
        v = todo.popleft()
        out.append(v)
        for u in sorted(graph.near[v]):
            if u in nodes and u not in seen:
                seen.add(u)
                todo.append(u)
    return out


def _grown(graph: Graph, nodes: set[int], start: int, goal: float) -> tuple[set[int], float]:
    """A connected region of about ``goal`` from ``start`` whose rest is connected too, and its load."""
    region, load, w = {start}, float(graph.weight[start]), graph.weight
    rest = nodes - region
    for cut_off in graph.pieces(rest)[1:]:
        region |= cut_off
        load += sum(w[list(cut_off)])
        rest -= cut_off
    while load < goal and len(rest) > 1:
        rim: dict[int, float] = {}
        for v in region:
            for u, b in graph.near[v].items():
                if u in rest:
                    rim[u] = rim.get(u, 0) + b
        at = lambda u: (graph.row[u] - graph.row[start]) ** 2 + (graph.col[u] - graph.col[start]) ** 2
        done = False
        for u in sorted(rim, key=lambda u: (-rim[u] / max(sum(graph.near[u].values()), 1e-9), at(u), u))[:24]:
            pieces = graph.pieces(rest - {u})
            extra = {u}.union(*pieces[1:]) if len(pieces) > 1 else {u}
            more = float(sum(w[list(extra)]))
            if len(rest) > len(extra) and abs(load + more - goal) < abs(load - goal):
                region, rest, load, done = region | extra, rest - extra, load + more, True
                break
        if not done:
            break
    return region, load


def _halves(graph: Graph, nodes: set[int], share: float) -> tuple[set[int], set[int]]:
    """A connected set cut in two connected sets, the first of about ``share`` of the weight."""
    total = float(sum(graph.weight[list(nodes)]))
    first = _ring(graph, nodes, min(nodes))[-1]
    second = _ring(graph, nodes, first)[-1]
    corners = [min(nodes, key=lambda v, s=s, t=t: (s * graph.row[v] + t * graph.col[v], v)) for s, t in ((1, 1), (1, -1), (-1, 1), (-1, -1), (1, 0), (0, 1))]
    best = None
    for start in dict.fromkeys([first, second, *corners]):
        region, load = _grown(graph, nodes, start, share * total)
        border = sum(b for v in region for u, b in graph.near[v].items() if u in nodes and u not in region)
        score = (round(abs(load - share * total) / max(total, 1e-9), 3), border)
        if best is None or score < best[0]:
            best = (score, region)
    return best[1], nodes - best[1]


def _bisected(graph: Graph, nodes: set[int], k: int, first: int, part: np.ndarray) -> None:
    """Deal parts first..first+k-1 to a connected set of at least k nodes."""
    if k == 1 or len(nodes) <= 1:
        part[list(nodes)] = first
        return
    heavy = max(nodes, key=lambda v: (graph.weight[v], -v))
    total = float(sum(graph.weight[list(nodes)]))
    if len(nodes) <= k:
        for j, v in enumerate(sorted(nodes)):
            part[v] = first + j
        return
    if graph.weight[heavy] >= total / k:  # a part of its own, with what it cuts off
        pieces = graph.pieces(nodes - {heavy})
        part[heavy] = first
        shares = np.array([sum(graph.weight[list(p)]) for p in pieces])
        wanted = shares >= 0.5 * (total - graph.weight[heavy]) / max(k - 1, 1)
        wanted[0] = True
        held = [p for p, w in zip(pieces, wanted, strict=True) if w][: k - 1]
        for p in pieces:
            if p not in held:
                part[list(p)] = first
        got = apportion(np.array([sum(graph.weight[list(p)]) for p in held]), np.array([len(p) for p in held]), k - 1)
        at = first + 1
        for p, n in zip(held, got, strict=True):
            _bisected(graph, p, int(n), at, part)
            at += int(n)
        return
    left = k // 2
    one, two = _halves(graph, nodes, left / k)
    if len(one) < left or len(two) < k - left:
        left = max(1, min(len(one), k - len(two)))
        left = min(max(left, k - len(two)), len(one), k - 1)
    _bisected(graph, one, left, first, part)
    _bisected(graph, two, k - left, first + left, part)


def _moves(graph: Graph, part: np.ndarray, p: int, q: int | None, loads: np.ndarray) -> list[tuple[float, int, set[int]]]:
    """(load, to, nodes) of what may leave part p, to part q or to any lighter one; p stays in one piece."""
    own = set(np.flatnonzero(part == p).tolist())
    out = []
    for v in own:
        targets = {int(part[u]) for u in graph.near[v] if part[u] != p and part[u] >= 0}
        targets = {t for t in targets if (t == q if q is not None else loads[t] < loads[p])}
        if not targets or len(own) == 1:
            continue
        inner = [u for u in graph.near[v] if u in own]
        moved = {v}
        if len(inner) > 1:
            pieces = graph.pieces(own - {v})
            if len(pieces) > 1:
                moved = moved.union(*pieces[1:])
        if len(moved) == len(own):
            continue
        load = float(sum(graph.weight[list(moved)]))
        out += [(load, t, moved) for t in sorted(targets)]
    return out


def refined(graph: Graph, part: np.ndarray, n_parts: int, target: float = 1.0, most: int = 2000) -> np.ndarray:
    """Move nodes between neighbouring parts while the sum of squared loads falls: single moves first,
    then pairs of moves over a part between."""
    part = part.copy()
    loads = np.bincount(part[part >= 0], graph.weight[part >= 0], n_parts).astype(float)
    mean = loads.sum() / max(n_parts, 1)
    better = lambda p, t, x: (loads[p] - x) ** 2 + (loads[t] + x) ** 2 < loads[p] ** 2 + loads[t] ** 2 - 1e-9

    def apply(p: int, t: int, x: float, moved: set[int]) -> None:
        part[list(moved)] = t
        loads[p] -= x
        loads[t] += x

    for _ in range(most):
        if mean and loads.max() / mean <= target:
            break
        found = None
        for p in np.argsort(-loads, kind="stable"):
            options = [(((loads[p] - x) ** 2 + (loads[t] + x) ** 2) - loads[p] ** 2 - loads[t] ** 2, t, x, m) for x, t, m in _moves(graph, part, int(p), None, loads) if better(p, t, x)]
            if options:
                _, t, x, m = min(options, key=lambda o: (o[0], o[1], min(o[3])))
                found = (int(p), t, x, m)
                break
        if found:
            apply(*found)
            continue
        if not _chain(graph, part, loads, apply):
            break
    return part


def _chain(graph: Graph, part: np.ndarray, loads: np.ndarray, apply) -> bool:
    """Two moves p -> q -> r that together even the loads; applied if found."""
    before = float((loads**2).sum())
    for p in np.argsort(-loads, kind="stable")[:3]:
        beside = {int(part[u]) for v in np.flatnonzero(part == p) for u in graph.near[v] if part[u] != p and part[u] >= 0}
        for q in sorted(beside):
            for x, _, moved in sorted(_moves(graph, part, int(p), q, loads), key=lambda o: (o[0], min(o[2])))[:40]:
                apply(int(p), q, x, moved)
                wanted = loads[q] - x
                options = [o for o in _moves(graph, part, q, None, loads) if o[1] != p and o[2].isdisjoint(moved)]
                options = sorted(options, key=lambda o: (abs(loads[q] - o[0] - wanted), o[1]))[:40]
                for y, r, more in options:
                    total = float((loads**2).sum()) - loads[q] ** 2 - loads[r] ** 2 + (loads[q] - y) ** 2 + (loads[r] + y) ** 2
                    if total < before - 1e-9:
                        apply(q, r, y, more)
                        return True
                apply(q, int(p), x, moved)
    return False


def settled(graph: Graph, part: np.ndarray, limit: float) -> np.ndarray:
    """Splinters go home: of a part in several pieces, every piece but the heaviest that weighs less than ``limit`` joins
    the part with which it shares the longest boundary (the smallest of equal ones). A piece that touches nothing else is
    an island and stays; one that touches only splinters waits until one of them has settled."""
    part = part.copy()
    while True:
        held = [(p, graph.pieces(set(np.flatnonzero(part == p).tolist()))) for p in np.unique(part)]
        splinters = [(float(sum(graph.weight[list(x)])), min(x), x) for _, pieces in held for x in pieces[1:]]
        splinters = sorted((w, v, x) for w, v, x in splinters if w < limit)
        loose = set().union(*(x for _, _, x in splinters)) if splinters else set()
        moves = []
        for _, _, x in splinters:
            beside: dict[int, float] = {}
            for v in x:
                for u, b in graph.near[v].items():
                    if u not in loose:
                        beside[int(part[u])] = beside.get(int(part[u]), 0.0) + b
            if beside:
                moves.append((x, min(beside, key=lambda q: (-beside[q], q))))
        if not moves:
            return part
        for x, q in moves:
            part[list(x)] = q


def with_neighbours(graph: Graph, part: np.ndarray, has: np.ndarray) -> np.ndarray:
    """Nodes that don't have a part of their own take that of the nearest node, in steps, that has one, the smallest where
    several are as near; 0 where none is reached."""
    out, near = np.where(has, part, 0), set(np.flatnonzero(has).tolist())
    left = set(range(len(graph))) - near
    while near and left:
        asked = {u for v in near for u in graph.near[v] if u in left}
        found = {u: min(int(out[v]) for v in graph.near[u] if v in near) for u in asked}
        out[list(found)] = list(found.values())
        near, left = asked, left - asked
    return out


def divide(graph: Graph, n_parts: int, target: float = 1.005, refine: bool = True) -> np.ndarray:
    """A part for each node. Nodes without cells or without a centre weigh nothing: the others are divided, tied to each other
    through them, and they follow."""
    n = len(graph)
    live = (graph.weight > 0) & np.isfinite(graph.row) & np.isfinite(graph.col)
    if not live.any():
        return np.zeros(n, int)
    if not live.all():
        owner = with_neighbours(graph, np.arange(n), live)
        _, group = np.unique(owner, return_inverse=True)
        kept = Graph(np.where(live, graph.weight, 0.0), np.where(live, graph.row, 0.0), np.where(live, graph.col, 0.0), graph.links)
        part = divide(kept.contracted(group), n_parts, target, refine)[group]
        return with_neighbours(graph, part, live)
    return settled(graph, _divided(graph, n_parts, target, refine), graph.weight.sum() / max(n_parts, 1) / 100)


def _divided(graph: Graph, n_parts: int, target: float, refine: bool) -> np.ndarray:
    n = len(graph)
    part = np.zeros(n, int)
    if n_parts == 1:
        return part
    if n <= n_parts:
        return np.arange(n)
    share = graph.weight.sum() / n_parts
    pieces = graph.pieces(set(range(n)))
    weights = np.array([graph.weight[list(p)].sum() for p in pieces])
    n_land = int((weights >= share / 2).sum())
    if not n_land:  # an archipelago: links over the water make it one land
        graph, pieces = _bridged(graph, pieces), [set(range(n))]
        n_land = 1
    n_land = min(n_land, n_parts)
    while n_land < min(len(pieces), n_parts) and sum(len(p) for p in pieces[:n_land]) < n_parts:
        n_land += 1
    # an island becomes one with the nearest node of the lands
    group = np.arange(n)
    shore = np.array(sorted(set().union(*pieces[:n_land])))
    for island in pieces[n_land:]:
        best = min(island, key=lambda v: (_gap(graph, v, shore), v))
        group[list(island)] = nearest(graph, best, shore)[0]
    _, group = np.unique(group, return_inverse=True)
    whole = graph.contracted(group)
    lands = [p for p in whole.pieces(set(range(len(whole))))]
    got = apportion(np.array([whole.weight[list(p)].sum() for p in lands]), np.array([len(p) for p in lands]), n_parts)
    out, at = np.full(len(whole), -1), 0
    for land, k in zip(lands, got, strict=True):
        nodes = np.array(sorted(land))
        inner = {int(v): j for j, v in enumerate(nodes)}
        own = Graph(whole.weight[nodes], whole.row[nodes], whole.col[nodes], {(inner[a], inner[b]): w for (a, b), w in whole.links.items() if a in inner and b in inner})
        groups = coarsened(own, max(GROUPS * int(k), 4 * int(k)))
        coarse = own.contracted(groups)
        dealt = np.zeros(len(coarse), int)
        _bisected(coarse, set(range(len(coarse))), int(k), 0, dealt)
        if refine:
            dealt = refined(coarse, dealt, int(k), target)
            if len(coarse) < len(own):
                dealt = refined(own, dealt[groups], int(k), target)
                groups = np.arange(len(own))
        out[nodes] = dealt[groups] + at
        at += int(k)
    return out[group]


def _gap(graph: Graph, v: int, others: np.ndarray) -> float:
    return float(((graph.row[others] - graph.row[v]) ** 2 + (graph.col[others] - graph.col[v]) ** 2).min())


def _bridged(graph: Graph, pieces: list[set[int]]) -> Graph:
    """Links from each component to its nearest ones; at last all are connected."""
    links = dict(graph.links)
    owner = np.zeros(len(graph), int)
    for k, p in enumerate(pieces):
        owner[list(p)] = k
    for p in pieces:
        others = np.flatnonzero(owner != owner[min(p)])
        v = min(p, key=lambda x: (_gap(graph, x, others), x))
        seen: set[int] = set()
        for u in nearest(graph, v, others, 64):
            if owner[u] not in seen and len(seen) < NEAREST:
                seen.add(int(owner[u]))
                links[(min(v, int(u)), max(v, int(u)))] = links.get((min(v, int(u)), max(v, int(u))), 0) + 1
    while len(parts := (made := Graph(graph.weight, graph.row, graph.col, links)).pieces(set(range(len(graph))))) > 1:
        rest = np.array(sorted(set(range(len(graph))) - parts[0]))
        v = min(parts[0], key=lambda x: (_gap(graph, x, rest), x))
        u = int(nearest(graph, v, rest)[0])
        links[(min(u, v), max(u, v))] = 1
    return made


# from cells to graphs

def node_graph(cells: DataFrame, ncol: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of ``cells`` (idx, node): weight and centre of each node, and how many sides of
    cells two nodes share."""
    row, col = F.expr(f"idx div {ncol}"), F.col("idx") % ncol
    nodes = cells.groupBy("node").agg(F.count(F.lit(1)).alias("weight"), F.avg(row).alias("row"), F.avg(col).alias("col"))
    beside = cells.select("node", F.explode(F.array(F.when(col < ncol - 1, F.col("idx") + 1), F.col("idx") + ncol)).alias("_to")).filter("_to is not null")
    met = beside.join(dealt(cells.select(F.col("idx").alias("_i"), F.col("node").alias("_n"))), F.col("_to") == F.col("_i")).filter("node <> _n")
    links = met.groupBy(F.least("node", "_n").alias("a"), F.greatest("node", "_n").alias("b")).agg(F.count(F.lit(1)).alias("length"))
    return nodes, links


def _collected(cells: DataFrame, ncol: int, order: str) -> tuple[np.ndarray, Graph]:
    """The ids of the nodes and their graph; ids in rising or falling order."""
    nodes, links = node_graph(cells, ncol)
    n = nodes.count()
    if n > MOST_NODES:
        raise ValueError(f"{n} basins and tributaries are too many to divide on the driver")
    rows = nodes.toPandas().sort_values("node", ascending=order == "asc", ignore_index=True)
    ids = rows["node"].to_numpy(np.int64)
    place = {int(v): k for k, v in enumerate(ids)}
    pairs = [(place[int(a)], place[int(b)], float(w)) for a, b, w in links.toPandas().itertuples(index=False)]
    return ids, Graph(rows["weight"].to_numpy(float), rows["row"].to_numpy(float), rows["col"].to_numpy(float), merged(pairs))


def _even(loads: np.ndarray) -> float:
    mean = loads.mean() if len(loads) else 0.0
    return float(loads.max() / mean) if mean else 1.0


def _overload(loads: np.ndarray) -> float:
    return float(np.maximum(loads - loads.mean(), 0).sum() / max(loads.mean(), 1e-9))


@dataclass
class Stem:
    """The opened main stem of a basin: its length, and its tributaries (root, place of entry counted
    from the stem's source, cells), by place."""

    root: int
    length: int
    roots: np.ndarray
    entry: np.ndarray
    cells: np.ndarray

    def weights(self) -> np.ndarray:
        """Stem cells that weigh with each tributary: those down to its entry from the one before."""
        ends = self.entry + 1
        before = np.concatenate([[0], ends[:-1]])
        own = ends - before
        own[-1] += self.length - ends[-1]
        return own

    def cut_at(self, part: np.ndarray) -> tuple[int, int]:
        """(place of the first stem cell that another part enters, the trunk's part)."""
        trunk = int(part[0])
        other = np.flatnonzero(part != trunk)
        return (int(self.entry[other[0]]) if len(other) else self.length), trunk


def _opened(base: DataFrame, stems: DataFrame, openable: list[int]) -> tuple[DataFrame, list[Stem]]:
    """(cells of these basins: idx, node, place, root; their stems). A node is a tributary's root; the
    stem's cells have the node that they weigh with and their place from the source."""
    inside = base.filter(F.col("root").isin(*openable)).select("idx", "par", "root", "rank", "size")
    mark = stems.select(F.col("idx").alias("_s"))
    cells = inside.join(dealt(mark), F.col("idx") == F.col("_s"), "left").withColumn("stem", F.col("_s").isNotNull()).drop("_s")
    long = cells.filter("stem").groupBy(F.col("root").alias("_r")).agg(F.count(F.lit(1)).alias("length"))  # OPENABLE rows
    cells = cut(cells.join(F.broadcast(long), F.col("root") == F.col("_r")).withColumn("place", F.when(F.col("stem"), F.col("length") - 1 - F.col("rank"))).drop("_r"), "opened")
    onto = cells.filter("stem").select(F.col("idx").alias("_p"), F.col("place").alias("entry"))
    side = cut(cells.filter("not stem").join(dealt(onto), F.col("par") == F.col("_p"), "left"), "sides")
    tops = side.filter("entry is not null").select("root", "length", "entry", "size", F.col("idx").alias("trib"))
    found = tops.toPandas().sort_values(["root", "entry", "trib"], ignore_index=True)  # one row a tributary
    out = []
    for root, rows in found.groupby("root"):
        out.append(Stem(int(root), int(rows["length"].iat[0]), rows["trib"].to_numpy(), rows["entry"].to_numpy(), rows["size"].to_numpy()))
    trees = solve(side.select("idx", F.when(F.col("entry").isNull(), F.col("par")).alias("par")), Wanted(), "tributaries").select(F.col("idx").alias("_t"), F.col("root").alias("node"))
    trees = side.select("idx", "root").join(dealt(trees), F.col("idx") == F.col("_t")).select("idx", "node", F.lit(None).cast("long").alias("place"), "root")
    ends = []
    for s in out:
        own = np.cumsum(s.weights())
        ends += [(s.root, int(t), int(lo), int(hi)) for t, lo, hi in zip(s.roots, [0, *own[:-1]], own, strict=True) if hi > lo]
    ends = base.sparkSession.createDataFrame(ends or [(-1, -1, 0, 0)], "_r long, node long, lo long, hi long")
    width = 1024
    ends = ends.withColumn("_bin", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"greatest(hi - 1, lo) div {width}"))))
    placed = cells.filter("stem").withColumn("_b", F.expr(f"place div {width}")).join(ends, (F.col("root") == F.col("_r")) & (F.col("_b") == F.col("_bin")) & (F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi")))
    return trees.unionByName(placed.select("idx", "node", F.col("place").cast("long").alias("place"), "root")), out


@dataclass
class Plan:
    """A division: node ids (a basin's root, or a tributary's in an opened basin) with their parts,
    loads in cells, the graph, and the opened stems."""

    ids: np.ndarray
    part: np.ndarray
    loads: np.ndarray
    graph: Graph
    stems: list[Stem]


def _whole(cells: DataFrame, ncol: int, n_parts: int, target: float, refine: bool, order: str) -> Plan:
    ids, graph = _collected(cells, ncol, order)
    part = divide(graph, n_parts, target, refine)
    return Plan(ids, part, np.bincount(part, graph.weight, n_parts).astype(float) if len(part) else np.zeros(n_parts), graph, [])


@dataclass
class Openable:
    """The graph in which all basins that may be opened are; the node of each id; the basin of each node."""

    ids: np.ndarray
    graph: Graph
    root: np.ndarray
    stems: dict[int, Stem]


def _trial(fine: Openable, opened: list[int], n_parts: int, target: float, refine: bool) -> Plan:
    """A plan with the given basins opened, all on the driver; stem weights follow the cuts for a few
    rounds, and the most even outcome, counted in cells, is kept."""
    label = np.where(np.isin(fine.root, opened), fine.ids, fine.root)
    ids, group = np.unique(-label, return_inverse=True)
    ids, graph = -ids, fine.graph.contracted(group)
    place = {int(v): k for k, v in enumerate(ids)}
    found = [fine.stems[v] for v in opened]
    links, own = dict(graph.links), graph.weight.copy()
    for s in found:
        at = [place[int(t)] for t in s.roots]
        own[at] = s.cells
        for a, b in zip(at, at[1:], strict=False):  # neighbours along the stem, diagonal steps included
            key = (min(a, b), max(a, b))
            links[key] = links.get(key, 0) + 1
    best, weight = None, own.copy()
    for s in found:
        weight[[place[int(t)] for t in s.roots]] = s.cells + s.weights()
    part = None
    for _ in range(STEM_ROUNDS):
        now = Graph(weight, graph.row, graph.col, links)
        part = divide(now, n_parts, target, refine) if part is None else refined(now, part, n_parts, target)
        loads, cuts, weight = np.bincount(part, own, n_parts).astype(float), [], own.copy()
        for s in found:
            at = [place[int(t)] for t in s.roots]
            p_min, trunk = s.cut_at(part[at])
            loads[trunk] += p_min
            weight[at[0]] += p_min
            cuts.append(p_min)
        if best is None or (_even(loads), _overload(loads)) < best[0]:
            best = ((_even(loads), _overload(loads)), part.copy(), loads)
        if _even(loads) <= target:
            break
        if not refine:
            break
    again = divide(Graph(weight, graph.row, graph.col, links), n_parts, target, refine) if refine and best[0][0] > target else None
    if again is not None:
        loads = np.bincount(again, own, n_parts).astype(float)
        for s in found:
            at = [place[int(t)] for t in s.roots]
            p_min, trunk = s.cut_at(again[at])
            loads[trunk] += p_min
        if (_even(loads), _overload(loads)) < best[0]:
            best = ((_even(loads), _overload(loads)), again, loads)
    return Plan(ids, best[1], best[2], Graph(weight, graph.row, graph.col, links), found)


def _candidates(plan: Plan, eligible: dict[int, int], opened: list[int], target: float) -> list[int]:
    """Whole basins in or beside a part over the target or the lightest part, the heaviest first."""
    mean = plan.loads.mean()
    ends = {k for k, x in enumerate(plan.loads) if x > mean * target} | {int(np.argmin(plan.loads))}
    out = []
    for k, v in enumerate(plan.ids):
        if int(v) in eligible and int(v) not in opened and (plan.part[k] in ends or any(plan.part[u] in ends for u in plan.graph.near[k])):
            out.append(int(v))
    return sorted(out, key=lambda v: (-eligible[v], v))[:TRIALS]


def _labels(network, base: DataFrame, basins: DataFrame | None) -> tuple[DataFrame, str]:
    """Checks the caller's labels (idx, basin): one for each basin. Returns root -> node order."""
    if basins is None:
        return base, "desc"
    if basins.schema["basin"].dataType.typeName() in ("float", "double", "string"):
        raise ValueError("basins must hold whole numbers")
    pairs = base.filter("not stranded").join(dealt(basins.select(F.col("idx").alias("_i"), "basin")), F.col("idx") == F.col("_i"), "left").select("root", "basin").distinct()
    got = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("root").alias("roots"), F.count_distinct("basin").alias("labels"), F.count_if(F.col("basin").isNull() | (F.col("basin") <= 0)).alias("odd")).first()
    if got["odd"]:
        raise ValueError("basins must be positive on every cell of a basin")
    if not got["n"] == got["roots"] == got["labels"]:
        raise ValueError("basins must give one label for each basin and one basin for each label")
    return base, "desc"


def partition(network, n_parts: int = 4, level: str = "subbasin", refine: bool = True, imbalance_target: float = 1.005, upa: DataFrame | None = None, basins: DataFrame | None = None, seed: int = 42, min_subtree_size: int = 100_000) -> tuple[DataFrame, list[float]]:
    """((idx, part), loads in cells). part: -1 on a basin of one cell, MAINSTEM on a stem held back.

    Cells that reach no pit go to the lightest part and count in no load. ``upa`` (idx, upa) decides
    between tributaries with equally many cells when a stem is traced. The division has no random
    steps and groups nodes by weight, so ``seed`` and ``min_subtree_size`` are only checked.
    """
    if level not in ("basin", "subbasin"):
        raise ValueError("level must be 'basin' or 'subbasin'")
    if isinstance(n_parts, (bool, np.bool_)) or not isinstance(n_parts, (int, np.integer)):
        raise ValueError("n_parts must be a whole number")
    if n_parts < 1:
        raise ValueError("n_parts must be at least 1")
    if min_subtree_size < 1:
        raise ValueError("min_subtree_size must be at least 1")
    if not imbalance_target >= 1:
        raise ValueError("imbalance_target must be at least 1")
    n_parts, base = int(n_parts), network.base
    if upa is not None:
        odd = base.join(dealt(upa.select(F.col("idx").alias("_u"), F.col("upa").cast("float").alias("_a"))), F.col("idx") == F.col("_u"), "left")
        if odd.filter("_a is null or isnan(_a) or _a <= 0 or _a = float('inf')").limit(1).count():
            raise ValueError("upa holds a value that is not a finite, positive area on a cell of the network")
    base, order = _labels(network, base, basins)
    roots = base.filter("par is null and not looped and size > 1").select(F.col("idx").alias("_root"))
    whole = cut(base.filter("not stranded").join(roots, F.col("root") == F.col("_root")).select("idx", F.col("root").alias("node")), "basins")
    plan, cells = _whole(whole, network.ncol, n_parts, imbalance_target, refine, order), None
    if level == "subbasin" and len(plan.ids) and n_parts > 1 and _even(plan.loads) > imbalance_target:
        plan, cells = _open(network, base, whole, plan, n_parts, imbalance_target, refine, order, upa)
    return _to_cells(base, whole, cells, plan), [float(x) for x in plan.loads]


def _open(network, base: DataFrame, whole: DataFrame, plan: Plan, n_parts: int, target: float, refine: bool, order: str, upa: DataFrame | None) -> tuple[Plan, DataFrame | None]:
    """Open basins while that helps. The cells are gone through once, with the OPENABLE heaviest basins
    open; trials only contract that graph."""
    donors = network.edges.filter("idx <> ds").select(F.col("ds").alias("idx")).distinct()
    sources = base.filter("not stranded").select("idx", "root").join(dealt(donors), "idx", "left_anti").groupBy("root").agg(F.count(F.lit(1)).alias("sources")).filter("sources > 1")
    sizes = base.filter("par is null and not looped").select(F.col("idx").alias("root"), "size").join(sources, "root")
    eligible = {int(r["root"]): int(r["size"]) for r in sizes.orderBy(F.col("size").desc(), "root").limit(OPENABLE).collect()}
    if not eligible:
        return plan, None
    stems = main_stems(base, upa)
    made, found = _opened(base, stems, list(eligible))
    rest = whole.filter(~F.col("node").isin(*eligible)).select("idx", "node", F.lit(None).cast("long").alias("place"), F.col("node").alias("root"))
    cells = cut(rest.unionByName(made), "nodes")
    ids, graph = _collected(cells.select("idx", "node"), network.ncol, order)
    owner = {int(t): s.root for s in found for t in s.roots}
    fine = Openable(ids, graph, np.array([owner.get(int(v), int(v)) for v in ids]), {s.root: s for s in found})
    opened: list[int] = []
    share = plan.loads.sum() / n_parts
    while len(opened) < MOST_OPENED and _even(plan.loads) > target:
        names = _candidates(plan, eligible, opened, target)
        names = sorted(names, key=lambda v: (eligible[v] <= share * target, -eligible[v], v))
        kept = None
        for v in names:
            trial = _trial(fine, [*opened, v], n_parts, target, refine)
            gain = _even(plan.loads) - _even(trial.loads)
            # one of two equally heavy parts may get lighter while the other is as heavy as before
            helps = gain >= LEAST_GAIN or (trial.loads.max() <= plan.loads.max() and _overload(plan.loads) - _overload(trial.loads) >= LEAST_GAIN)
            if helps and (kept is None or (_even(trial.loads), _overload(trial.loads)) < (_even(kept[1].loads), _overload(kept[1].loads))):
                kept = (v, trial)
            if helps and _even(trial.loads) <= target:
                break
        if kept is None:
            break
        opened.append(kept[0])
        plan = kept[1]
    return plan, cells


def _to_cells(base: DataFrame, whole: DataFrame, cells: DataFrame | None, plan: Plan) -> DataFrame:
    spark = base.sparkSession
    lightest = int(np.argmin(plan.loads))
    nodes = [(int(v), int(p)) for v, p in zip(plan.ids, plan.part, strict=True)]
    nodes = spark.createDataFrame(nodes or [(-1, -1)], "_node long, part int")
    if not plan.stems:
        placed = whole.join(nodes, F.col("node") == F.col("_node")).select("idx", "part")
    else:
        opened = [s.root for s in plan.stems]
        at = {int(v): k for k, v in enumerate(plan.ids)}
        cuts = [(s.root, *s.cut_at(plan.part[[at[int(t)] for t in s.roots]])) for s in plan.stems]
        cuts = spark.createDataFrame(cuts, "_root long, p_min long, trunk int")
        inside = F.col("root").isin(*opened)
        named = cells.withColumn("node", F.when(inside, F.col("node")).otherwise(F.col("root"))).withColumn("place", F.when(inside, F.col("place")))
        placed = named.join(nodes, F.col("node") == F.col("_node"))
        stem = placed.filter("place is not null").join(F.broadcast(cuts), F.col("root") == F.col("_root"))  # MOST_OPENED rows
        stem = stem.select("idx", F.when(F.col("place") < F.col("p_min"), F.col("trunk")).otherwise(MAINSTEM).alias("part"))
        placed = placed.filter("place is null").select("idx", "part").unionByName(stem)
    got = placed.select(F.col("idx").alias("_i"), "part")
    out = base.select("idx", "stranded").join(dealt(got), F.col("idx") == F.col("_i"), "left")
    return cut(out.select("idx", F.when(F.col("stranded"), lightest).otherwise(F.coalesce("part", F.lit(-1))).cast("int").alias("part")), "parts")
