"""Plain loops over small networks, to hold the engine's results against.

A network is a list of receivers: ds[v], v itself at a pit, -1 off the network.
"""

from __future__ import annotations

import numpy as np

from thalweg.network import Network


def terrain(nrow: int, ncol: int, seed: int, holes: int = 0) -> list[int]:
    """Steepest descent on random heights over a tilt; some cells have no data."""
    rng = np.random.default_rng(seed)
    z = rng.random((nrow, ncol)) + np.arange(nrow)[:, None] * 0.35
    off = set(rng.choice(nrow * ncol, holes, replace=False).tolist())
    out = []
    for v in range(nrow * ncol):
        r, c = divmod(v, ncol)
        if v in off:
            out.append(-1)
            continue
        best, to = 0.0, v
        for dr, dc in ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)):
            y, x = r + dr, c + dc
            if 0 <= y < nrow and 0 <= x < ncol and y * ncol + x not in off:
                slope = (z[r, c] - z[y, x]) / (dr * dr + dc * dc) ** 0.5
                if slope > best:
                    best, to = slope, y * ncol + x
        out.append(to)
    return out


def rivers(nrow: int, widths: list[int]) -> tuple[list[int], tuple[int, int]]:
    """Basins side by side; rows drain into a middle column, which drains down to a pit."""
    ncol, first = sum(widths), 0
    out = [0] * (nrow * ncol)
    for w in widths:
        middle = first + w // 2
        for r in range(nrow):
            for c in range(first, first + w):
                v = r * ncol + c
                out[v] = v + 1 if c < middle else v - 1 if c > middle else v + ncol if r < nrow - 1 else v
        first += w
    return out, (nrow, ncol)


def cells(ds: list[int]) -> list[int]:
    return [v for v in range(len(ds)) if ds[v] >= 0]


def donors(ds: list[int]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {v: [] for v in cells(ds)}
    for v in cells(ds):
        if ds[v] != v:
            out[ds[v]].append(v)
    return out


def looped(ds: list[int]) -> set[int]:
    """Cells on a cycle of more than one cell."""
    out = set()
    for v in cells(ds):
        u, seen = v, set()
        while u not in seen and ds[u] != u:
            seen.add(u)
            u = ds[u]
        if ds[u] != u:
            w = ds[u]
            out.add(u)
            while w != u:
                out.add(w)
                w = ds[w]
    return out


def path(ds: list[int], v: int) -> list[int] | None:
    """v and all cells below it, down to the pit; None if there is no pit."""
    out = [v]
    while ds[out[-1]] != out[-1]:
        out.append(ds[out[-1]])
        if len(out) > len(ds):
            return None
    return out


def upstream(ds: list[int]) -> dict[int, set[int]]:
    """All cells above each cell, itself included; cells on cycles are left out."""
    loop, out = looped(ds), {v: {v} for v in cells(ds)}
    for v in cells(ds):
        if v in loop:
            continue
        u = v
        while ds[u] != u and ds[u] not in loop:
            u = ds[u]
            out[u].add(v)
    return out


def depth_first(ds: list[int], area: list[float] | None = None) -> list[int]:
    near, out = donors(ds), []

    def visit(v: int) -> None:
        todo = [v]
        while todo:
            u = todo.pop()
            out.append(u)
            todo += reversed(sorted(near[u], key=lambda x: ((-np.float32(area[x]) if area else 0), x)))

    for pit in sorted((v for v in cells(ds) if ds[v] == v), reverse=True):
        visit(pit)
    return out


def breadth_first(ds: list[int]) -> list[int]:
    near, ring, out = donors(ds), sorted(v for v in cells(ds) if ds[v] == v), []
    while ring:
        out += ring
        ring = [u for v in ring for u in near[v]]
    return out


def from_sources(ds: list[int]) -> list[int]:
    """Cells leave the queue when all their donors have; sources enter by index."""
    left = {v: len(x) for v, x in donors(ds).items()}
    queue, at = [v for v in cells(ds) if not left[v]], 0
    while at < len(queue):
        v, at = queue[at], at + 1
        if ds[v] != v:
            left[ds[v]] -= 1
            if not left[ds[v]]:
                queue.append(ds[v])
    return queue


def soonest(ds: list[int]) -> dict[int, int]:
    out = {}
    near = donors(ds)
    for v in from_sources(ds):
        out[v] = max((out[u] + 1 for u in near[v]), default=0)
    return out


def conflict_free(ds: list[int]) -> dict[int, int]:
    """The queue itself: whoever finds its receiver taken in this layer waits for the next."""
    left, out, t = {v: len(x) for v, x in donors(ds).items()}, {}, 0
    queue = [v for v in cells(ds) if not left[v]]
    while queue:
        taken, later = set(), []
        for v in queue:
            to = ds[v]
            if to == v:
                out[v] = t
            elif to in taken:
                later.append(v)
            else:
                out[v] = t
                taken.add(to)
                left[to] -= 1
                if not left[to]:
                    later.append(to)
        queue, t = later, t + 1
    return out


def push(ds: list[int], layers: dict[int, int], start: dict[int, float], combine) -> dict[int, float]:
    """A plain push: within a layer all read first and write then; the last write to a cell stays."""
    value = dict(start)
    for t in range(max(layers.values(), default=-1) + 1):
        here = [v for v in sorted(layers) if layers[v] == t and ds[v] != v]
        made = [(ds[v], combine(value[ds[v]], value[v])) for v in here]
        for to, x in made:
            if x is not None:
                value[to] = x
    return value


def strahler(ds: list[int], inside: set[int] | None = None) -> dict[int, int]:
    out, near = {}, donors(ds)
    for v in from_sources(ds):
        if inside is not None and v not in inside:
            continue
        above = sorted((out[u] for u in near[v] if u in out), reverse=True)
        out[v] = 1 if not above else above[0] + (len(above) > 1 and above[0] == above[1])
    return out


def network(spark, ds: list[int], shape: tuple[int, int], **options) -> Network:
    return Network.from_pointers(spark, ds, shape, **options)


def found(df, *columns: str) -> dict:
    """idx -> value (or values) of a result."""
    rows = df.select("idx", *columns).collect()
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: r[1] if len(columns) == 1 else tuple(r)[1:] for r in rows}
