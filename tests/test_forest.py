"""The forest solver in tiles of every width, and by doubling, against plain walks."""

import random

import pytest

from thalweg.operators import forest as G


def walked(rows):
    """{idx: (root, rank, path, sum, most, longest, depth, head)} of (idx, par, weight, value)."""
    by = {r[0]: r for r in rows}
    out = {v: [v, 0, 0.0, 0.0, -1e9, 0.0, 0, v] for v in by}
    for v in by:
        u, steps, length = v, 0, 0.0
        while True:
            o = out[u]
            o[3] += by[v][3]
            o[4] = max(o[4], by[v][3])
            o[5] = max(o[5], length)
            o[6], o[7] = max((o[6], o[7]), (steps, v))
            if by[u][1] is None:
                break
            length += by[u][2]
            steps += 1
            u = by[u][1]
        out[v][:3] = u, steps, length
    return {v: tuple(o) for v, o in out.items()}


def some(seed, n, spread):
    """Cells of a forest whose receivers lie up to ``spread`` indices away."""
    rng = random.Random(seed)
    names = sorted(rng.sample(range(3 * n), n))
    order = names[:]
    rng.shuffle(order)
    place = {v: k for k, v in enumerate(order)}
    rows = []
    for v in names:
        near = [u for u in names if place[u] < place[v] and abs(u - v) <= spread]
        rows.append((v, rng.choice(near) if near and rng.random() < 0.97 else None, float(rng.randrange(1, 9)), float(rng.randrange(9))))
    return rows


WANT = G.Wanted(path=("w",), sums=("x",), most=("x",), longest=("w",), depth=True)


@pytest.mark.parametrize(("n", "spread", "tile"), [(150, 3, 1 << 18), (400, 4, 25), (200, 600, 50), (60, 600, 1)])
def test_tiles_and_doubling_agree_with_walks(spark, monkeypatch, n, spread, tile):
    monkeypatch.setattr(G, "TILE", tile)
    monkeypatch.setattr(G, "WIDER", 2)
    rows = some(n + tile, n, spread)
    df = spark.createDataFrame(rows, "idx long, par long, w double, x double")
    got = {r["idx"]: (r["root"], r["rank"], r["path_w"], r["sum_x"], r["most_x"], r["longest_w"], r["depth"], r["head"]) for r in G.solve(df, WANT).collect()}
    assert got == walked(rows)


def test_a_long_river_through_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(G, "TILE", 64)
    n = 3000
    df = spark.range(n).selectExpr("id idx", f"if(id = {n - 1}, null, id + 1) par", "1L one")
    got = G.solve(df, G.Wanted(sums=("one",), depth=True)).orderBy("idx").collect()
    assert [(r["root"], r["rank"], r["sum_one"], r["depth"], r["head"]) for r in got] == [(n - 1, n - 1 - k, k + 1, k, 0) for k in range(n)]


@pytest.mark.parametrize("tile", [1 << 18, 4])
def test_cycles_are_told(spark, monkeypatch, tile):
    monkeypatch.setattr(G, "TILE", tile)
    rows = [(k, k + 1) for k in range(9)] + [(9, 3), (20, None), (21, 20)]
    with pytest.raises(G.CyclicError):
        G.solve(spark.createDataFrame(rows, "idx long, par long"))
    assert G.solve(spark.createDataFrame([], "idx long, par long")).count() == 0
