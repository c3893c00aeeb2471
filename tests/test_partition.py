import brute
import numpy as np
import pytest
from brute import found, network

from thalweg.operators import partition as P
from thalweg.operators.partition import MAINSTEM, Graph, apportion, divide, merged, refined


def line(weights):
    n = len(weights)
    return Graph(np.array(weights, float), np.zeros(n), np.arange(n, dtype=float), {(k, k + 1): 1.0 for k in range(n - 1)})


def loads_of(part, weights, k):
    return np.bincount(part, weights, k).tolist()


def test_links_are_undirected_and_without_loops():
    assert merged([(1, 0, 2), (0, 1, 3), (2, 2, 9), (0, 1, 4)]) == {(0, 1): 9}


@pytest.mark.parametrize(("shares", "capacity", "want"), [([2.9, 1.1], [9, 9], [3, 1]), ([2, 1, 1], [9, 9, 9], [2, 1, 1]), ([3.5, 0.5], [2, 9], [2, 2])])
def test_parts_go_where_the_heaviest_gets_lightest(shares, capacity, want):
    assert apportion(np.array(shares, float), np.array(capacity), 4).tolist() == want


def test_a_line_is_evened_out():
    assert loads_of(refined(line([1] * 10), np.array([0] * 7 + [1] * 3), 2), [1] * 10, 2) == [5, 5]
    assert sorted(loads_of(divide(line([70] + [10] * 9), 4), [70] + [10] * 9, 4)) == [30, 30, 30, 70]
    assert loads_of(divide(line([10] * 24), 4), [10] * 24, 4) == [60] * 4


def test_what_a_move_cuts_off_travels_along():
    # a - c - b beside each other; only c touches the other part
    graph = Graph(np.array([1.0, 1, 1, 3, 3, 3, 1]), np.zeros(7), np.arange(7.0), {(0, 2): 1, (1, 2): 1, (2, 6): 1, (2, 3): 1, (3, 4): 1, (4, 5): 1})
    part = refined(graph, np.array([0, 0, 0, 0, 0, 0, 1]), 2)
    for k in (0, 1):
        assert len(graph.pieces(set(np.flatnonzero(part == k).tolist()))) == 1


@pytest.mark.parametrize("seed", range(3))
def test_random_grids_are_divided_evenly_and_in_one_piece_each(seed):
    rng, n = np.random.default_rng(seed), 18
    links = {}
    for r in range(n):
        for c in range(n):
            for y, x in ((r, c + 1), (r + 1, c)):
                if y < n and x < n:
                    links[(r * n + c, y * n + x)] = float(rng.integers(1, 9))
    graph = Graph(rng.integers(1, 50, n * n).astype(float), np.repeat(np.arange(n), n).astype(float), np.tile(np.arange(n), n).astype(float), links)
    for k in (2, 5, 8):
        part = divide(graph, k)
        loads = np.bincount(part, graph.weight, k)
        assert loads.max() / loads.mean() < 1.03
        assert all(len(graph.pieces(set(np.flatnonzero(part == j).tolist()))) == 1 for j in range(k))


def test_islands_without_a_land_are_divided_by_nearness():
    graph = Graph(np.full(20, 2.0), np.zeros(20), np.arange(20) * 3 + 0.5, {})
    part = divide(graph, 4)
    assert loads_of(part, graph.weight, 4) == [10] * 4
    for k in range(4):
        own = np.flatnonzero(part == k)
        assert own.max() - own.min() == 4


def check(net, ds, part, load):
    """Full cover, no flow between parts, the stem drains into itself, loads are cells, and the stages
    accumulate what one pass does."""
    got, size = found(part, "part"), {}
    for v in brute.cells(ds):
        p = brute.path(ds, v)
        if p:
            size[p[-1]] = size.get(p[-1], 0) + 1
    lone = {v for v in size if size[v] == 1}
    assert set(got) == set(brute.cells(ds)) and all((got[v] == -1) == (v in lone) for v in got)
    reaching = [v for v in got if brute.path(ds, v) and v not in lone]
    assert [sum(got[v] == k for v in reaching) for k in range(len(load))] == load
    for v in reaching:
        assert got[ds[v]] in (got[v], MAINSTEM)
    order = brute.depth_first(ds)[::-1]
    whole, staged = dict.fromkeys(order, 1), dict.fromkeys(order, 1)
    for v in order:
        if ds[v] != v:
            whole[ds[v]] += whole[v]
    for stage in (*range(len(load)), MAINSTEM):
        for v in order:
            if got[v] == stage and ds[v] != v:
                staged[ds[v]] += staged[v]
    assert staged == whole
    return got


def pieces(shape, got, value):
    """Pieces of a part on the raster, corners count as touching, the stem joined in."""
    left, n = {v for v, p in got.items() if p in (value, MAINSTEM)}, 0
    while left:
        todo, own = [left.pop()], False
        while todo:
            v = todo.pop()
            own = own or got[v] == value
            r, c = divmod(v, shape[1])
            for y in (r - 1, r, r + 1):
                for x in (c - 1, c, c + 1):
                    u = y * shape[1] + x
                    if 0 <= x < shape[1] and u in left:
                        left.discard(u)
                        todo.append(u)
        n += own
    return n


@pytest.mark.parametrize(
    ("nrow", "widths", "level", "bound"),
    [(12, [3] * 8, "basin", 1.0), (61, [61], "subbasin", 1.04), (41, [41, 27], "subbasin", 1.04), (21, [11] * 5, "basin", 1.6), (21, [11] * 5, "subbasin", 1.05), (41, [41, 41], "subbasin", 1.05)],
)
def test_rivers(spark, nrow, widths, level, bound):
    ds, shape = brute.rivers(nrow, widths)
    net = network(spark, ds, shape)
    part, load = net.partition(4, level, min_subtree_size=1)
    got = check(net, ds, part, load)
    assert max(load) / (sum(load) / 4) <= bound + 1e-9
    for k in range(4):
        assert pieces(shape, got, k) == 1
    if level == "basin":
        roots = {}
        for v in got:
            roots.setdefault(brute.path(ds, v)[-1], set()).add(got[v])
        assert all(len(x) == 1 for x in roots.values())


def test_a_terrain(spark):
    ds = brute.terrain(24, 24, seed=5, holes=20)
    net = network(spark, ds, (24, 24))
    for level in ("basin", "subbasin"):
        part, load = net.partition(3, level)
        check(net, ds, part, load)
        assert len(load) == 3


def test_a_basin_of_one_cell_takes_no_part(spark):
    ds = [-1] * 27
    for r in range(3):
        for c in range(9):
            v = r * 9 + c
            ds[v] = v + 1 if c < 3 or 5 <= c < 8 else v if c in (3, 8) or v == 4 else -1
    net = network(spark, ds, (3, 9))
    for level in ("basin", "subbasin"):
        part, load = net.partition(2, level)
        assert check(net, ds, part, load)[4] == -1
        assert sum(load) == net.ncells - 1


def test_two_tributaries_that_enter_one_cell(spark):
    ds = [-1] * 300
    for r in range(100):
        ds[r * 3 + 1] = (r + 1) * 3 + 1 if r < 99 else r * 3 + 1
    ds[150], ds[152] = 151, 151
    net = network(spark, ds, (100, 3))
    part, load = net.partition(4, "subbasin", min_subtree_size=1)
    got = check(net, ds, part, load)
    assert sorted(load) == [0, 0, 1, 51] and sum(p == MAINSTEM for p in got.values()) == 50


def test_stem_cells_weigh_with_the_tributary_that_enters_them():
    stem = P.Stem(0, 100, np.arange(4), np.array([50, 51, 52, 53]), np.ones(4))
    assert stem.weights().tolist() == [51, 1, 1, 47]
    assert stem.cut_at(np.array([0, 1, 0, 0])) == (51, 0)


def test_cycles_and_one_part(spark):
    ds = [1, 2, 3, 0, 5, 6, 7, 7]
    net = network(spark, ds, (1, 8))
    part, load = net.partition(2)
    got = found(part, "part")
    assert all(p >= 0 for p in got.values()) and sum(load) == 4
    part, load = net.partition(1)
    assert set(found(part, "part").values()) == {0} and load == [4.0]
    none = network(spark, [1, -1], (1, 2))
    part, load = none.partition(1)
    assert found(part, "part") == {0: -1} and load == [0.0]


def test_graph_of_columns(spark):
    cells = spark.createDataFrame([(v, v % 8) for v in range(64)], "idx long, node long")
    nodes, links = P.node_graph(cells, 8)
    assert {r["weight"] for r in nodes.collect()} == {8}
    assert {(r["a"], r["b"]): r["length"] for r in links.collect()} == {(k, k + 1): 8 for k in range(7)}


def test_options_that_are_refused(spark):
    net = network(spark, [1, 1], (1, 2))
    for bad in ({"n_parts": 0}, {"n_parts": -1}, {"n_parts": 2.5}, {"n_parts": True}, {"level": "cell"}, {"min_subtree_size": 0}, {"imbalance_target": 0.9}):
        with pytest.raises(ValueError):
            net.partition(**bad)
    with pytest.raises(ValueError):
        net.partition(2, upa=spark.createDataFrame([(0, 1.0), (1, float("nan"))], "idx long, upa double"))
    for labels in ([(0, 1), (1, 2)], [(0, 0), (1, 0)]):
        with pytest.raises(ValueError):
            net.partition(2, basins=spark.createDataFrame(labels, "idx long, basin long"))


def test_splinters_join_the_part_of_their_longest_boundary():
    # a row of nodes: 0 0 1 0 2 2, node 2 light; node 6 is an island of part 0
    g = P.Graph(np.array([5.0, 5, 0.1, 0.2, 5, 5, 0.1]), np.zeros(7), np.arange(7.0), {(0, 1): 1, (1, 2): 3, (2, 3): 1, (3, 4): 2, (4, 5): 1})
    got = P.settled(g, np.array([0, 0, 1, 0, 2, 2, 0]), 1.0)
    assert got.tolist() == [0, 0, 1, 2, 2, 2, 0]  # the only piece of a part stays, whatever its weight
    got = P.settled(g, np.array([0, 0, 2, 0, 2, 2, 0]), 1.0)
    assert got.tolist() == [0, 0, 0, 2, 2, 2, 0]  # two splinters side by side never swap
    assert P.settled(g, np.array([0, 0, 1, 0, 2, 2, 0]), 0.01).tolist() == [0, 0, 1, 0, 2, 2, 0]


def test_nodes_without_cells_follow_their_neighbours():
    g = P.Graph(np.array([4.0, 0, 4, 4, 0, 0]), np.array([0.0, np.nan, 0, 0, np.nan, 0]), np.array([0.0, 1, 2, 3, 4, 5]), {(0, 1): 1, (1, 2): 1, (2, 3): 1, (3, 4): 1})
    part = P.divide(g, 3)
    assert len({part[0], part[2], part[3]}) == 3 and part[1] in (part[0], part[2]) and part[4] == part[3] and part[5] == 0
    assert P.divide(P.Graph(np.zeros(3), np.zeros(3), np.zeros(3), {}), 2).tolist() == [0, 0, 0]
    assert P.with_neighbours(g, np.array([7, 0, 5, 5, 0, 0]), np.array([True, False, True, True, False, False])).tolist() == [7, 5, 5, 5, 5, 0]


def test_a_dominant_node_takes_what_it_cuts_off():
    # a star: the centre is above its share, and the small leaves it separates go with it
    weight = np.array([50.0, *[1.0] * 5, 20.0, 20.0])
    g = P.Graph(weight, np.zeros(8), np.arange(8.0), {**{(0, k): 1 for k in range(1, 6)}, (0, 6): 1, (6, 7): 1})
    part = P.divide(g, 3)
    assert {int(part[k]) for k in range(6)} == {int(part[0])} and len({int(part[0]), int(part[6]), int(part[7])}) == 3
