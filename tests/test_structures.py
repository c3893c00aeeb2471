import pytest
from brute import found, network
import brute
from pyspark.sql import functions as F

from thalweg.operators import structure

SHAPE = (14, 17)


@pytest.fixture(scope="module")
def ds():
    return brute.terrain(*SHAPE, seed=4, holes=9)


@pytest.fixture(scope="module")
def net(spark, ds):
    return network(spark, ds, SHAPE)


def ordered(df):
    return [r[0] for r in df.orderBy("pos").select("idx").collect()]


def test_ranks_sizes_and_labels(net, ds):
    up, base = brute.upstream(ds), found(net.base, "rank", "size", "root")
    for v in brute.cells(ds):
        p = brute.path(ds, v)
        assert base[v] == (len(p) - 1, len(up[v]), p[-1])
    pits = sorted((v for v in brute.cells(ds) if ds[v] == v), reverse=True)
    assert found(net.basins, "basin") == {v: pits.index(brute.path(ds, v)[-1]) + 1 for v in brute.cells(ds)}
    assert net.nbasins == len(pits) and net.ncells == len(brute.cells(ds))


def test_orderings(net, ds):
    assert ordered(net.ordering("dfs")) == brute.depth_first(ds)
    assert ordered(net.ordering("bfs")) == brute.breadth_first(ds)
    assert ordered(net.ordering("topo", "u2d")) == brute.from_sources(ds)
    assert ordered(net.ordering("dfs", "u2d")) == brute.depth_first(ds)[::-1]
    assert ordered(net.ordering("topo", "d2u")) == brute.from_sources(ds)[::-1]


def test_depth_first_by_area_breaks_ties_by_index(spark, net, ds):
    area = [float(v % 3 + 1) for v in range(len(ds))]
    upa = spark.createDataFrame(list(enumerate(area)), "idx long, upa double")
    assert ordered(net.ordering("dfs", upa=upa)) == brute.depth_first(ds, area)
    odd = spark.createDataFrame([(k, float("nan") if k == 0 else 1.0) for k in range(len(ds))], "idx long, upa double")
    with pytest.raises(Exception, match="finite and positive"):
        net.ordering("dfs", upa=odd)
    with pytest.raises(ValueError):
        net.ordering("bfs", upa=upa)
    with pytest.raises(ValueError):
        net.ordering("dfs", "sideways")
    with pytest.raises(ValueError):
        net.ordering("lex")


def test_layerings(net, ds):
    assert found(net.layering("asap"), "layer") == brute.soonest(ds)
    assert found(net.layering("cfds"), "layer") == brute.conflict_free(ds)
    top = {}
    for v in brute.cells(ds):
        p = brute.path(ds, v)
        top[p[-1]] = max(top.get(p[-1], 0), len(p) - 1)
    assert found(net.layering("alap"), "layer") == {v: top[brute.path(ds, v)[-1]] - len(brute.path(ds, v)) + 1 for v in brute.cells(ds)}
    lost = {k: net.conflicts(k).agg(F.sum("conflicts")).first()[0] for k in ("asap", "cfds", "alap")}
    assert lost["cfds"] == 0 and lost["asap"] > 0 and lost["alap"] > 0
    with pytest.raises(ValueError):
        net.layering("soon")


def test_conflict_free_layers_do_not_depend_on_the_block_size(net, ds):
    for limit in (1, 5, 40):
        assert found(structure.conflict_free(net.base, limit), "layer") == brute.conflict_free(ds)


def test_decomposition(net, ds):
    layers = brute.soonest(ds)
    want = sorted(layers, key=lambda v: (layers[v], v))
    assert ordered(net.decomposition("asap")) == want
    sizes = [tuple(r) for r in structure.layer_sizes(net.layering("asap")).orderBy("layer").collect()]
    assert sum(n for _, n, _ in sizes) == len(layers) and [o for _, _, o in sizes] == [sum(n for _, n, _ in sizes[:k]) for k in range(len(sizes))]
    top = max(layers.values())
    assert found(net.decomposition("asap", "d2u"), "layer") == {v: top - x for v, x in layers.items()}


def test_donors(spark, net, ds):
    near = brute.donors(ds)
    assert found(net.upstream(), "donors", "n_up") == {v: (sorted(x, reverse=True), len(x)) for v, x in near.items()}
    kept = [v for v in range(len(ds)) if v % 3]
    mask = spark.createDataFrame([(v,) for v in kept], "idx long")
    want = {v: (sorted((u for u in x if u % 3), reverse=True) if v % 3 else [], sum(u % 3 > 0 for u in x)) for v, x in near.items()}
    assert found(net.upstream(mask), "donors", "n_up") == want


def test_masks_of_a_confluence(spark):
    net = network(spark, [3, 3, -1, 3], (2, 2))
    for kept, first in (([0, 3], 0), ([1, 3], 1)):
        mask = spark.createDataFrame([(v,) for v in kept], "idx long")
        assert found(net.upstream(mask), "donors", "n_up")[3] == ([first], 1)


def test_intervals_hold_the_cells_upstream(spark, net, ds):
    got, up = found(net.dfs_interval(), "dfs_in", "dfs_out"), brute.upstream(ds)
    for p in brute.cells(ds):
        lo, hi = got[p]
        assert {q for q in got if lo <= got[q][0] <= hi} == up[p]
    points = spark.createDataFrame([(v,) for v in brute.cells(ds)[::5]], "idx long")
    pairs = {(r[0], r[1]) for r in structure.drains_through(net.dfs_interval(), points).collect()}
    assert pairs == {(p, q) for p in brute.cells(ds)[::5] for q in up[p]}


def interval_input(spark, rows):
    return spark.createDataFrame(rows, "idx long, seq long, upg long")


@pytest.mark.parametrize(
    ("rows", "outlets", "message"),
    [
        ([(0, 0, 1), (1, 0, 1), (2, 2, 3)], [2], "no cell has place 1"),
        ([(0, 0, 1), (1, 1, 2), (2, 2, 4)], [2], "more than the 3 cells"),
        ([(0, 0, 1), (1, 1, 0), (2, 2, 3)], [2], "less than 1"),
        ([(0, 0, 1), (1, 1, 1), (2, 3, 3)], [2], "last place is 3"),
        ([(0, 0, 1), (1, 1, 2), (2, 2, 3)], [], "needs outlets"),
        ([(0, 0, 1), (1, 1, 2), (2, 2, 3)], [2, 2], "one cell"),
        ([(0, 0, 1), (1, 1, 2), (2, 2, 3)], [1], "gaps"),
        ([(0, 0, 1), (1, 1, 2), (2, -1, 3)], [2], "without a place"),
        ([(0, 0, 1), (1, 1, 2), (2, 2, 3)], [9], "no cell of the grid"),
    ],
)
def test_intervals_refuse_what_does_not_belong_together(spark, rows, outlets, message):
    with pytest.raises(ValueError, match=message):
        structure.dfs_interval(interval_input(spark, rows), spark.createDataFrame([(v,) for v in outlets], "idx long"))


def test_a_huge_count_is_refused_and_not_wrapped(spark):
    from decimal import Decimal

    rows = spark.createDataFrame([(0, 0, Decimal(2**64 - 1)), (1, 1, Decimal(2))], "idx long, seq long, upg decimal(20,0)")
    with pytest.raises(ValueError, match="upstream count"):
        structure.dfs_interval(rows, spark.createDataFrame([(1,)], "idx long"))


def test_main_stems(spark):
    net = network(spark, [3, 3, -1, 3], (2, 2))
    assert set(found(structure.main_stems(net.base), "root")) == {3, 0}
    ds = [3, -1, 3, 3]
    net = network(spark, ds, (2, 2))
    upa = spark.createDataFrame([(0, 0.00431728), (1, 0.0), (2, 0.00431739), (3, 0.0129)], "idx long, upa double")
    assert set(found(structure.main_stems(net.base, upa), "root")) == {3, 2}
    same = upa.withColumn("upa", F.lit(1.0))
    assert set(found(structure.main_stems(net.base, same), "root")) == {3, 0}


# cycles

def test_a_chain_into_a_ring_is_covered_by_what_can_schedule_it(spark):
    # eight cells in a row that enter a ring of four
    ds = [*range(1, 9), 9, 10, 11, 8]
    net = network(spark, ds, (1, 12))
    n = {k: net.ordering(k).count() for k in ("dfs", "bfs", "topo")}
    n |= {k: net.layering(k).filter("layer >= 0").count() for k in ("asap", "cfds", "alap")}
    assert n == {"dfs": 0, "bfs": 0, "topo": 8, "asap": 8, "cfds": 8, "alap": 0}
    assert set(found(net.base.filter("looped"), "ds")) == {8, 9, 10, 11}
    assert set(found(net.rank, "rank").values()) == {-1} and set(found(net.basins, "basin").values()) == {0}


@pytest.mark.parametrize("seed", range(2))
def test_random_maps_with_cycles(spark, seed):
    import random

    rng, n = random.Random(seed), 60
    ds = [rng.randrange(n) if rng.random() < 0.9 else v for v in range(n)]
    net, loop = network(spark, ds, (1, n)), brute.looped(ds)
    base = found(net.base, "looped", "stranded")
    assert {v for v in base if base[v][0]} == loop
    assert {v for v in base if base[v][1]} == {v for v in range(n) if brute.path(ds, v) is None}
    assert {v: t for v, t in found(net.layering("asap"), "layer").items() if t >= 0} == brute.soonest(ds)
    assert {v: t for v, t in found(net.layering("cfds"), "layer").items() if t >= 0} == brute.conflict_free(ds)
    assert ordered(net.ordering("topo", "u2d")) == brute.from_sources(ds)
    assert ordered(net.ordering("dfs")) == brute.depth_first(ds)


def test_two_cells_that_drain_into_each_other(spark):
    net = network(spark, [1, 0], (1, 2))
    assert set(found(net.layering("cfds"), "layer").values()) == {-1} == set(found(net.layering("asap"), "layer").values())
    assert net.ordering("dfs").count() == 0 and net.nlayers("alap") == 0


# inputs

def test_an_empty_network(spark):
    net = network(spark, [-1] * 9, (3, 3))
    assert net.ncells == 0 and net.nbasins == 0
    for k in ("dfs", "bfs", "topo"):
        assert net.ordering(k).count() == 0
    for k in ("asap", "cfds", "alap"):
        assert net.nlayers(k) == 0
    assert net.dense(net.basins, "basin").count() == 9


@pytest.mark.parametrize("shape", [(1.9, 1), (-1, -1), (1, float("nan")), (1, float("inf")), (True, 1), (1,), (1, 1, 1), ("1", 1)])
def test_shapes_that_are_refused(spark, shape):
    with pytest.raises(ValueError):
        network(spark, [0], shape)


def test_pointers_that_are_refused(spark):
    for bad in ([2**32, 0], [0, -2], [0.5, 0], [2, 0], [float("nan"), 0], [0]):
        with pytest.raises(ValueError):
            network(spark, bad, (1, 2))
    assert network(spark, [1.0, 1], (1.0, 2)).ncells == 2
    assert network(spark, [], (0, 2)).ncells == 0


def test_receivers_off_the_network_become_pits(spark):
    assert found(network(spark, [1, -1], (1, 2)).edges, "ds") == {0: 0}
    net = network(spark, [1, 3, 3, 3], (2, 2), mask=[True, False, True, True])
    assert found(net.edges, "ds") == {0: 0, 2: 3, 3: 3}


@pytest.mark.parametrize("transform", [(0, 1, 0), (0, 1, 0.1, 0, 0, -1), (0, 0, 0, 0, 0, -1), (0, float("inf"), 0, 0, 0, -1)])
def test_transforms_that_are_refused(spark, transform):
    with pytest.raises(ValueError):
        network(spark, [0], (1, 1), transform=transform)
