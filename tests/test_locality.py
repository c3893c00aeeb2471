import brute
import pytest
from brute import network
from pyspark.sql import functions as F

from thalweg.operators import locality

SHAPE = (12, 15)


def order(spark, seq):
    return spark.createDataFrame([(v, k) for k, v in enumerate(seq)], "idx long, pos long")


def edges(spark, ds):
    return spark.createDataFrame([(v, d) for v, d in enumerate(ds) if d >= 0], "idx long, ds long")


NONE = "idx long, ds long"


def lru(stream, lines, ways):
    """Misses of a whole stream, one list a set."""
    sets, missed = {}, 0
    for x in stream:
        held = sets.setdefault(x % (lines // ways), [])
        if x in held:
            held.remove(x)
        else:
            missed += 1
        held.append(x)
        del held[:-ways]
    return missed / len(stream) if stream else 1.0


def test_strides_and_medians(spark):
    got = locality.serial_locality(order(spark, [2, 0, 1]), edges(spark, [2, 2, 2]), 3, levels=())
    assert (got["ds_stride_mean"], got["ds_stride_median"], got["stride_median"], got["stride_p95"]) == (1.5, 2, 2, 2)


def test_reuse(spark):
    seq = order(spark, [0, 16, 0, 17])
    assert sorted(r[0] for r in locality.reuse_intervals(seq).collect()) == [2, 2]
    # a line whose slot another line took has lost its past
    far = 16 * locality.REUSE_SLOTS
    assert [r[0] for r in locality.reuse_intervals(order(spark, [0, far, 0, 1])).collect()] == [1]
    with pytest.raises(ValueError):
        locality.reuse_intervals(seq, 0)
    got = locality.serial_locality(order(spark, [0, 16]), spark.createDataFrame([], NONE), 64, levels=())
    assert got["reuse_interval_mean"] == got["reuse_interval_median"] == 2


def test_miss_rates_with_known_answers(spark):
    none = spark.createDataFrame([], NONE)
    l1 = lambda seq: locality.miss_rates(order(spark, seq), none, levels=("L1",))["L1"]
    assert l1([]) == 1.0
    assert l1([0, 1024 * 16, 0]) == pytest.approx(2 / 3)
    assert l1(list(range(20_000))) == pytest.approx(1 / 16, abs=2e-3)
    assert l1([5] * 3000) == 1 / 3000
    assert l1([16 * k for k in range(4096)] * 2) == 1.0
    in_a_set = [16 * 64 * k for k in range(9)]
    assert l1(in_a_set[:8] * 20) == 8 / 160 and l1(in_a_set * 20) == 1.0


@pytest.mark.parametrize("stretch", [1, 3, 1 << 16])
def test_caches_cut_into_stretches_are_one_cache(spark, stretch, monkeypatch):
    monkeypatch.setattr(locality, "CACHE_LEVELS", {"A": (12, 3), "B": (8, 8)})
    ds = brute.terrain(*SHAPE, seed=2)
    seq = brute.from_sources(ds)
    stream = []
    for v in seq:
        stream.append(v * 4 >> 6)
        if ds[v] != v:
            stream.append((ds[v] * 4 + locality.RECEIVERS_AT) >> 6)
    got = locality.miss_rates(order(spark, seq), edges(spark, ds), levels=("A", "B"), stretch=stretch)
    assert got == {"A": pytest.approx(lru(stream, 12, 3)), "B": pytest.approx(lru(stream, 8, 8))}


def test_layers(spark):
    ds = brute.terrain(*SHAPE, seed=3)
    layers = brute.soonest(ds)
    per = {r["layer"]: r for r in locality.layer_locality(spark.createDataFrame(sorted(layers.items()), "idx long, layer int")).collect()}
    for t in set(layers.values()):
        own = sorted(v for v in layers if layers[v] == t)
        gaps = sorted(b - a for a, b in zip(own, own[1:]))
        r = per[t]
        assert (r["n"], r["span"], r["footprint"]) == (len(own), own[-1] - own[0], len({v // 16 for v in own}))
        assert r["gap_median"] == (gaps[len(gaps) // 2] if gaps else 0)
        hits = [a // 16 == b // 16 for a, b in zip(own, own[1:])]
        assert r["gap_hits"] == (pytest.approx(sum(hits) / len(hits)) if hits else 1.0)


def test_front_ends(spark):
    net = network(spark, brute.terrain(*SHAPE, seed=3), SHAPE)
    serial, parallel = net.serial_locality("bfs", ("L1",)), net.parallel_locality("cfds", ("L1",))
    assert 0 < serial["miss_rate_L1"] < 1 and 0 < parallel["miss_rate_L1"] < 1
    assert parallel["ncells"] == net.ncells and parallel["nlayers"] == net.nlayers("cfds")
    empty = network(spark, [-1] * 4, (2, 2))
    assert empty.serial_locality("dfs", ("L1",))["miss_rate_L1"] == 1.0
    assert empty.parallel_locality("asap", ())["nlayers"] == 0
    assert net.edges.filter(F.col("idx") < 0).count() == 0
