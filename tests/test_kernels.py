import brute
import numpy as np
import pytest
from brute import found, network
from pyspark.sql import functions as F

from thalweg.functions import d8, geodesy
from thalweg.operators import kernels

SHAPE = (13, 16)
METRES = (0.0, 100.0, 0.0, 0.0, 0.0, -100.0)
SAFE = [("asap", "pull"), ("asap", "atomic_push"), ("alap", "pull"), ("cfds", "push"), ("cfds", None)]


@pytest.fixture(scope="module")
def ds():
    return brute.terrain(*SHAPE, seed=7, holes=6)


@pytest.fixture(scope="module")
def net(spark, ds):
    return network(spark, ds, SHAPE, transform=METRES, latlon=False)


@pytest.fixture(scope="module")
def areas(spark, ds):
    return {v: float((v * 7919) % 101 + 1) for v in range(len(ds))}


def table(spark, values, kind):
    return spark.createDataFrame(sorted(values.items()), f"idx long, {kind}")


def lengths(ds):
    out = {}
    for v in brute.cells(ds):
        p = brute.path(ds, v)
        out[v] = sum(np.float64(np.float32(0 if a == b else 100 if abs(a - b) in (1, SHAPE[1]) else np.hypot(100, 100))) for a, b in zip(p, p[1:]))
    return out


def test_area_is_the_sum_of_all_cells_upstream(spark, net, ds, areas):
    up, a = brute.upstream(ds), table(spark, areas, "area double")
    want = {v: sum(areas[u] for u in x) for v, x in up.items()}
    assert found(net.upstream_area(ordering="dfs", cell_area=a), "upa") == want
    for layering, manner in SAFE[:2]:
        assert found(net.upstream_area(layering=layering, manner=manner, cell_area=a), "upa") == want


def test_types_of_areas(spark, net, areas):
    kinds = {k: net.upstream_area(ordering="bfs", cell_area=table(spark, {v: int(x) if k == "long" else x for v, x in areas.items()}, f"area {k}")).schema["upa"].dataType.typeName() for k in ("float", "double", "long")}
    assert kinds == {"float": "float", "double": "double", "long": "double"}


def test_a_plain_push_loses_writes(spark, net, ds, areas):
    a, n = table(spark, areas, "area double"), len(brute.cells(ds))
    layers = brute.soonest(ds)
    want = brute.push(ds, layers, {v: areas[v] for v in brute.cells(ds)}, lambda old, x: old + x)
    got = found(net.upstream_area(layering="asap", manner="push", cell_area=a), "upa")
    assert got == want and len(got) == n
    assert got != found(net.upstream_area(ordering="dfs", cell_area=a), "upa")


def test_masks_block_edges_at_both_ends(spark, net, ds, areas):
    kept = {v for v in brute.cells(ds) if v % 5}
    cut = [(ds[v] if ds[v] in kept else v) if v in kept else -1 for v in range(len(ds))]
    got = found(kernels.upstream_area(net.edges, table(spark, areas, "area double"), mask=spark.createDataFrame([(v,) for v in kept], "idx long")), "upa")
    want = {v: sum(areas[u] for u in x) for v, x in brute.upstream(cut).items()}
    assert got == {v: want.get(v, -9999.0) for v in brute.cells(ds)}


def test_lengths(net, ds):
    want = lengths(ds)
    ldn = net.distance_to_outlet(ordering="dfs")
    got, exact = found(ldn, "ldn"), found(net.distance_to_outlet(layering="asap", exact=True), "ldn")
    assert got == {v: float(np.float32(x)) for v, x in want.items()}
    assert all(abs(exact[v] - got[v]) < 1e-2 for v in got)
    up = brute.upstream(ds)
    lup = found(net.longest_upstream_path(ldn, ordering="topo"), "lup")
    assert all(abs(lup[v] - (max(got[u] for u in up[v]) - got[v])) < 1e-3 for v in got)


def test_hop_by_hop_lengths_do_not_depend_on_the_block_size(net, ds):
    step, want = found(net.pixel_length, "plen"), {}
    for v in sorted(brute.cells(ds), key=lambda v: len(brute.path(ds, v))):
        want[v] = float(np.float32(want[ds[v]]) + np.float32(step[v])) if ds[v] != v else 0.0
    for limit in (3, 1000):
        assert found(kernels.distance_to_outlet(net.edges, net.pixel_length, exact=True, base=net.base, limit=limit), "ldn") == want


def test_a_plain_push_of_lengths_keeps_the_last_taker(spark, net, ds):
    ldn = {v: float((v * 37) % 50) for v in brute.cells(ds)}
    layers = brute.soonest(ds)
    height = brute.push(ds, layers, ldn, lambda old, x: x if x > old else None)
    want = {v: height[v] - ldn[v] for v in height}
    t = table(spark, ldn, "ldn float")
    for limit in (2, 1000):
        assert found(kernels.longest_upstream_path(net.edges, t, layering=net.layering("asap"), base=net.base, limit=limit), "lup") == want
    safe = found(net.longest_upstream_path(t, layering="alap", manner="pull"), "lup")
    assert safe == {v: max(ldn[u] for u in x) - ldn[v] for v, x in brute.upstream(ds).items()} != want


def test_stream_orders(spark, net, ds):
    assert found(net.strahler_order(ordering="dfs"), "strahler") == brute.strahler(ds)
    for limit in (2, 30):
        assert found(kernels.strahler_order(net.edges, net.base, limit=limit), "strahler") == brute.strahler(ds)
    up = brute.upstream(ds)
    inside = {v for v in up if len(up[v]) >= 3}
    channels = net.channel_mask(net.base.select("idx", F.col("size").cast("float").alias("upa")), 3.0)
    got = found(net.strahler_order(layering="cfds", channel_mask=channels), "strahler")
    assert got == {v: brute.strahler(ds, inside).get(v, 0) for v in up}


def test_a_plain_push_of_orders_is_wrong_where_two_sources_meet(spark):
    net = network(spark, [2, 2, 2], (1, 3))
    assert found(net.strahler_order(layering="cfds"), "strahler") == {0: 1, 1: 1, 2: 2}
    assert found(net.strahler_order(layering="asap", manner="push"), "strahler") == {0: 1, 1: 1, 2: 1}


def test_thresholds_are_inclusive(spark):
    net = network(spark, [3, 3, 3, 3], (2, 2))
    upa = spark.createDataFrame([(k, float(k + 1)) for k in range(4)], "idx long, upa float")
    assert set(found(net.channel_mask(upa, 2.0).withColumn("x", F.lit(1)), "x")) == {1, 2, 3}


def test_arguments_that_are_refused(net):
    for bad in ({}, {"ordering": "dfs", "layering": "cfds"}, {"ordering": "x"}, {"layering": "x"}, {"layering": "asap", "manner": "serial"}, {"ordering": "dfs", "manner": "pull"}, {"layering": "asap", "manner": "jump"}):
        with pytest.raises(ValueError):
            net.upstream_area(**bad)
    with pytest.raises(ValueError):
        net.strahler_order(layering="asap", manner="atomic_push")
    for bad in (0.0, 1.0, float("nan"), float("-inf")):
        with pytest.raises(ValueError):
            kernels.check_nodata(bad)
    with pytest.raises(ValueError):
        kernels.check_nodata(-1e-50, "float")
    assert kernels.check_nodata(-1e-50) == -1e-50


# directions and geometry

def codes(spark, values, kind="int"):
    return spark.createDataFrame(list(enumerate(values)), f"idx long, code {kind}")


def test_decoding(spark):
    from thalweg.network import Network

    assert found(d8.receivers(codes(spark, [1, 16]), 1, 2), "ds") == {0: 1, 1: 0}
    assert found(d8.receivers(codes(spark, [255, 0, 247]), 1, 3), "ds") == {0: 0, 1: 1}
    assert found(d8.receivers(codes(spark, [16, 1, 64]), 1, 3), "ds") == {0: 0, 1: 2, 2: 2}  # columns don't wrap
    assert found(d8.receivers(codes(spark, [1, 247]), 1, 2), "ds") == {0: 0}
    assert found(d8.receivers(codes(spark, [65535, 1, 0]), 1, 3, nodata=65535), "ds") == {1: 2, 2: 2}
    nan = codes(spark, [float("nan"), 1.0, 0.0], "double")
    assert found(d8.receivers(nan, 1, 3, nodata=float("nan")), "ds") == {1: 2, 2: 2}
    assert found(d8.receivers(codes(spark, [1.5, 1.0, 0.0], "double"), 1, 3, nodata=1.5), "ds") == {1: 2, 2: 2}
    for bad in ([1.5, 0.0], [256.0, 0.0], [-1.0, 0.0], [None, 0.0]):
        with pytest.raises(Exception, match="whole number"):
            d8.receivers(codes(spark, bad, "double"), 1, 2).collect()
    with pytest.warns(RuntimeWarning, match="2 cells"):
        net = Network.from_d8(codes(spark, [3, 3, 1, 0]), (2, 2))
    assert found(net.edges, "ds") == {0: 0, 1: 1, 2: 3, 3: 3}
    with pytest.raises(ValueError):
        Network.from_d8(codes(spark, [1, 0, 0]), (2, 2))


def test_degrees(spark):
    net = network(spark, [1, 1], (1, 2), transform=(0, 1, 0, 60, 0, -1))
    assert abs(found(net.pixel_length, "plen")[0] - 56639.81) < 0.01
    assert abs(found(net.pixel_length, "plen")[0] - geodesy.degree_metres_x(59.5)) < 0.01
    with pytest.raises(ValueError):
        network(spark, [1, 1], (1, 2)).pixel_length
    with pytest.raises(ValueError):
        network(spark, [1, 1], (1, 2), earth="flat")


def test_the_short_way_round_the_globe(spark):
    net = network(spark, [*range(359), 0], (1, 360), transform=(-180, 1, 0, 0.5, 0, -1))
    step = found(net.pixel_length, "plen")
    wide = network(spark, [359, *range(1, 360)], (1, 360), transform=(-180, 1, 0, 0.5, 0, -1))
    assert step[5] == 0 and abs(found(wide.pixel_length, "plen")[0] - geodesy.degree_metres_x(0.0)) < 0.01


def test_areas_of_the_whole_globe(spark):
    rows = spark.range(180).select(geodesy.pixel_area_km2(F.col("id"), (-180, 1, 0, 90, 0, -1)).alias("a"), geodesy.pixel_area_km2(F.col("id"), (-180, 1, 0, 90, 0, -1), model="wgs84").alias("w")).agg(F.sum("a") * 360, F.sum("w") * 360).first()
    assert abs(rows[0] / (4 * np.pi * 6371.0**2) - 1) < 1e-4 and abs(rows[1] / 510065621.7 - 1) < 1e-4
    flat = spark.range(1).select(geodesy.pixel_area_km2(F.col("id"), METRES, False)).first()[0]
    assert abs(flat - 0.01) < 1e-9


def test_skeletons_are_taken_apart_as_well(spark, net, ds, monkeypatch):
    from thalweg.operators import blocks

    monkeypatch.setattr(blocks, "SKELETON", 12)
    assert found(kernels.strahler_order(net.edges, net.base, limit=6), "strahler") == brute.strahler(ds)
    whole = found(kernels.distance_to_outlet(net.edges, net.pixel_length, exact=True, base=net.base, limit=100_000), "ldn")
    assert found(kernels.distance_to_outlet(net.edges, net.pixel_length, exact=True, base=net.base, limit=6), "ldn") == whole
