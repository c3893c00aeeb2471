"""No query of the network sends a table of cells whole through the driver, however small its files look."""

import pytest

from thalweg.plans import network_queries, source_queries

SF = "/root/testdata/sf0.001"
QUERIES = network_queries.queries() | source_queries.queries()
#: A limit that the compressed files of the cells keep, but not the rows themselves; the smallest row of a table takes 16 bytes.
LIMIT, ROW = 12_000, 16
NAMES = [
    "layering_cfds",
    "interval_rasters",
    "layering_asap",
    "layering_alap",
    "layer_sizes",
    "geotiff_values",
    "geotiff_header",
    "geometry",
    "edges",
    "drains_through",
    "donors_masked",
    "donors",
    "distance_to_outlet",
    "distance_to_outlet_exact",
    "dfs_interval",
    "dense_ranks",
    "decomposition",
    "conflicts",
    "channel_mask",
    "basins",
    "basin_graph_nodes",
    "basin_graph_links",
    "aligned_window",
    "decode_d8",
]


def sent_rows(spark, run) -> int:
    """Rows of the largest table that was sent whole while ``run`` ran."""
    store = spark._jsparkSession.sharedState().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    before = {store.executionsList().apply(k).executionId() for k in range(store.executionsList().size())}
    run()
    bus.waitUntilEmpty(30_000)
    most, done = 0, store.executionsList()
    for at in (done.apply(k).executionId() for k in range(done.size())):
        if at in before:
            continue
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if node.name() != "BroadcastExchange":
                continue
            for metric in (node.metrics().apply(k) for k in range(node.metrics().size())):
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return most


@pytest.mark.parametrize("name", NAMES)
def test_no_table_of_cells_is_sent_whole(spark, name):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", LIMIT)
    try:
        most = sent_rows(spark, lambda: QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert most * ROW <= LIMIT
