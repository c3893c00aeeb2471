"""Registered queries of the drainage-network engine over the terrain network, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.functions.d8 import receivers, unknown_codes
from thalweg.network import Network
from thalweg.operators import kernels, locality, structure
from thalweg.operators.partition import node_graph
from thalweg.operators.store import cut, dealt
from thalweg.plans.terrain import CLOSURE_SQL, DEGREES, EDGES_SQL, codes, heights, network, orders, shape

#: Levels to which the twin of the stream order is unrolled; a tenth would need 2^9 sources.
ORDER_LEVELS = 9


def _cents(spark: SparkSession, sf_dir: str, kind: str = "long") -> DataFrame:
    return heights(spark, sf_dir, shape(spark, sf_dir)[1]).select("idx", F.col("cents").cast(kind).alias("area"))


def outlet_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = network(spark, sf_dir)
    return net.base.filter("par is null").select("idx", F.col("size").alias("cells"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network(spark, sf_dir).edges


def _strange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terrain's codes with some that the convention doesn't define, and 255 as no data."""
    odd = F.when(F.col("idx") % 101 == 0, 3).when(F.col("idx") % 103 == 0, 200).when(F.col("idx") % 107 == 0, 255)
    return codes(spark, sf_dir).select("idx", F.coalesce(odd, F.col("code")).cast("int").alias("code"))


def unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unknown_codes(_strange(spark, sf_dir), nodata=255).select(F.col("code").cast("int").alias("code"), "count")


def decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receivers(cut(_strange(spark, sf_dir), "strange"), *shape(spark, sf_dir), nodata=255)


def mask_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = orders(spark, sf_dir).filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("idx"))
    net = network(spark, sf_dir)
    return Network(net.edges, net.shape, mask=kept).edges


def donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network(spark, sf_dir).upstream().select("idx", "n_up", F.array_join("donors", ",").alias("donors"))


def donors_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = orders(spark, sf_dir).filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("idx"))
    return network(spark, sf_dir).upstream(kept).select("idx", "n_up", F.array_join("donors", ",").alias("donors"))


def rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network(spark, sf_dir).rank


def basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network(spark, sf_dir).basins


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = _cents(spark, sf_dir).select("idx", (F.col("area") + 1).alias("upa"))
    return structure.main_stems(network(spark, sf_dir).base, areas)


def ordering_dfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network(spark, sf_dir).ordering("dfs")


def ordering_dfs_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = _cents(spark, sf_dir).select("idx", (F.col("area") % 1000 + 1).alias("upa"))
    return network(spark, sf_dir).ordering("dfs", upa=areas)


def ordering_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network(spark, sf_dir).ordering("bfs")


def ordering_topo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network(spark, sf_dir).ordering("topo", "u2d")


def layering_asap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network(spark, sf_dir).layering("asap")


def layering_alap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network(spark, sf_dir).layering("alap")


def layering_cfds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network(spark, sf_dir).layering("cfds")


def reverse_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.reverse_layers(network(spark, sf_dir).layering("alap"))


def decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network(spark, sf_dir).decomposition("asap")


def layer_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.layer_sizes(network(spark, sf_dir).layering("asap"))


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes and conflicts per layer of all three layerings; the conflict-free one has none."""
    net = network(spark, sf_dir)
    parts = [net.conflicts(k).select(F.lit(k).alias("layering"), "layer", "writes", "conflicts") for k in ("asap", "alap")]
    none = net.conflicts("cfds").agg(F.lit("cfds").alias("layering"), F.lit(-1).alias("layer"), F.sum("writes").alias("writes"), F.sum("conflicts").alias("conflicts"))
    return parts[0].unionByName(parts[1]).unionByName(none)


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network(spark, sf_dir).dfs_interval()


def drains_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell with the outlet that it drains through, by containment of intervals."""
    net = network(spark, sf_dir)
    return structure.drains_through(cut(net.dfs_interval(), "intervals"), net.edges.filter("idx = ds").select("idx"))


def upstream_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network(spark, sf_dir).upstream_area(layering="cfds", manner="pull", cell_area=_cents(spark, sf_dir))


def upstream_area_lossy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network(spark, sf_dir).upstream_area(layering="asap", manner="push", cell_area=_cents(spark, sf_dir))


def distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network(spark, sf_dir).distance_to_outlet(ordering="dfs")


def distance_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network(spark, sf_dir).distance_to_outlet(ordering="dfs", exact=True)


def longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = network(spark, sf_dir)
    return net.longest_upstream_path(cut(net.distance_to_outlet(ordering="dfs"), "ldn"), ordering="topo")


def longest_lossy(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = network(spark, sf_dir)
    return net.longest_upstream_path(cut(net.distance_to_outlet(ordering="dfs"), "ldn"), layering="asap", manner="push")


def strahler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network(spark, sf_dir).strahler_order(ordering="dfs")


def strahler_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream order over the cells that drain four cells or more."""
    net = network(spark, sf_dir)
    channels = net.channel_mask(net.base.select("idx", F.col("size").cast("float").alias("upa")), 4.0)
    return net.strahler_order(layering="cfds", channel_mask=cut(channels, "channels"))


def strahler_lossy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network(spark, sf_dir).strahler_order(layering="alap", manner="push")


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = network(spark, sf_dir)
    return kernels.channel_mask(net.base.select("idx", F.col("size").cast("float").alias("upa")), 10.0)


def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths, and areas on the sphere and the ellipsoid, of the raster laid out in degrees."""
    net = network(spark, sf_dir, DEGREES, True)
    round_, flat = net.cell_area, Network(net.edges, net.shape, DEGREES, True, earth="wgs84", checked=True).cell_area
    out = net.pixel_length.join(dealt(round_.withColumnRenamed("area", "sphere_km2")), "idx").join(dealt(flat.withColumnRenamed("area", "wgs84_km2")), "idx")
    return out.select("idx", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("plen", "sphere_km2", "wgs84_km2")])


def serial_locality(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = network(spark, sf_dir)
    got = locality.serial_locality(net.ordering("dfs"), net.edges, net.ncol, levels=())
    return spark.createDataFrame([tuple(float(v) for v in got.values())], ", ".join(f"{k} double" for k in got))


def parallel_locality(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = network(spark, sf_dir)
    got = locality.parallel_locality(net.layering("asap"), net.edges, net.ncol, levels=())
    return spark.createDataFrame([tuple(round(float(v), 9) for v in got.values())], ", ".join(f"{k} double" for k in got))


def miss_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated miss rates of the depth-first and the topological order."""
    net = network(spark, sf_dir)
    rows = [(k, level, rate) for k in ("dfs", "topo") for level, rate in locality.miss_rates(net.ordering(k), net.edges).items()]
    return spark.createDataFrame(rows, "ordering string, level string, miss_rate double")


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which cells of a map with cycles lie on one or drain into one."""
    n = orders(spark, sf_dir).count()
    key = F.col("o_orderkey")
    pointers = orders(spark, sf_dir).select(key.alias("idx"), ((key * key + 1) % n).alias("ds"))
    return Network(pointers, (1, n)).base.select("idx", "looped", "stranded")


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = network(spark, sf_dir)
    return node_graph(net.base.select("idx", F.col("root").alias("node")), net.ncol)[0].select("node", "weight")


def graph_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = network(spark, sf_dir)
    return node_graph(net.base.select("idx", F.col("root").alias("node")), net.ncol)[1]


def partition_basin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network(spark, sf_dir).partition(4, "basin")[0]


def partition_subbasin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network(spark, sf_dir).partition(6, "subbasin")[0]


def queries() -> dict:
    return {
        "outlet_area": outlet_area, "edges": edges, "unknown_codes": unknown, "decode_d8": decode, "mask_cut": mask_cut, "donors": donors, "donors_masked": donors_masked,
        "rank_to_pit": rank, "basins": basins, "main_stems": stems,
        "ordering_dfs": ordering_dfs, "ordering_dfs_by_area": ordering_dfs_by_area, "ordering_bfs": ordering_bfs, "ordering_topo": ordering_topo,
        "layering_asap": layering_asap, "layering_alap": layering_alap, "layering_cfds": layering_cfds, "reverse_layers": reverse_layers, "decomposition": decomposition, "layer_sizes": layer_sizes, "conflicts": conflicts,
        "dfs_interval": intervals, "drains_through": drains_through,
        "upstream_area": upstream_area, "upstream_area_lossy_push": upstream_area_lossy, "distance_to_outlet": distance, "distance_to_outlet_exact": distance_exact,
        "longest_upstream_path": longest, "longest_upstream_path_lossy_push": longest_lossy, "strahler_order": strahler, "strahler_order_channels": strahler_channels, "strahler_order_lossy_push": strahler_lossy, "channel_mask": channels,
        "geometry": geometry, "serial_locality": serial_locality, "parallel_locality": parallel_locality, "miss_rates": miss_rates, "cycles": cycles,
        "basin_graph_nodes": graph_nodes, "basin_graph_links": graph_links, "partition_basin": partition_basin, "partition_subbasin": partition_subbasin,
    }


# DuckDB twins

_STRANGE = EDGES_SQL + """,
q AS (
  SELECT i.idx, i.idx // ncol AS r, i.idx % ncol AS c,
    CASE WHEN i.idx % 101 = 0 THEN 3 WHEN i.idx % 103 = 0 THEN 200 WHEN i.idx % 107 = 0 THEN 255 WHEN g.idx IS NULL THEN 247 ELSE coalesce(p.code, 0) END AS code
  FROM n, unnest(range(0, ((n + ncol - 1) // ncol) * ncol)) AS i(idx) LEFT JOIN g ON g.idx = i.idx LEFT JOIN p ON p.idx = i.idx AND p.k = 1
)
"""
_DONORS = """
SELECT e.idx, coalesce(c.n, 0)::INT AS n_up, coalesce(d.l, '') AS donors FROM e
LEFT JOIN (SELECT ds, count(*) AS n FROM e x WHERE idx <> ds{both} GROUP BY ds) c ON c.ds = e.idx
LEFT JOIN (SELECT ds, string_agg(idx, ',' ORDER BY idx DESC) AS l FROM e x WHERE idx <> ds{list} GROUP BY ds) d ON d.ds = e.idx
"""
_KEPT = " AND x.{c} IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')"


def _paths(order: str) -> str:
    """The key of the depth-first order: places among siblings from the pit down to the cell."""
    return CLOSURE_SQL + f""",
sib AS (SELECT idx, ds, row_number() OVER (PARTITION BY ds ORDER BY {order}) AS k FROM e JOIN g USING (idx) WHERE idx <> ds),
key AS MATERIALIZED (SELECT w.u AS idx, list(sib.k ORDER BY w.h DESC) FILTER (sib.k IS NOT NULL) AS path FROM w LEFT JOIN sib ON sib.idx = w.v GROUP BY w.u)
"""


_DFS = """,
dfs AS MATERIALIZED (SELECT idx, row_number() OVER (ORDER BY root DESC, path NULLS FIRST) - 1 AS pos FROM key JOIN rk USING (idx))
"""
_INTERVAL = _paths("idx") + _DFS + """,
blk AS (SELECT root, min(pos) AS lo, max(pos) AS hi FROM dfs JOIN rk USING (idx) GROUP BY root),
seq AS (SELECT count(*) AS total FROM dfs),
itv AS (
  SELECT dfs.idx, rk.root, (seq.total - 1 - hi) + pos - lo AS dfs_in, (seq.total - 1 - hi) + pos - lo + sz.size - 1 AS dfs_out
  FROM dfs JOIN rk USING (idx) JOIN blk USING (root) JOIN sz USING (idx), seq
)
"""
_ASAP = "SELECT idx, depth AS layer FROM sz"
_ALAP = "SELECT idx, (max(rank) OVER (PARTITION BY root) - rank) AS layer FROM rk"


def _lossy(layers: str) -> str:
    """Edges that a plain push leaves, and the closure over them, after the whole closure."""
    return CLOSURE_SQL + f""",
ly AS ({layers}),
kept AS (SELECT ds, max(e.idx) AS idx FROM e JOIN ly USING (idx) WHERE e.idx <> ds GROUP BY ds, layer),
e2 AS MATERIALIZED (SELECT e.idx, coalesce(kept.ds, e.idx) AS ds FROM e LEFT JOIN kept USING (idx)),
w2 AS (SELECT idx AS u, idx AS v FROM e2 UNION ALL SELECT w2.u, e2.ds FROM w2 JOIN e2 ON w2.v = e2.idx WHERE e2.ds <> e2.idx)
"""


def _orders(edge: str, closure: str, cells: str = "SELECT idx FROM e") -> str:
    """Stream orders: a cell has order k + 1 if two donors of order k meet somewhere above."""
    steps = [f", o1 AS ({cells})"]
    for k in range(1, ORDER_LEVELS):
        steps.append(f", c{k} AS (SELECT ds FROM {edge} JOIN o{k} USING (idx) WHERE idx <> ds GROUP BY ds HAVING count(*) > 1)")
        steps.append(f", o{k + 1} AS (SELECT DISTINCT v AS idx FROM {closure} JOIN c{k} ON u = ds)")
    every = " UNION ALL ".join(f"SELECT idx FROM o{k}" for k in range(1, ORDER_LEVELS + 1))
    return "".join(steps) + f" SELECT e.idx, count(s.idx)::SMALLINT AS strahler FROM e LEFT JOIN ({every}) s USING (idx) GROUP BY e.idx"


_LDN = CLOSURE_SQL + """,
st2 AS (SELECT idx, (CASE WHEN idx = ds THEN 0 WHEN abs(idx - ds) IN (1, ncol) THEN 100 ELSE sqrt(20000.0::DOUBLE) END)::FLOAT::DOUBLE AS plen FROM e, n),
ln AS MATERIALIZED (SELECT u AS idx, sum(plen)::FLOAT AS ldn FROM w JOIN st2 ON st2.idx = w.v GROUP BY u)
"""
_MID = "radians(((g.r + h.r) / 2.0::DOUBLE + 0.5) * (-1.0::DOUBLE / 1200) + 47.0)"
_WIDE = "radians(1.0::DOUBLE / 1200)"


def _geometry() -> str:
    lat = "((g.r + 0.5) * (-1.0::DOUBLE / 1200) + 47.0)"
    half = "(1.0::DOUBLE / 1200 / 2.0)"
    lo, hi = f"sin(radians({lat} - {half}))", f"sin(radians({lat} + {half}))"
    f = "(1.0::DOUBLE / 298.257223563)"
    e2 = f"({f} * (2.0 - {f}))"
    zone = lambda s: f"({s} / (1.0 - {e2} * {s} * {s}) + ln((1.0 + sqrt({e2}) * {s}) / (1.0 - sqrt({e2}) * {s})) / (2.0 * sqrt({e2})))"
    dy = f"(111132.92 - 559.82 * cos(2 * {_MID}) + 1.175 * cos(4 * {_MID}) - 0.0023 * cos(6 * {_MID}))"
    dx = f"(111412.84 * cos({_MID}) - 93.5 * cos(3 * {_MID}) + 0.118 * cos(5 * {_MID}))"
    return EDGES_SQL + f"""
SELECT e.idx,
  round((CASE WHEN e.idx = e.ds THEN 0 ELSE sqrt(pow({dy} / 1200 * abs(g.r - h.r), 2) + pow({dx} / 1200 * abs(g.c - h.c), 2)) END)::FLOAT::DOUBLE, 4) AS plen,
  round((6371000.0::DOUBLE * 6371000.0 * {_WIDE} * ({hi} - {lo}) * 1e-6)::FLOAT::DOUBLE, 4) AS sphere_km2,
  round((6378137.0::DOUBLE * 6378137.0 * (1.0 - {e2}) * {_WIDE} * 0.5 * ({zone(hi)} - {zone(lo)}) * 1e-6)::FLOAT::DOUBLE, 4) AS wgs84_km2
FROM e JOIN g ON g.idx = e.idx JOIN g h ON h.idx = e.ds
"""


def _middle(table: str, value: str, rank: str) -> str:
    return f"(SELECT {value} FROM (SELECT {value}, row_number() OVER (ORDER BY {value}) - 1 AS k, count(*) OVER () AS m FROM {table}) WHERE k = {rank})"


_SERIAL = _paths("idx") + _DFS + f""",
s AS MATERIALIZED (SELECT abs(idx - lag(idx) OVER (ORDER BY pos)) AS stride, idx // ncol <> lag(idx // ncol) OVER (ORDER BY pos) AS jump FROM dfs, n QUALIFY stride IS NOT NULL),
d AS MATERIALIZED (SELECT abs(idx - ds) AS d FROM e WHERE idx <> ds),
u AS MATERIALIZED (SELECT pos - lag(pos) OVER (PARTITION BY line ORDER BY pos) AS i FROM (SELECT pos, idx * 4 // 64 AS line FROM dfs) QUALIFY i IS NOT NULL)
SELECT (SELECT avg(stride) FROM s) AS stride_mean, {_middle('s', 'stride', 'm // 2')}::DOUBLE AS stride_median, {_middle('s', 'stride', 'floor(0.95 * (m - 1) + 0.5)')}::DOUBLE AS stride_p95,
  {_middle('s', 'stride', 'floor(0.99 * (m - 1) + 0.5)')}::DOUBLE AS stride_p99, (SELECT max(stride) FROM s)::DOUBLE AS stride_max, (SELECT avg(jump::INT) FROM s) AS row_jump_frac,
  (SELECT avg(i) FROM u) AS reuse_interval_mean, {_middle('u', 'i', 'm // 2')}::DOUBLE AS reuse_interval_median,
  (SELECT avg(d) FROM d) AS ds_stride_mean, {_middle('d', 'd', 'm // 2')}::DOUBLE AS ds_stride_median, (SELECT max(d) FROM d)::DOUBLE AS ds_stride_max
"""
_PARALLEL = CLOSURE_SQL + f""",
ly AS MATERIALIZED (SELECT idx, depth AS layer FROM sz),
gp AS MATERIALIZED (SELECT layer, idx - lag(idx) OVER q AS gap, (idx * 4 // 64 = lag(idx * 4 // 64) OVER q)::INT AS hit FROM ly WINDOW q AS (PARTITION BY layer ORDER BY idx) QUALIFY gap IS NOT NULL),
md AS (SELECT layer, gap FROM (SELECT layer, gap, row_number() OVER (PARTITION BY layer ORDER BY gap) - 1 AS k, count(*) OVER (PARTITION BY layer) AS m FROM gp) WHERE k = m // 2),
pl AS MATERIALIZED (
  SELECT l.layer, l.span, l.prints, coalesce(md.gap, 0) AS gap, coalesce(h.hits, 1.0) AS hits
  FROM (SELECT layer, max(idx) - min(idx) AS span, count(DISTINCT idx * 4 // 64) AS prints FROM ly GROUP BY layer) l
  LEFT JOIN md USING (layer) LEFT JOIN (SELECT layer, avg(hit) AS hits FROM gp GROUP BY layer) h USING (layer)
),
d AS MATERIALIZED (SELECT abs(idx - ds) AS d FROM e WHERE idx <> ds)
SELECT (SELECT count(*) FROM pl)::DOUBLE AS nlayers, (SELECT count(*) FROM ly)::DOUBLE AS ncells, (SELECT round(avg(span), 9) FROM pl) AS span_mean, {_middle('pl', 'span', 'm // 2')}::DOUBLE AS span_median,
  (SELECT max(span) FROM pl)::DOUBLE AS span_max, (SELECT round(avg(gap), 9) FROM pl) AS gap_median_mean, round((SELECT avg(hits) FROM pl), 9) AS gap_cl_hit_frac,
  (SELECT round(avg(prints), 9) FROM pl) AS cl_footprint_mean, (SELECT max(prints) FROM pl)::DOUBLE AS cl_footprint_max, (SELECT sum(prints) FROM pl)::DOUBLE AS cl_footprint_sum,
  (SELECT round(avg(d), 9) FROM d) AS ds_stride_mean, {_middle('d', 'd', 'm // 2')}::DOUBLE AS ds_stride_median, (SELECT max(d) FROM d)::DOUBLE AS ds_stride_max
"""
_ROOTS = CLOSURE_SQL + """,
sides AS (
  SELECT least(x.root, y.root) AS a, greatest(x.root, y.root) AS b FROM g JOIN rk x USING (idx), n, unnest([1, 2]) AS t(k), rk y
  WHERE y.idx = CASE WHEN t.k = 2 THEN g.idx + ncol WHEN g.c < ncol - 1 THEN g.idx + 1 END AND x.root <> y.root
)
"""


def oracle_sql() -> dict[str, str]:
    channel = "SELECT idx FROM sz WHERE size >= 4"
    return {
        "outlet_area": CLOSURE_SQL + "SELECT sz.idx, size AS cells FROM sz JOIN e USING (idx) WHERE idx = ds",
        "edges": EDGES_SQL + "SELECT idx, ds FROM e",
        "unknown_codes": _STRANGE + "SELECT code::INT AS code, count(*) AS count FROM q WHERE code IN (3, 200) GROUP BY code",
        "decode_d8": _STRANGE + "SELECT q.idx, coalesce(t.idx, q.idx) AS ds FROM q LEFT JOIN st USING (code) LEFT JOIN q t ON t.r = q.r + dr AND t.c = q.c + dc AND t.code NOT IN (247, 255) WHERE q.code NOT IN (247, 255)",
        "mask_cut": EDGES_SQL + ", k AS (SELECT o_orderkey AS idx FROM orders WHERE o_orderstatus <> 'F') SELECT e.idx, coalesce(t.idx, e.idx) AS ds FROM e JOIN k USING (idx) LEFT JOIN k t ON t.idx = e.ds",
        "donors": EDGES_SQL + _DONORS.format(both="", list=""),
        "donors_masked": EDGES_SQL + _DONORS.format(both=_KEPT.format(c="idx"), list=_KEPT.format(c="idx") + _KEPT.format(c="ds")),
        "rank_to_pit": CLOSURE_SQL + "SELECT idx, rank FROM rk",
        "basins": CLOSURE_SQL + "SELECT idx, dense_rank() OVER (ORDER BY root DESC) AS basin FROM rk",
        "main_stems": CLOSURE_SQL + ", pick AS (SELECT idx, row_number() OVER (PARTITION BY ds ORDER BY size DESC, (cents + 1)::FLOAT DESC, idx) > 1 AS off FROM e JOIN sz USING (idx) JOIN g USING (idx) WHERE idx <> ds)"
        " SELECT w.u AS idx, any_value(root) AS root FROM w LEFT JOIN pick ON pick.idx = w.v JOIN rk ON rk.idx = w.u GROUP BY w.u HAVING NOT coalesce(bool_or(off), false)",
        "ordering_dfs": _paths("idx") + _DFS + "SELECT idx, pos FROM dfs",
        "ordering_dfs_by_area": _paths("(cents % 1000 + 1) DESC, idx") + _DFS + "SELECT idx, pos FROM dfs",
        "ordering_bfs": _paths("idx") + "SELECT idx, row_number() OVER (ORDER BY rank, root, path NULLS FIRST) - 1 AS pos FROM key JOIN rk USING (idx)",
        "ordering_topo": CLOSURE_SQL + "SELECT idx, row_number() OVER (ORDER BY far.h, far.i, idx) - 1 AS pos FROM sz",
        "layering_asap": CLOSURE_SQL + _ASAP,
        "layering_alap": CLOSURE_SQL + _ALAP,
        "reverse_layers": CLOSURE_SQL + f"SELECT idx, max(layer) OVER () - layer AS layer FROM ({_ALAP})",
        "decomposition": CLOSURE_SQL + "SELECT idx, depth AS layer, row_number() OVER (ORDER BY depth, idx) - 1 AS pos FROM sz",
        "layer_sizes": CLOSURE_SQL + "SELECT depth AS layer, count(*) AS size, (sum(count(*)) OVER (ORDER BY depth) - count(*))::BIGINT AS offset FROM sz GROUP BY depth",
        "conflicts": CLOSURE_SQL + f", ly AS (SELECT 'asap' AS layering, * FROM ({_ASAP}) UNION ALL SELECT 'alap', * FROM ({_ALAP}))"
        " SELECT layering, layer, count(*) AS writes, count(*) - count(DISTINCT ds) AS conflicts FROM ly JOIN e USING (idx) WHERE idx <> ds GROUP BY layering, layer"
        " UNION ALL SELECT 'cfds', -1, count(*), 0 FROM e WHERE idx <> ds",
        "dfs_interval": _INTERVAL + "SELECT idx, dfs_in, dfs_out FROM itv",
        "drains_through": CLOSURE_SQL + "SELECT root AS point, idx FROM rk",
        "upstream_area": CLOSURE_SQL + "SELECT v AS idx, sum(cents)::DOUBLE AS upa FROM w JOIN g ON g.idx = u GROUP BY v",
        "upstream_area_lossy_push": _lossy(_ASAP) + "SELECT v AS idx, sum(cents)::DOUBLE AS upa FROM w2 JOIN g ON g.idx = u GROUP BY v",
        "distance_to_outlet": _LDN + "SELECT idx, ldn FROM ln",
        "distance_to_outlet_exact": _LDN + ", hx AS (SELECT idx, 0::FLOAT AS ldn FROM e WHERE idx = ds UNION ALL SELECT e.idx, (hx.ldn + plen::FLOAT)::FLOAT FROM hx JOIN e ON e.ds = hx.idx AND e.idx <> e.ds JOIN st2 ON st2.idx = e.idx) SELECT idx, ldn FROM hx",
        "longest_upstream_path": _LDN + "SELECT v AS idx, (max(a.ldn) - any_value(b.ldn))::FLOAT AS lup FROM w JOIN ln a ON a.idx = u JOIN ln b ON b.idx = v GROUP BY v",
        "strahler_order": CLOSURE_SQL + _orders("e", "w"),
        "strahler_order_channels": CLOSURE_SQL + f", ch AS MATERIALIZED ({channel}), ce AS (SELECT e.* FROM e JOIN ch USING (idx))" + _orders("ce", "w", "SELECT idx FROM ch"),
        "strahler_order_lossy_push": _lossy(_ALAP) + _orders("e2", "w2"),
        "channel_mask": CLOSURE_SQL + "SELECT idx FROM sz WHERE size >= 10",
        "geometry": _geometry(),
        "serial_locality": _SERIAL,
        "parallel_locality": _PARALLEL,
        "cycles": "WITH RECURSIVE n AS (SELECT count(*) AS n FROM orders), e AS (SELECT o_orderkey AS idx, (o_orderkey * o_orderkey + 1) % n AS ds FROM orders, n),"
        " w AS (SELECT idx AS u, ds AS v FROM e WHERE idx <> ds UNION SELECT w.u, e.ds FROM w JOIN e ON w.v = e.idx WHERE e.ds <> e.idx),"
        " l AS (SELECT u AS idx FROM w WHERE u = v), s AS (SELECT DISTINCT u AS idx FROM w JOIN l ON l.idx = w.v)"
        " SELECT e.idx, l.idx IS NOT NULL AS looped, s.idx IS NOT NULL AS stranded FROM e LEFT JOIN l USING (idx) LEFT JOIN s USING (idx)",
        "basin_graph_nodes": CLOSURE_SQL + "SELECT root AS node, count(*) AS weight FROM rk GROUP BY root",
        "basin_graph_links": _ROOTS + "SELECT a, b, count(*) AS length FROM sides GROUP BY a, b",
    }
