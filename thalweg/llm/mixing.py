"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Targets: sources share all sizes by weight; none may take more than ``most`` times its own size,
and what is over is shared again by weight (water filling, solved exactly by sorting the sources
by the level at which each of them is full). Schedule: the points of a golden-ratio sequence pass
through the cumulative slot shares and name a source for each slot; slots are ranked per source,
and the k-th slot of a source takes the k-th block of its shuffled stream, round after round. The
few slots that the sequence still owes a source at the end follow in a tail. The last slot of a
source is cut so that it takes exactly the whole part of its target. What a slot takes keeps the slot's
number, which is the order of the mix: every stretch of it holds the sources in about their shares.

Edge cases: a null text or one without words has size 0 and is taken 0 times; a null source is a
source of its own and comes last; rows that repeat are rows of their own; ties of the shuffle are
broken by id and size, and rows equal in all three are interchangeable; an empty table gives an
empty mix; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thalweg.llm.common import WORD, cut, running, spare, table

#: The expression of a word inside a SQL string.
SQL_WORD = WORD.replace("\\", "\\\\")
#: Words of one block.
BLOCK = 2048
#: Weights, dealt to the sources by code point order, again and again.
WEIGHTS = (5.0, 2.0, 1.0)
#: Times its own size that a source, and so a document, may be taken.
MOST = 3
#: The golden section in units of 2^-31, odd, so that the sequence has full period.
GOLDEN = 1327217885
UNIT = 1 << 31
#: Cells of the unit interval in which slots meet sources.
CELLS = 4096
#: Slots of a chunk when they are ranked.
CHUNK = 16384


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, target. ``sizes`` has source and size.

    One window orders the sources, of which there are few; rows of documents were summed before.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    full = totals.withColumn("w", weight).withColumn("full_at", most * F.col("source_size") / F.col("w"))
    upto = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    full = (
        full.withColumn("full_before", F.coalesce(F.sum(most * F.col("source_size")).over(upto), F.lit(0)))
        .withColumn("w_before", F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("w_all", F.sum("w").over(every))
        .withColumn("level", (F.col("total") - F.col("full_before")) / (F.col("w_all") - F.col("w_before")))
    )
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(every)["level"]
    full = full.withColumn("level", level)
    target = F.least(most * F.col("source_size").cast("double"), F.col("w") * F.col("level"))
    return full.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def quotas(goals: DataFrame, block: int) -> DataFrame:
    """What each source takes: words, blocks of its stream, slots, and its share of the unit interval."""
    q = (
        goals.withColumn("take", F.floor(F.col("target") + 1e-6))
        .withColumn("blocks", F.ceil(F.col("source_size") / block))
        .withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("take") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.col("take") - F.col("rounds") * F.col("source_size"))
        .withColumn("slots", F.col("rounds") * F.col("blocks") + F.ceil(F.col("rest") / block))
    )
    before = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    q = q.withColumn("slots_before", F.coalesce(F.sum("slots").over(before), F.lit(0))).withColumn("all_slots", F.sum("slots").over(Window.partitionBy()))
    edge = lambda x: F.when(F.col("all_slots") > 0, F.floor(x / F.col("all_slots") * UNIT)).otherwise(0)
    return q.withColumn("lo", edge(F.col("slots_before"))).withColumn("hi", edge(F.col("slots_before") + F.col("slots")))


def schedule(quota: DataFrame) -> DataFrame:
    """Slots in order: slot, source, k (its rank within the source, from 0).

    Ranks come from counts per chunk of slots and a window within (source, chunk), so no task sees
    a whole source.
    """
    spark = quota.sparkSession
    n = int(quota.agg(F.coalesce(F.max("all_slots"), F.lit(0))).first()[0])
    slots = spark.range(n).select(F.col("id").alias("slot"), (((F.col("id") + 1) % UNIT) * GOLDEN % UNIT).alias("point"))
    slots = slots.withColumn("cell", F.floor(F.col("point") / (UNIT // CELLS)))
    cells = quota.filter("hi > lo").select("source", "slots", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / (UNIT // CELLS)), F.floor((F.col("hi") - 1) / (UNIT // CELLS)))).alias("cell"))
    named = slots.join(cells, "cell").filter("point >= lo and point < hi").select("slot", "source", "slots", F.floor(F.col("slot") / CHUNK).alias("chunk"), F.lit(1).alias("one"))
    ranked = running(named, ["source"], ["slot"], "one", "k", "chunk")
    main = ranked.filter("k < slots").select("slot", "source", F.col("k").cast("long").alias("k"))
    had = named.groupBy("source").agg(F.sum("one").alias("had"))
    had = had.withColumnRenamed("source", "_s")
    owed = quota.join(had, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("had", F.coalesce("had", F.lit(0))).filter("slots > had")
    tail = owed.select("source", F.explode(F.sequence(F.col("had"), F.col("slots") - 1)).alias("k"), "slots")
    place = F.row_number().over(Window.orderBy(F.col("k") / F.col("slots"), F.col("source").asc_nulls_last(), "k"))
    return main.unionByName(tail.select((n + place - 1).cast("long").alias("slot"), "source", F.col("k").cast("long").alias("k")))


def streams(sizes: DataFrame, seed: int = 7) -> DataFrame:
    """Add ``offset``: the words of the source's shuffled stream that precede the document."""
    deal = sizes.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), "doc_id", "size").cast("binary"))).withColumn("_salt", F.substring("_h", 1, 3))
    return running(deal, ["source"], ["_h", "doc_id", "size"], "size", "offset", "_salt").drop("_h", "_salt")


def mix(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, goals, pieces) of a mix of ``sizes`` (doc_id, source, size, ...).

    documents: the rows with their stream offsets; goals: targets per source; pieces: what each
    slot takes, in slot order: slot, source, epoch, offset (which document), doc_id, word_from and
    word_to (end exclusive) of that document's words.
    """
    goals = cut(targets(sizes, weights, most), "goals")
    quota = quotas(goals, block)
    docs = cut(streams(sizes, seed), "streams")
    slots = schedule(quota)
    q = quota.select(F.col("source").alias("_s"), "source_size", "blocks", "rounds", "rest")
    slots = slots.join(q, F.col("source").eqNullSafe(F.col("_s")))
    slots = slots.withColumn("epoch", F.floor(F.col("k") / F.col("blocks"))).withColumn("block", F.col("k") % F.col("blocks"))
    end = F.when(F.col("epoch") < F.col("rounds"), F.col("source_size")).otherwise(F.col("rest"))
    slots = slots.select("slot", F.col("source").alias("_s"), "epoch", F.col("block").alias("_b"), (F.col("block") * block).alias("from"), F.least((F.col("block") + 1) * block, end).alias("to"))
    held = docs.filter("size > 0").select("source", "doc_id", "offset", "size")
    held = held.withColumn("block", F.explode(F.sequence(F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("size") - 1) / block))))
    pairs = held.join(slots, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    pieces = pairs.select(
        "slot", "source", "epoch", "offset", "doc_id",
        (F.greatest("offset", "from") - F.col("offset")).alias("word_from"),
        (F.least(F.col("offset") + F.col("size"), "to") - F.col("offset")).alias("word_to"),
    ).filter("word_to > word_from")
    return docs, goals, pieces


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs`` (doc_id, source, text, ...) and slot (replaced if there is one), one row
    for each round in which a row is taken; slot is the first that takes of it in that round, and rows of a partition are in the order of
    slots. A row taken in part in a round keeps the taken words with the blanks between them. Rows that
    share id, source and text are rows of their own, and other columns of theirs come from the least of them."""
    d, s, c, o, spans_ = (spare(docs, f"_{x}") for x in ("doc", "source", "code", "offset", "spans"))
    code = F.xxhash64(F.coalesce("text", F.lit("")))
    rows, _, pieces = mix(cut(docs.select("doc_id", "source", code.alias("code"), n_words("text").alias("size")), "sizes"), **options)
    spans = pieces.groupBy(F.col("source").alias(s), F.col("offset").alias(o), "epoch").agg(F.min("word_from").alias("from"), F.max("word_to").alias("to"), F.min("slot").alias("slot"))
    spans = rows.filter("size > 0").join(spans, F.col("source").eqNullSafe(F.col(s)) & (F.col("offset") == F.col(o)), "left")
    one = F.when(F.col("epoch").isNotNull(), F.struct("slot", "from", "to", "size"))
    spans = spans.groupBy(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("code").alias(c)).agg(F.sort_array(F.collect_list(one)).alias(spans_), F.count_if(F.coalesce("epoch", F.lit(0)) == 0).alias(o)).filter(F.size(spans_) > 0)
    on = F.col("doc_id").eqNullSafe(F.col(d)) & F.col("source").eqNullSafe(F.col(s)) & (code == F.col(c))
    spans = cut(spans, "spans")
    taken = docs.join(spans.filter(F.col(o) == 1).hint("shuffle_hash"), on).select(*docs.columns, F.explode(spans_).alias(s))
    if spans.filter(F.col(o) > 1).limit(1).count():  # else texts move once
        again = docs.join(spans.filter(F.col(o) > 1).hint("shuffle_hash"), on).groupBy(d, s, c).agg(F.min(F.struct(*docs.columns)).alias(o), F.first(spans_).alias(spans_))
        taken = taken.unionByName(again.select(f"{o}.*", F.explode(spans_).alias(s)))
    part = F.expr(f"""
      array_join(zip_with(slice(regexp_extract_all(text, '{SQL_WORD}', 0), cast({s}.from + 1 as int), cast({s}.to - {s}.from as int)),
        slice(split(text, '{SQL_WORD}', -1), cast({s}.from + 2 as int), cast({s}.to - {s}.from - 1 as int)), (w, b) -> concat(w, coalesce(b, ''))), '')
    """)
    whole = (F.col(f"{s}.from") == 0) & (F.col(f"{s}.to") == F.col(f"{s}.size"))
    got = taken.withColumn("text", F.when(whole, F.col("text")).otherwise(part)).withColumn("slot", F.col(f"{s}.slot"))
    return got.select(*[x for x in docs.columns if x != "slot"], "slot").sortWithinPartitions("slot")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, from the pieces of its slots, and the first slot that does."""
    docs = table(spark, sf_dir, "documents")
    sizes = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    rows, goals, pieces = mix(sizes)
    taken = pieces.groupBy(F.col("source").alias("_s"), F.col("offset").alias("_o")).agg(F.sum(F.col("word_to") - F.col("word_from")).alias("_taken"), F.min("slot").alias("first_slot"))
    got = rows.join(taken, F.col("source").eqNullSafe(F.col("_s")) & (F.col("offset") == F.col("_o")) & (F.col("size") > 0), "left").drop("_s", "_o")
    goals = goals.withColumnRenamed("source", "_s")
    got = got.join(goals, F.col("source").eqNullSafe(F.col("_s")))
    return got.select("doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


#: The slots of a source take whole rounds of its stream and then its first words, so the counts need no schedule; the
#: schedule gives each document the slot of the block in which its words begin.
OP2_SQL = rf"""
WITH s AS (
  SELECT row_number() OVER () AS row, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), t AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM t),
f AS (SELECT *, 3 * source_size / w AS full_at FROM w),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM f WINDOW b AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT source, source_size, coalesce(least(3.0::DOUBLE * source_size, w * (SELECT arg_min(level, full_at) FROM l WHERE level <= full_at)), 0) AS target FROM l
), q0 AS (
  SELECT *, floor(target + 1e-6)::BIGINT AS take, (source_size + {BLOCK - 1}) // {BLOCK} AS blocks FROM g
), q AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE take // source_size END AS rounds, CASE WHEN source_size = 0 THEN 0 ELSE take % source_size END AS rest FROM q0
), n AS (SELECT *, (rounds * blocks + (rest + {BLOCK - 1}) // {BLOCK})::BIGINT AS slots FROM q),
i AS (SELECT *, (coalesce(sum(slots) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before, (sum(slots) OVER ())::BIGINT AS every FROM n),
e AS (SELECT *, floor(before / every * {UNIT}::DOUBLE)::BIGINT AS lo, floor((before + slots) / every * {UNIT}::DOUBLE)::BIGINT AS hi FROM i WHERE every > 0),
p AS (SELECT slot, (slot + 1) % {UNIT} * {GOLDEN} % {UNIT} AS point FROM range((SELECT coalesce(max(every), 0) FROM e)) AS r(slot)),
m AS (SELECT slot, source, slots, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS k FROM p JOIN e ON point >= lo AND point < hi),
had AS (SELECT source, count(*) AS had FROM m GROUP BY source),
owed AS (SELECT e.source, e.slots, e.every, unnest(range(coalesce(had, 0), e.slots)) AS k FROM e LEFT JOIN had ON e.source IS NOT DISTINCT FROM had.source),
c AS (
  SELECT slot, source, k FROM m WHERE k < slots
  UNION ALL SELECT every + row_number() OVER (ORDER BY k / slots, source NULLS LAST, k) - 1, source, k FROM owed
), o AS (
  SELECT s.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(concat_ws(':', 7, doc_id, size)), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM s
)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE rounds * size + greatest(0, least(off + size, rest) - off) END::BIGINT AS taken, c.slot::BIGINT AS first_slot
FROM o JOIN q ON o.source IS NOT DISTINCT FROM q.source
LEFT JOIN c ON c.source IS NOT DISTINCT FROM o.source AND c.k = off // {BLOCK} AND size > 0 AND (rounds > 0 OR off < rest)
"""
