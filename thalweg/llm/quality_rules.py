r"""Quality rules with risk-controlled thresholds, in DataFrame and SQL functions only.

A rule rejects a document when a share (of signs, capitals, repeated words, ...) is above its
cutoff. Labelled documents are split in two by a hash of their id. The first half chooses: for each
stratum (language) and rule the cutoff that rejects most bad documents less what it costs in good ones,
and the order of the rules by that gain. The good documents of the second half are the holdout that
certifies: for each stratum and each number j of leading rules, the exact binomial tail P(Bin(n, ALPHA) <= good
documents that any of the j rules rejects) is the p-value of "these rules together falsely reject more
than ALPHA". It must be at most DELTA divided by the number of all such tests in all strata (Bonferroni), so
that with confidence 1 - DELTA no stratum loses more than ALPHA of its good documents to all its rules. The
largest certified j is taken; none certified means no rule is on in that stratum.

Edge cases: a null or empty text has no words and fails the base rule; a text of one or two words
has no 3-word window; a null language is a stratum of its own; strata without enough labels have
no active rule; a document labelled twice counts once if both labels agree on good, and as bad if
any label is 0; rows that repeat give repeated rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thalweg.llm.common import WORD, cut, table

#: Most good documents, as a share of a stratum, that its rules may reject together.
ALPHA = 0.01
#: Chance that the certified rules of any stratum exceed ALPHA, over all tests together.
DELTA = 0.05
#: What one falsely rejected good document weighs against one rejected bad one.
COST = 2
#: Rules: the share in thousandths that is compared, and the candidate cutoffs.
RULES = {
    "symbols": ("1000 * n_symbols div greatest(word_chars, 1)", (20, 50, 80, 100, 150, 200, 300)),
    "capitals": ("1000 * n_capitals div greatest(word_chars, 1)", (100, 200, 300, 400, 500, 600, 700)),
    "duplicate_lines": ("1000 * n_dup_lines div greatest(n_lines, 1)", (50, 100, 200, 300, 400, 500)),
    "repeats": ("1000 * n_repeat_words div greatest(n_words, 1)", (20, 50, 100, 150, 200, 300, 400)),
    "bars": ("1000 * n_bars div greatest(n_words, 1)", (50, 100, 200, 300, 400)),
    "long_words": ("100 * word_chars div greatest(n_words, 1)", (700, 800, 900, 1000, 1200, 1500)),
}


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` and the counts of each text: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines, n_capitals, n_bars (all long). One pass, no shuffle.

    Repeated 3-word windows are found per row: windows are hashed; only where a hash repeats are
    (hash, place) pairs sorted and the places of equal neighbours merged into covered words.
    """
    capitals, signs, blanks = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "#*$%&|<>", " \t\n\x0b\x0c\r"
    without = lambda signs: F.length("_t") - F.length(F.translate("_t", signs, ""))
    df = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    df = df.withColumn("_w", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))
    df = df.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)))
    df = df.select(
        *keep, "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", blanks, "")).cast("long").alias("word_chars"),
        without(signs).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        without(capitals).cast("long").alias("n_capitals"),
        without("|").cast("long").alias("n_bars"),
        F.expr("transform(slice(_w, 1, greatest(size(_w) - 2, 0)), (w, i) -> xxhash64(w, get(_w, i + 1), get(_w, i + 2)))").alias("_h"),
    ).drop("_w")
    places = """
      sort_array(transform(filter(_s, (e, j) -> e.x <=> get(_s, j - 1).x or e.x <=> get(_s, j + 1).x), e -> e.i))
    """
    some = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("_s", F.when(some, F.expr("sort_array(transform(_h, (x, i) -> named_struct('x', x, 'i', i)))")))
    df = df.withColumn("_p", F.when(F.col("_s").isNotNull(), F.expr(places)))
    covered = F.expr("aggregate(_p, named_struct('c', 0L, 'last', -3), (a, p) -> named_struct('c', a.c + least(3, p - a.last), 'last', p), a -> a.c)")
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_h", "_s", "_p")


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def log_gamma(x: str) -> str:
    """SQL for ln Gamma(x), x >= 1, by Stirling's series after shifting x up by 10."""
    y = f"({x} + 10)"
    shift = " + ".join(f"ln({x} + {k})" for k in range(10))
    return f"(({y} - 0.5D) * ln({y}) - {y} + 0.9189385332046727D + 1 / (12D * {y}) - 1 / (360D * pow({y}, 3)) + 1 / (1260D * pow({y}, 5)) - ({shift}))"


def tail(n: str, k: str, alpha: float) -> str:
    """SQL for P(Bin(n, alpha) <= k) where k <= n * alpha, else 1.

    The largest term comes from log-gammas; the rest follow by their ratio. Terms further than
    20 standard deviations below k are under 1e-80 of the sum.
    """
    point = f"exp({log_gamma(f'({n} + 1D)')} - {log_gamma(f'({k} + 1D)')} - {log_gamma(f'({n} - {k} + 1D)')} + {k} * ln({alpha}D) + ({n} - {k}) * ln({1 - alpha}D))"
    span = f"cast(least({k}, 20 * sqrt({n} * {alpha}D) + 50) as int)"
    sums = f"aggregate(sequence(0, {span}), named_struct('t', 1D, 's', 0D), (a, j) -> named_struct('t', a.t * ({k} - j) * {1 - alpha}D / (({n} - {k} + j + 1) * {alpha}D), 's', a.s + a.t), a -> a.s)"
    return f"case when {k} > {n} * {alpha}D then 1D else {point} * {sums} end"


def _value(rule: str) -> str:
    return f"cast({RULES[rule][0]} as long)"


def chosen(held: DataFrame, cost: float) -> DataFrame:
    """(stratum, cutoffs, ranks): what each rule gains most by and its place among the rules that gain anything, as
    maps by rule. ``held``: stratum, _good and the counts of the documents that choose."""
    counts = held.groupBy("stratum").agg(*[F.count_if((F.col("_good") == g) & (F.expr(_value(r)) > c)).alias(f"{r}:{c}:{g}") for r, (_, cs) in RULES.items() for c in cs for g in (0, 1)])
    tests = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), (F.col(f"{r}:{c}:0") - cost * F.col(f"{r}:{c}:1")).alias("gain")) for r, (_, cs) in RULES.items() for c in cs])
    tested = counts.select("stratum", F.explode(tests).alias("t")).select("stratum", "t.*").filter("gain > 0")
    best = tested.groupBy("stratum", "rule").agg(F.max(F.struct("gain", "cutoff")).alias("b")).select("stratum", "rule", "b.*")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("gain"), "rule")))
    pairs = lambda v: F.map_from_entries(F.collect_list(F.struct("rule", v)))
    return best.groupBy("stratum").agg(pairs("cutoff").alias("cutoffs"), pairs("rank").alias("ranks"))


def certify(measured: DataFrame, labels: DataFrame, stratum: str, alpha: float = ALPHA, delta: float = DELTA, cost: float = COST) -> DataFrame:
    """One row for each stratum with certified rules: stratum and a map from rule to its cutoff.

    ``labels``: doc_id and quality. All labelled documents that pass the base rule count.
    """
    marks = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_good"))
    held = measured.filter(~base_failed()).join(marks, F.col("doc_id") == F.col("_id")).filter("_good is not null")
    held = held.withColumn("stratum", F.col(stratum)).withColumn("_first", F.md5(F.col("doc_id").cast("string")) < "8")
    rules = chosen(held.filter("_first"), cost).withColumnRenamed("stratum", "_s")
    good = held.filter("not _first and _good = 1").join(rules, F.col("stratum").eqNullSafe(F.col("_s")))
    broken = F.array_min(F.array(*[F.when(F.expr(_value(r)) > F.col("cutoffs")[r], F.col("ranks")[r]) for r in RULES]))
    n = len(RULES)
    counts = good.withColumn("_rank", F.coalesce(broken, F.lit(n + 1))).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("_rank") <= j).alias(f"k{j}") for j in range(1, n + 1)])
    tested = counts.join(rules, F.col("stratum").eqNullSafe(F.col("_s"))).withColumn("m", F.sum(F.size("ranks")).over(Window.partitionBy()))
    tests = F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"k{j}").alias("k")) for j in range(1, n + 1)])
    tested = tested.select("stratum", "n", "m", "cutoffs", "ranks", F.explode(tests).alias("t")).select("*", "t.j", "t.k").filter("j <= size(ranks)")
    ok = tested.withColumn("p", F.expr(tail("n", "k", alpha))).filter(f"p <= {delta}D / m")
    most = ok.groupBy(F.col("stratum").alias("_t")).agg(F.max("j").alias("most"))
    return most.join(rules, F.col("_t").eqNullSafe(F.col("_s"))).select(F.col("_t").alias("stratum"), F.map_filter("cutoffs", lambda r, c: F.col("ranks")[r] <= F.col("most")).alias("cutoffs"))


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """Add base_failed, kept and failed_rules (names of the rules a document breaks)."""
    cutoffs = cutoffs.select(F.col("stratum").alias("_stratum"), "cutoffs")
    df = measured.join(cutoffs, F.col(stratum).eqNullSafe(F.col("_stratum")), "left").withColumn("base_failed", base_failed())
    broken = [F.when(F.expr(f"cast({v} as long)") > F.col("cutoffs")[r], F.lit(r)) for r, (v, _) in RULES.items()]
    df = df.withColumn("failed_rules", F.array_compact(F.array(*broken)))
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_stratum", "cutoffs")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of every document and whether base and certified rules keep it."""
    measured = cut(measure(table(spark, sf_dir, "documents"), ("doc_id", "lang")), "measured")
    cutoffs = cut(certify(measured, table(spark, sf_dir, "labels"), "lang"), "cutoffs")
    out = judge(measured, cutoffs, "lang")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def _oracle() -> str:
    value = {r: v.replace(" div ", " // ") for r, (v, _) in RULES.items()}
    grid = ", ".join(f"('{r}', {c})" for r, (_, cs) in RULES.items() for c in cs)
    pick = "CASE rule " + " ".join(f"WHEN '{r}' THEN {v}" for r, v in value.items()) + " END"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT row, doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT row, i, hash(w[i], w[i + 1], w[i + 2]) AS h, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
r AS (SELECT row, i FROM g QUALIFY count(*) OVER (PARTITION BY row, g) > 1),
c AS (SELECT row, count(DISTINCT i + o)::BIGINT AS n FROM r, unnest([0, 1, 2]) AS u(o) GROUP BY row),
b AS (
  SELECT w.row, doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
    length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals, length(regexp_replace(t, '[^|]', '', 'g'))::BIGINT AS n_bars
  FROM w LEFT JOIN c USING (row)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
m AS (SELECT doc_id, min(quality) AS good FROM labels GROUP BY doc_id),
rules(rule, cutoff) AS (VALUES {grid}),
h AS (SELECT f.*, good, md5(doc_id::VARCHAR) < '8' AS first FROM f JOIN m USING (doc_id) WHERE NOT base_failed AND good IS NOT NULL),
c1 AS (
  SELECT lang, rule, cutoff, count(*) FILTER (good = 0 AND {pick} > cutoff) - {COST} * count(*) FILTER (good = 1 AND {pick} > cutoff) AS gain
  FROM h, rules WHERE first GROUP BY lang, rule, cutoff
), c2 AS (
  SELECT lang, rule, max(gain) AS gain, arg_max(cutoff, gain * 1000000 + cutoff) AS cutoff FROM c1 WHERE gain > 0 GROUP BY lang, rule
), c3 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY gain DESC, rule) AS rank FROM c2),
g2 AS (
  SELECT h.row, h.lang, coalesce(min(c3.rank) FILTER ({pick} > cutoff), 99) AS broken FROM h JOIN c3 ON h.lang IS NOT DISTINCT FROM c3.lang WHERE NOT first AND good = 1 GROUP BY h.row, h.lang
), k AS (
  SELECT c3.lang, c3.rank AS j, count(*) AS n, count(*) FILTER (broken <= c3.rank) AS k FROM c3 JOIN g2 ON c3.lang IS NOT DISTINCT FROM g2.lang GROUP BY c3.lang, c3.rank
), p AS (
  SELECT *, CASE WHEN k > n * {ALPHA}::DOUBLE THEN 1 ELSE list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}::DOUBLE) + (n - i) * ln({1 - ALPHA}::DOUBLE)) FOR i IN range(0, k + 1)]) END AS p,
    count(*) OVER () AS tests FROM k
), most AS (SELECT lang, max(j) AS j FROM p WHERE p <= {DELTA}::DOUBLE / tests GROUP BY lang),
best AS (SELECT c3.lang, rule, cutoff FROM c3 JOIN most ON c3.lang IS NOT DISTINCT FROM most.lang WHERE rank <= j),
v AS (
  SELECT row, string_agg(rule, ',' ORDER BY array_position([{', '.join(f"'{r}'" for r in RULES)}], rule)) AS failed FROM f JOIN best ON f.lang IS NOT DISTINCT FROM best.lang WHERE {pick} > cutoff GROUP BY row
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed IS NULL AS kept, coalesce(failed, '') AS failed_rules
FROM f LEFT JOIN v USING (row)
"""


OP4_SQL = _oracle()
