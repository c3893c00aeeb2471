import math
from collections import Counter

import pytest
from pyspark.sql import functions as F
from samples import TEXTS, docs, empty, same, words, write

from thalweg.llm import quality_rules as Q


def counted(text):
    text, w = text or "", words(text)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    often = {x for x, n in Counter(windows).items() if n > 1}
    covered = {k + j for k, x in enumerate(windows) if x in often for j in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_the_twin_agrees(spark):
    assert same(spark, Q.op4_quality_rules, Q.OP4_SQL) == 200
    assert same(spark, Q.op4_quality_rules, Q.OP4_SQL, "/root/testdata/sf0.01") == 1000


def test_the_twin_agrees_where_rules_are_certified(spark, tmp_path):
    def text(k):
        base = " ".join(f"w{k}x{j}" for j in range(60))
        return base + " " + "###|| " * 30 if k % 3 == 0 else base.upper() if k % 301 == 1 else base

    source = spark.createDataFrame([(k, text(k), ("en", None)[k % 2], "a", 1) for k in range(9000)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(9000)], "doc_id long, quality int, toxic int")
    sf = write(spark, tmp_path, documents=source.coalesce(1), labels=labels.coalesce(1))
    assert same(spark, Q.op4_quality_rules, Q.OP4_SQL, sf) == 9000
    rejected = [r for r in Q.op4_quality_rules(spark, sf).collect() if not r["kept"]]
    assert len(rejected) >= 3000 and all(r["doc_id"] % 3 == 0 for r in rejected)


def test_counts(spark):
    more = ["a b c a b c a b c", "x y x y x y x", "a\nb\na\n \na\n", "# * $ % & | < >", "p q r s p q r", " ".join(["la"] * 200)]
    source = docs(spark, [*TEXTS, *more])
    got = Q.measure(source, ("doc_id", "text")).collect()
    assert len(got) == source.count()
    for r in got:
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == counted(r["text"])


@pytest.mark.parametrize(("n", "k"), [(1, 0), (10, 0), (500, 0), (500, 1), (500, 4), (3000, 12), (100000, 900), (100000, 1100), (7, 7)])
def test_binomial_tails_are_exact(spark, n, k):
    got = spark.createDataFrame([(n, k)], "n long, k long").select(F.expr(Q.tail("n", "k", 0.01))).first()[0]
    if k > n * 0.01:
        assert got == 1.0
    else:
        term = lambda i: math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.01) + (n - i) * math.log(0.99))
        assert got == pytest.approx(math.fsum(term(i) for i in range(k + 1)), rel=1e-8)


def test_all_rules_of_a_stratum_keep_one_promise(spark):
    """Each of six rules rejects other good documents, 0.6 % of them: one rule keeps the promise, all six don't."""
    broken = {"n_symbols": 4000, "n_capitals": 4000, "n_dup_lines": 10, "n_repeat_words": 100, "n_bars": 100}
    good, which = F.col("doc_id") % 5 != 0, (F.floor(F.col("doc_id") / 5) % 160).cast("int")
    measured = spark.range(120_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "en").alias("lang"), F.lit(100).cast("long").alias("n_words"), F.lit(10).cast("long").alias("n_lines"))
    for j, (c, v) in enumerate(broken.items()):
        measured = measured.withColumn(c, F.when(~good | (which == j), v if c != "n_repeat_words" else 45).otherwise(0).cast("long"))
    measured = measured.withColumn("word_chars", F.when(~good | (which == 5), 160 * 100).otherwise(500).cast("long"))
    labels = measured.select("doc_id", good.cast("int").alias("quality"))
    cutoffs = Q.certify(measured, labels, "lang")
    judged = Q.judge(measured, cutoffs, "lang").join(labels, "doc_id")
    rows = judged.groupBy("lang", "quality").agg(F.avg((~F.col("kept")).cast("int")).alias("lost")).collect()
    assert len(rows) == 4
    for r in rows:
        assert r["lost"] == 1.0 if r["quality"] == 0 else 0 < r["lost"] <= Q.ALPHA
    assert all(len(r["cutoffs"]) == 1 for r in cutoffs.collect())


def test_strata_with_too_few_labels_have_no_rule(spark):
    measured = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), *[F.lit(100).cast("long").alias(c) for c in ("n_words", "word_chars", "n_lines", "n_dup_lines", "n_capitals", "n_bars")], F.lit(0).cast("long").alias("n_repeat_words"), (F.col("id") % 2 * 90).alias("n_symbols"))
    labels = measured.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality"))
    assert Q.certify(measured, labels, "lang").count() == 0


def test_rows_of_every_kind(spark, tmp_path):
    source = docs(spark)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 12)] + [(3, None, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    rows = Q.op4_quality_rules(spark, write(spark, tmp_path / "a", documents=source, labels=labels)).collect()
    assert len(rows) == source.count()
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in rows)
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert Q.op4_quality_rules(spark, write(spark, tmp_path / "b", documents=empty(spark), labels=labels)).count() == 0
