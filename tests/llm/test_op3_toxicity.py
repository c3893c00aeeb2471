import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from samples import SF, docs, empty, write

from thalweg.llm import toxicity
from thalweg.llm.features import WordIds, spellings

D, LEAST = toxicity.DISCOUNT, toxicity.LEAST


def draw(key):
    """xxhash64 of a word and a long, as Spark chains them, modulo the share that calibrates."""
    h = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), xxhash.xxh64_intdigest(b"toxicity", 42))
    return (h - (1 << 64) if h >> 63 else h) % toxicity.HOLD


class Book:
    """Interpolated Kneser-Ney models of both classes over sequences of symbols, by the book, with dictionaries.

    ``orders``: for each order, from the longest, {(context, symbol): [n0, n1]}; contexts are tuples."""

    def __init__(self, longest, length):
        self.orders = [longest]
        for _ in range(length):
            shorter = defaultdict(lambda: [0, 0])
            for (c, x), n in self.orders[-1].items():
                for k in (0, 1):
                    shorter[c[1:], x][k] += n[k] > 0
            self.orders.append(dict(shorter))
        self.total = []
        for o in self.orders:
            t = defaultdict(lambda: [0, 0])
            for (c, _), n in o.items():
                for k in (0, 1):
                    t[c][k] += n[k]
            self.total.append(t)
        self.kept = [{g: n for g, n in o.items() if sum(n) >= LEAST} for o in self.orders]
        self.spent = []
        for o in self.kept:
            t = defaultdict(lambda: [0.0, 0.0])
            for (c, _), n in o.items():
                for k in (0, 1):
                    t[c][k] += max(n[k] - D, 0)
            self.spent.append(t)

    def p(self, k, context, x, at=0):
        kept, total = self.kept[at].get((context, x), [0, 0]), self.total[at].get(context, [0, 0])
        if at == len(self.orders) - 1:
            n = sum(total)
            shared = (sum(kept) + 0.5) / (n + 0.5 * (len(self.orders[at]) + 1))
            every = max(total[k], 1)
            return max(kept[k] - D, 0) / every + (1 - self.spent[at].get((), [0, 0])[k] / every) * shared
        back = self.p(k, context[1:], x, at + 1)
        if sum(total) < LEAST or not total[k]:
            return back
        return max(kept[k] - D, 0) / total[k] + (1 - self.spent[at].get(context, [0, 0])[k] / total[k]) * back


def of_words(rows):
    ids, pairs = WordIds(), defaultdict(lambda: [0, 0])
    for text, toxic in rows:
        w = ids.of(text).tolist()
        for a, b in zip([toxicity.START, *w], w, strict=False):
            pairs[(a,), b][toxic] += 1
    return Book(pairs, 1)


def of_letters(rows):
    grams = defaultdict(lambda: [0, 0])
    for text, toxic in rows:
        for w in (text or "").encode().split():
            letters = [ord(c) % 4095 + 1 for c in WordIds.bare(w) + "\x03"]
            for j, x in enumerate(letters):
                grams[tuple(([0] * 4 + letters[:j])[-4:]), x][toxic] += 1
    return Book(grams, 4)


CORPUS = [("you bad bad dog, go away bad dog", 1), ("a good dog and a good cat", 0), ("a good day", 0), ("bad cat! go", 1), (None, 0), ("", 1), ("an odd word", 1), ("Good DOG ###", 0)]


def models(spark, rows):
    return toxicity.models_of(toxicity.counts(spark.createDataFrame(rows, "text string, toxic int")))


def test_chances_are_those_of_the_book(spark):
    got, words, letters = models(spark, CORPUS), of_words(CORPUS), of_letters(CORPUS)
    ids = WordIds()
    known = [toxicity.START, *ids.of("you bad dog good a cat away unseen").tolist()]
    for a in known:
        for b in known[1:]:
            one = np.array([a], np.uint64)
            p = got.words.over((one << np.uint64(32) | np.uint64(b)).view(np.int64), *got.words.weights(one), got.word.of(np.array([b])))
            assert p[:, 0] == pytest.approx([words.p(k, (a,), b) for k in (0, 1)], rel=1e-5)
    for w in ("bad", "good", "dogs", "zzz", ""):
        code = [ord(c) % 4095 + 1 for c in w + "\x03"]
        want = [math.log(letters.p(1, c, x) / letters.p(0, c, x)) for j, x in enumerate(code) for c in [tuple(([0] * 4 + code[:j])[-4:])]]
        assert got.spelt(spellings([w])[0]) == pytest.approx(want, rel=1e-4, abs=1e-5)


def test_keys_are_found():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 3000):
        keys = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, n))
        asked = np.concatenate([keys, keys + 1, rng.integers(0, 100, 50)])
        at, here = toxicity.Keys(keys).find(asked)
        assert here.tolist() == np.isin(asked, keys).tolist()
        assert (keys[at[here]] == asked[here]).all()


def test_chances_add_up(spark):
    got = models(spark, CORPUS)
    keys = got.word.keys.keys
    for a in (toxicity.START, int(WordIds().of("bad")[0]), int(WordIds().of("good")[0])):
        one = np.full(len(keys), a, np.uint64)
        p = got.words.over((one << np.uint64(32) | keys.astype(np.uint64)).view(np.int64), *got.words.weights(one), got.word.of(keys))
        assert (p.sum(axis=1) < 1).all() and (p > 0).all()


def test_counts_grow_with_the_documents(spark):
    """No two pairs share a count, however many there are."""
    rows = [(" ".join(f"w{k}x{j}" for j in range(300)) + " toxic word", k % 2) for k in range(60)] * 2
    got = toxicity.counts(spark.createDataFrame(rows, "text string, toxic int")).filter("kind = 0")
    assert got.count() == 60 * 301 + 1 and got.agg({"n0": "sum"}).first()[0] == 60 * 302
    assert got.filter("n0 + n1 > 2").count() == 1
    assert len(models(spark, rows).words.keys) == 60 * 301 + 1


def test_the_whole_comparison_against_loops(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    marks: dict = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        if r["toxic"] is not None:
            marks[r["doc_id"]] = max(r["toxic"], marks.get(r["doc_id"], 0))
    rows = [(texts[d], m) for d, m in marks.items() if d in texts and zlib.crc32(str(d).encode()) % 4 != 2 and draw(d)]
    book, ids = of_words(rows), WordIds()
    got = toxicity.op3_toxicity(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3)
        w = ids.of(texts[r["doc_id"]]).tolist()
        want = [math.log(book.p(1, (a,), b) / book.p(0, (a,), b)) for a, b in zip([toxicity.START, *w], w, strict=False)]
        assert r["log_ratio"] == pytest.approx(math.fsum(want) / max(len(w), 1), rel=1e-4, abs=1e-5)


def test_evidence_of_many_texts_is_that_of_each(spark):
    m = models(spark, CORPUS)
    texts = ["bad dog", None, "", "a good dog and a bad cat " * 30, "go", "### !!! you bad", "you bad dog go away bad cat an odd word ok"]
    whole = toxicity.Evidence(m).of(texts)
    for t, row in zip(texts, whole, strict=True):
        e = toxicity.Evidence(m)
        assert row == pytest.approx(e.of([t])[0])
        raw = (t or "").encode().split()
        if not raw:
            assert not row.any()
            continue
        k = [e.raw[w] for w in raw]
        best = lambda x, s: max(sum(x[i : i + s]) for i in range(len(x) - s + 1)) / s if len(x) >= s else sum(x) / s
        alone, spelt = e.alone[k].tolist(), e.spelt[k].tolist()
        n = len(toxicity.STRETCHES)
        assert row[1:3] == pytest.approx([np.mean(alone), np.mean(spelt)])
        assert row[3 + n : 3 + 2 * n] == pytest.approx([best(alone, s) for s in toxicity.STRETCHES])
        top = sorted((e.alone[j] for j in set(k)), reverse=True)
        want = [top[p - 1] if len(top) >= p else min(top[-1], 0) for p in toxicity.PLACES]
        assert row[3 + 3 * n : 3 + 3 * n + len(want)] == pytest.approx(want)


def auc(y, s):
    order = np.argsort(np.argsort(s))
    n1 = y.sum()
    return (order[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))


def test_held_out_documents_are_told_apart(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op3_toxicity(spark, sf).toPandas().set_index("doc_id")
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and got["score"].between(0, 1).all()
    marks = spark.read.parquet(f"{sf}/labels.parquet").toPandas().groupby("doc_id")["toxic"].max()
    held = got[got["held_out"]].join(marks, how="inner")
    y = held["toxic"].to_numpy()
    assert auc(y, held["score"].to_numpy()) > 0.95
    hit = held["predicted"].to_numpy() == 1
    assert y[hit].mean() > 0.9 and hit[y == 1].mean() > 0.87


def test_rows_of_every_kind(spark, tmp_path):
    source = docs(spark)
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(1, 12)] + [(3, 0, 1), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.op3_toxicity(spark, write(spark, tmp_path / "a", documents=source, labels=labels)).collect()
    assert len(rows) == source.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    clash = source.withColumn("_text", F.lit("clash")).withColumn("log_ratio", F.lit("clash"))
    got = toxicity.score(clash, (models(spark, CORPUS), np.zeros(1 + toxicity.WIDTH)))
    assert set(got.columns) == {*clash.columns} - {"text"} and {(r["_text"], r["score"]) for r in got.collect()} == {("clash", 0.5)}
    none = labels.filter("doc_id < 0")
    rows = toxicity.op3_toxicity(spark, write(spark, tmp_path / "b", documents=source, labels=none)).collect()
    assert len({r["score"] for r in rows}) == 1
    assert toxicity.op3_toxicity(spark, write(spark, tmp_path / "c", documents=empty(spark), labels=none)).count() == 0
