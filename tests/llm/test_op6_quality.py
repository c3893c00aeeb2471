import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import SF, docs, empty, write
from test_op3_toxicity import auc

from thalweg.llm import factorisation as M
from thalweg.llm.features import N_STRUCTURE, WordIds, structure


@pytest.mark.parametrize("seed", range(3))
def test_the_square_of_the_sum_gives_all_pairs(seed):
    rng = np.random.default_rng(seed)
    m = M.Machine(50, seed)
    m.w, m.w0 = rng.normal(size=50).astype(np.float32), 0.3
    m.v = rng.normal(size=(50, M.RANK)).astype(np.float32)
    rows = [(rng.choice(50, n, replace=False), rng.normal(size=n).astype(np.float32)) for n in (1, 2, 9)]
    for (idx, x), got in zip(rows, m.scores(rows), strict=True):
        z = m.w0 + sum(m.w[i] * a for i, a in zip(idx, x))
        z += sum(m.v[idx[i]] @ m.v[idx[j]] * x[i] * x[j] for i in range(len(idx)) for j in range(i))
        assert got == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-4)


def test_pairs_are_learned_that_no_single_feature_shows():
    rng = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(1500):
        a, b = rng.integers(0, 2, 2)
        rows.append((np.array([a, 2 + b]), np.ones(2, np.float32)))
        y.append(float(a == b))
    m = M.Machine(4)
    m.v = rng.normal(0, 0.3, (4, M.RANK)).astype(np.float32)
    for _ in range(8):
        m.fit(rows, np.array(y))
    assert auc(np.array(y), m.scores(rows)) > 0.95


def test_features_of_any_text():
    ids = WordIds()
    for t in (None, "", " \n", "one", "a " * 50_000, "|" * 10, "é\n\né\n"):
        idx, x = M.features(ids.of(t), t, [None, 0.0, -1.0, 1e12])
        assert len(set(idx.tolist())) == len(idx) and idx.max() < M.n_features(4) and np.isfinite(x).all()
        assert len(structure(t, ids.of(t))) == N_STRUCTURE


def plain_features(text, n_chars):
    """{feature: value} of a document by the description, without the module's arrays."""
    ids = WordIds()
    n = Counter(int(i) % M.BUCKETS for i in ids.of(text))
    size = math.sqrt(sum(math.log1p(k) ** 2 for k in n.values()))
    out = {i: math.log1p(k) / max(size, 1e-9) for i, k in n.items()}
    for j, s in enumerate(structure(text, ids.of(text))):
        out[M.BUCKETS + j] = s
        out[M.BUCKETS + N_STRUCTURE + j * (M.STEPS + 1) + min(math.ceil(math.sqrt(s) * M.STEPS), M.STEPS)] = 0.5
    out[M.BUCKETS + N_STRUCTURE * (M.STEPS + 2) + (33 if n_chars is None else min(32, int(math.log2(max(n_chars, 0) + 1))))] = 0.5
    return out


def test_the_whole_query_against_all_pairs(spark):
    """The machine fitted on features made one by one, and every score as the sum over all pairs of features."""
    docs_ = {r["doc_id"]: (r["text"], r["n_chars"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    marks: dict = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        if r["quality"] is not None:
            marks[r["doc_id"]] = min(r["quality"], marks.get(r["doc_id"], 1))
    seen = sorted(d for d in marks if d in docs_ and zlib.crc32(str(d).encode()) % 5)
    found = {d: plain_features(*x) for d, x in docs_.items()}
    # the order of summation is the module's: words by bucket, statistics, steps, metadata
    order = {d: list(f) for d, f in found.items()}
    for d, (text, n_chars) in docs_.items():
        order[d] = M.features(WordIds().of(text), text, [n_chars])[0].tolist()
        assert sorted(order[d]) == sorted(found[d])
    machine = M.Machine(M.n_features(1))
    machine.fit([(np.array(order[d]), np.array([found[d][i] for i in order[d]], np.float32)) for d in seen], np.array([marks[d] for d in seen], float))
    rows = M.op6_quality(spark, SF).collect()
    assert len(rows) == len(docs_)
    for r in rows:
        f = found[r["doc_id"]]
        i, x = np.array(list(f)), np.array(list(f.values()))
        v = machine.v[i].astype(float) * x[:, None]
        pairs = np.triu(v @ v.T, 1).sum()
        z = machine.w0 + (machine.w[i] * x).sum() + pairs
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=2e-3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3)


def test_held_out_documents_are_told_apart(spark):
    sf = "/root/testdata/sf0.1"
    got = M.op6_quality(spark, sf).toPandas().set_index("doc_id")
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and got["score"].between(0, 1).all()
    marks = spark.read.parquet(f"{sf}/labels.parquet").toPandas().groupby("doc_id")["quality"].min()
    held = got[got["held_out"]].join(marks, how="inner")
    assert auc(held["quality"].to_numpy(), held["score"].to_numpy()) > 0.99
    assert (held["predicted"] == held["quality"]).mean() > 0.97


def test_rows_of_every_kind(spark, tmp_path):
    source = docs(spark)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 12)] + [(3, 0, 1), (4, None, 0)], "doc_id long, quality int, toxic int")
    rows = M.op6_quality(spark, write(spark, tmp_path / "a", documents=source, labels=labels)).collect()
    assert len(rows) == source.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    clash = source.withColumn("m0", F.lit("clash")).withColumn("_m0", F.lit("clash"))
    got = M.score(clash, M.Machine(M.n_features(1)), ("n_chars",)).collect()
    assert {(r["m0"], r["_m0"]) for r in got} == {("clash", "clash")}
    none = labels.filter("doc_id < 0")
    rows = M.op6_quality(spark, write(spark, tmp_path / "b", documents=source, labels=none)).collect()
    assert {r["score"] for r in rows} == {0.5}
    assert M.op6_quality(spark, write(spark, tmp_path / "c", documents=empty(spark), labels=none)).count() == 0
