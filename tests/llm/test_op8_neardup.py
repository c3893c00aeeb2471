import random

import numpy as np
import pytest
from samples import docs, empty, same, write

from thalweg.llm import neardup as N


def sets_of(texts, width):
    out = []
    for t in texts:
        w = (t or "").encode().translate(N._LOWER).split()
        out.append({tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, 1))} if w else set())
    return out


def brute(texts, width, similarity):
    """The smallest index reachable over links, each pair compared."""
    s, low = sets_of(texts, width), list(range(len(texts)))

    def find(v):
        while low[v] != v:
            v = low[v]
        return v

    for a in range(len(s)):
        for b in range(a):
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= similarity * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                low[y] = x
    return [find(v) for v in range(len(s))]


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed):
    rng, out = random.Random(seed), []
    for _ in range(25):
        base = " ".join(f"w{rng.randrange(4000)}" for _ in range(rng.choice((4, 12, 60, 200, 900))))
        out.append(base)
        for _ in range(rng.choice((0, 1, 5, 12))):
            out.append(edited(rng, rng.choice(out[-3:]), rng.choice((0, 1, 2, 6))))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "width", "similarity"), [(1, 3, 85), (2, 5, 80), (3, 5, 80)])
def test_components_are_those_of_all_pairs(spark, seed, width, similarity):
    texts = corpus(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, links = N.near_duplicates(df, width, similarity)
    got = {r["id"]: r["component_id"] for r in rows.collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, width, similarity)
    s = sets_of(texts, width)
    for r in links.collect():
        assert 100 * len(s[r["a"]] & s[r["b"]]) >= similarity * len(s[r["a"]] | s[r["b"]])


@pytest.mark.parametrize("small", [{"REGION": 4, "BLOCK": 16, "ANCHORS": 2, "SIDE": 8}, {"BLOCK": 7, "ANCHORS": 0, "SIDE": 5, "COLUMNS": 3, "ELEMENTS": 900}])
def test_crowded_regions_and_large_families_stay_whole(spark, monkeypatch, small):
    for k, v in small.items():
        monkeypatch.setattr(N, k, v)
    rng = random.Random(5)
    base = " ".join(f"w{rng.randrange(4000)}" for _ in range(400))
    texts = [edited(rng, base, 2) for _ in range(90)] + [f"other {k} text of its own kind {k}" for k in range(10)] + corpus(7)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, _ = N.near_duplicates(df, 5, 80)
    got = {r["id"]: r["component_id"] for r in rows.collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, 5, 80)


def test_the_twin_agrees(spark):
    assert same(spark, N.op8_neardup, N.OP8_SQL) == 200


def test_signatures_estimate_likeness():
    rng = np.random.default_rng(3)
    for n in (20, 300, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 10 :], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)]))
        real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((N.signature(a) == N.signature(b)).mean() - real) < 0.13
        assert (N.signature(a) == N.signature(np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)))).mean() < 0.1


def test_components_of_links(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 50), (50, 70)], "a long, b long")
    got = {r["id"]: r["label"] for r in N.components(links).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys((50, 70, 100), 50)}


def test_rows_of_every_kind(spark, tmp_path):
    source = docs(spark)
    rows = N.op8_neardup(spark, write(spark, tmp_path / "a", documents=source)).collect()
    assert len(rows) == source.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[6][0]["component_id"] == by[7][0]["component_id"] == 6 and not by[7][0]["kept"]
    assert sorted(r["n_shingles"] for r in by[1]) == [0, 4] and {r["component_id"] for r in by[1]} == {1}
    assert by[2][0]["n_shingles"] == 0 and by[4][0]["n_shingles"] == 1 and by[5][0]["n_shingles"] == 1
    assert by[None][0]["component_id"] is None and by[None][0]["kept"]
    assert N.op8_neardup(spark, write(spark, tmp_path / "b", documents=empty(spark))).count() == 0


def of_a_template(seed, n, own, edits, pairs):
    """Texts that share most words of one template, and partners of the first of them."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(300)]
    out = []
    for k in range(n):
        w = list(base)
        w[: len(w) * own // 100] = [f"own{k}x{j}" for j in range(len(w) * own // 100)]
        out.append(" ".join(w))
    return out + [edited(rng, out[k], edits) for k in range(pairs)]


@pytest.mark.parametrize("small", [{}, {"REGION": 1, "BLOCK": 20, "ANCHORS": 3, "SIDE": 16}])
def test_pairs_at_the_threshold_in_a_family_below_it(spark, monkeypatch, small):
    for k, v in small.items():
        monkeypatch.setattr(N, k, v)
    texts = of_a_template(1, 100, 20, 8, 100)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, _ = N.near_duplicates(df, 3, 85)
    got = {r["id"]: r["component_id"] for r in rows.collect()}
    want = brute(texts, 3, 85)
    assert len(set(want)) == 100
    assert [got[k] for k in range(len(texts))] == want


def test_links_of_300_texts_of_one_template(spark):
    """Texts at about 0.81 of each other, and partners at 0.87 of some of them."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(400)]
    own = []
    for _ in range(150):
        w = list(base)
        for p in rng.sample(range(0, 398, 3), 7):
            w[p] = f"own{rng.randrange(10**9)}"
        own.append(" ".join(w))
    texts = own + [edited(rng, rng.choice(own), rng.choice((8, 9, 10, 11))) for _ in range(150)]
    want = brute(texts, 3, 85)
    assert 20 < len(set(want)) < 290
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in N.near_duplicates(df, 3, 85)[0].collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_counts_of_shared_members():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 90))) for _ in range(40)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    off = ~np.eye(40, dtype=bool)
    assert (N.shared_counts(sets) == want)[off].all() and (N.shared_counts(sets, 13) == want[:13, 13:]).all()
    alone = [np.array([k]) for k in range(3)]
    assert (N.shared_counts(alone)[~np.eye(3, dtype=bool)] == 0).all()


def test_a_forest_spans_all_likely_pairs():
    rng = np.random.default_rng(8)
    for _ in range(30):
        kinds = rng.integers(0, 1 << 16, (6, N.VALUES)).astype("<u2")
        sigs = kinds[rng.integers(0, 6, 40)]
        change = rng.random(sigs.shape) < rng.choice((0.05, 0.2, 0.3))
        sigs = np.where(change, rng.integers(0, 1 << 16, sigs.shape), sigs).astype("<u2")
        label = list(range(40))
        for i, j in N.forest(sigs, 0.6):
            assert (sigs[i] == sigs[j]).mean() >= 0.6
            assert label[i] != label[j]
            label = [label[i] if x == label[j] else x for x in label]
        likely = (sigs[:, None] == sigs[None]).mean(axis=2) >= 0.6
        assert all(label[i] == label[j] for i, j in zip(*np.nonzero(likely), strict=True))


def among_rivals(seed, n):
    """A text, its only partner (changed in eight places), and rivals that just fall short of both."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(300)]
    places = [10 + 20 * k for k in range(8)]
    partner = list(base)
    for p in places:
        partner[p] = f"new{p}"
    out = [" ".join(base), " ".join(partner)]
    for k in range(n):
        w = list(base)
        for p in rng.sample(places, 4):
            w[p] = f"new{p}"
        for p in rng.sample(range(180, 290, 5), 5):
            w[p] = f"rival{k}x{p}"
        out.append(" ".join(w))
    return out


def test_a_partner_behind_refused_rivals_is_found(spark):
    texts = among_rivals(9, 160)
    want = brute(texts, 3, 85)
    assert want[:2] == [0, 0] and want.count(0) == 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, _ = N.near_duplicates(df, 3, 85)
    got = {r["id"]: r["component_id"] for r in rows.collect()}
    assert [got[k] for k in range(len(texts))] == want
