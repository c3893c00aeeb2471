import hashlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F
from samples import SF, docs, empty, words, write

from thalweg.llm import imatch as I


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def term(word: str) -> int:
    return signed(xxhash.xxh64_intdigest(word.encode(), 42))


def folded(values, *more) -> int:
    """The hash of a list of longs and then of two ints, each seeded with the one before."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest((v & (1 << 64) - 1).to_bytes(8, "little"), h)
    for v in more:
        h = xxhash.xxh64_intdigest(v.to_bytes(4, "little"), h)
    return signed(h)


def slots(text: str, lexicon: set) -> list:
    own = {term(w) for w in words(text.lower())}
    kept = sorted(own & lexicon) or sorted(own)
    out = []
    for level, cover in enumerate(I.COVER):
        parts = I.SUBSETS // I.SPLIT
        for s in (g + parts * j for g in range(parts) for j in range(I.SPLIT)):
            some = [t for t in kept if (t >> 20) % cover == s]
            out.append(folded(some, level, I.SEED) & 0x7FFFFFFF if some else None)
    return out


def brute(rows):
    """Fingerprints and edits of (id, text) rows with distinct ids."""
    rows = sorted((i, t or "") for i, t in rows)
    seen = Counter(t for _, x in rows for t in {term(w) for w in words(x.lower())})
    n = len(rows)
    lexicon = {t for t, k in seen.items() if max(2, I.LOW * n) <= k <= max(2, I.HIGH * n)}
    out = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % n][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        out[i] = (len(t), edited, slots(t, lexicon), slots(edited, lexicon), slots(after, lexicon))
    return out


def like(a, b) -> float:
    if all(x is None for x in (*a, *b)):
        return 1.0
    best = 0.0
    for level in range(len(I.COVER)):
        at = level * I.SUBSETS
        pairs = [(x, y) for x, y in zip(a[at : at + I.SUBSETS], b[at : at + I.SUBSETS], strict=True) if x is not None or y is not None]
        if not level or len(pairs) >= I.SUBSETS * I.FILLED:
            best = sum(x == y for x, y in pairs) / len(pairs) if pairs else 0.0
    return best


def text_of(s) -> str:
    return "-".join("" if x is None else f"{x:08X}" for x in s)


def test_the_query_over_all_documents(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want, rows = brute(texts), I.op7_imatch(spark, SF).collect()
    assert len(rows) == len(want)
    for r in rows:
        n, edited, own, other, after = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (text_of(own), text_of(other))
        assert abs(r["near_edited"] - like(own, other)) < 1e-9 and abs(r["near_next"] - like(own, after)) < 1e-9


def test_edits_are_nearer_than_strangers(spark):
    got = I.op7_imatch(spark, "/root/testdata/sf0.01").filter("n_chars > 400").agg(F.avg((F.col("near_edited") > F.col("near_next")).cast("int")), F.avg("near_edited"), F.avg("near_next")).first()
    assert got[0] > 0.9 and got[1] > got[2] + 0.2


def test_likeness_follows_the_shared_terms(spark):
    """No neighbour that shares few of the terms looks like a copy, and no edit like a stranger."""
    docs_ = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    order = sorted(docs_)
    terms = {k: {w for w in words(t.lower())} for k, t in docs_.items()}
    rows = I.op7_imatch(spark, "/root/testdata/sf0.01").collect()
    for r in rows:
        k = r["doc_id"]
        near = terms[order[(order.index(k) + 1) % len(order)]]
        if len(terms[k]) >= 20 and len(near) >= 20 and len(terms[k] & near) < 0.1 * len(terms[k] | near):
            assert r["near_next"] < 0.5
    edits = [r["near_edited"] for r in rows if len(terms[r["doc_id"]]) >= 40]
    assert sum(x > 0.3 for x in edits) > 0.9 * len(edits)


def test_membership_is_exact(spark):
    found = [k * 32768 + j for k in range(-5, 40, 3) for j in (0, 1, 777, 32767)]
    df = spark.createDataFrame([(t,) for f in found for t in (f, f + 1, f + 32768, -f)], "t long")
    for some in (found, [], found[:1], [0], [7 << 40, 7 << 41, 0, 1, 2]):
        assert all(r["hit"] == (r["t"] in set(some)) for r in df.select("t", I.held_by(some)(F.col("t")).alias("hit")).collect())


def test_two_places_hold_all_numbers_or_none():
    import random

    rng = random.Random(3)
    found = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(5000)]
    table = I.two_places(found, 1 << 14)
    assert sorted(t for t in table if t is not None) == sorted(found)
    assert all(t is None or k in (t & 16383, t >> 31 & 16383) for k, t in enumerate(table))
    assert I.two_places(found, 1 << 12) is None
