import hashlib
import re

import corpus_pipeline as P
import pytest
from samples import SF, docs, empty, words
from test_op10_language import brute as languages
from test_op2_mixing import shares
from test_op5_secrets import SECRETS, spans
from test_op8_neardup import brute
from tokenizers import Tokenizer

from thalweg.llm import bpe
from thalweg.llm.common import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after each stage over the smallest table."""
    df, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(df)
    for name, f in P.STAGES:
        df = cut(f(spark, df, SF), f"test-{name}")
        out.append(df)
    return out


def test_columns_and_names(stages):
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "secrets", "mixing", "tokens"]
    for df in stages[:-1]:
        assert df.columns == COLUMNS


def test_language_keeps_what_is_beyond_doubt(stages):
    before, after = ({r["doc_id"]: r for r in x.collect()} for x in stages[:2])
    assert all(after[k]["text"] == before[k]["text"] and after[k]["lang"] for k in after)
    assert len(after) > 0.9 * len(before)
    assert not any(r["text"] is None or not re.search(r"[^\W\d_]", r["text"]) for r in after.values())
    known = [(before[k]["lang"], after[k]["lang"]) for k in after if before[k]["lang"]]
    assert sum(a == b for a, b in known) / len(known) > 0.95


def test_one_document_of_each_group_stays(stages):
    before = sorted(((r["doc_id"], r["text"]) for r in stages[1].collect()))
    low = brute([t for _, t in before], 5, 80)
    want = {before[k][0] for k in range(len(before)) if low[k] == k}
    assert {r["doc_id"] for r in stages[2].collect()} == want
    assert stages[2].count() == len(want) < len(before)


def test_secrets_are_gone(spark, stages):
    """After the pipeline's own stage, whose input holds no secret at this scale, and over a larger table."""
    larger = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for source, got in ((stages[2], stages[3]), (larger, P.secrets(spark, larger, SF))):
        before = {r["doc_id"]: r["text"] for r in source.collect()}
        after = {r["doc_id"]: r for r in got.collect()}
        assert after.keys() == before.keys()
        for k, r in after.items():
            found = spans(before[k])
            if not found:
                assert r["text"] == before[k]
                continue
            assert "[secret]" in r["text"]
            assert not any(before[k][x:y] in r["text"] for x, _, y, _ in found)
            assert r["n_chars"] == len(r["text"])
    assert sum(bool(spans(t)) for t in before.values()) >= 10


def test_the_mix_and_its_tokens(stages):
    size = {r["doc_id"]: (r["source"], len(words(r["text"])), r["text"]) for r in stages[3].collect()}
    taken, by = {}, {}
    for r in stages[4].collect():
        n = len(words(r["text"]))
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + n
        by[r["source"]] = by.get(r["source"], 0) + n
        assert r["text"] == size[r["doc_id"]][2] or r["text"] in size[r["doc_id"]][2]
    assert all(n <= 3 * size[k][1] for k, n in taken.items())
    totals: dict = {}
    for s, n, _ in size.values():
        totals[s] = totals.get(s, 0) + n
    want = shares(totals)
    assert all(abs(by.get(s, 0) - want[s]) <= 1 for s in want)
    coder = bpe.load(bpe.vocabulary())
    rows, tokens = stages[4].collect(), stages[5].collect()
    assert sorted((r["doc_id"], tuple(coder.encode_batch([r["text"]])[0])) for r in rows) == sorted((r["doc_id"], tuple(r["ids"])) for r in tokens)
    assert all(r["n_tokens"] == len(r["ids"]) for r in tokens)


def test_run_gives_the_last_stage(spark, stages):
    key = lambda df: sorted((r["doc_id"], tuple(r["ids"])) for r in df.collect())
    assert key(P.run(spark, SF)) == key(stages[-1])


def redacted(text):
    out, at = [], 0
    for start, _, end, _ in spans(text):
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def mixed(rows):
    """(id, text, source) of each row that the mix takes in each round, from plain streams of words."""
    sources: dict = {}
    for d, text, source in rows:
        sources.setdefault(source, []).append((d, text, len(words(text))))
    target = shares({s: sum(n for _, _, n in x) for s, x in sources.items()})
    out = []
    for source, docs_ in sources.items():
        order = sorted(docs_, key=lambda x: (hashlib.md5(f"7:{x[0]}:{x[2]}".encode()).hexdigest(), x[0], x[2]))
        left = int(target[source] + 1e-6)
        while left and any(n for _, _, n in order):
            for d, text, n in order:
                n = min(n, left)
                if n:
                    ends = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
                    starts = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
                    out.append((d, text if n == len(ends) else text[starts[0] : ends[n - 1]], source))
                left -= n
    return out


def test_the_whole_pipeline_against_loops(spark):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    told = languages([r[:3] for r in rows], hold=False)
    kept = sorted((d, t, told[d][1], s) for d, t, _, s in rows if told[d][3])
    low = brute([t for _, t, _, _ in kept], 5, 80)
    clean = [(d, redacted(t), lang, s) for k, (d, t, lang, s) in enumerate(kept) if low[k] == k]
    lang = {d: x for d, _, x, _ in clean}
    library = Tokenizer.from_file(bpe.vocabulary())
    library.no_truncation()
    library.no_padding()
    want = [(d, lang[d], s, tuple(library.encode(t, add_special_tokens=False).ids)) for d, t, s in mixed([(d, t, s) for d, t, _, s in clean])]
    got = [(r["doc_id"], r["lang"], r["source"], tuple(r["ids"])) for r in P.run(spark, SF).collect()]
    assert len(want) > 100
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES], ids=[n for n, _ in P.STAGES])
def test_each_stage_bears_rows_of_every_kind(spark, stage):
    source = docs(spark)
    got = stage(spark, source, SF)
    if stage is not P.tokens:
        assert got.columns == COLUMNS
    assert got.count() >= 1
    assert stage(spark, empty(spark), SF).count() == 0
    if stage is P.near_duplicates:
        assert {r["doc_id"] for r in got.collect()} == {k for k in range(1, 12) if k != 7} | {None}
    if stage is P.secrets:
        assert stage(spark, docs(spark, SECRETS), SF).filter("text like '%[secret]%'").count() >= 6
