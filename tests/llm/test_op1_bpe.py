import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from samples import SF, TEXTS, docs, empty

from thalweg.llm import bpe


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def coder():
    return bpe.load(bpe.vocabulary())


def test_odd_texts(library, coder):
    texts = [*TEXTS[1:], "It's we'll THEY'RE I'm aaaaaaaaaaaa", "é ẛ̣ ΣΑΣ ς İ ǅ ﬁ", "１２３ ४५ Ⅷ ½", "<|endoftext|><|startoftext|> x<|endoftext|>y", "퟿￿\U0010ffff", "abc" * 700]
    got = coder.encode_batch(texts)
    for t, ids in zip(texts, got, strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids == want, t[:50]
        assert coder.decode(ids) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=60), max_size=4))
def test_any_text(library, coder, texts):
    for t, ids in zip(texts, coder.encode_batch(texts), strict=True):
        assert ids == library.encode(t, add_special_tokens=False).ids


def test_a_small_memory_changes_nothing(library, coder, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    small = bpe.PairIndexBPE.__new__(bpe.PairIndexBPE)
    small.__dict__ |= coder.__dict__ | {"memory": {d: (bpe.Memory(), bpe.Memory()) for d in (True, False)}}
    texts = [f"river{k % 7} and%% {k} <|endoftext|> again river{k % 3}" for k in range(60)]
    for at in range(0, 60, 4):
        for t, (raw, said) in zip(texts[at : at + 4], small.coded(texts[at : at + 4]), strict=True):
            want = library.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(raw, "<u4").tolist() == want and said.decode() == library.decode(want, skip_special_tokens=False)
        assert small.encode_batch(texts[at : at + 4]) == coder.encode_batch(texts[at : at + 4])
        assert all(len(m.ids) < 40 for pair in small.memory.values() for m in pair)


def test_documents(spark, library):
    got = {(r["doc_id"], r["text"]): r for r in bpe.op1_bpe(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()}
    assert len(got) == 200
    for (_, text), r in got.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_rows_of_every_kind(spark):
    source = docs(spark)
    rows = bpe.encode(source, keep=("lang",)).collect()
    assert len(rows) == source.count() and rows[0]["ids"] == [] and rows[0]["decoded"] == ""
    assert rows[5]["ids"] == rows[6]["ids"] != []
    clash = bpe.encode(source.withColumn("_bpe_text", F.lit("clash")), keep=("text", "_bpe_text")).collect()
    assert [r["_bpe_text"] for r in clash] == ["clash"] * len(rows) and [r["ids"] for r in clash] == [r["ids"] for r in rows]
    assert bpe.encode(empty(spark)).count() == 0 and bpe.digest(empty(spark)).count() == 0
