import zlib

import xxhash
import zstandard
from pyspark.sql import functions as F
from samples import SF, docs, empty, write

from thalweg.llm import langid as L


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = L.op10_language(spark, sf).collect()
    assert len(rows) == len(texts)
    held = [(texts[r["doc_id"]]["lang"], r["lang_pred"]) for r in rows if r["held_out"] and texts[r["doc_id"]]["lang"] and r["lang_pred"] != "und"]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        text = texts[r["doc_id"]]["text"]
        assert (r["lang_pred"] == "und") == (not text or not any(c.isalpha() for c in text))


def draw(key):
    """xxhash64 of a word and a long, as Spark chains them."""
    h = xxhash.xxh64_intdigest(b"langid", 42)
    h = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), h)
    return (h - (1 << 64) if h >> 63 else h) % (1 << 30)


def brute(rows, hold=True):
    """The whole query by plain loops: {id: (held out, language, score, accepted)}."""
    held = {d: hold and zlib.crc32(str(d).encode()) % 3 == 1 for d, _, _ in rows}
    seen = [r for r in rows if not held[r[0]] and r[1] is not None and r[2] is not None]
    names = sorted({r[2] for r in seen}, key=lambda x: (-sum(r[2] == x for r in seen), x))
    sample = {x: [t for _, _, t in sorted((draw(d), d, t) for d, t, lang in seen if lang == x)[: L.SAMPLE_DOCS]] for x in names}
    lines = {x: [[y for y in (L.plain(z).strip() for z in t.split("\n")) if y] for t in texts] for x, texts in sample.items()}
    coders = []
    for name, raw in L.agreed({x: v for x, v in lines.items() if any(v)}):
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        coders.append((name, zstandard.ZstdCompressor(level=L.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)))
    out = {}
    for d, t, _ in rows:
        if not t or not any(c.isalpha() for c in t):
            out[d] = (held[d], "und", 0.0, False)
            continue
        raw = L.plain(t)
        sizes = [sum(len(c.compress(raw[k : k + L.CHUNK])) for k in range(0, len(raw), L.CHUNK)) for _, c in coders]
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        gap = (sizes[order[1]] - sizes[order[0]]) / sizes[order[1]]
        out[d] = (held[d], coders[order[0]][0], gap / (gap + 0.02), gap >= L.MARGIN)
    return out


def test_the_whole_query_against_loops(spark):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(rows)
    got = {r["doc_id"]: (r["held_out"], r["lang_pred"], r["score"], r["accepted"]) for r in L.op10_language(spark, SF).collect()}
    assert got == want


def test_what_stands_late_in_a_text_is_learned(spark):
    rows = [(k, ("filler words of no kind " * 200 + f"zebra quagga okapi {k}") if k % 2 else "plain old text of other words " * 20, ("late", "other")[k % 2 == 0]) for k in range(40)]
    model = dict(L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert b"okapi" in model["late"] and len(model["late"]) > 4000 * 20


def test_letters_are_letters():
    coder = L.Compressor([("a", b"some words " * 20), ("b", b"andere worte " * 20)])
    for text in ("²", "½ Ⅷ ①", "123 ⅓", "_", "。", "ⓐ"):
        assert coder.predict(text)[0] == "und"
    for text in ("ª x", "中", "ǅ", "é"):
        assert coder.predict(text)[0] != "und"


def test_sizes_are_those_of_one_compression_a_language():
    model = [("a", b"the cat sat on the mat " * 40), ("b", b"der hund lag auf der matte " * 40)]
    coder = L.Compressor(model)
    raw = L.plain("The cat lay on the mat")
    want = []
    for _, words in model:
        d = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        c = zstandard.ZstdCompressor(level=L.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
        want.append(len(c.compress(raw)))
    assert coder.sizes(raw) == want
    assert coder.predict("The cat lay on the mat")[0] == "a" and coder.predict("Der Hund lag auf der Matte")[0] == "b"
    assert coder.sizes(raw * 1000)[0] > 0
    assert coder.predict(None) == coder.predict("") == coder.predict("123 !") == ("und", 0.0, False)
    assert L.Compressor([]).predict("text") == ("und", 0.0, False)
    assert not L.Compressor([("a", b"x" * 50), ("b", b"x" * 50)]).predict("some words")[2]


def test_mislabelled_lines_leave_the_dictionaries():
    en, de = [f"the cat sat on the mat number {k}".encode() for k in range(40)], [f"der hund lag auf der matte nummer {k}".encode() for k in range(40)]
    pieces = {"en": [[x] for x in en] + [[de[0]]], "de": [[x] for x in de]}  # a line that one half of the sample holds
    model = dict(L.agreed(pieces))
    assert b"matte" not in model["en"] and b"mat" in model["en"]


def test_rows_of_every_kind(spark, tmp_path):
    source = docs(spark)
    rows = L.op10_language(spark, write(spark, tmp_path / "a", documents=source)).collect()
    assert len(rows) == source.count()
    kinds = {r["doc_id"]: r["lang_pred"] for r in rows if r["doc_id"] not in (1, None)}
    assert kinds[2] == kinds[3] == kinds[9] == "und" and kinds[6] == kinds[7] in ("en", "de")
    assert L.op10_language(spark, write(spark, tmp_path / "b", documents=empty(spark))).count() == 0
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    clash = source.withColumn("_lang_text", F.lit("clash")).withColumn("accepted", F.lit("clash"))
    got = L.classify(clash, [], keep_text=True)
    assert set(got.columns) == {*clash.columns, "lang_pred"} and {r["_lang_text"] for r in got.collect()} == {"clash"}
    assert {r["lang_pred"] for r in L.classify(source, []).collect()} == {"und"}
    assert SF
