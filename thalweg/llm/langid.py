"""Language identification by compression: the dictionary that makes a text smallest names it.

Each language has a zstandard raw-content dictionary of training text. A text is lower-cased,
stripped of ASCII signs and digits, and cut into chunks; each chunk is compressed with each
dictionary, and the sizes are summed over the whole text. The language with the smallest sum wins;
a narrow margin is a rejection. Training documents quote passages of other languages, so the sample
is split into halves and each half's lines are kept only if the other half's dictionaries agree.

Edge cases: a null text or one without a letter (of any script; numbers and signs that look like letters aren't)
is ``und`` with score 0, not accepted; equal sums go to the language with more training rows, then to
the smaller name, and aren't accepted; an empty training set makes every text ``und``; rows without an
id are never learned from and not held out; long texts are compressed and learned from as a whole; repeated
rows give repeated results; other columns pass through, whatever their names, but lang_pred, score and accepted are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thalweg.llm.common import held_out, slices, small_batches, spare, table

#: Bounds of the training sample, whose texts are whole: documents for a language, and documents in all, which
#: many languages share evenly (one each at least).
SAMPLE_DOCS, ALL_DOCS = 80, 40_000
#: Rounds of judging the sample's lines.
ROUNDS = 2
#: Bytes of one chunk. Each starts afresh, so that long texts still lean on the dictionary.
CHUNK = 6_000
#: Lower levels look for too few of the dictionary's short matches.
LEVEL = 9
#: Texts whose best size is within this share of the second best are rejected.
MARGIN = 0.01
_SIGNS = bytes(b for b in range(128) if not chr(b).isalpha() and chr(b) not in " \t\n\r\v\f")
_BLANKS = bytes.maketrans(b"\t\r\v\f", b"    ")
_LETTER = regex.compile(r"\p{L}")


def fit(docs: DataFrame, lang: str = "lang", key: str = "doc_id", text: str = "text") -> list[tuple[str, bytes]]:
    """(language, dictionary) by falling number of training rows.

    The sample is bounded (SAMPLE_DOCS, ALL_DOCS) and chosen by a hash of the id: first by a
    threshold that the language's row count sets, so that no window sees a whole hot language.
    """
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    table_ = sorted(rows.groupBy(lang).count().collect(), key=lambda r: (-r["count"], r[lang]))
    if not table_:
        return []
    most = max(1, min(SAMPLE_DOCS, ALL_DOCS // len(table_)))
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for r in table_ for x in (r[lang], min(1.0, (4.0 * most + 20) / r["count"]))])
    drawn = rows.select(F.col(lang).alias("lang"), F.col(key).alias("key"), draw.alias("draw"), F.col(text).alias("text")).filter(F.col("draw") < share[F.col("lang")])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "key", "text"))
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in drawn.withColumn("place", place).filter(F.col("place") <= most).collect():
        texts.setdefault(r["lang"], []).append((r["place"], r["text"]))
    found = {r[lang]: [[plain(x).strip() for x in p.split("\n")] for _, p in sorted(texts.get(r[lang], []))] for r in table_}
    once = {name: [[x for x in row if x] for row in rows] for name, rows in found.items()}
    return agreed({name: rows for name, rows in once.items() if any(rows)})


def plain(text: str) -> bytes:
    """Lower case, without ASCII signs and digits, which tell nothing of the language."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_BLANKS, _SIGNS)


def agreed(pieces: dict[str, list[list[bytes]]]) -> list[tuple[str, bytes]]:
    """A dictionary for each language of the lines on which both halves of the sample agree."""
    join = lambda rows: b"\n".join(x for row in rows for x in row)
    kept = pieces
    for _ in range(ROUNDS):
        judges = [Compressor([(name, join(rows[h::2])) for name, rows in kept.items()]) for h in (0, 1)]
        own = lambda at, k, x, j=judges: j[1 - k % 2].best(j[1 - k % 2].sizes(x))[0] == at
        kept = {name: [[x for x in row if own(at, k, x)] for k, row in enumerate(rows)] for at, (name, rows) in enumerate(pieces.items())}
        kept = {name: rows if any(rows) else pieces[name] for name, rows in kept.items()}
    return [(name, join(rows)) for name, rows in kept.items()]


class Compressor:
    def __init__(self, model: list[tuple[str, bytes]], level: int = LEVEL):
        self.names = [name for name, _ in model]
        self.coders = []
        for _, raw in model:
            d = zstandard.ZstdCompressionDict(raw.rjust(16), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def sizes(self, raw: bytes) -> list[int]:
        chunks = [raw[k : k + CHUNK] for k in range(0, len(raw), CHUNK)]
        return [sum(len(code(c)) for c in chunks) for code in self.coders]

    @staticmethod
    def best(sizes: list[int]) -> tuple[int, float]:
        """The place of the smallest size, the first of equal ones, and the relative gap to the next."""
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min((s for k, s in enumerate(sizes) if k != best), default=2 * sizes[best])
        return best, (second - sizes[best]) / second

    def predict(self, text: str | None, margin: float = MARGIN) -> tuple[str, float, bool]:
        if not text or not self.names or not _LETTER.search(text):
            return "und", 0.0, False
        best, gap = self.best(self.sizes(plain(text)))
        return self.names[best], gap / (gap + 0.02), gap >= margin


def classify(docs: DataFrame, model: list[tuple[str, bytes]], text: str = "text", margin: float = MARGIN, keep_text: bool = False) -> DataFrame:
    """Columns of ``docs``, plus lang_pred, score and accepted; nothing is shuffled. Texts come along
    only with ``keep_text``."""
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (() if keep_text else (text,)) and c not in ("lang_pred", "score", "accepted")]
    source = docs.select(*rest, F.col(text).alias(spare(docs, "text")))
    schema = docs.select(*rest).schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's constants

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Compressor(shared.value)
        for b in slices(batches):
            got = [coder.predict(t, margin) for t in b.column(b.num_columns - 1).to_pylist()]
            extra = [pa.array(list(x), kind) for x, kind in zip(zip(*got, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *extra], schema.names)

    return source.mapInArrow(run, schema)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learned from documents whose crc32 mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"), 3, 1)
    model = fit(docs.filter(~held))
    found = classify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")
