"""Toxicity by class-conditional Kneser-Ney models.

Two models of toxic and two of ordinary labelled documents: one gives each word after the word before
it, one each letter of a word after up to four letters before it. Both are interpolated Kneser-Ney
models with an absolute discount: each order backs off to the continuation counts of the next shorter
one, down to single words or letters, whose own back-off is a distribution of continuation counts that the
classes share; so an expression that one class has hardly seen costs both alike. The comparison is the
difference of a text's length-normalised log-likelihoods, ``log_ratio``. It dilutes a few toxic
expressions in a long text, so the score also takes the largest differences over stretches of a few words,
of words alone and of their spelling, by a small logistic model, which is fitted on labelled documents that
the counts haven't seen.

Counts are gathered from all labelled training documents, keyed by (word, word) or by letters, and summed in
Spark; they grow with the documents. What a model needs for scoring goes to the executors whole: all that
was seen LEAST times in either class together. What was seen less often is in the back-off weight. Words are
32-bit hashes, of which two words in a million share one per 10,000 words known.

Edge cases: a null or empty text, or one without words, has the score of no evidence; a document
labelled twice is toxic if any label is 1; null labels are left out; with no training document of
one class every score is the other class's share; rows without an id are scored, never learned from and not
held out; very long texts count whole; repeated rows give repeated rows; other columns pass through, whatever
their names, but score and log_ratio are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thalweg.llm.common import cut, held_out, hits, id_bit, id_map, slices, small_batches, spare, table
from thalweg.llm.features import LETTER, WordIds, spellings

DISCOUNT = 0.75
#: Times that a word, a pair or a run of letters must have been seen to be in a model.
LEAST = 2
#: Raw and bare words that a worker remembers.
CACHE_WORDS = 400_000
#: Words that a task counts before it gives their sums, and bytes of texts that it scores at once.
PIECE, TAKEN = 2_000_000, 3_000_000
#: Stands before the first word.
START = 0xFFFFFFFF
#: Words of the stretches whose best mean counts.
STRETCHES = (2, 6, 20, 60)
#: Places, in falling order of toxicity, of the distinct words whose ratios count by themselves:
#: ordinary texts have a suspicious word here and there, toxic ones have several.
PLACES = (1, 2, 3, 5, 8)
#: One in so many labelled documents calibrates instead of counting; most documents used for that.
HOLD, MOST_CALIBRATION = 4, 6000
#: Documents with at least this score are called toxic.
THRESHOLD = 0.3
WIDTH = 3 + 3 * len(STRETCHES) + 2 * len(PLACES)


def counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n0, n1): how often each key stands in ordinary (0) and toxic (1) documents, over all of ``docs``
    (text, toxic). kind 0: a word and the one before it, 32 bits each; 1: a letter and the four before it. Pieces of
    about PIECE words are summed before they are dealt out."""
    small_batches(docs.sparkSession)

    def summed(pairs: list[np.ndarray], seen: Counter, toxic: int) -> Iterator[pa.RecordBatch]:
        words = list(seen)
        letters, which = spellings([WordIds.bare(w) for w in words])
        times = np.fromiter(seen.values(), np.int64, len(words))[which]
        own, at = np.unique(letters, return_inverse=True)
        for kind, (key, n) in enumerate((np.unique(np.concatenate(pairs), return_counts=True), (own, np.bincount(at, times, len(own)).astype(np.int64)))):
            none = np.zeros(len(key), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), *map(pa.array, (none, n) if toxic else (n, none))], ["kind", "key", "n0", "n1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        pairs, seen, held = ([], []), (Counter(), Counter()), [0, 0]
        for batch in slices(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = ids.of(text).astype(np.uint64)
                if len(w):
                    before = np.concatenate([[np.uint64(START)], w[:-1]])
                    pairs[toxic].append((before << np.uint64(32) | w).view(np.int64))
                    seen[toxic].update(text.encode("utf-8", "surrogatepass").split())
                    held[toxic] += len(w)
            for toxic in (0, 1):
                if held[toxic] > PIECE:
                    yield from summed(pairs[toxic], seen[toxic], toxic)
                    pairs[toxic].clear()
                    seen[toxic].clear()
                    held[toxic] = 0
        for toxic in (0, 1):
            if held[toxic]:
                yield from summed(pairs[toxic], seen[toxic], toxic)

    got = docs.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "kind int, key long, n0 long, n1 long")
    # dealt out by context, so that sums by context find their rows together in what is written
    shift = F.when(F.col("kind") == 0, F.shiftrightunsigned("key", 32)).otherwise(F.shiftright("key", LETTER))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = got.withColumn("context", shift).repartition(n, "kind", "context")
    return dealt.groupBy("kind", "context", "key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).drop("context")


def _gathered(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and their counts in both classes, of those that were seen LEAST times."""
    got = df.filter(f"n0 + n1 >= {LEAST}").select("key", F.col("n0").cast("float").alias("n0"), F.col("n1").cast("float").alias("n1")).toArrow()
    key = got.column("key").to_numpy()
    order = np.argsort(key)
    return key[order], np.stack([got.column(c).to_numpy()[order] for c in ("n0", "n1")])


class Keys:
    """A set of distinct numbers in which many are looked for at once: a table of places by their hash, with free places
    between; made in each process when it is first needed."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys

    def __len__(self) -> int:
        return len(self.keys)

    def __getstate__(self) -> dict:
        return {"keys": self.keys}

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        x = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ x >> np.uint64(32)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _make(self) -> None:
        self.bits = max(4, int(4 * len(self.keys)).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        left, slots = np.arange(len(self.keys), dtype=np.int32), self._slots(self.keys)
        while len(left):
            free = self.table[slots] < 0
            self.table[slots[free]] = left[free]
            over = self.table[slots] != left  # somebody else's place: the next one
            left, slots = left[over], (slots[over] + 1) & ((1 << self.bits) - 1)

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each asked number is among the keys (0 if nowhere), and whether it is there."""
        at, here = np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
        if not len(self.keys) or not len(asked):
            return at, here
        if not hasattr(self, "table"):
            self._make()
        left, slots = np.arange(len(asked)), self._slots(asked)
        while len(left):
            found = self.table[slots]
            hit = self.keys[found] == asked[left]
            hit &= found >= 0
            at[left[hit]], here[left[hit]] = found[hit], True
            on = ~hit & (found >= 0)
            left, slots = left[on], (slots[on] + 1) & ((1 << self.bits) - 1)
        return at, here


class Level:
    """One order of both classes: what follows a context, backing off to a shorter one."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, contexts: np.ndarray, total: np.ndarray, shift: int):
        self.keys, self.n, self.contexts, self.total = Keys(keys), n, Keys(contexts), total
        at, here = self.contexts.find(self.context(keys, shift))
        assert here.all()  # a key that is kept was seen as often as its context at least
        self.shift, self.at = shift, at.astype(np.int32)
        own = np.stack([np.bincount(at, np.maximum(x - DISCOUNT, 0), len(contexts)) for x in n])
        with np.errstate(divide="ignore", invalid="ignore"):
            self.left = np.where(total > 0, 1 - own / total, 1).astype(np.float32)

    @staticmethod
    def context(key: np.ndarray, shift: int) -> np.ndarray:
        return key.view(np.uint64) >> np.uint64(shift) if shift == 32 else key >> shift

    def weights(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how often each context was seen, the weight of its back-off), each for both classes."""
        at, here = self.contexts.find(context)
        if not len(self.contexts):
            return np.zeros((2, len(context)), np.float32), np.ones((2, len(context)), np.float32)
        return np.where(here, self.total[:, at], 0), np.where(here, self.left[:, at], 1)

    def over(self, key: np.ndarray, seen: np.ndarray, left: np.ndarray, back: np.ndarray) -> np.ndarray:
        """The chances of keys whose contexts have these weights, ``back`` being those of the shorter context."""
        at, here = self.keys.find(key)
        n = np.where(here, self.n[:, at], 0) if len(self.keys) else np.zeros_like(back)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(seen > 0, np.maximum(n - DISCOUNT, 0) / seen + left * back, back)


    def after(self, key: np.ndarray, back: np.ndarray) -> np.ndarray:
        """As ``over``; the contexts of known keys needn't be looked for."""
        at, here = self.keys.find(key)
        if not len(self.keys):
            return back
        where = self.at[at]
        miss = np.flatnonzero(~here)
        place, there = self.contexts.find(self.context(key[miss], self.shift))
        where[miss] = place
        seen, left, n = self.total[:, where], self.left[:, where], np.where(here, self.n[:, at], 0)
        seen[:, miss[~there]] = 0
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(seen > 0, np.maximum(n - DISCOUNT, 0) / seen + left * back, back)


class Base:
    """Single words or letters of both classes by continuation counts, backing off to what the classes share."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, total: np.ndarray, kinds: int):
        self.keys = Keys(keys)
        every = np.maximum(total, 1)[:, None]
        shared = (n.sum(0) + 0.5) / (total.sum() + 0.5 * (kinds + 1))
        unknown = 0.5 / (total.sum() + 0.5 * (kinds + 1))
        own = np.maximum(n - DISCOUNT, 0) / every
        left = 1 - own.sum(1, keepdims=True)
        self.p = np.concatenate([own + left * shared, left * unknown], axis=1)

    def of(self, keys: np.ndarray) -> np.ndarray:
        at, here = self.keys.find(keys)
        return self.p[:, np.where(here, at, len(self.keys.keys))]


def level(counted: DataFrame, shift: int) -> Level:
    """``counted``: key, n0, n1; the bits of a key above ``shift`` are its context."""
    contexts = counted.groupBy(F.shiftrightunsigned("key", shift).alias("key")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    keys, n = _gathered(counted)
    return Level(keys, n, *(x.astype(np.uint64) if x.ndim == 1 and shift == 32 else x for x in _gathered(contexts)), shift)


def continuations(counted: DataFrame, bits: int) -> DataFrame:
    """(key, n0, n1): after how many distinct contexts the last ``bits`` bits of the keys stand in each class."""
    return counted.groupBy(F.col("key").bitwiseAND(F.lit((1 << bits) - 1)).alias("key")).agg(F.count_if(F.col("n0") > 0).alias("n0"), F.count_if(F.col("n1") > 0).alias("n1"))


def base(counted: DataFrame) -> Base:
    """``counted``: key, n0, n1 of single words or letters."""
    n0, n1, kinds = counted.agg(F.coalesce(F.sum("n0"), F.lit(0)), F.coalesce(F.sum("n1"), F.lit(0)), F.count(F.lit(1))).first()
    return Base(*_gathered(counted), np.array([n0, n1], float), kinds)


class Models:
    """The models of words and of letters; letters from the longest context to the shortest."""

    def __init__(self, words: Level, word: Base, letters: list[Level], letter: Base):
        self.words, self.word, self.letters, self.letter = words, word, letters, letter

    def spelt(self, keys: np.ndarray) -> np.ndarray:
        """The log ratio of each letter."""
        keys, every = np.unique(keys, return_inverse=True)  # words share most of their letters
        p = self.letter.of(keys & ((1 << LETTER) - 1))
        for order, one in reversed(list(enumerate(self.letters))):
            key = keys & ((1 << LETTER * (5 - order)) - 1)
            p = one.after(key, p)
        p = np.log(np.maximum(p, 1e-12))
        return (p[1] - p[0])[every]


def models_of(counted: DataFrame) -> Models:
    """``counted``: as counts gives it, in a table."""
    words, letters = counted.filter("kind = 0").drop("kind"), counted.filter("kind = 1").drop("kind")
    levels = []
    for k in range(4, 0, -1):
        levels.append(level(letters, LETTER))
        letters = continuations(letters, LETTER * k)
    return Models(level(words, 32), base(continuations(words, 32)), levels, base(letters))


class Evidence:
    """What the models say of texts. Words are remembered within a bound: raw ones by their bare form, bare ones with
    all that doesn't depend on the word before."""

    def __init__(self, models: Models):
        self.models = models
        self.forget()

    @classmethod
    def of_worker(cls, models: Models) -> Evidence:
        """That of the models' copy in this process: tasks of a worker share what they remember."""
        if not hasattr(models, "evidence"):
            models.evidence = cls(models)
        return models.evidence

    def forget(self) -> None:
        self.raw: dict[bytes, int] = {}
        self.bare: dict[bytes, int] = {}
        size = 1 << 12
        self.id, (self.p, self.seen, self.left) = np.zeros(size, np.uint64), np.zeros((3, 2, size), np.float32)
        self.alone, self.spelt = np.zeros((2, size), np.float32)
        self.add([b"\xffstart"], [""], np.array([START], np.uint64))

    def add(self, names: list[bytes], bare: list[str], ids: np.ndarray) -> None:
        at, n = len(self.bare), len(names)
        while at + n > len(self.id):
            grow = lambda x: np.concatenate([x, np.zeros_like(x)], axis=-1)
            self.id, self.p, self.seen, self.left, self.alone, self.spelt = map(grow, (self.id, self.p, self.seen, self.left, self.alone, self.spelt))
        here = slice(at, at + n)
        self.id[here] = ids
        self.p[:, here] = self.models.word.of(ids.astype(np.int64))
        self.seen[:, here], self.left[:, here] = self.models.words.weights(ids)
        self.alone[here] = np.log(self.p[1, here] / self.p[0, here])
        keys, which = spellings(bare)
        self.spelt[here] = np.bincount(which, self.models.spelt(keys), n)
        self.bare.update(zip(names, range(at, at + n), strict=True))

    def learn(self, words: list[bytes]) -> None:
        # ASCII letters need no trimming and no decoding
        named = {w: w.lower() if w.isalpha() else WordIds.bare(w).encode() or b"\xff" + w[:3] for w in words}
        known = self.bare
        new = {x: w for w, x in named.items() if x not in known}
        if new:
            bare = ["" if x[0] == 0xFF else x.decode() for x in new]
            ids = np.array([WordIds.id_of(w, b) for w, b in zip(new.values(), bare, strict=True)], np.uint64)
            self.add(list(new), bare, ids)
        self.raw.update((w, known[x]) for w, x in named.items())

    def of(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text: mean log ratio over the text and its largest mean over stretches of words, of words
        after words, of words alone and of their spelling; then the ratios of the most toxic words."""
        rows = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
        out = np.zeros((len(texts), WIDTH))
        some = [k for k, r in enumerate(rows) if r]
        if not some:
            return out
        if len(self.bare) > CACHE_WORDS:
            self.forget()
        elif len(self.raw) > CACHE_WORDS:
            self.raw = {}
        if new := list(set(chain.from_iterable(rows)).difference(self.raw)):
            self.learn(new)
        size = np.array([len(rows[k]) for k in some])
        ends = np.cumsum(size)
        starts = ends - size
        get = self.raw.__getitem__
        k = np.fromiter(map(get, chain.from_iterable(rows)), np.int64, int(ends[-1]))
        before = np.concatenate([[0], k[:-1]])
        before[starts] = 0
        key = (self.id[before] << np.uint64(32) | self.id[k]).view(np.int64)
        p = np.log(np.maximum(self.models.words.over(key, self.seen[:, before], self.left[:, before], self.p[:, k]), 1e-12))
        doc = np.repeat(np.arange(len(some)), size)
        values = (p[1] - p[0], self.alone[k], self.spelt[k])
        columns = [np.add.reduceat(x, starts, dtype=np.float64) / size for x in values]
        for x in values:
            sums = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
            total = sums[ends] - sums[starts]
            for s in STRETCHES:
                means = np.full(len(x), -np.inf)
                if len(x) >= s:
                    means[: len(x) - s + 1] = np.where(doc[s - 1 :] == doc[: len(x) - s + 1], sums[s:] - sums[:-s], -np.inf)
                best = np.maximum.reduceat(means, starts)
                columns.append(np.where(size >= s, best, total) / s)
        distinct = np.unique(doc << 32 | k)
        whose, word = distinct >> 32, distinct & 0xFFFFFFFF
        first = np.searchsorted(whose, np.arange(len(some)))
        many = np.diff(np.append(first, len(whose)))
        for x in (self.alone[word], self.spelt[word]):
            ranked = x[np.lexsort((-x, whose))]
            last = ranked[first + np.minimum(many, PLACES[-1]) - 1]
            for place in PLACES:
                columns.append(np.where(many >= place, ranked[first + np.minimum(place, many) - 1], np.minimum(last, 0.0)))
        out[some] = np.stack(columns, axis=1)
        return out


def labelled(docs: DataFrame, marks: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, toxic) of the documents that have a mark. Texts of others aren't dealt out: a map of the ids, of fixed
    size, goes to the texts."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(id_map(marks.select(F.col(key).alias("id"))))
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), id_bit(key).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(hits(shared.value, b.column(2)))).select([0, 1])

    asked = rows.mapInArrow(run, rows.drop("at").schema)
    return asked.join(marks.select(F.col(key).alias("_key"), "toxic").hint("shuffle_hash"), F.col("key") == F.col("_key")).select("key", "text", "toxic")


def fit(docs: DataFrame, marks: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[Broadcast, np.ndarray]:
    """Models, as they were sent to the executors, and the weights of the logistic model. ``docs``: key, text;
    ``marks``: key, toxic, one row a key."""
    held = cut(labelled(docs, marks, key, text), "labelled")
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("key")), F.lit(HOLD))
    luck = F.pmod(F.xxhash64(F.lit("calibration"), F.col("key")), F.lit(1 << 30))
    rate = min(1.0, MOST_CALIBRATION / max(held.filter(draw == 0).count(), 1))
    shared = docs.sparkSession.sparkContext.broadcast(models_of(cut(counts(held.filter(draw != 0)), "toxic-counts")))
    some = held.filter((draw == 0) & (luck < int((1 << 30) * rate)))
    rows = evidence(some.select("toxic", "text"), shared).toArrow().to_pandas()
    if not len(rows) or rows["toxic"].nunique() < 2:
        share = marks.agg(F.avg("toxic")).first()[0] or 0.0
        return shared, np.array([np.log((share + 1e-3) / (1 - share + 1e-3)), *[0.0] * WIDTH])
    return shared, logistic(np.array(rows["evidence"].tolist()), rows["toxic"].to_numpy(float))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (first: the constant) of a ridge logistic regression by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w, keep = np.zeros(z.shape[1]), np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + keep, z.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    own = w[1:] / scale
    return np.concatenate([[w[0] - own @ mean], own])


def evidence(docs: DataFrame, shared, text: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """Columns of ``docs`` but the text, plus evidence array<double>; with weights, score and log_ratio instead."""
    small_batches(docs.sparkSession)
    made = ("evidence",) if weights is None else ("score", "log_ratio")
    rest = [c for c in docs.columns if c not in (text, *made)]
    source = docs.select(*rest, F.col(text).alias(spare(docs, "text")))
    schema = docs.select(*rest).schema
    for c in made:
        schema = schema.add(c, T.ArrayType(T.DoubleType()) if weights is None else T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = Evidence.of_worker(shared.value)
        for b in slices(batches, TAKEN):
            got = models.of(b.column(b.num_columns - 1).to_pylist())
            if weights is None:
                new = [pa.array(got.tolist(), pa.list_(pa.float64()))]
            else:
                new = [pa.array(1 / (1 + np.exp(-np.clip(weights[0] + got @ weights[1:], -500, 500)))), pa.array(got[:, 0])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], schema.names)

    return source.mapInArrow(run, schema)


def score(docs: DataFrame, model: tuple[Broadcast | Models, np.ndarray], text: str = "text") -> DataFrame:
    """Columns of ``docs`` but the text, plus score (0 to 1) and log_ratio, the difference of the length-normalised
    log-likelihoods; nothing is shuffled."""
    models, w = model
    return evidence(docs, docs.sparkSession.sparkContext.broadcast(models) if isinstance(models, Models) else models, text, w)


def marks_of(labels: DataFrame, mark: str = "toxic") -> DataFrame:
    """doc_id and label, one row a document: the largest label, nulls left out."""
    return labels.groupBy("doc_id").agg(F.max(mark).alias(mark)).filter(F.col(mark).isNotNull() & F.col("doc_id").isNotNull())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labelled ones whose crc32 mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"), 4, 2)
    model = fit(docs.filter(~held), marks_of(table(spark, sf_dir, "labels").filter(~held)))
    got = score(docs.select("doc_id", "text"), model)
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "log_ratio")
