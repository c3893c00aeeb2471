"""BPE encoding and decoding by a pair occurrence index.

For the distinct pre-tokens of a batch, all symbols lie in one linked list; an index maps each
adjacent pair to all its positions. Active ranks are applied in ascending order, and each merge
updates only the lists of the two pairs beside it. Chunks between blanks are encoded and decoded once
and remembered, within a bound, so a repeated chunk costs two dictionary lookups.

Edge cases: a null text is empty; an empty text has no ids and decodes to the empty string;
lone surrogates can't occur in Spark strings; repeated rows give repeated results; other columns
of the input are left out of the result except those named in ``keep``.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thalweg.llm.common import slices, small_batches, spare, table

#: Chunks or pre-tokens of a generation of a worker's memory; it holds two.
CACHE_WORDS = 200_000
_BLANK = "\\t\\n\\v\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_BLANK}\p{{L}}\p{{N}}]+")


_ODD = regex.compile("[\x1c-\x1f]")
# Letters, numbers and lower-case forms of Unicode 16 and 17 that the vocabularies' library
# knows and this Python doesn't. What else this Python has no class for is neither, whatever the
# expressions' own tables say.
NEWER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEWER_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
NEWER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEWER_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


@lru_cache(maxsize=1 << 16)
def _proxy(c: str) -> str:
    """A character of the same class for one that this Python has no class for, else itself."""
    if unicodedata.category(c) != "Cn":
        return c
    if any(a <= ord(c) <= z for a, z in NEWER_LETTERS):
        return "é"
    return "²" if any(a <= ord(c) <= z for a, z in NEWER_NUMBERS) else "§"


def _chunks(text: str) -> list[str]:
    """The text cut at blanks; Python also cuts at four control characters that aren't blanks here."""
    return [text] if _ODD.search(text) else text.split()


def byte_letters() -> dict[int, str]:
    """The printable stand-in for each byte, as byte-level vocabularies use them."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    free = iter(range(0x100, 0x200))
    return out | {b: chr(next(free)) for b in range(256) if b not in out}


class Memory:
    """Codes of strings, as two tables: of ids as little-endian 32-bit numbers, and of decoded text. Of what two generations of CACHE_WORDS hold, what
    the last one asked for stays."""

    def __init__(self) -> None:
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, bytes] = {}
        self.old: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def missing(self, asked: Iterable[str]) -> list[str]:
        """Those of ``asked`` that must be learned; all others are in the tables from now on."""
        if len(self.ids) > CACHE_WORDS:
            self.old, self.ids, self.text = (self.ids, self.text), {}, {}
        ids, text, old, old_text = self.ids, self.text, *self.old
        out = []
        for w in set(asked).difference(ids):
            if w in old:
                ids[w] = old[w]
                if w in old_text:
                    text[w] = old_text[w]
            else:
                out.append(w)
        return out


class PairIndexBPE:
    """Encoder and decoder of one vocabulary file of the tokenizers library's format."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.token = {i: t for t, i in self.vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pairs = sorted((self.vocab[x] << 20 | self.vocab[y], r, self.vocab[x + y]) for r, (x, y) in enumerate(model["merges"]))
        self.pair_key, self.pair_rank = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        by_rank = sorted(pairs, key=lambda p: p[1])
        self.merge_of = [(key >> 20, key & 0xFFFFF, new) for key, _, new in by_rank]
        first: dict[int, int] = {}
        for key, r, _ in by_rank:
            for side in (key >> 20, key & 0xFFFFF):
                first.setdefault(side, r)
        #: Ranks whose product stands in a pair of a lower rank: one place of a word at a time.
        self.late = {r for r, (_, _, new) in enumerate(self.merge_of) if first.get(new, r) < r}
        letters = byte_letters()
        self.first_symbol = np.array([self.vocab[letters[b]] for b in range(256)], np.int32)
        self.last_symbol = np.array([self.vocab[letters[b] + self.suffix] for b in range(256)], np.int32)
        #: What is remembered of chunks and special tokens, and of pre-tokens: with decoded text and without.
        self.memory = {True: (Memory(), Memory()), False: (Memory(), Memory())}

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of one text without special tokens."""
        if text.isascii():
            return _PIECES.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if text.isprintable() or "".join(map(_proxy, text)) == text:  # what has no class isn't printable
            return _PIECES.findall(text)
        text = text.translate(NEWER_LOWER)
        return [text[m.start() : m.end()] for m in _PIECES.finditer("".join(map(_proxy, text)))]

    def rank_at(self, sym: np.ndarray, right: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places whose pair has a rank, and those ranks."""
        key = sym[places].astype(np.int64) << 20 | sym[right[places]]
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        hit = self.pair_key[at] == key
        return places[hit], self.pair_rank[at[hit]]

    def merge(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of distinct nonempty words by the pair occurrence index.

        ``where`` is the index: rank of a pair -> arrays of its positions. Position n stands for
        the edge of a word. Dead positions have symbol -1 and so match no pair.
        """
        if not words:
            return []
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(size)
        heads, n = ends - size, int(ends[-1])
        data = np.frombuffer(b"".join(raw), np.uint8)
        sym = np.empty(n + 1, np.int32)
        sym[:n] = self.first_symbol[data]
        sym[ends - 1] = self.last_symbol[data[ends - 1]]
        sym[n] = -1
        left, right = np.arange(-1, n, dtype=np.int64), np.arange(1, n + 2, dtype=np.int64)
        left[heads], right[ends - 1], right[n] = n, n, n
        where: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(places: np.ndarray) -> None:
            places, ranks = self.rank_at(sym, right, places)
            if not len(places):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            edge = np.flatnonzero(np.diff(ranks)) + 1
            cuts = [0, *edge.tolist(), len(places)]
            for k, r in enumerate(ranks[cuts[:-1]].tolist()):
                part = places[cuts[k] : cuts[k + 1]]
                if r in where:
                    where[r].append(part)
                else:
                    where[r] = [part]
                    heapq.heappush(active, r)

        every = np.arange(n)
        note(every[right[:n] < n])
        while active:
            r = heapq.heappop(active)
            a, b, new = self.merge_of[r]
            lists = where.pop(r)
            p = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            p = p[(sym[p] == a) & (sym[right[p]] == b)]
            if r in self.late and len(p) > 1:  # a merge may make a lower rank active: that goes first
                word = np.searchsorted(ends, p, side="right")
                once = np.concatenate([[True], word[1:] != word[:-1]])
                if not once.all():
                    where[r] = [p[~once]]
                    heapq.heappush(active, r)
                    p = p[once]
            elif a == b and len(p) > 1:  # of overlapping pairs the left one counts
                keep, last = [], -1
                for x, q in zip(p.tolist(), right[p].tolist(), strict=True):
                    if x != last:
                        keep.append(x)
                        last = q
                p = np.array(keep)
            if not len(p):
                continue
            q = right[p]
            after = right[q]
            sym[p], sym[q] = new, -1
            right[p] = after
            left[after] = p
            before = left[p]
            note(np.concatenate([p[after < n], before[before < n]]))
        alive = np.flatnonzero(sym[:n] >= 0)
        ids = sym[alive].tolist()
        cuts = np.searchsorted(alive, heads).tolist() + [len(ids)]
        return [tuple(ids[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]

    def learn(self, chunks: list[str], decoded: bool) -> None:
        """Remember what chunks are coded to; their new pre-tokens pass through the pair index together."""
        rows = [self.pieces(c) for c in chunks]
        known, words = self.memory[decoded]
        new = words.missing(chain.from_iterable(rows))
        for w, coded in zip(new, self.merge(new), strict=True):
            words.ids[w] = pack(f"<{len(coded)}I", *coded)
            if decoded:
                words.text[w] = self.decode(coded).encode("utf-8", "surrogatepass")
        ids, text = words.ids, words.text
        for c, row in zip(chunks, rows, strict=True):
            known.ids[c] = ids[row[0]] if len(row) == 1 else b"".join([ids[w] for w in row])
            if decoded:
                known.text[c] = text[row[0]] if len(row) == 1 else b" ".join([text[w] for w in row])

    def cut(self, text: str | None) -> list[str]:
        """A text as chunks and special tokens. No pre-token spans a blank, so texts are cut at blanks and each
        distinct chunk is encoded once; case and composition are settled per chunk, too."""
        text = text or ""
        if "<|" in text and self.cut_special.search(text):
            return [x for k, part in enumerate(self.cut_special.split(text)) for x in ([part] if k % 2 else _chunks(part))]
        return _chunks(text)

    def coded(self, texts: Iterable[str | None], decoded: bool = True) -> Iterator[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit numbers, decoded text in UTF-8) of each text; special tokens in a
        text count as such."""
        rows = [self.cut(t) for t in texts]
        chunks = self.memory[decoded][0]
        new = chunks.missing(chain.from_iterable(rows))
        for c in new:
            if c in self.special:
                chunks.ids[c], chunks.text[c] = pack("<I", self.special[c]), c.encode()
        self.learn([c for c in new if c not in self.special], decoded)
        ids, text = chunks.ids.__getitem__, chunks.text.__getitem__
        for row in rows:
            # a chunk without ids leaves no gap in the text
            yield b"".join(map(ids, row)), b" ".join(filter(None, map(text, row))) if decoded else b""

    def encode_batch(self, texts: Iterable[str | None]) -> list[list[int]]:
        """The ids of each text."""
        return [np.frombuffer(raw, "<u4").tolist() for raw, _ in self.coded(texts, False)]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: without a decoder in the file, tokens joined by one space."""
        return " ".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str) -> PairIndexBPE:
    with open(path, encoding="utf-8") as f:
        return PairIndexBPE(json.load(f))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary on this machine; every executor has the same package."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, keep: tuple[str, ...] = (), decoded: bool = True) -> DataFrame:
    """Columns key, ``keep``, ids array<int> and, if asked, decoded string; nothing is shuffled."""
    small_batches(docs.sparkSession)
    source = docs.select(key, *keep, F.col(text).alias(spare(docs, "text")))
    schema = docs.select(key, *keep).schema.add("ids", T.ArrayType(T.IntegerType()))
    if decoded:
        schema = schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path or vocabulary())
        for b in slices(batches, 4_000_000):
            got = list(model.coded(b.column(b.num_columns - 1).to_pylist(), decoded))
            offsets = np.zeros(len(got) + 1, np.int32)
            np.cumsum([len(x) // 4 for x, _ in got], out=offsets[1:])
            flat = np.frombuffer(b"".join([x for x, _ in got]), "<u4").astype(np.int32)
            made = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            if decoded:
                made.append(pa.array([x.decode() for _, x in got], pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], schema.names)

    return source.mapInArrow(run, schema)


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns key, ``keep``, n_tokens, ids_sha256, decoded_sha256: the same codes as ``encode``,
    hashed where they are made, so that ids and texts needn't travel."""
    small_batches(docs.sparkSession)
    source = docs.select(key, *keep, F.col(text).alias(spare(docs, "text")))
    schema = docs.select(key, *keep).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path or vocabulary())
        for b in slices(batches, 4_000_000):
            n, x, y = [], [], []
            for raw, said in model.coded(b.column(b.num_columns - 1).to_pylist()):
                n.append(len(raw) // 4)
                x.append(hashlib.sha256(raw).hexdigest())
                y.append(hashlib.sha256(said).hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64()), pa.array(x, pa.string()), pa.array(y, pa.string())], schema.names)

    return source.mapInArrow(run, schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return digest(table(spark, sf_dir, "documents"))
