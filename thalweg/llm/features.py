"""Words of texts as numbers, many at a time: the shared front of the word-based classifiers."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Words remembered by a worker; emptied when full.
CACHE_WORDS = 600_000
_TRIM = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class WordIds:
    """Stable 32-bit ids of words: lower case, ASCII signs trimmed from both ends.

    A word of signs alone has the id of its first three signs, so that runs of signs stay visible.
    """

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def new(self, word: bytes) -> int:
        return self.id_of(word, self.bare(word))

    @staticmethod
    def id_of(word: bytes, bare: str) -> int:
        return xxhash.xxh32_intdigest(bare.encode() or word[:3])

    @staticmethod
    def bare(word: bytes) -> str:
        return word.strip(_TRIM).decode("utf-8", "replace").lower()

    def of(self, text: str | None) -> np.ndarray:
        """uint32 ids of the words of a text, in order."""
        words = text.encode("utf-8", "surrogatepass").split() if text else []
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
        except KeyError:
            for w in set(words):
                if w not in known:
                    known[w] = self.new(w)
            return np.fromiter(map(known.__getitem__, words), np.uint32, len(words))


#: Bits of a letter in a key of letters: a code point modulo 4095, from 1; 0 stands before a word.
LETTER = 12


def spellings(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(key, which word) for each letter of the words and each word's end. A key holds the four letters before, the
    nearest lowest, and the letter itself, LETTER bits each."""
    marked = [f"{w}\x03" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) % ((1 << LETTER) - 1) + 1
    which = np.repeat(np.arange(len(marked)), size)
    place = np.arange(len(chars)) - np.repeat(np.cumsum(size) - size, size)
    key = chars.copy()
    for back in range(1, 5):
        before = np.zeros(len(chars), np.int64)
        before[back:] = chars[:-back] if back < len(chars) else 0
        key |= np.where(place >= back, before, 0) << LETTER * back
    return key, which


_UPPER, _DIGIT, _SIGN, _BAR = (bytes(b for b in range(128) if t(chr(b))) for t in (str.isupper, str.isdigit, lambda c: c in "#*$%&|<>~^{}[]\\", lambda c: c == "|"))
_VOWEL_RUN = re.compile(rb"(.)\1\1")


def structure(text: str | None, ids: np.ndarray) -> list[float]:
    """Statistics of a text's shape, each about 0 to 1."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n, words = max(len(raw), 1), max(len(ids), 1)
    share = lambda chars: (n - len(raw.translate(None, chars))) / n if raw else 0.0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct = len(np.unique(ids)) if len(ids) else 0
    pairs = ids[:-1].astype(np.uint64) << np.uint64(32) | ids[1:] if len(ids) > 1 else ids[:0]
    return [
        min(1.0, np.log1p(len(ids)) / 10),
        float(len(ids) < 50),
        float(len(ids) < 10),
        share(_UPPER),
        share(_DIGIT),
        share(_SIGN),
        share(_BAR),
        share(b"!"),
        min(1.0, len(raw) / words / 20),
        1 - distinct / words,
        1 - len(np.unique(pairs)) / max(len(pairs), 1) if len(pairs) else 0.0,
        1 - len(set(lines)) / max(len(lines), 1) if lines else 0.0,
        min(1.0, len(lines) / words),
        min(1.0, len(_VOWEL_RUN.findall(raw)) / words),
    ]


#: How many numbers structure() gives.
N_STRUCTURE = 14
