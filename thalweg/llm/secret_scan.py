r"""Secret scans by a trigram inverted index, in DataFrame and SQL functions only.

From each rule's regular expression a Boolean trigram query is derived: a disjunction of
conjunctions of trigrams that every match must contain. The index holds postings for the trigrams that
the rules ask for, a few dozen, so it is kept where its documents are: each row has the list of the trigrams that
post it. A rule intersects these postings by its query; the documents that satisfy it are the rule's
candidates, and only they are verified with the expression. A rule without a mandatory trigram scans
every document. Nothing is shuffled, and rows need no id. ``postings`` gives the same index by trigram.

Spans are code point offsets into the text, end exclusive. Places come from splitting at the
expression: the pieces before a match and the matches before it add up to its start.

Edge cases: a null text is empty; matches are leftmost and do not overlap within a rule; a match
whose secret is too short is dropped but its characters stay consumed; null and repeated ids are
scanned like any others; repeated rows give repeated rows; an empty table gives no rows; other columns are
kept, whatever their names (``scan`` replaces one that is named like its result).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.llm.common import spare, table


@dataclass(frozen=True)
class Rule:
    """kind: name; regex: read alike by Java and Python; group: the part whose length counts;
    least: the shortest such part; base: one of the contract's own kinds."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    base: bool = False


def _either(word: str) -> str:
    """A word in either case, ASCII only, without a flag that engines read differently."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key")
RULES = (
    Rule("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 0, 40),
    Rule("bearer", r"[Bb]earer\x20+([A-Za-z0-9+/_.=-]+)", 1, 20),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("pay_key", r"[sr]k_(?:live|test)_[A-Za-z0-9]+", 0, 24),
    Rule("map_key", r"AIza[A-Za-z0-9_-]+", 0, 39),
)
#: More alternatives than this in a query are given up for a plain conjunction of what is certain.
MOST_STRINGS = 64


def _strings(tree) -> tuple[list[frozenset[str] | None], ...]:
    """The regex as alternatives of runs: each alternative is a list of exact literal strings that
    occur one after the other, broken where something unknown stands. Lower case."""
    runs: list[list[str]] = [[""]]  # alternatives; the last string of each is still open
    for op, arg in tree:
        if op is sre.LITERAL:
            runs = [[*r[:-1], r[-1] + chr(arg).lower()] for r in runs]
        elif op is sre.IN and (chars := _small_class(arg)):
            runs = [[*r[:-1], r[-1] + c] for r in runs for c in chars]
        elif op is sre.SUBPATTERN:
            runs = _join(runs, _strings(arg[3]))
        elif op is sre.BRANCH:
            runs = _join(runs, [x for b in arg[1] for x in _strings(b)])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[:2] == (0, 1) and len(part := _strings(arg[2])) == 1:
            runs = [*_join(runs, part), *runs]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            runs = [[*r, ""] for r in _join(runs, _strings(arg[2]))]
        else:
            runs = [[*r, ""] for r in runs]
        if len(runs) > MOST_STRINGS:
            runs = [["", ""]]
    return runs


def _join(left, right):
    return [[*a[:-1], a[-1] + b[0], *b[1:]] for a in left for b in right]


def _small_class(arg) -> list[str]:
    """The lower-case letters of a class of one letter in either case, or of a few characters."""
    chars = set()
    for op, x in arg:
        if op is not sre.LITERAL:
            return []
        chars.add(chr(x).lower())
    return sorted(chars) if len(chars) <= 6 else []


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """A disjunction of sets of trigrams, all of which a match must contain (lower-cased), or None
    if some way to match has no mandatory trigram."""
    out = set()
    for run in _strings(sre_parse.parse(regex)):
        grams = frozenset(s[k : k + 3] for s in run for k in range(len(s) - 2))
        if not grams:
            return None
        out.add(grams)
    return sorted((g for g in out if not any(o < g for o in out)), key=sorted)


def plans(rules: tuple[Rule, ...] = RULES) -> dict[str, list[frozenset[str]] | None]:
    return {r.kind: trigram_query(r.regex) for r in rules}


def posted(low: Column, grams: list[str]) -> Column:
    """The asked trigrams that post a text, given in lower case."""
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(g)) for g in grams]))


def asked(queries: dict[str, list[frozenset[str]] | None]) -> list[str]:
    """The trigrams that any query needs."""
    return sorted({g for q in queries.values() if q for need in q for g in need})


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index by trigram: (gram, key), once for each row that the trigram posts."""
    held = posted(F.lower(F.coalesce(F.col(text), F.lit(""))), asked(plans(rules)))
    return docs.select(F.explode(held).alias("gram"), F.col(key).alias("key"))


def candidate(held: str, query: list[frozenset[str]]) -> Column:
    """Whether the postings in column ``held`` satisfy a trigram query."""
    some = F.lit(False)
    for need in query:
        every = F.lit(True)
        for g in sorted(need):
            every = every & F.array_contains(held, g)
        some = some | every
    return some


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start, kind_no, end>> of a rule's matches in a text; SQL functions only."""
    regex = F.lit(rule.regex)
    pieces, hits = F.split(text, rule.regex, -1), F.regexp_extract_all(text, regex, F.lit(0))
    parts = F.regexp_extract_all(text, regex, F.lit(rule.group)) if rule.group else hits
    rows = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(hits)).alias("before"), hits.alias("hit"), parts.alias("part"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["hit"])
        own = F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))
        return F.struct(end.cast("int").alias("at"), F.when(F.length(x["part"]) >= rule.least, F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(rows, zero, step, lambda acc: acc["out"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", out: str = "found") -> DataFrame:
    """All columns of ``docs`` and ``out``: array<struct<start, no, end, kind>> sorted by start,
    then by the order of the rules. Rows are scanned where they are."""
    queries = plans(rules)
    whole, low, held = (spare(docs, f"_secret_{c}") for c in ("text", "low", "held"))
    rows = docs.withColumn(whole, F.coalesce(F.col(text), F.lit(""))).withColumn(low, F.lower(whole)).withColumn(held, posted(F.col(low), asked(queries)))
    parts = []
    for no, rule in enumerate(rules):
        named = _named(spans_of(F.col(whole), rule), no, rule.kind)
        empty = F.array().cast("array<struct<start:int,no:int,end:int,kind:string>>")
        if queries[rule.kind] is None:
            # the scan's own quick test: a match of the least length exists
            test = F.col(whole).rlike(f"(?:{rule.regex})" if not _run_class(rule) else f"{_run_class(rule)}{{{rule.least}}}")
        else:
            test = candidate(held, queries[rule.kind])
        parts.append(F.when(test, named).otherwise(empty))
    return rows.withColumn(out, F.sort_array(F.concat(*parts))).drop(whole, low, held)


def _named(spans: Column, no: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("no"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _run_class(rule: Rule) -> str | None:
    """The character class if the rule is a run of one class."""
    m = re.fullmatch(r"(\[[^\]]+\])\+", rule.regex)
    return m[1] if m and not rule.group else None


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; overlapping spans are replaced as one."""
    own = spare(docs, "_found")
    found = scan(docs, rules, text, own)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, piece).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(F.col(text)) - acc["at"]))
    clean = F.when(F.size(own) > 0, F.aggregate(own, zero, step, rest)).otherwise(F.col(text))
    return found.withColumn(text, clean).drop(own)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest of base spans, and all spans of every document."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = {r.kind for r in RULES if r.base}
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    own = F.filter("found", lambda s: s["kind"].isin(*base))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(own), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
