"""Document fingerprints by I-Match with randomised lexicon subsets, in DataFrame and SQL functions only.

Document frequencies of all terms over all documents give the lexicon: the terms whose inverse
document frequency lies in a band. A document keeps its distinct lexicon terms, sorted; several
random subsets of the lexicon each leave some of them, and each subset's list is hashed to one
slot of the fingerprint. Subsets come in levels, from parts of the whole lexicon down to thin
samples of it, so that short and long documents both have slots that a partial edit leaves alone.
The likeness of two fingerprints is the share of equal slots among those that either fills, on one level: the
thinnest on which at least FILLED of the slots are filled. How many are equal has no say in the choice.

The lexicon is an exact set of terms and bounded: a term of the band stands in at least LOW of all
documents, so there are at most (mean distinct terms of a document) / LOW such terms. It is carried as one
table in which each term has two places.

Edge cases: a null text is empty; a text without lexicon terms takes all its terms instead; a text
without words has empty slots only, and two such texts have likeness 1; documents with equal ids
share one place in the order (the one with the smallest text speaks for it) but all rows are
returned; a null id comes first; in a table of one id the next document is itself; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.llm.common import WORD, cut, successors, table

#: The band: shares of documents in which a lexicon term stands.
LOW, HIGH = 0.0005, 0.15
#: Subsets of a level, and how many of them would cover the lexicon, by level.
SUBSETS = 24
COVER = (24, 96, 384, 1536)
#: Subsets that are told apart at once; then each of SUBSETS / SPLIT parts is told apart.
SPLIT = 6
#: Share of a level's slots that must be filled for the level to count.
FILLED = 1 / 3
#: Part of every slot's hash.
SEED = 11
#: Stands for a null id; comes before all others in the order.
NO_ID = -(1 << 63)


def terms(text: Column) -> Column:
    """The distinct words of a text in lower case, as 64-bit hashes."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))
    return F.transform(words, lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, text: str = "text") -> list[int]:
    """The terms in the band, over all documents, as hashes. Terms are counted with partial sums before the shuffle."""
    held = docs.select(F.explode(terms(F.coalesce(F.col(text), F.lit("")))).alias("term"))
    n = docs.count()
    counts = held.groupBy("term").count().filter(F.col("count").between(max(2, LOW * n), max(2, HIGH * n)))
    return counts.select("term").toArrow().column("term").to_pylist()


def two_places(found: list[int], size: int) -> list[int | None] | None:
    """A table of ``size`` (a power of two) in which each number stands at one of its two places; None if they don't fit."""
    out: list[int | None] = [None] * size
    for t in found:
        at = t & (size - 1)
        for _ in range(200):
            t, out[at] = out[at], t
            if t is None:
                break
            at = (t >> 31 if at == t & (size - 1) else t) & (size - 1)  # whoever was there moves to the other place
        else:
            return None
    return out


def held_by(found: list[int]) -> Callable[[Column], Column]:
    """A test of membership in a set of hashes, for columns: a look at the two places of a hash in one table, which is
    folded to a literal."""
    size = 1 << max(4, (3 * len(found)).bit_length())
    while (table_ := two_places(found, size)) is None:
        size *= 2
    known = set(found)
    none = next(k for k in range(len(found) + 1) if k not in known)
    literal = F.split(F.lit(",".join(str(none if t is None else t) for t in table_)), ",").cast("array<bigint>")
    mask = F.lit(size - 1)
    places = lambda t: F.array(t.bitwiseAND(mask), F.shiftright(t, 31).bitwiseAND(mask))
    return lambda t: (t != none) & F.exists(places(t), lambda k: F.get(literal, k.cast("int")) == t)


def slots_sql(kept: str) -> str:
    """SQL for the slots of a sorted array of term hashes. Level by level, each subset keeps the
    terms whose hash falls to it; finer levels only look at what the coarser ones could hold. Terms are told apart in two
    steps, by parts and then by the subsets of a part, which take far fewer looks than one for each subset."""
    parts, levels = SUBSETS // SPLIT, []
    for level, cover in enumerate(COVER):
        number = f"pmod(shiftright(t, 20), {cover})"
        some = f"filter({kept}_{level}, t -> {number} < {SUBSETS} and pmod(shiftright(t, 20), {parts}) = g)"
        lists = f"transform(array({some}), part -> transform(sequence(0, {SPLIT - 1}), s -> filter(part, t -> {number} = g + {parts} * s)))"
        own = f"transform(flatten({lists}), x -> case when size(x) > 0 then cast(xxhash64(x, {level}, {SEED}) & 2147483647L as int) end)"
        levels.append(f"flatten(transform(sequence(0, {parts - 1}), g -> {own}))")
    return f"concat({', '.join(levels)})"


def with_fingerprint(df: DataFrame, text: str, out: str, known: Callable[[Column], Column]) -> DataFrame:
    """Add ``out``: array<int>, the slots of the column ``text``; ``known`` tests for the lexicon."""
    df = df.withColumn("_terms", terms(F.coalesce(F.col(text), F.lit(""))))
    inside = F.filter("_terms", known)
    df = df.withColumn("_in", inside)
    df = df.withColumn("_k_0", F.sort_array(F.when(F.size("_in") > 0, F.col("_in")).otherwise(F.col("_terms"))))
    for level in range(1, len(COVER)):
        df = df.withColumn(f"_k_{level}", F.expr(f"filter(_k_{level - 1}, t -> pmod(shiftright(t, 20), {COVER[level]}) < {SUBSETS})"))
    return df.withColumn(out, F.expr(slots_sql("_k"))).drop("_terms", "_in", *[f"_k_{k}" for k in range(len(COVER))])


def likeness(a: str, b: str) -> Column:
    """0 to 1: the share of equal slots among those that either fingerprint fills, on the thinnest level of which enough
    are filled, or on the first; 1 if both are empty."""
    levels = []
    for level in range(len(COVER)):
        x, y = f"slice({a}, {level * SUBSETS + 1}, {SUBSETS})", f"slice({b}, {level * SUBSETS + 1}, {SUBSETS})"
        both = f"zip_with({x}, {y}, (p, q) -> case when p is null and q is null then 0 when p <=> q then 1000 + 1 else 1 end)"
        # thousands count equal slots, units all filled ones
        levels.append(f"aggregate({both}, 0, (s, v) -> s + v)")
    pick = " ".join(f"when ({t}) % 1000 >= {ceil(SUBSETS * FILLED)} then ({t})" for t in reversed(levels[1:]))
    total = f"case {pick} else {levels[0]} end"
    empty = f"forall({a}, v -> v is null) and forall({b}, v -> v is null)"
    return F.expr(f"case when {empty} then 1D else coalesce(try_divide(cast(({total}) div 1000 as double), ({total}) % 1000), 0D) end")


def as_text(slots: str) -> Column:
    """A fingerprint as one string: slots in hexadecimal, empty ones as nothing."""
    return F.array_join(F.transform(slots, lambda v: F.lpad(F.hex(v), 8, "0")), "-", "")


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likenesses.

    Ids and lengths are put in order first. One exchange deals the texts out by id, and both joins
    use it: the first cuts the prefix that the document before asks for, the second brings it
    there. Fingerprints meet their successors in a narrow table afterwards.
    """
    key = F.coalesce("doc_id", F.lit(NO_ID)).alias("_k")  # never null, so that no filter sets one use of the exchange apart
    docs = table(spark, sf_dir, "documents").select(key, F.coalesce("text", F.lit("")).alias("text"))
    known = held_by(lexicon(docs))
    keys = docs.groupBy("_k").agg(F.max(F.floor(F.length("text") / 4)).alias("cut"))
    order = cut(successors(keys, ["_k"]), "order")
    low = order.agg(F.min("_k")).first()[0]
    order = order.select("_k", "cut", F.coalesce("next._k", F.lit(low)).alias("next_id"))
    asked = order.select(F.col("next_id").alias("_id"), F.col("_k").alias("before_id"), F.col("cut").alias("asked"))
    dealt = docs.repartition("_k")
    heads = dealt.join(asked.hint("shuffle_hash"), F.col("_k") == F.col("_id"))
    heads = heads.select("before_id", F.col("_k").alias("next_id"), F.expr("left(text, cast(asked as int))").alias("head"))
    heads = heads.groupBy("before_id", "next_id").agg(F.min("head").alias("head"))
    rows = dealt.join(heads.hint("shuffle_hash"), F.col("_k") == F.col("before_id"), "left")
    edited = F.expr("left(text, cast(length(text) - length(text) div 4 as int)) || left(head, cast(length(text) div 4 as int))")
    rows = rows.select("_k", "next_id", "text", edited.alias("edited"))
    rows = rows.select("*", F.length("text").cast("long").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("edited_sha"))
    rows = with_fingerprint(rows, "text", "slots", known).drop("text")
    rows = cut(with_fingerprint(rows, "edited", "edited_slots", known).drop("edited"), "fingerprints")
    nexts = rows.groupBy(F.col("_k").alias("_id")).agg(F.min("slots").alias("next_slots"))
    return rows.join(nexts, F.col("next_id") == F.col("_id")).select(
        F.nullif("_k", F.lit(NO_ID)).alias("doc_id"), "n_chars", F.lower(F.hex("edited_sha")).alias("edited_sha256"), as_text("slots").alias("fingerprint"), as_text("edited_slots").alias("edited_fingerprint"),
        likeness("slots", "edited_slots").alias("near_edited"), likeness("slots", "next_slots").alias("near_next"),
    )
