"""Near-duplicates by MinHash and an LSH forest.

A document is the set of its distinct word shingles. Documents with one set are one class, and
only one of each class goes on. Each class has a MinHash signature, and each of TREES trees sorts
the classes by its own sequence of signature values. Classes that share a prefix of a tree's sequence
are a region of that order, and candidates are longest-common-prefix neighbours in it: a region reaches
up to the shortest prefix of DEPTHS that at most REGION classes share, so it is shallow where the order is
sparse and deep where it is dense. In a region the neighbours in order are compared by their signatures
first; the runs they form are then compared with each other until no two runs hold a likely pair. A
region that is still crowded at the last depth isn't compared at all: its classes go on together.

So each tree gives a spanning forest of likely pairs, of as many edges as classes at most, and the trees'
forests together make families. A family holds every likely pair of every region, so all that can
be linked is inside one. Families are confirmed on full sets: the shared shingles of all pairs of a family
come from one product of its membership matrix, and a spanning forest of the links is what goes on. A large
family is dealt into blocks, which anchors (a hashed sample) tie together; then whatever of it isn't in its
largest component meets all its blocks, block with block. No pair is left out and no list of pairs is made.
Components come from repeated minimum labels with pointer jumping, all in DataFrames.

Two documents of a similarity s at the threshold miss each other in all regions with a chance of
(1 - s^d)^TREES: below 1e-5 at depth 3 and 3e-4 at depth 4 for s = 0.8. A family that is large, near the
threshold and yet not linked costs the square of its size over BLOCK in tasks.

Edge cases: ASCII capitals are lowered; a text with fewer words than a shingle is one shingle, the
whole; a null or wordless text has the empty set, is linked with nothing and is kept; documents
that share an id are one node (a class of either joins both) but all rows are returned; null ids
are nodes of their own kind: they're returned as kept, with no component; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.llm.common import cut, hits, id_bit, id_map, slices, small_batches, table

TREES, VALUES = 16, 128
#: Values of a tree's sequence, and the prefixes by which regions are made.
STEP, DEPTHS = VALUES // TREES, (3, 4)
#: Classes that a region may hold before it is divided.
REGION = 512
#: Classes of a block of a family, anchors of a family in all its blocks, and shingles of a block.
BLOCK, ANCHORS, ELEMENTS = 128, 32, 1_000_000
#: Classes of a side where blocks of one family meet, and columns of a membership matrix at once.
SIDE, COLUMNS = 1024, 8192
#: Words that a task remembers, and bytes of texts that it takes at once.
KNOWN, TAKEN = 150_000, 4_000_000
#: How much lower than the threshold an estimate may be: four and a half standard deviations of 128 values.
SLACK = 0.16
_RNG = np.random.default_rng(2024)
_MUL = _RNG.integers(1, 1 << 63, (VALUES, 1), dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, (VALUES, 1), dtype=np.uint64)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class Shingler:
    """Distinct shingle hashes of texts; words are hashed once and remembered, within a bound."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles of a text."""
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        try:
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(len(h) - self.width + 1, 1)
        out = np.zeros(n, np.uint64)
        for k in range(min(self.width, len(h))):
            out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        if len(h) < self.width:
            out ^= np.uint64(len(h))
        return np.unique(out)


def signature(found: np.ndarray) -> np.ndarray:
    """16 bits of each of VALUES minima of the hashes, under as many multiply-add functions."""
    best = np.full((VALUES, 1), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):  # all functions at once over a piece that fits the cache
        h = found[None, at : at + 1024] * _MUL
        h += _ADD
        np.minimum(best, h.min(axis=1, keepdims=True), out=best)
    # the minima of long texts are all small: mix them before cutting
    best = best[:, 0] * np.uint64(0x9E3779B97F4A7C15)
    return ((best ^ best >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype("<u2")


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))


def shingled(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, code, sig): size of the set, a 128-bit code of the whole set, and the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for b in slices(batches, TAKEN):
            n, code, sig = [], [], []
            for t in b.column(1).to_pylist():
                s = shingler.of(t)
                n.append(len(s))
                code.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(code, pa.binary()), pa.array(sig, pa.binary())], ["id", "n", "code", "sig"])

    return _rows(docs, key, text).mapInArrow(run, "id long, n long, code binary, sig binary")


def full_sets(docs: DataFrame, width: int, wanted: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, found): the sorted distinct shingle hashes of the documents that ``wanted`` (id) asks for, and
    of some others. Texts are not dealt out: a map of the ids goes to them."""
    shared = docs.sparkSession.sparkContext.broadcast(id_map(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for whole in batches:
            for b in slices([whole.filter(pa.array(hits(shared.value, whole.column(2))))], TAKEN):
                found = [shingler.of(t).view(np.int64) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "found"])

    rows = _rows(docs, key, text).filter("id is not null").withColumn("_at", id_bit("id"))
    return rows.mapInArrow(run, "id long, found array<long>")


def tree_keys(classes: DataFrame) -> DataFrame:
    """(k0, k1, ..., tree, id): each class in each tree with the codes of its prefixes, a column for each depth."""
    names = [f"k{j}" for j in range(len(DEPTHS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sigs = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u2").reshape(-1, VALUES).astype(np.uint64)
            ids, columns = b.column(0).to_numpy(), []
            for t in range(TREES):
                own, code, codes = sigs[:, t * STEP : (t + 1) * STEP], np.full(len(sigs), t + 1, np.uint64), []
                for d in range(max(DEPTHS)):
                    code = (code ^ own[:, d]) * np.uint64(0xC2B2AE3D27D4EB4F)
                    code ^= code >> np.uint64(31)
                    if d + 1 in DEPTHS:
                        codes.append(code.view(np.int64))
                columns.append(codes)
            trees = np.repeat(np.arange(TREES, dtype=np.int32), len(ids))
            yield pa.RecordBatch.from_arrays([*[pa.array(np.concatenate([c[j] for c in columns])) for j in range(len(DEPTHS))], pa.array(trees), pa.array(np.tile(ids, TREES))], [*names, "tree", "id"])

    return classes.select("id", "sig").mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", tree int, id long")


def _sized(keys: DataFrame, k: str) -> DataFrame:
    """``keys`` whose code ``k`` more than one class has, with ``size``, the number of such classes, and ``root``, the
    smallest. Sizes are written first, so that a hot code's rows can be split over tasks where they meet its size."""
    sizes = keys.groupBy(F.col(k).alias("_k")).agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("root")).filter("size > 1")
    return cut(keys.join(cut(sizes, "sizes"), F.col(k) == F.col("_k")).drop("_k"), "shared")


def regions(classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(region, tree, id): the regions of the trees' orders; and edges (a, b) that hold the classes of a region together
    that is crowded at the last depth, None if there is none. Classes that are alone are left out."""
    keys, out = tree_keys(classes), None
    for j in range(len(DEPTHS)):
        shared = _sized(keys, f"k{j}")
        own = shared.filter(f"size <= {REGION}").select(F.col(f"k{j}").alias("region"), "tree", "id")
        out = own if out is None else out.unionByName(own)
        keys = shared.filter(f"size > {REGION}")
        if not keys.limit(1).count():
            return out, None
        if j < len(DEPTHS) - 1:
            keys = keys.drop("size", "root")
    return out, keys.filter("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b")).distinct()


def forest(sigs: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A spanning forest of the likely pairs among rows that are in the order of their tree.

    Neighbours in order come first. The runs that they form are then searched: rows that are reached are
    compared with all that aren't yet, so a region of one kind takes one pass and only strangers all pairs.
    """
    n, need = len(sigs), least * VALUES
    near = (sigs[1:] == sigs[:-1]).sum(axis=1) >= need
    edges = [(int(k), int(k) + 1) for k in np.flatnonzero(near)]
    run = np.concatenate([[0], np.cumsum(~near)])
    todo = np.ones(n, bool)
    for start in range(n):
        if not todo[start]:
            continue
        found = np.flatnonzero(run == run[start])
        todo[found] = False
        queue = [found]
        while queue:
            rows = queue.pop()
            for i in rows.tolist():
                left = np.flatnonzero(todo)
                if not len(left):
                    return edges
                hit = left[(sigs[left] == sigs[i]).sum(axis=1) >= need]
                _, first = np.unique(run[hit], return_index=True)
                for j in hit[first].tolist():
                    edges.append((i, j))
                    more = np.flatnonzero(run == run[j])
                    todo[more] = False
                    queue.append(more)
    return edges


def _in_turn(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list]:
    """Rows sorted by their first ``keys`` columns, all of a group at once: a list for each column."""
    held: list | None = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [list(c.values.to_numpy()[x:y] for x, y in zip(o, o[1:], strict=False)) if pa.types.is_list(c.type) and (o := c.offsets.to_pylist()) else c.to_pylist() for c in b.columns]
        now = columns if held is None else [x + y for x, y in zip(held, columns, strict=True)]
        codes = list(zip(*now[:keys], strict=True))
        start = 0
        for k in range(1, len(codes)):
            if codes[k] != codes[k - 1]:
                yield [c[start:k] for c in now]
                start = k
        held = [c[start:] for c in now]
    if held is not None:
        yield held


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order)


def likely(members: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(a, b): a spanning forest of the likely pairs of each region. Rows are dealt and sorted by region and, in it, by
    the tree's sequence; a task goes through its regions one after another, one in memory."""
    both = members.join(classes.select(F.col("id").alias("_i"), "sig"), F.col("id") == F.col("_i"))
    rows = both.select("region", "id", "sig", F.expr(f"substring(sig, tree * {2 * STEP} + 1, {2 * STEP})").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for _, ids, sigs in _in_turn(batches, 1):
            if len(ids) > 1:
                pairs = forest(np.frombuffer(b"".join(sigs), "<u2").reshape(-1, VALUES), least)
                found += [(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in pairs if ids[i] != ids[j]]
            if len(found) > 50_000:
                yield _edges(found)
                found = []
        yield _edges(found)

    return _dealt(rows, ["region"], ["label", "id"]).select("region", "id", "sig").mapInArrow(run, "a long, b long").distinct()


def shared_counts(sets: list[np.ndarray], half: int | None = None) -> np.ndarray:
    """How many members each two sets have in common; with ``half``, each of the sets before it with each after it."""
    size = np.array([len(x) for x in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    use = times[column] > 1
    row, column = row[use], column[use]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]])) if len(column) else column
    n = len(sets)
    out = np.zeros((n, n) if half is None else (half, n - half), np.int64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        x, y = np.searchsorted(column, (at, at + COLUMNS))
        held = np.zeros((n, min(COLUMNS, int(column[-1]) + 1 - at)), np.float32)  # counts below 2^24 are exact
        held[row[x:y], column[x:y] - at] = 1
        out += (held @ held.T if half is None else held[:half] @ held[half:].T).astype(np.int64)
    return out


def linked(ids: list[int], sets: list[np.ndarray], similarity: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among all pairs: 100 * shared >= similarity * union."""
    n = len(ids)
    size = np.array([len(x) for x in sets])
    shared = shared_counts(sets)
    link = 100 * shared >= similarity * (size[:, None] + size[None, :] - shared)
    out, todo = [], np.ones(n, bool)
    for start in range(n):
        if not todo[start]:
            continue
        todo[start], queue = False, [start]
        while queue:
            i = queue.pop()
            new = np.flatnonzero(link[i] & todo)
            todo[new] = False
            queue += new.tolist()
            out += [(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in new.tolist() if ids[i] != ids[j]]
    return out


def linked_across(ids: list[int], sets: list[np.ndarray], labels: list[int], half: int, similarity: int) -> list[tuple[int, int]]:
    """Links between the first ``half`` sets and the others that join what the labels leave apart: enough of them to tie
    all that such links tie."""
    size = np.array([len(x) for x in sets])
    shared = shared_counts(sets, half)
    label = np.array(labels)
    link = (100 * shared >= similarity * (size[:half, None] + size[None, half:] - shared)) & (label[:half, None] != label[None, half:])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    out = []
    for i in np.flatnonzero(link.any(axis=1)).tolist():
        at = half + np.flatnonzero(link[i])
        for j in at[np.unique(label[at], return_index=True)[1]].tolist():
            x, y = find(labels[i]), find(labels[j])
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def confirm(placed: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(a, b): the links within each block of each family. ``placed``: family, block, id."""
    rows = placed.join(sets.withColumnRenamed("id", "_i"), F.col("id") == F.col("_i")).select("family", "block", "id", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, ids, found in _in_turn(batches, 2):
            if len(ids) > 1:
                yield _edges(linked(ids, found, similarity))

    return _dealt(rows, ["family", "block"], ["id"]).mapInArrow(run, "a long, b long").distinct()


def confirm_across(met: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(a, b): links between the sides of each cell. ``met``: family, cell, side (0 or 1), label, id."""
    rows = met.join(sets.withColumnRenamed("id", "_i"), F.col("id") == F.col("_i")).select("family", "cell", "side", "label", "id", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, side, labels, ids, found in _in_turn(batches, 2):
            half = side.count(0)
            if 0 < half < len(side):
                yield _edges(linked_across(ids, found, labels, half, similarity))

    return _dealt(rows, ["family", "cell"], ["side", "id"]).mapInArrow(run, "a long, b long").distinct()


def rest_of_families(large: DataFrame, labels: DataFrame) -> DataFrame | None:
    """(family, cell, side, label, id): who is still to meet whom; None if nobody. ``large``: family, id, sides (how many
    blocks of SIDE the family makes), of families that had more than one block. All but a family's largest component
    (side 0) meet all of it (side 1)."""
    now = large.join(labels.withColumnRenamed("id", "_i"), F.col("id") == F.col("_i"), "left").select("family", "id", "sides", F.coalesce("label", "id").alias("label"))
    now = cut(now, "large")
    parts = now.groupBy("family", "label").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("major"), (F.sum("n") - F.max("n")).alias("minors"), F.sum("n").alias("all")).filter("minors > 0")
    if not (parts := cut(parts, "parts")).limit(1).count():
        return None
    share = F.ceil(F.col("sides") * F.col("minors") / F.col("all")).cast("int")
    rows = now.join(parts.withColumnRenamed("family", "_f"), F.col("family") == F.col("_f")).withColumn("few", share)
    own = lambda n: F.pmod(F.xxhash64("id", F.lit("side")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    minor = rows.filter("label <> major").select("family", own("few").alias("p"), every("sides").alias("q"), F.lit(0).alias("side"), "label", "id", "sides")
    whole = rows.select("family", every("few").alias("p"), own("sides").alias("q"), F.lit(1).alias("side"), "label", "id", "sides")
    return minor.unionByName(whole).select("family", (F.col("p").cast("long") * F.col("sides") + F.col("q")).alias("cell"), "side", "label", "id")


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each linked id reaches. ``links``: a, b.

    Each round gives a node the least label among its neighbours, then that label's own label;
    minima are gathered before the shuffle, so hubs don't weigh. Rounds end when nothing changes.
    """
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")), "labels")
    while True:
        beside = edges.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(beside, F.col("id") == F.col("a"), "left").select("id", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("id").alias("_i"), F.col("label").alias("far"))
        step = step.join(jump, F.col("low") == F.col("_i"), "left").select("id", F.least("low", "far").alias("now"), "label")
        step = cut(step, "labels")
        changed = step.filter("now <> label").limit(1).count()
        labels = step.select("id", F.col("now").alias("label"))
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, width: int = 5, similarity: int = 80, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, links): rows has id, n_shingles, component_id (null id: null) for each row of ``docs``;
    links (a, b) are confirmed links between class representatives that make the components."""
    rows = cut(shingled(docs, width, key, text), "shingled")
    whole = rows.filter("id is not null and code is not null")
    classes = cut(whole.groupBy("code").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("sig").alias("sig"), F.count(F.lit(1)).alias("copies")), "classes")
    # documents of one id but several texts hold their classes together
    several = whole.groupBy("id").agg(F.min(F.xxhash64("code")).alias("lo"), F.max(F.xxhash64("code")).alias("hi")).filter("lo <> hi").select(F.col("id").alias("_d"))
    reps = whole.join(several, F.col("id") == F.col("_d")).join(classes.select(F.col("code").alias("_c"), F.col("id").alias("rep")), F.col("code") == F.col("_c"))
    ties = cut(reps.select(F.col("rep").alias("a"), F.col("id").alias("b")).filter("a <> b").distinct(), "ties")

    member, crowded = regions(classes)
    edges = likely(member, classes, similarity / 100 - SLACK)
    families = components(edges if crowded is None else edges.unionByName(crowded))
    sized = families.join(classes.groupBy(F.col("id").alias("_i")).agg(F.sum("n").alias("n")), F.col("id") == F.col("_i")).select(F.col("label").alias("family"), "id", "n")
    sized = cut(sized, "families")
    blocks = lambda most: F.ceil(F.greatest(F.count(F.lit(1)) / most, F.sum("n") / ELEMENTS)).cast("int")
    sizes = cut(sized.groupBy("family").agg(F.count(F.lit(1)).alias("size"), blocks(BLOCK).alias("blocks"), blocks(SIDE).alias("sides")), "sizes")
    member = sized.join(sizes.withColumnRenamed("family", "_f"), F.col("family") == F.col("_f"))
    own = F.array(F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")).cast("int"))
    anchor = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("id", F.lit("anchor")), F.col("size")) < ANCHORS)
    dealt = F.when(anchor, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)
    sets = cut(full_sets(docs, width, families.select("id"), key, text).join(families.select(F.col("id").alias("_i")), F.col("id") == F.col("_i"), "left_semi"), "sets")
    links = cut(confirm(member.select("family", F.explode(dealt).alias("block"), "id"), sets, similarity), "links")
    labels = components(links.unionByName(ties))
    rest = rest_of_families(member.filter("blocks > 1").select("family", "id", "sides"), labels)
    if rest is not None:
        links = links.unionByName(cut(confirm_across(rest, sets, similarity), "links"))
        labels = components(links.unionByName(ties))
    # only classes of several documents or with links say anything that a row doesn't know itself
    said = classes.join(labels.withColumnRenamed("id", "_i"), F.col("id") == F.col("_i"), "left").filter("copies > 1 or label is not null")
    said = cut(said.select(F.col("code").alias("_c"), F.coalesce("label", "id").alias("label")), "classes")
    out = rows.select("id", "n", "code").join(said, F.col("code") == F.col("_c"), "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("label", "id")).alias("component_id")), links


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document over 3-word shingles at a similarity of 0.85."""
    rows, _ = near_duplicates(table(spark, sf_dir, "documents"), 3, 85)
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 1, 2))) AS u(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(id, low) AS (SELECT a, a FROM l UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.id WHERE r.low < l.b),
c AS (SELECT id, min(low) AS low FROM r GROUP BY id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(low, doc_id) AS component_id, coalesce(low, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = doc_id
"""
