"""Main text of web pages by nearest-URL page differencing.

Each page is cut into lines: its blocks of text. Pages of a host are put in order of their URL path,
and each is paired with the nearer of its two neighbours, by edit distance of the paths. The lines of
a pair, of the whole page, are aligned by their longest common subsequence, and lines that both
share are deleted as template. That needs no words of a template: it holds for any host.

What a page itself says is respected first. Menus, forms, scripts and the like are dropped by element,
role or a whole class name. A page that declares its article or main part has its text there; what
stands outside isn't main text even if no other page shares it. Articles of a host quote the same
passages, and a shared line alone can't tell a quotation from a template (the README has figures). So
a line inside a declared article goes only if at least USUAL of the host's pages have it, too.

The pages are read twice, so that only line hashes are dealt out, and the extracted lines only where the
list of what goes is long.

Edge cases: a null or empty html has the empty text; a page that is alone in its host isn't
differenced, and a page whose neighbour shares all its lines (a copy: nothing would be left) keeps
them; null URLs form a host of their own; equal URLs are ordered by id, nulls first, and content;
pages with equal or null ids are pages of their own; equal rows count as one page and are all
returned; an unclosed tag ends with its parent, a stray end tag is passed over; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thalweg.llm.common import cut, slices, small_batches, successors, table

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"""([A-Za-z][A-Za-z0-9:_-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements whose content is no text at all.
RAW = frozenset("script style noscript template svg iframe object canvas textarea title".split())
#: Elements that aren't main text.
ASIDE = frozenset("nav aside footer header form head button select dialog menu fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html"
    " li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul head".split()
)
#: Roles of such parts.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Whole class names or ids of such parts. An article or main part inside one counts nevertheless.
LAYOUT = frozenset(
    "ad ads advert adverts advertisement advertisements ad-container ad-slot ad-banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar"
    " header site-header page-header masthead footer site-footer page-footer sidebar side-bar sidebar-left sidebar-right notice notices cookie cookies cookie-banner cookie-notice cookie-consent consent gdpr alert".split()
)
#: Those of what readers write; an article inside one is a reader's.
READERS = frozenset("comment comments comment-list commentlist comments-area comments-section reader-comments user-comments replies respond disqus disqus_thread".split())
#: Those that an article has for its own headline.
_HEADS = frozenset("header page-header masthead".split())
#: An end tag of another element closes no further than these.
_SCOPE = frozenset("article main body html table section".split())
_CLOSES_P = BLOCK - {"br"}
_WHOLE = frozenset("html body article main".split())
#: States of the parser: text counts; an element or reader part drops it; only a layout name drops it.
_OPEN, _SHUT, _SOFT = 0, 1, 2
#: Share of a host's pages, and their least number, that make a line of an article template.
USUAL, LEAST_PAGES = 2 / 3, 4
#: Salts by which pages of one host meet its usual lines.
SALTS = 64
#: Most pages and lines to be deleted that are sent to all executors; more are dealt out with the texts.
MOST_SENT = 200_000
#: Bits of alignment rows that are held at once.
_ROWS = 1 << 27


def _said(name: str, raw: str, article: bool) -> int:
    """What the attributes of a tag say of its text."""
    found = {a[0].lower(): a[1] or a[2] or a[3] for a in reversed(_ATTR.findall(raw))}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in ROLES:
        return _SHUT
    named = {*found.get("class", "").lower().split(), *found.get("id", "").lower().split()}
    if named & READERS:
        return _SHUT
    named &= LAYOUT
    return _SOFT if named and not (article and named <= _HEADS) and name not in _WHOLE else _OPEN


def lines(page: str | None) -> tuple[list[str], list[bool]]:
    """The lines of a page that may be main text, in page order, and whether each stands in a declared
    article or main part."""
    out: list[str] = []
    inside: list[bool] = []
    parts: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # name, and the state from here on: dropped or not, article or not
    frames: list[dict[str, int]] = [{}]  # open elements by name, a frame for each of _SCOPE
    scopes: dict[str, int] = {}
    state, article = _OPEN, False
    at, page = 0, page or ""

    def flush() -> None:
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append(text)
                inside.append(article)

    def pop() -> str:
        gone = stack.pop()[0]
        if gone in _SCOPE:
            frames.pop()
            scopes[gone] -= 1
        else:
            frames[-1][gone] -= 1
        return gone

    while m := _TAG.search(page, at):
        if state == _OPEN and m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            flush()
        if m[1]:
            if (scopes if name in _SCOPE else frames[-1]).get(name):
                while pop() != name:
                    pass
                state, article = stack[-1][1:] if stack else (_OPEN, False)
            continue
        if name in VOID:
            continue
        if name in RAW:
            if not m[3].rstrip().endswith("/") or name != "svg":
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in _CLOSES_P and stack and stack[-1][0] == "p":
            pop()
            state, article = stack[-1][1:] if stack else (_OPEN, False)
        said = _said(name, m[3], article) if m[3].strip() else _OPEN
        if name in ASIDE and not (name == "header" and article):
            said = _SHUT
        if name in ("article", "main") and said == _OPEN and state != _SHUT:
            state, article = _OPEN, True
        elif said and state != _SHUT:
            state = said
        stack.append((name, state, article))
        if name in _SCOPE:
            frames.append({})
            scopes[name] = scopes.get(name, 0) + 1
        else:
            frames[-1][name] = frames[-1].get(name, 0) + 1
    if state == _OPEN:
        parts.append(page[at:])
    flush()
    return out, inside


def main_lines(page: str | None) -> list[str]:
    """The lines that are main text unless differencing deletes them: those of the declared article, or
    all if none is declared."""
    out, inside = lines(page)
    return [x for x, own in zip(out, inside, strict=True) if own] if any(inside) else out


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """For each line of ``a`` the bit vector over ``b`` whose zeros, up to a place, count the longest
    common subsequence so far: the bit-parallel recurrence on whole numbers of any length."""
    at: dict[int, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    every = (1 << len(b)) - 1
    v = every
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & every
        yield v


def _zeros(v: int, n: int) -> np.ndarray:
    """How many of the first 0, 1, ..., n bits are 0."""
    bits = np.unpackbits(np.frombuffer(v.to_bytes(-(-n // 8), "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(a: list[int], b: list[int]) -> set[int]:
    """The places in ``a`` of a longest common subsequence with ``b``.

    Equal ends are cut off first. The rest takes len(a) * len(b) / 64 steps of a processor however often a line
    repeats; where the rows would be too large to be held, ``a`` is halved at its best meeting place.
    """
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    end_a, end_b = len(a), len(b)
    while end_a > lo and end_b > lo and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    out = {*range(lo), *range(end_a, len(a))}
    both = {*a[lo:end_a]} & {*b[lo:end_b]}
    mine = [k for k in range(lo, end_a) if a[k] in both]
    x, y = [a[k] for k in mine], [t for t in b[lo:end_b] if t in both]
    todo = [(0, len(x), 0, len(y))]
    while todo:
        i, n, j, m = todo.pop()
        if i == n or j == m:
            continue
        if n - i > 1 and (n - i) * (m - j) > _ROWS:
            half = (i + n) // 2
            *_, down = _rows(x[i:half], y[j:m])
            *_, up = _rows(x[half:n][::-1], y[j:m][::-1])
            meet = j + int(np.argmax(_zeros(down, m - j) + _zeros(up, m - j)[::-1]))
            todo += [(i, half, j, meet), (half, n, meet, m)]
            continue
        rows = list(_rows(x[i:n], y[j:m]))
        r, c = n - i, m - j
        while r and c:
            if rows[r - 1] >> (c - 1) & 1:
                c -= 1
            elif r > 1 and not rows[r - 2] >> (c - 1) & 1:
                r -= 1
            else:
                r, c = r - 1, c - 1
                out.add(mine[i + r])
    return out


def template(ours: list[int], inside: list[bool], near: list[int], usual: list[int] | None) -> list[int]:
    """Which of a page's main lines (their places among the main lines) go as template. ``near``: the lines of
    its neighbour; ``usual``: lines that most pages of the host have."""
    shared = common(ours, near)
    own = [k for k, x in enumerate(inside) if x]
    if own:
        most = frozenset(usual or ())
        shared = {k for k in shared if ours[k] in most}
    else:
        own = list(range(len(ours)))
    gone = [at for at, k in enumerate(own) if k in shared]
    return gone if len(gone) < len(own) else []


def keyed(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(k, id, host, path, url, html): k tells rows apart that differ in anything."""
    clean = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "^[a-z]+://", "")
    host = F.regexp_replace(F.regexp_extract(clean, "^([^/?#]*)", 1), "^(www|m)[.]", "")
    path = F.regexp_replace(F.regexp_extract(clean, "^[^/?#]*([^?#]*)", 1), "(/|[.]html?)$", "")
    part = [F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-")) for c in (key, url, html)]
    return pages.select(F.unhex(F.md5(F.concat_ws("\n", *part))).alias("k"), F.col(key).alias("id"), host.alias("host"), path.alias("path"), F.col(url).alias("url"), F.col(html).alias("html"))


def neighbours(pages: DataFrame) -> DataFrame:
    """(k, near): each page's neighbour in the order of its host's paths, of the two beside it the one whose path
    takes fewer edits (the later one if both take as many). ``pages``: k, id, host, path, distinct."""
    order = cut(successors(pages, ["host", "path", "id", "k"], within=["host"]), "page-order")
    gaps = order.filter("next is not null").select("k", F.col("next.k").alias("after"), F.levenshtein("path", "next.path").alias("gap"))
    sides = gaps.select("k", "after", "gap", F.lit(0).alias("side")).unionByName(gaps.select(F.col("after").alias("k"), F.col("k").alias("after"), "gap", F.lit(1).alias("side")))
    return sides.groupBy("k").agg(F.min_by("after", F.struct("gap", "side")).alias("near"))


def line_hashes(pages: DataFrame) -> DataFrame:
    """(k, id, host, path, ours, inside): the hashes of each page's lines. ``pages``: as keyed gives them."""
    small_batches(pages.sparkSession)
    source = pages.select("k", "id", "host", "path", "html")
    schema = source.drop("html").schema.add("ours", T.ArrayType(T.LongType())).add("inside", T.ArrayType(T.BooleanType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [lines(t) for t in b.column(4).to_pylist()]
            ours = pa.array([[xxhash.xxh64_intdigest(x) - (1 << 63) for x in g[0]] for g in got], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], ours, pa.array([g[1] for g in got], pa.list_(pa.bool_()))], schema.names)

    return source.mapInArrow(run, schema)


def usual_lines(held: DataFrame) -> DataFrame:
    """(host, usual): the lines that at least USUAL of a host's pages have, of hosts of LEAST_PAGES or more; no more
    than a page's mean number of lines over USUAL. ``held``: host, ours, one row a page."""
    sizes = held.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter(f"pages >= {LEAST_PAGES}")
    counts = held.select("host", F.explode(F.array_distinct("ours")).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(f"n >= {LEAST_PAGES}")
    most = counts.join(sizes.withColumnRenamed("host", "_h"), F.col("host") == F.col("_h")).filter(F.col("n") >= F.lit(USUAL) * F.col("pages"))
    return most.groupBy("host").agg(F.collect_list("line").alias("usual"))


def templates(hashes: DataFrame) -> DataFrame:
    """(k, gone): the places of the main lines that go, for pages that lose any. ``hashes``: as line_hashes gives
    them, in a table."""
    held = cut(hashes.groupBy("k").agg(*[F.first(c).alias(c) for c in ("id", "host", "path", "ours", "inside")]), "pages")
    near = neighbours(held.select("k", "id", "host", "path"))
    theirs = near.join(held.select(F.col("k").alias("_k"), F.col("ours").alias("theirs")), F.col("near") == F.col("_k")).select(F.col("k").alias("_k"), "theirs")
    rows = held.join(theirs, F.col("k") == F.col("_k")).select("k", "host", "ours", "inside", "theirs", F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("int").alias("salt"))
    usual = usual_lines(held).select(F.col("host").alias("_h"), "usual", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    rows = rows.join(usual, (F.col("host") == F.col("_h")) & (F.col("salt") == F.col("_s")), "left").select("k", "ours", "inside", "theirs", "usual")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            gone = [template(*x) for x in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)]
            made = pa.RecordBatch.from_arrays([b.column(0), pa.array(gone, pa.list_(pa.int32()))], ["k", "gone"])
            yield made.filter(pa.array([bool(x) for x in gone]))

    return rows.mapInArrow(run, "k binary, gone array<int>")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text: the main text of every page."""
    source = keyed(pages, key, url, html)
    gone = cut(templates(line_hashes(source)).withColumnRenamed("k", "_k"), "gone")
    size = gone.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()[0]
    small_batches(pages.sparkSession)
    source = source.select("k", "id", "url", "html")
    schema = source.drop("html").schema.add("kept", T.ArrayType(T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = pa.array([main_lines(t) for t in b.column(3).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], got], schema.names)

    both = source.mapInArrow(run, schema).join(F.broadcast(gone) if size <= MOST_SENT else gone.hint("shuffle_hash"), F.col("k") == F.col("_k"), "left")
    left = F.when(F.col("gone").isNull(), F.col("kept")).otherwise(F.expr("filter(kept, (x, i) -> not array_contains(gone, i))"))
    return both.select(F.col("id").alias(key), F.col("url").alias(url), F.array_join(left, " ").alias("text"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page and its length."""
    got = extract(table(spark, sf_dir, "pages"))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
