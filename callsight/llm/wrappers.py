"""Main text by wrappers: union-free expressions inferred from the pages of a host.

The token streams of a host's pages are aligned one after the other. Where a page and the wrapper
disagree, the elements on either side become optional; like elements, or groups of them, in a row
become a repeated group; texts that differ become a slot. What is left as fixed text is the host's
template. The wrapper tells where the host keeps its articles, and a second pass over the pages reads
them there.

Wrappers are folded inside each partition first, then over a fixed number of salts, then by host, so
no task ever holds the pages of a host.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callsight.llm.common import column, groups, settle, shuffle_width, small, table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
    "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
    "time", "tt", "u", "var", "wbr",
}
CLOSED_BY_ITSELF = {"li", "dt", "dd", "tr", "td", "th", "option", "p"}
#: Elements that never hold the article.
ASIDE = RAW | {
    "head", "nav", "footer", "aside", "form", "svg", "math", "button", "select", "object", "canvas", "dialog", "menu",
    "audio", "video", "map", "datalist", "fieldset",
}
ASIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "promotion", "sidebar",
    "side", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "cookie",
    "cookies", "consent", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "comment", "comments",
    "disqus", "discussion", "replies", "reply", "respond", "social", "share", "sharing", "related", "recommended",
    "newsletter", "subscribe", "subscription", "signup", "login", "search", "widget", "toolbar", "pagination", "pager",
    "gdpr", "paywall", "complementary", "contentinfo", "form",
}
MAIN_WORDS = {"article", "content", "main", "post", "entry", "story", "body", "text"}
WORD = re.compile(r"[a-z]+")

ARTICLE, MAIN, CONTENT, BODY = "article", "main", "content", "body"


def _names(attributes: str) -> tuple[set[str], str, bool]:
    """The words of class, id and role, the classes as written, and whether the element is hidden."""
    words: set[str] = set()
    classes, hidden = "", False
    if attributes and "=" in attributes or "hidden" in attributes.lower():
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            value, name = (a or b or c).lower(), name.lower()
            if name in ("class", "id", "role"):
                words |= set(WORD.findall(value))
                classes += "." + re.sub(r"\d+", "", value)
            elif name == "hidden" or value == "true":
                hidden = True
    return words, classes, hidden


def events(html: str) -> Iterator[tuple]:
    """(open, tag, words, classes, hidden), (close, tag) and (text, characters) of a page; raw content is left out."""
    at, end = 0, len(html)
    while at < end:
        found = TOKEN.search(html, at)
        if not found:
            yield ("text", html[at:])
            return
        if found.start() > at:
            yield ("text", html[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            yield ("close", tag)
            continue
        yield ("open", tag, *_names(found[3]))
        if tag in RAW and not found[3].rstrip().endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(html, at)
            at = close.end() if close else end
            yield ("close", tag)
        elif tag in VOID or found[3].rstrip().endswith("/"):
            yield ("close", tag)


class Open:
    """The elements open at a place of the page, closed the way browsers close them."""

    def __init__(self) -> None:
        self.tags: list[str] = []

    def opened(self, tag: str) -> int:
        """How many elements a new one closes."""
        closes = 0
        if tag not in INLINE:
            for back, other in enumerate(reversed(self.tags), 1):
                if other == "p" or other == tag and tag in CLOSED_BY_ITSELF:
                    closes = back
                    break
                if other not in INLINE:
                    break
        del self.tags[len(self.tags) - closes :]
        self.tags.append(tag)
        return closes

    def closed(self, tag: str) -> int:
        for back, other in enumerate(reversed(self.tags), 1):
            if other == tag:
                del self.tags[len(self.tags) - back :]
                return back
            if tag in INLINE and other not in INLINE:
                return 0
        return 0


# A wrapper is [sign, optional, repeated, pages, text, children]; a text has the sign "#" and, until
# two texts differ, the hash of what it says.


def _element(sign: str, children: list) -> list:
    return [sign, False, False, 1, None, children]


def _group_size(signs: list[str], at: int) -> int:
    for size in range(1, 5):
        if at + 2 * size <= len(signs) and signs[at : at + size] == signs[at + size : at + 2 * size]:
            return size
    return 0


def folded(children: list) -> list:
    """Like elements, or like groups of up to four, in a row become one that is repeated."""
    out: list = []
    signs = [child[0] for child in children]
    at = 0
    while at < len(children):
        size = _group_size(signs, at)
        if not size:
            out.append(children[at])
            at += 1
            continue
        group, like = children[at : at + size], signs[at : at + size]
        at += size
        while signs[at : at + size] == like:
            group = [aligned(a, b, same_page=True) for a, b in zip(group, children[at : at + size])]
            at += size
        for child in group:
            child[2] = True
        out += group
    return out


#: Children are aligned by a full table up to this many cells, beyond by occurrence.
TABLE_CELLS = 250_000
#: Elements nested deeper stand in the wrapper beside their parents.
DEPTH = 150


def _longest_common(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence."""
    table_ = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i in range(len(left) - 1, -1, -1):
        for j in range(len(right) - 1, -1, -1):
            same = left[i] == right[j]
            table_[i][j] = table_[i + 1][j + 1] + 1 if same else max(table_[i + 1][j], table_[i][j + 1])
    pairs, i, j = [], 0, 0
    while i < len(left) and j < len(right):
        if left[i] == right[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif table_[i + 1][j] >= table_[i][j + 1]:
            i += 1
        else:
            j += 1
    return pairs


def _by_occurrence(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Places of a common subsequence in which the n-th of a sign meets the n-th: the longest rising run of these."""
    seen: dict[str, int] = {}
    places = {}
    for j, sign in enumerate(right):
        seen[sign] = seen.get(sign, 0) + 1
        places[sign, seen[sign]] = j
    seen.clear()
    met = []
    for i, sign in enumerate(left):
        seen[sign] = seen.get(sign, 0) + 1
        if (sign, seen[sign]) in places:
            met.append((i, places[sign, seen[sign]]))
    ends: list[int] = []  # least end of a rising run of each length, and for every pair the one before it
    holders: list[int] = []
    before = []
    for at, (_, j) in enumerate(met):
        length = bisect_left(ends, j)
        before.append(holders[length - 1] if length else -1)
        ends[length : length + 1] = [j]
        holders[length : length + 1] = [at]
    pairs, at = [], holders[-1] if holders else -1
    while at >= 0:
        pairs.append(met[at])
        at = before[at]
    return pairs[::-1]


def common(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Places at which two rows of signs are matched, in order: equal ends first, then what lies between."""
    least = min(len(left), len(right))
    begin = 0
    while begin < least and left[begin] == right[begin]:
        begin += 1
    end = 0
    while end < least - begin and left[-1 - end] == right[-1 - end]:
        end += 1
    inner = left[begin : len(left) - end], right[begin : len(right) - end]
    between = _longest_common if len(inner[0]) * len(inner[1]) <= TABLE_CELLS else _by_occurrence
    pairs = [(at, at) for at in range(begin)]
    pairs += [(begin + i, begin + j) for i, j in between(*inner)]
    return pairs + [(len(left) - at, len(right) - at) for at in range(end, 0, -1)]


def aligned(a: list, b: list, same_page: bool = False) -> list:
    """The wrapper of both; the two have one sign."""
    if a[0] == "#":
        text = a[4] if a[4] == b[4] else None
        return ["#", a[1] or b[1], a[2] or b[2], a[3] if same_page else a[3] + b[3], text, []]
    left, right = a[5], b[5]
    children: list = []
    i = j = 0
    for to_i, to_j in [*common([c[0] for c in left], [c[0] for c in right]), (len(left), len(right))]:
        children += [[c[0], True, *c[2:]] for c in [*left[i:to_i], *right[j:to_j]]]
        if to_i < len(left):
            children.append(aligned(left[to_i], right[to_j], same_page))
        i, j = to_i + 1, to_j + 1
    pages = a[3] if same_page else a[3] + b[3]
    return [a[0], a[1] or b[1], a[2] or b[2], pages, None, folded(children)]


def said(text: str) -> str:
    return " ".join(unescape(text).split())


def text_key(text: str) -> str:
    return xxhash.xxh3_64_hexdigest(text.encode("utf-8", "surrogatepass"))


def wrapper_of(html: str) -> list:
    """The wrapper of one page. Elements that never hold the article have no inside."""
    root = _element("page", [])
    stack, open_ = [root], Open()

    def close(count: int) -> None:
        for _ in range(count):
            done = stack.pop()
            if done is not stack[-1]:
                done[5] = [] if _apart(done[0].split(".")[0], set(WORD.findall(done[0]))) else folded(done[5])

    for event in events(html):
        if event[0] == "text":
            if not event[1].isspace():
                stack[-1][5].append(["#", False, False, 1, event[1], []])
        elif event[0] == "open":
            close(open_.opened(event[1]))
            node = _element(event[1] + event[3], [])
            stack[-1][5].append(node)
            # Beyond the depth, what is inside of an element follows it.
            stack.append(node if len(stack) < DEPTH else stack[-1])
        else:
            close(open_.closed(event[1]))
    close(len(stack) - 1)
    root[5] = folded(root[5])
    left = [root]
    while left:
        node = left.pop()
        left += node[5]
        if node[4] is not None:
            node[4] = text_key(said(node[4]))
    return root


def _apart(tag: str, words: set[str]) -> bool:
    return tag in ASIDE or bool(words & ASIDE_WORDS) and tag not in ("html", "body", "article", "main")


def rules_of(wrapper: list) -> dict:
    """Where the host keeps its articles, and the texts of its template outside of marked articles."""
    kinds: set[str] = set()
    fixed: list[str] = []

    waiting = [wrapper]
    while waiting:
        node = waiting.pop()
        tag, words = node[0].split(".")[0], set(WORD.findall(node[0]))
        if node[0] == "#":
            if node[4] and not node[2] and node[3] >= 5 and node[3] >= 0.9 * wrapper[3]:
                fixed.append(node[4])
            continue
        if _apart(tag, words):
            continue
        if tag == "article":
            kinds.add(ARTICLE)
        elif tag == "main" or "role" in words or tag not in ("html", "body") and words == {tag, "main"}:
            kinds.add(MAIN)
        elif tag in ("div", "section", "td") and words & MAIN_WORDS:
            kinds.add(CONTENT)
        waiting += node[5]
    where = next((kind for kind in (ARTICLE, MAIN, CONTENT) if kind in kinds), BODY)
    return {"place": where, "fixed": fixed if where == BODY else []}


def _is_place(kind: str, tag: str, words: set[str]) -> bool:
    if kind == ARTICLE:
        return tag == "article"
    if kind == MAIN:
        return tag == "main" or "main" in words
    return kind == CONTENT and tag in ("div", "section", "td") and bool(words & MAIN_WORDS)


def text_of(html: str, place: str = ARTICLE, fixed: frozenset[str] = frozenset()) -> str:
    """The main text of a page whose wrapper keeps articles at ``place``; a page without it is read whole."""
    inside: list[str] = []
    outside: list[str] = []
    block: list[str] = []
    open_, depth_apart, depth_place = Open(), 0, 0  # depths at which the region began, 0 for none

    def end() -> None:
        text = said("".join(block))
        block.clear()
        if text:
            if depth_place:
                inside.append(text)
            elif not fixed or text_key(text) not in fixed:
                outside.append(text)

    for event in events(html):
        if event[0] == "text":
            if not depth_apart:
                block.append(event[1])
            continue
        tag = event[1]
        if not depth_apart and tag not in INLINE:
            end()
        if event[0] == "open":
            if tag == "br":
                block.append(" ")
            open_.opened(tag)
            depth = len(open_.tags)
            if depth_apart and depth <= depth_apart:
                depth_apart = 0
            if depth_place and depth <= depth_place:
                depth_place = 0
            words = event[2]
            if not depth_apart:
                in_header = tag == "header" and not depth_place
                if _apart(tag, words) or in_header or event[4]:
                    depth_apart = depth
                    if tag in INLINE:
                        block.append(" ")
                elif not depth_place and _is_place(place, tag, words):
                    depth_place = depth
        else:
            open_.closed(tag)
            depth = len(open_.tags)
            if depth_apart and depth < depth_apart:
                depth_apart = 0
            if depth_place and depth < depth_place:
                depth_place = 0
    end()
    return "\n\n".join(inside or outside)


def host_of(url: str) -> Column:
    pattern = r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
    return F.lower(F.coalesce(F.regexp_extract(url, pattern, 1), F.lit("")))


def host_rules(pages: DataFrame, salts: int = 16) -> DataFrame:
    """host, place, fixed: the wrapper of every host of ``pages`` (url, html), told in what extraction needs."""
    parts = shuffle_width(pages.sparkSession)
    schema = "host string, wrapper string"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())],
                names=["host", "wrapper"],
            )

        for batch in batches:
            for host, html in zip(column(batch, "host").to_pylist(), column(batch, "html").to_pylist()):
                mine = wrapper_of(html or "")
                held[host] = aligned(held[host], mine) if host in held else mine
                if len(held) >= 2000:
                    yield out()
                    held = {}
        if held:
            yield out()

    def folding(keys: list[str]):
        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in groups(batches, keys):
                held = None
                for text in group.column("wrapper").to_pylist():
                    held = aligned(held, json.loads(text)) if held else json.loads(text)
                host = group.column("host")[0].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([host]), pa.array([json.dumps(held)])], names=["host", "wrapper"])

        return fold

    @F.pandas_udf("struct<place string, fixed array<string>>")
    def told(wrappers: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rules_of(json.loads(text)) for text in wrappers], columns=["place", "fixed"])

    local = pages.select(host_of("url").alias("host"), "html").mapInArrow(first, schema)
    some = (
        local.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .repartition(parts, "host", "salt")
        .sortWithinPartitions("host", "salt", "wrapper")
        .mapInArrow(folding(["host", "salt"]), schema)
    )
    whole = some.repartition(parts, "host").sortWithinPartitions("host", "wrapper").mapInArrow(folding(["host"]), schema)
    return whole.select("host", told("wrapper").alias("r")).select("host", "r.place", "r.fixed")


def extracted(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text`` (the main text, empty if there is none) and ``n_chars``, its code points.

    Blocks are joined by two line breaks; white space inside a block is one space. A null or empty
    html has an empty text; pages without a readable host share one wrapper. Broken html is read as
    far as it goes. Columns of these names are replaced, all others and all rows stay.
    """
    rules = settle(host_rules(pages)).select(F.col("host").alias("__host"), "place", "fixed")

    @F.pandas_udf("string")
    def text(html: pd.Series, place: pd.Series, fixed: pd.Series) -> pd.Series:
        return pd.Series(
            [text_of(h or "", p or ARTICLE, frozenset(f) if f is not None else frozenset()) for h, p, f in zip(html, place, fixed)],
            dtype=object,
        )

    rows = pages.withColumn("__host", host_of("url")).join(small(rules, 100_000), "__host", "left")
    keep = [name for name in pages.columns if name not in ("text", "n_chars")]
    found = rows.withColumn("__text", text("html", "place", "fixed"))
    return found.select(*keep, F.col("__text").alias("text"), F.length("__text").cast("long").alias("n_chars"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", "url", "text", "n_chars"
    )
