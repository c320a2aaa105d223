"""Alignment against brute force, and pages that are very deep or very wide."""

import random
import time
from itertools import combinations

from callsight.llm import wrappers


def longest(left, right):
    """Length of a longest common subsequence, by trying all."""
    for size in range(min(len(left), len(right)), 0, -1):
        parts = {tuple(left[at] for at in chosen) for chosen in combinations(range(len(left)), size)}
        if any(tuple(right[at] for at in chosen) in parts for chosen in combinations(range(len(right)), size)):
            return size
    return 0


def check(left, right, pairs):
    assert all(left[i] == right[j] for i, j in pairs)
    assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))


def test_children_are_aligned_like_brute_force(monkeypatch):
    rng = random.Random(1)
    for _ in range(200):
        left, right = ([rng.choice("abc") for _ in range(rng.randint(0, 7))] for _ in range(2))
        pairs = wrappers.common(left, right)
        check(left, right, pairs)
        assert len(pairs) == longest(left, right)
    monkeypatch.setattr(wrappers, "TABLE_CELLS", 0)
    for _ in range(200):
        left, right = ([rng.choice("abcdef") for _ in range(rng.randint(0, 9))] for _ in range(2))
        check(left, right, wrappers.common(left, right))
    assert wrappers.common(list("abcxyz"), list("abcdxyz")) == [(0, 0), (1, 1), (2, 2), (3, 4), (4, 5), (5, 6)]


def nodes(wrapper):
    waiting = [wrapper]
    while waiting:
        node = waiting.pop()
        yield node
        waiting += node[5]


def test_deep_pages_keep_every_text():
    deep = lambda tag, says: "<html><body>" + f"<{tag}>" * 5000 + says + f"</{tag}>" * 5000 + "<article><p>Kept.</p></article>"
    for tag in ("div", "span", "b"):
        started = time.time()
        one, two = wrappers.wrapper_of(deep(tag, "one")), wrappers.wrapper_of(deep(tag, "two"))
        both = wrappers.aligned(one, two)
        assert sum(node[0] == "#" for node in nodes(both)) == 2
        assert wrappers.rules_of(both)["place"] == wrappers.ARTICLE
        assert wrappers.text_of(deep(tag, "one")) == "Kept."
        assert time.time() - started < 30
    assert wrappers.text_of("<body>" + "<div>" * 5000 + "all of it") == "all of it"


def test_wide_pages_end_soon():
    wide = lambda salt: "".join(f"<div class='{salt}{'x' * (at % 7)}{chr(97 + at % 26)}{chr(97 + at // 26 % 26)}{chr(97 + at // 676 % 26)}'>t</div>" for at in range(60_000))
    started = time.time()
    both = wrappers.aligned(wrappers.wrapper_of(wide("a")), wrappers.wrapper_of(wide("b")))
    same = wrappers.aligned(wrappers.wrapper_of(wide("a")), wrappers.wrapper_of("<p>first</p>" + wide("a")))
    assert len(both[5]) > len(same[5]) > 0
    assert time.time() - started < 60


def test_deep_pages_in_spark(spark):
    deep = "<html><body>" + "<div>" * 3000 + "inside" + "</div>" * 3000 + "</body></html>"
    rows = [(at, "https://a.example/%d" % at, deep) for at in range(4)] + [(9, "https://a.example/9", "<article>Text</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {row.page_id: row.text for row in wrappers.extracted(pages).collect()}
    assert got == {0: "inside", 1: "inside", 2: "inside", 3: "inside", 9: "Text"}
