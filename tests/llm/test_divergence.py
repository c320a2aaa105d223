"""The divergence audit against brute force, and its skyband against all pairs."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import pytest

from callsight.llm import divergence

SCHEMA = "text string, lang string, source string, n int, term string, at string"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(rows, k, least):
    docs, counts, places = Counter(), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        places[lang].add(source)
        counts[lang, source].update(words(text))
        docs.update({(lang, word) for word in words(text)})
    out = []
    for lang, sources in places.items():
        kept = [word for (l, word), n in docs.items() if l == lang and n >= least]

        def shares(count):
            total = sum(count[word] for word in kept)
            return {w: 1 + floor(Fraction(10**9 * (count[w] + 2), total + 2 * len(kept))) for w in kept}

        f = lambda p, q: floor(Fraction((p - q) ** 2, p + q))
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        for source in sources:
            own = shares(counts[lang, source])
            pairs = []
            for other in sources - {source}:
                theirs = shares(counts[lang, other])
                pairs.append((-sum(f(own[w], theirs[w]) for w in kept), other.encode()))
            terms = [(-f(own[w], whole[w]), w.encode()) for w in kept if counts[lang, source][w] and own[w] > whole[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:k])):
                out += [(lang, source, part, item.decode(), -value, at + 1) for at, (value, item) in enumerate(found)]
    return sorted(out)


def audited(spark, rows, **limits):
    frame = spark.createDataFrame([(*row, 1, "x", "y") for row in rows], SCHEMA)
    return sorted(map(tuple, divergence.audit(frame, **limits).collect()))


@pytest.mark.parametrize("tile, terms, chunk", [(128, 4096, 20_000), (2, 3, 40)])
def test_audit_is_exact(spark, monkeypatch, tile, terms, chunk):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(divergence, "HELD", 16)
    rng = random.Random(3)
    vocabulary = [f"w{chr(97 + at % 26)}{'é' * (at % 3)}{chr(97 + at // 26)}" for at in range(60)]
    rows = [(None, None, None), ("", "en", None), ("Lone WORDS", "xx", "a"), ("Lone", "xx", "b"), ("　\x7fA1B_é", "en", "")]
    for at in range(150):
        source, lang = rng.choice(["a", "b", "c", "d", "É", None]), rng.choice(["en", "de", None])
        shift = hash((source, lang)) % 20
        rows.append((" ".join(rng.choice(vocabulary[shift : shift + 30]).title() for _ in range(rng.randint(0, 30))), lang, source))
    rows += [rows[-1]] * 3
    assert audited(spark, rows, k=4, least_docs=3) == brute(rows, 4, 3)


def test_nothing(spark):
    assert audited(spark, []) == []
    assert audited(spark, [("a", "en", "x")]) == []
    assert audited(spark, [("a", "en", "x"), (None, "en", "y")]) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_skyband_keeps_all_that_few_dominate():
    rng = random.Random(4)
    for _ in range(40):
        rows = [(rng.randint(1, 9), rng.randint(1, 9), b"%d" % at) for at in rng.sample(range(1000), 60)]
        rows.sort(key=lambda row: (-row[0], row[1], row[2]))
        band = divergence.Skyband(3)
        kept = [row for row in rows if band.keeps(row[1], row[2])]
        above = lambda a, b: a != b and a[0] >= b[0] and a[1] <= b[1] and a[2] <= b[2]
        assert kept == [row for row in rows if sum(above(other, row) for other in rows) < 3]


def test_counts_beyond_sixty_four_bits_stay_exact(spark):
    count, total, terms = 9 * 10**15, 10**16 + 7, 1000
    frame = spark.createDataFrame([(count, total, terms), (5, 5, 0)], "n long, total long, terms long")
    got = [row.p for row in frame.select(divergence.share(frame.n, frame.total, frame.terms).alias("p")).collect()]
    assert got == [1 + 10**9 * (count + 2) // (total + 2 * terms), 0]
