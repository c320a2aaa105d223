"""Runs against brute force."""

import hashlib
import random
import re
import zlib

import pytest

from callsight.llm import runs


def brute(words):
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - at + q
            if end > at and length >= max(6, 4 * q) and (at, length) not in found:
                found[at, length] = q
            at = max(end, at) + 1
    return sorted(((s, l, q) for (s, l), q in found.items()), key=lambda run: (run[0], run[2]))


def texts(seed):
    rng = random.Random(seed)
    for _ in range(150):
        words = []
        for _ in range(rng.randint(0, 6)):
            kind, letters = rng.random(), "abcdefghij"[: rng.randint(1, 10)]
            piece = [rng.choice(letters) for _ in range(rng.randint(1, 12))]
            words += piece * rng.randint(1, 9) if kind < 0.6 else piece
            words += piece[: rng.randint(0, len(piece))]
            if kind > 0.9:
                words += [str(rng.random())]
        yield [word.encode() for word in words]


@pytest.mark.parametrize("seed", range(8))
def test_runs_are_those_of_brute_force(seed):
    for words in texts(seed):
        assert runs.runs_of(words) == brute(words), words


def test_two_words_at_random_and_long_periods():
    rng = random.Random(5)
    words = [rng.choice([b"a", b"b"]) for _ in range(1500)]
    assert runs.runs_of(words) == brute(words)
    period = [str(at).encode() for at in range(400)]
    words = [b"x"] * 7 + period * 4 + period[:17] + [b"y", b"z"] * 5
    assert runs.runs_of(words) == [(0, 7, 1), (7, 1617, 400), (1624, 10, 2)] == brute(words)
    words = [b"same"] * 60_000
    assert runs.runs_of(words) == [(0, 60_000, 1)]


def test_rare_words_split_to_stability():
    prose = [str(at % 50).encode() for at in range(140)]
    assert runs.segments(prose) == []
    words = prose + [b"on", b"and"] * 6 + [b"other" + word for word in prose]
    assert runs.segments(words) == [(140, 152)]
    many = [b"w%d" % (at // 3) for at in range(60_000)] + [b"go"] * 8  # every word is rare
    assert runs.segments(many) == [(60_000, 60_008)]


def test_a_deep_cascade_of_splits_ends_soon():
    """Each split makes the word at the end of the largest piece rare: as many rounds as words."""
    words = []
    for at in range(8000):
        words += [b"w%d" % at, b"w%d" % (at + 1)]
    words = words + words[::-1]
    assert runs.runs_of(words) == brute_lags(words, 12)


def brute_lags(words, most):
    found = {}
    for q in range(1, most + 1):
        at = 0
        while at + q < len(words):
            end = at
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            if end - at + q >= max(6, 4 * q) and (at, end - at + q) not in found:
                found[at, end - at + q] = q
            at = max(end, at) + 1
    return sorted(((s, l, q) for (s, l), q in found.items()), key=lambda run: (run[0], run[2]))


def _expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    dropped = {i for s, l, q in found for i in range(s + q, s + l)}
    best = min(found, key=lambda run: (-run[1], run[0], run[2])) if found else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
        sha("".join(f"{s},{l},{q}\n" for s, l, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_query_in_spark(spark):
    rng, rows = random.Random(1), [(None, "a " * 9), (None, None), (10**15, ""), (-7, " \t\n"), (5, "\x1c a\x85b　é " * 8)]
    rows += [(5, "\x1c a\x85b　é " * 8)]
    for at in range(120):
        rows.append((at, " ".join(rng.choice("abcde") * rng.randint(1, 2) for _ in range(rng.randint(1, 120)))))
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start int, period string")
    got = runs.with_runs(frame, runs.planted).drop("collapsed").collect()
    key = lambda row: tuple((v is not None, v) for v in row)
    assert sorted(map(tuple, got), key=key) == sorted((_expected(*row) for row in rows), key=key)
    empty = spark.createDataFrame([], frame.schema)
    assert runs.with_runs(empty).count() == 0


def test_whole_table(spark, sf):
    got = {row[0]: tuple(row) for row in runs.query(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    short = [row for row in docs if len(row.text or "") < 6000]
    assert len(short) > 150
    for row in short:
        assert got[row.doc_id] == _expected(row.doc_id, row.text)
