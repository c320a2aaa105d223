"""Periodic runs of words, found by recursive frequency splitting.

A run of period q holds every one of its words at least four times. A word that occurs less often within
the segment at hand can therefore be in no run there: it splits the segment, which makes further words
rare. Splitting goes on until nothing moves, in a time near to the length of the text: a split recounts
its smaller pieces, the largest keeps the counts less what left. Ordinary prose dissolves that way.

Surviving segments are scanned lag by lag. A stretch of 3q equal places at lag q covers three multiples
of q in a row, so only multiples are compared first; what is left is compared in full and extended.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsight.llm.common import column, table

#: A run has this many words, and this many periods, or more.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Places at which a candidate is compared before it is compared in full.
PROBES = 16


def least_length(period: int) -> int:
    return max(LEAST_WORDS, LEAST_PERIODS * period)


def segments(words: list[bytes]) -> list[tuple[int, int]]:
    """The pieces (begin, end) in which every word occurs often enough to be in a run."""
    places: dict[bytes, list[int]] = {}
    for at, word in enumerate(words):
        places.setdefault(word, []).append(at)
    stable = []
    counts = {word: len(at) for word, at in places.items()}
    work = [(0, len(words), counts, counts.keys())]  # a piece, its counts, the words whose count is new
    while work:
        begin, end, counts, changed = work.pop()
        if end - begin < LEAST_WORDS:
            continue
        cuts = []
        for word in changed:
            if 0 < counts[word] < LEAST_PERIODS:
                first = bisect_left(places[word], begin)
                cuts += places[word][first : first + counts[word]]
        if not cuts:
            stable.append((begin, end))
            continue
        cuts.sort()
        pieces = [piece for piece in zip([begin, *(at + 1 for at in cuts)], [*cuts, end]) if piece[0] < piece[1]]
        if not pieces:
            continue  # every word was cut
        largest = max(pieces, key=lambda piece: piece[1] - piece[0])
        lost = Counter(words[at] for at in cuts)
        for piece in pieces:
            if piece is largest:
                continue
            inside = words[piece[0] : piece[1]]
            lost.update(inside)
            if len(inside) >= LEAST_WORDS:
                own = Counter(inside)
                work.append((*piece, own, own.keys()))
        for word, times in lost.items():
            counts[word] -= times
        work.append((*largest, counts, lost.keys()))
    return stable


def _equal_until(left: np.ndarray, right: np.ndarray) -> int:
    """How many leading places of two arrays are equal; looks at little more than these."""
    at, step, size = 0, 32, min(len(left), len(right))
    while at < size:
        same = left[at : at + step] == right[at : at + step]
        if not same.all():
            return at + int(same.argmin())
        at += len(same)
        step *= 2
    return size


def scan(x: np.ndarray) -> list[tuple[int, int, int]]:
    """start, length, period of every run in a segment of word numbers."""
    size, found, ends = len(x), [], set()
    long_runs: list[tuple[int, int, int]] = []  # begin, end, period of runs that may cover candidates
    for q in range(1, size // LEAST_PERIODS + 1):
        if least_length(q) > size:
            break
        same = x[0 : size - q : q] == x[q::q]
        at = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * q
        if not len(at):
            continue
        long_runs = [run for run in long_runs if run[1] - run[0] >= 3 * q]
        for begin, end, period in long_runs:
            if q % period == 0:  # what a run covers has its period
                at = at[(at < begin) | (at + 3 * q > end)]
        probes = np.linspace(0, 2 * q, PROBES).astype(np.int64)
        if len(at):
            at = at[(x[at[:, None] + probes] == x[at[:, None] + probes + q]).all(axis=1)]
        passed = 0
        for place in at.tolist():
            if place < passed:
                continue
            right = place + _equal_until(x[place : size - q], x[place + q :])
            passed = right
            if right - place < 2 * q:
                continue
            left = place - _equal_until(x[:place][::-1], x[q : q + place][::-1])
            end = right + q
            # A run of this extent that is known has a period that divides q.
            if end - left >= least_length(q) and (left, end) not in ends:
                ends.add((left, end))
                found.append((left, end - left, q))
                long_runs.append((left, end, q))
    return found


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """start, length, period of every run of a text, by start, then period."""
    found = []
    for begin, end in segments(words):
        number: dict[bytes, int] = {}
        x = np.fromiter((number.setdefault(word, len(number)) for word in words[begin:end]), np.int64, end - begin)
        found += [(begin + start, length, period) for start, length, period in scan(x)]
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return [words[at] for at in np.flatnonzero(np.cumsum(step[:-1]) == 0)]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words as the contract alters them: of every tenth document, by a checksum, a tail is made periodic."""
    if doc_id is None or not words:
        return words
    check = zlib.crc32(str(doc_id).encode())
    if check % 10:
        return words
    rest, n = check // 10, len(words)
    begin = rest % n
    period = 1 + (n - begin) // (3 + rest % 8)
    return words[:begin] + [words[begin + (at - begin) % period] for at in range(begin, n)]


def with_runs(documents: DataFrame, alter=None) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, collapsed for every row.

    Words are what ASCII white space parts; a null text has none. A run is a stretch of
    ``max(6, 4 * period)`` words or more whose words ``period`` apart are equal, as long as it gets, named
    by its smallest period. The longest run is shown (ties: smallest start, then period), nulls if there
    is none; ``collapsed`` is the text without repeats, its words joined by one space, never null.
    ``alter(words, doc_id)`` may change the words first. Rows are judged one by one: repeated rows give
    repeated results, a null doc_id stays null, other columns are not read.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(column(batch, "doc_id"), column(batch, "text").cast(pa.binary())):
                words = (text.as_py() or b"").split()  # of bytes: ASCII white space only
                if alter:
                    words = alter(words, doc_id.as_py())
                runs = runs_of(words)
                best = min(runs, key=lambda run: (-run[1], run[0], run[2])) if runs else (None, None, None)
                listed = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
                rest = b" ".join(collapsed(words, runs))
                rows.append(
                    (
                        len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(rest).hexdigest(), rest,
                    )
                )
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.binary()]
            arrays = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)] if rows else [pa.array([], kind) for kind in kinds]
            arrays[-1] = arrays[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *arrays], names=names)

    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed"]
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(find, ", ".join(f"{name} {'string' if at > 5 else 'long'}" for at, name in enumerate(names)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), planted).drop("collapsed")
