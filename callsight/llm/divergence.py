"""How the sources of a language differ in their words.

Words are counted once, by (lang, source, term), on one shuffle by (lang, term); a window over the same
key gives each term's count in the whole language. From there:

* the terms a group uses most beyond its language come from dominance skybands: a term that k others
  dominate (no lower count in the group, no higher count in the language, earlier name) cannot be among
  the k first, whatever the totals are. Every partition keeps the skyband of what it holds; the skyband
  of all is within their union, which is small and ranked exactly.
* the distance of two sources is summed over all terms, in dense tiles of sources by terms. Terms that
  no source of a tile has add the same amount each, so they are counted, not visited.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callsight.llm.common import column, groups, settle, shuffle_width, table

#: Every byte that is no part of a word becomes a blank, A to Z become a to z.
_LETTERS = bytes(
    byte + 32 if 65 <= byte <= 90 else byte if 97 <= byte <= 122 or byte >= 128 else 32 for byte in range(256)
)
#: Counts that a task holds before it passes them on; rows of kept terms in a chunk; sources in a tile; terms summed at a time.
HELD, CHUNK_ROWS, TILE, TERMS = 300_000, 20_000, 128, 4096
SCALE = 1_000_000_000


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs: summed as far as memory is set; a row without term names each group."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (often, docs) in held.items():
            names = [b"", *often]
            for at in range(0, len(names), 50_000):
                part = names[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(part), pa.string()),
                        pa.array([source] * len(part), pa.string()),
                        pa.array(part, pa.binary()).cast(pa.string()),
                        pa.array([often[x] for x in part], pa.int64()),
                        pa.array([docs[x] for x in part], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )
        held.clear()

    for batch in batches:
        groups_ = zip(column(batch, "lang").to_pylist(), column(batch, "source").to_pylist())
        for group, text in zip(groups_, column(batch, "text").cast(pa.binary())):
            often, docs = held.setdefault(group, (Counter(), Counter()))
            found = terms_of(text.as_py())
            often.update(found)
            docs.update(set(found))
            if len(docs) > HELD // 8 and sum(len(x) for _, x in held.values()) > HELD:
                yield from out()
    yield from out()


def term_counts(documents: DataFrame, least_docs: int) -> DataFrame:
    """lang, source, term, n, lang_n, first for every group's kept terms, and a row with term '' and n = 0 for every group.

    ``first`` marks one row of each (lang, term).
    """
    rows = documents.select(*(F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name) for name in ("lang", "source", "text")))
    found = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    width = shuffle_width(documents.sparkSession)
    # Hashed by a part of the grouping: the counts, the window and its sort need no other shuffle.
    counts = found.repartition(width, "lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    return (
        counts.withColumn("lang_n", F.sum("n").over(of_term))
        .withColumn("all_docs", F.sum("docs").over(of_term))
        .withColumn("first", F.col("source") == F.min("source").over(of_term))
        .where((F.col("all_docs") >= least_docs) | (F.col("term") == ""))
        .select("lang", "source", "term", "n", "lang_n", "first")
    )


def totals_of(counts: DataFrame) -> DataFrame:
    """lang, source, total, lang_total, terms, at (place of the source in its language) for every group."""
    word = F.col("term") != ""
    by_group = settle(
        counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(word & F.col("first")).alias("firsts"))
    )
    by_lang = by_group.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("firsts").alias("terms"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return settle(by_group.join(by_lang, "lang").select("lang", "source", "total", "lang_total", "terms", place.alias("at")))


def share(count: Column, total: Column, terms: Column) -> Column:
    """The smoothed share of a term in parts of a billion, exactly; 0 where a language keeps no term."""
    wide = (count.cast("decimal(20,0)") + 2) * F.lit(SCALE).cast("decimal(10,0)")
    whole = F.call_function("div", wide, (total.cast("decimal(20,0)") + 2 * terms).cast("decimal(21,0)"))
    return F.when(terms > 0, 1 + whole).otherwise(F.lit(0)).cast("long")


def divergence(p: Column, q: Column) -> Column:
    return F.when(p + q > 0, F.call_function("div", (p - q) * (p - q), p + q)).otherwise(F.lit(0)).cast("long")


class Skyband:
    """Rows (lang count, name), given by falling group count, that fewer than ``k`` others dominate.

    It is enough to look among the rows kept: of all that dominate a row, the first k are kept.
    """

    def __init__(self, k: int):
        self.k, self.kept = k, []

    def keeps(self, lang_n: int, name: bytes) -> bool:
        above = 0
        for other_n, other in self.kept:
            if other_n <= lang_n and other < name:
                above += 1
                if above == self.k:
                    return False
        self.kept.append((lang_n, name))
        return True


def skybands(counts: DataFrame, k: int) -> DataFrame:
    """The rows of ``counts`` that may be among the ``k`` first of their group: a skyband of each partition."""

    def retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, band = None, Skyband(k)
        for batch in batches:
            chosen = []
            langs, sources, terms = (column(batch, name).to_pylist() for name in ("lang", "source", "term"))
            for at, (lang, source, term, n) in enumerate(zip(langs, sources, terms, column(batch, "lang_n").to_pylist())):
                if (lang, source) != last:
                    last, band = (lang, source), Skyband(k)
                if band.keeps(n, term.encode()):
                    chosen.append(at)
            yield batch.take(pa.array(chosen, pa.int64()))

    fields = ["lang", "source", "term", "n", "lang_n"]
    words = counts.where("term <> '' and n > 0").select(*fields)
    order = ["lang", "source", F.desc("n"), "lang_n", "term"]
    return words.sortWithinPartitions(*order).mapInArrow(retain, "lang string, source string, term string, n long, lang_n long")


def distinctive_terms(counts: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """lang, source, item, value, rank: the ``k`` terms of a group that stand out most against its language."""
    p = share(F.col("n"), F.col("total"), F.col("terms"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    judged = skybands(counts, k).join(totals, ["lang", "source"]).withColumns({"p": p, "q": q}).where("p > q")
    judged = judged.select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return judged.withColumn("rank", rank).where(F.col("rank") <= k)


def _tile_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, a, b, value, seen of the pairs of a tile, over the terms of a chunk; rows without term give absent shares."""
    for part in groups(batches, ["lang", "x", "y", "chunk"]):
        lang, x, y = (part.column(name)[0].as_py() for name in ("lang", "x", "y"))
        at, p = part.column("at").to_numpy(), part.column("p").to_numpy()
        terms = part.column("term").combine_chunks()
        heads = int(pc.sum(pc.equal(terms, "")).as_py())  # '' sorts first
        left_at = np.unique(at[:heads][at[:heads] // TILE == x])
        right_at = np.unique(at[:heads][at[:heads] // TILE == y])
        absent = dict(zip(at[:heads].tolist(), p[:heads].tolist()))
        left0, right0 = (np.array([absent[z] for z in side.tolist()], dtype=np.int64) for side in (left_at, right_at))
        at, p, terms = at[heads:], p[heads:], terms[heads:]
        code = np.zeros(len(at), dtype=np.int64)
        if len(at):
            code[1:] = np.cumsum(pc.not_equal(terms[1:], terms[:-1]).to_numpy(zero_copy_only=False))
        seen = int(code[-1]) + 1 if len(at) else 0
        sums = np.zeros((len(left_at), len(right_at)), dtype=np.int64)
        for first in range(0, seen, TERMS):
            begin, end = np.searchsorted(code, [first, first + TERMS])
            count = min(TERMS, seen - first)
            left, right = np.tile(left0, (count, 1)), np.tile(right0, (count, 1))
            for side, ids, block in ((left, left_at, x), (right, right_at, y)):
                own = np.flatnonzero(at[begin:end] // TILE == block) + begin
                side[code[own] - first, np.searchsorted(ids, at[own])] = p[own]
            for row in range(len(left_at)):
                mine = left[:, row : row + 1]
                sums[row] += ((mine - right) ** 2 // np.maximum(mine + right, 1)).sum(axis=0)
        rows, cols = np.nonzero(left_at[:, None] < right_at[None, :])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(rows), pa.string()),
                pa.array(left_at[rows], pa.int64()),
                pa.array(right_at[cols], pa.int64()),
                pa.array(sums[rows, cols], pa.int64()),
                pa.array(np.full(len(rows), seen, dtype=np.int64)),
            ],
            names=["lang", "a", "b", "value", "seen"],
        )


def source_distances(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, source, item, value, rank: every other source of the language, farthest first."""
    width = shuffle_width(counts.sparkSession)
    words = counts.where("term <> ''")
    chunks = max(1, -(-words.count() // CHUNK_ROWS))
    tiles = totals.groupBy("lang").agg((F.floor(F.max("at") / TILE) + 1).cast("int").alias("tiles"))
    known = totals.join(tiles, "lang")
    absent = share(F.lit(0), F.col("total"), F.col("terms"))
    heads = known.select(
        "lang", "at", "tiles", F.lit("").alias("term"), absent.alias("p"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    )
    present = words.join(known, ["lang", "source"]).select(
        "lang", "at", "tiles", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int").alias("chunk"),
    )
    own, other = F.floor(F.col("at") / TILE).cast("int"), F.col("other")
    dealt = (
        heads.unionByName(present)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("lang", F.least(own, other).alias("x"), F.greatest(own, other).alias("y"), "chunk", "term", F.col("at").cast("long").alias("at"), "p")
        .repartition(width, "lang", "x", "y", "chunk")
        .sortWithinPartitions("lang", "x", "y", "chunk", "term", "at")
    )
    sums = dealt.mapInArrow(_tile_sums, "lang string, a long, b long, value long, seen long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    end = known.select("lang", "at", "source", "terms", absent.alias("p0"))
    one = end.select("lang", F.col("at").alias("a"), F.col("source").alias("one"), "terms", F.col("p0").alias("p"))
    two = end.select("lang", F.col("at").alias("b"), F.col("source").alias("two"), F.col("p0").alias("q"))
    unseen = (F.col("terms") - F.col("seen")) * divergence(F.col("p"), F.col("q"))
    pairs = sums.join(one, ["lang", "a"]).join(two, ["lang", "b"]).withColumn("value", (F.col("value") + unseen).cast("long"))
    both = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item"))))
    pairs = pairs.select("lang", "value", both.alias("pair")).select("lang", "pair.source", "pair.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank)


def audit(documents: DataFrame, k: int = 10, least_docs: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: what sets the sources of each language apart.

    A null text, lang or source reads as ''. Terms are stretches of A-Z (as a-z), a-z and all characters
    beyond ASCII; a language keeps those in ``least_docs`` of its rows. A term's share in a group, in parts
    of a billion, is p = 1 + floor(1e9 * (count + 2) / (total + 2 * terms)); two shares differ by
    floor((p - q)^2 / (p + q)). Part ``pair`` lists for every group each other source of its language with
    the sum over all kept terms (0 without any); part ``term`` the ``k`` terms a group has with a greater
    share than its language. Ranks go by value, then by the item's bytes. Repeated rows count as rows;
    an empty table has no groups. Columns other than lang, source and text are not read.
    """
    counts = settle(term_counts(documents, least_docs))
    totals = totals_of(counts)
    fields = ["lang", "source", "part", "item", "value", "rank"]
    return (
        source_distances(counts, totals).withColumn("part", F.lit("pair")).select(*fields)
        .union(distinctive_terms(counts, totals, k).withColumn("part", F.lit("term")).select(*fields))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))
