"""Line removal by log templates.

A line is parsed to a fixed depth: by its number of words, then by its leading words, with words that
hold a digit read as variable. The lines of a leaf fall into clusters, each led by the line of the most
documents; a line joins the first leader it agrees with at the share ``fixed`` of its places. The places
where the lines of a cluster differ are its fields, whatever words they hold and however often those
recur, so that a template has one key in a table of any size. A template found in ``min_docs``
documents or more recurs; its lines stay in the document of the smallest doc_id and leave all others.
A line of ``long_words`` words or more is also a template by itself, word for word with its digits, and
recurs from two documents on. A line of fewer than ``min_words`` words is a template as it is written,
and recurs from ``short_docs`` documents on.

The tree is never held anywhere: leaves and templates are keys of groupings. Lines travel as hashes of
64 bits; only lines of leaves that hold several lines and enough documents are split into words. A large
leaf is clustered in parts of bounded size, then the leaders of its parts among each other.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from operator import ne

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsight.llm.common import column, settle, shuffle_width, table

FIELD = "<*>"
DIGIT = re.compile("[0-9]")
#: Words from which on a line is generalised; a shorter one is only taken as it is written.
MIN_WORDS = 3
#: Words of the lines that are clustered at once.
PART_WORDS = 1 << 16


def masked(line: str, min_words: int) -> list[str]:
    """The words of a line, those that hold a digit as fields if it has ``min_words`` words."""
    words = line.split()
    if len(words) >= min_words and DIGIT.search(line):
        words = [FIELD if DIGIT.search(word) else word for word in words]
    return words


def key_of(words: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("\n".join(words).encode("utf-8", "surrogatepass")) - (1 << 63)


def _documents(documents: DataFrame) -> DataFrame:
    return documents.where("text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text"
    )


def verbatim(line: str) -> int:
    return key_of(["", *line.split()])


def lines_of(
    documents: DataFrame, depth: int, min_words: int, min_docs: int, long_words: int, short_docs: int
) -> DataFrame:
    """doc_id, text_key, leaf, line, need for the distinct lines of each text; long lines once more as they are written.

    ``need`` is the number of documents from which on a template of the leaf recurs.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, leaves, keys, needs = [], [], [], []
            for row, text in enumerate(column(batch, "text").to_pylist()):
                seen = set()
                for line in text.split("\n"):
                    words = masked(line, min_words)
                    if not words:
                        continue
                    short = len(words) < min_words
                    key = key_of(words)
                    if key not in seen:
                        seen.add(key)
                        rows.append(row)
                        leaves.append(key_of([str(len(words)), *(words if short else words[:depth])]))
                        keys.append(key)
                        needs.append(short_docs if short else min_docs)
                    if len(words) >= long_words and (key := verbatim(line)) not in seen:
                        seen.add(key)
                        rows.append(row)
                        leaves.append(key)
                        keys.append(key)
                        needs.append(min(min_docs, 2))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id").take(at), column(batch, "text_key").take(at)]
                + [pa.array(values, pa.int64()) for values in (leaves, keys, needs)],
                names=["doc_id", "text_key", "leaf", "line", "need"],
            )

    return _documents(documents).mapInArrow(parse, "doc_id long, text_key long, leaf long, line long, need long")


def words_of(wanted: DataFrame, min_words: int) -> DataFrame:
    """leaf, line, docs, parts, words (joined by blanks) from rows of text, lines (array of leaf, line, docs, variants).

    ``parts`` is the number of parts in which the leaf is clustered.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, lines in zip(column(batch, "text").to_pylist(), column(batch, "lines").to_pylist()):
                left = {entry["line"]: entry for entry in lines}
                for line in text.split("\n"):
                    if not left:
                        break
                    words = masked(line, min_words)
                    entry = left.pop(key_of(words), None) if words else None
                    if entry:
                        parts = -(-entry["variants"] * len(words) // PART_WORDS)
                        out.append((entry["leaf"], entry["line"], entry["docs"], parts, " ".join(words)))
            leaf, line, docs, parts, words = zip(*out) if out else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(values, pa.int64()) for values in (leaf, line, docs, parts)), pa.array(words, pa.string())],
                names=["leaf", "line", "docs", "parts", "words"],
            )

    return wanted.mapInArrow(split, "leaf long, line long, docs long, parts long, words string")


class Leaders:
    """The leading lines of some lines of a leaf, met in their order.

    Two lines may differ at ``may`` places. Of ``may`` + 1 groups of places they then agree in one, so
    leaders are looked up by the words of a group, and only those found are compared.
    """

    def __init__(self, size: int, depth: int, fixed: float):
        self.may = size - math.ceil(fixed * size - 1e-9)
        rest = max(size - depth, 0)  # the leading words are those of the leaf
        count = min(self.may + 1, rest + 1)
        bounds = [size - rest + rest * at // count for at in range(count + 1)]
        self.slices = list(zip(bounds, bounds[1:]))
        self.keys: list[int] = []
        self.words: list[list[str]] = []
        self.found: dict[tuple, list[int]] = {}

    def of(self, key: int, words: list[str]) -> int:
        """The key of the first leader that agrees with a line, or else its own."""
        slots = [(at, *words[begin:end]) for at, (begin, end) in enumerate(self.slices)]
        for leader in sorted({leader for slot in slots for leader in self.found.get(slot, ())}):
            if sum(map(ne, words, self.words[leader])) <= self.may:
                return self.keys[leader]
        for slot in slots:
            self.found.setdefault(slot, []).append(len(self.keys))
        self.keys.append(key)
        self.words.append(words)
        return key


def led(lines: DataFrame, keys: list[str], depth: int, fixed: float) -> DataFrame:
    """leaf, line, docs, parts, words, leader: each line with the line that leads it among those of equal ``keys``.

    Only leaders keep their words.
    """

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leaders = None, None
        for batch in batches:
            out, left = [], []
            here = zip(*(column(batch, name).to_pylist() for name in keys))
            for key, line, text in zip(here, column(batch, "line").to_pylist(), column(batch, "words").to_pylist()):
                words = text.split(" ")
                if key != at:
                    at, leaders = key, Leaders(len(words), depth, fixed)
                leader = leaders.of(line, words)
                out.append(leader)
                left.append(text if leader == line else None)
            yield pa.RecordBatch.from_arrays(
                [column(batch, name) for name in ("leaf", "line", "docs", "parts")]
                + [pa.array(left, pa.string()), pa.array(out, pa.int64())],
                names=["leaf", "line", "docs", "parts", "words", "leader"],
            )

    placed = lines.repartition(shuffle_width(lines.sparkSession), *keys)
    return placed.sortWithinPartitions(*keys, F.desc("docs"), "line").mapInArrow(
        lead, "leaf long, line long, docs long, parts long, words string, leader long"
    )


def template_lines(
    documents: DataFrame, min_docs: int = 3, depth: int = 4, fixed: float = 0.7, min_words: int = MIN_WORDS,
    long_words: int = 50, short_docs: int = 4,
) -> DataFrame:
    """The recurring templates of ``documents`` (doc_id, text) and the lines they match.

    One row for each line to leave and template it is of: doc_id, text_key (hash of the text), line
    (hash of its masked words, or of a long or short line as it is written), template. The line stays in the document that comes first by (doc_id, text_key), nulls
    first. The lines of a generalised template agree in their first ``depth`` words and with its leading line, in a large leaf with the leading line of their part, at the share ``fixed`` of
    all words. Null and empty texts have no lines. Rows
    with equal doc_id and text count as one document.
    """
    whole = settle(lines_of(documents, depth, min_words, min_docs, long_words, short_docs).distinct())
    document = F.struct("doc_id", "text_key")
    # Documents of a line are counted first, so that hot lines and leaves arrive summed.
    counted = settle(
        whole.groupBy("leaf", "line", "need").agg(F.count("*").alias("docs"), F.min(document).alias("first"))
    )
    leaves = counted.groupBy("leaf", "need").agg(F.sum("docs").alias("docs"), F.count("*").alias("variants"))
    busy = settle(leaves.where("docs >= need").select("leaf", "variants"))
    # A leaf of one line is its own template; the words matter only where lines differ.
    wanted = (
        counted.join(busy.where("variants > 1"), "leaf")
        .groupBy(F.col("first.doc_id").alias("__doc"), F.col("first.text_key").alias("__text_key"))
        .agg(F.collect_list(F.struct("leaf", "line", "docs", "variants")).alias("lines"))  # at most the lines of one text
    )
    texts = _documents(documents).join(
        wanted, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("text_key") == F.col("__text_key"))
    )
    words = words_of(texts.select("text", "lines"), min_words).dropDuplicates(["leaf", "line"])
    words = words.withColumn("part", F.pmod(F.xxhash64("line"), "parts"))
    parts = settle(led(words, ["leaf", "part"], depth, fixed))
    leaders = led(parts.where("parts > 1 and words is not null").drop("leader"), ["leaf"], depth, fixed)
    leaders = leaders.select("leaf", F.col("line").alias("leader"), F.col("leader").alias("above"))
    general = parts.where("parts = 1").select("leaf", "line", F.xxhash64("leaf", "leader").alias("template")).union(
        parts.where("parts > 1").join(leaders, ["leaf", "leader"]).select("leaf", "line", F.xxhash64("leaf", "above").alias("template"))
    )
    alone = counted.join(busy.where("variants = 1"), "leaf", "left_semi")
    known = general.union(alone.select("leaf", "line", F.xxhash64("leaf", "line").alias("template")))
    # Only templates of enough documents go on; counting a document twice here is put right below.
    enough = counted.join(known, ["leaf", "line"])
    sums = enough.groupBy("template", "need").agg(F.sum("docs").alias("docs")).where("docs >= need")
    known = settle(enough.join(sums.select("template"), "template").select("leaf", "line", "template"))
    found = settle(whole.join(known, ["leaf", "line"]).select("doc_id", "text_key", "line", "template", "need"))
    recurring = (
        found.select("template", "need", "doc_id", "text_key")
        .distinct()
        .groupBy("template", "need")
        .agg(F.count("*").alias("docs"), F.min(document).alias("first"))
        .where("docs >= need")
        .select("template", "first")
    )
    return (
        found.join(recurring, "template")
        .where(~document.eqNullSafe(F.col("first")))
        .select("doc_id", "text_key", "line", "template")
    )


def _kept(texts: pd.Series, gone: pd.Series, min_words: int) -> pd.DataFrame:
    out, dropped = [], np.zeros(len(texts), dtype=np.int64)
    for at, (text, keys) in enumerate(zip(texts, gone)):
        if text is None:
            out.append(None)
            continue
        leaving, lines = set(keys), text.split("\n")
        kept = [
            line for line in lines
            if not (words := masked(line, min_words)) or key_of(words) not in leaving and verbatim(line) not in leaving
        ]
        out.append("\n".join(kept))
        dropped[at] = len(lines) - len(kept)
    return pd.DataFrame({"text": pd.Series(out, dtype=object), "dropped": dropped})


def without_templates(documents: DataFrame, min_words: int = MIN_WORDS, **options) -> DataFrame:
    """``documents`` without recurring lines; every row and column stays, null texts stay null.

    A line that leaves takes its line break along. ``__lines_dropped`` counts what went.
    """
    gone = (
        template_lines(documents, min_words=min_words, **options)
        .groupBy(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__text_key"))
        .agg(F.collect_set("line").alias("__gone"))  # at most the lines of one text
    )
    rows = documents.withColumn("__key", F.xxhash64("text"))
    joined = rows.join(
        gone,
        F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.col("__key") == F.col("__text_key")),
        "left",
    )
    changed = F.col("__gone").isNotNull()

    @F.pandas_udf("struct<text string, dropped long>")
    def kept(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        return _kept(texts, gone, min_words)

    return (
        joined.withColumn("__kept", kept(F.when(changed, F.col("text")), "__gone"))
        .withColumn("__lines_dropped", F.when(changed, F.col("__kept.dropped")).otherwise(0).cast("long"))
        .withColumn("text", F.when(changed, F.col("__kept.text")).otherwise(F.col("text")))
        .drop("__key", "__doc", "__text_key", "__gone", "__kept")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_templates(documents).select(
        "doc_id",
        "text",
        F.col("__lines_dropped").alias("n_lines_dropped"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; one that has no word left goes, as all its lines stand elsewhere."""
    names = docs.columns
    cleaned = without_templates(docs)
    emptied = (F.col("__lines_dropped") > 0) & (F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]")) == 0)
    cleaned = cleaned.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in names:
        cleaned = cleaned.withColumn(
            "n_chars", F.when(F.col("__lines_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
        )
    return cleaned.select(*names)
