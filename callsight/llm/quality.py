"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins. Shallow trees, boosted feature by feature in cycles, add up to one
lookup table for each feature; the feature pairs that explain most of what is left get a table over
two features, boosted the same way. A score is the logistic of a sum of table entries.

The model is fitted on the driver from a sample of labelled rows of at most ``max_rows``; features
and scores are computed in the executors over whole texts, batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callsight.llm.common import column, settle, table

FEATURES = [
    "words", "word_length", "symbols", "upper", "digits", "marks", "shouts", "bars", "stops", "lines",
    "repeated_lines", "distinct_words", "top_word", "repeated_pairs", "plain_words", "long_words",
]

#: Labelled rows the model is fitted on, chosen by a hash of doc_id.
MAX_ROWS = 20_000
THRESHOLD = 0.3


def features(text: str | None) -> list[float]:
    """Numbers that describe one whole text; a null text counts as an empty one."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    lines = [line for line in text.split("\n") if line.strip()]
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    size = len(text)
    by_word: dict[str, int] = {}
    for word in words:
        by_word[word] = by_word.get(word, 0) + 1
    characters = sum(map(len, words))
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 0
    return [
        float(np.log1p(n)),
        characters / n,
        int(counts[list(b"#*$%&<>")].sum()) / n,
        int(counts[65:91].sum()) / characters,
        int(counts[48:58].sum()) / characters,
        int(counts[list(b",;:?-_()[]{}'\"/\\@=+~^`")].sum()) / n,
        int(counts[33]) / n,
        int(counts[124]) / n,
        int(counts[46]) / n,
        len(lines) / n,
        1 - len(set(lines)) / len(lines),
        len(by_word) / n,
        max(by_word.values()) / n,
        1 - pairs / (n - 1) if n > 1 else 0.0,
        sum(map(str.isalpha, words)) / n,
        (size - characters) / n,
    ]


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(text) for text in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))


@dataclass(frozen=True)
class Model:
    """Bin edges and tables; ``pairs`` holds (feature, feature, coarse edges of both, table)."""

    start: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for at, (edges, values) in enumerate(zip(self.edges, self.tables)):
            total += values[np.searchsorted(edges, x[:, at], side="right")]
        for i, j, edges_i, edges_j, values in self.pairs:
            total += values[
                np.searchsorted(edges_i, x[:, i], side="right"), np.searchsorted(edges_j, x[:, j], side="right")
            ]
        return 1 / (1 + np.exp(-total))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.zeros(0)


def _best_cut(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram; place 0 is no cut."""
    if len(gradient) < 2:
        return 0.0, 0
    left_g, left_w = np.cumsum(gradient)[:-1], np.cumsum(weight)[:-1]
    right_g, right_w = gradient.sum() - left_g, weight.sum() - left_w
    gain = left_g**2 / (left_w + 1) + right_g**2 / (right_w + 1) - gradient.sum() ** 2 / (weight.sum() + 1)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int = 3) -> np.ndarray:
    """A tree of a few leaves over the bins of one feature: the step of each bin."""
    parts = [(0, len(gradient))]
    while len(parts) < leaves:
        cuts = [(*_best_cut(gradient[a:b], weight[a:b]), a, b) for a, b in parts]
        gain, at, a, b = max(cuts)
        if gain <= 1e-9 or not at:
            break
        parts[parts.index((a, b)) : parts.index((a, b)) + 1] = [(a, a + at), (a + at, b)]
    step = np.zeros(len(gradient))
    for a, b in parts:
        step[a:b] = gradient[a:b].sum() / (weight[a:b].sum() + 1)
    return step


def _pair_tree(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree of two levels over a grid, one feature a level: its gain and steps."""
    best = (0.0, np.zeros_like(gradient))
    for turn in (False, True):
        g, w = (gradient.T, weight.T) if turn else (gradient, weight)
        for at in range(1, g.shape[0]):
            gain, step = 0.0, np.zeros_like(g)
            for rows in (slice(0, at), slice(at, None)):
                gs, ws = g[rows].sum(axis=0), w[rows].sum(axis=0)
                values = _tree(gs, ws, leaves=2)
                step[rows] = values
                gain += float((gs * values).sum())
            if gain > best[0]:
                best = (gain, step.T if turn else step)
    return best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, pairs: int = 4, rate: float = 0.2) -> Model:
    """Boost the tables. No rows, or rows of one label only, give a constant score."""
    count = x.shape[1] if x.ndim == 2 else len(FEATURES)
    share = float((y.sum() + 0.5) / (len(y) + 1))
    start = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Model(start, [np.zeros(0)] * count, [np.zeros(1)] * count, [])
    edges = [_edges(x[:, at], bins) for at in range(count)]
    placed = [np.searchsorted(edges[at], x[:, at], side="right") for at in range(count)]
    tables = [np.zeros(len(edges[at]) + 1) for at in range(count)]
    total = np.full(len(y), start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for at in range(count):
            g, w = slopes()
            size = len(tables[at])
            step = rate * _tree(np.bincount(placed[at], g, size), np.bincount(placed[at], w, size))
            tables[at] += step
            total += step[placed[at]]

    coarse = [_edges(x[:, at], 8) for at in range(count)]
    cells = [np.searchsorted(coarse[at], x[:, at], side="right") for at in range(count)]

    def grid(i: int, j: int, values: np.ndarray) -> np.ndarray:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        return np.bincount(cells[i] * shape[1] + cells[j], values, shape[0] * shape[1]).reshape(shape)

    g, w = slopes()
    ranked = sorted(
        ((_pair_tree(grid(i, j, g), grid(i, j, w))[0], i, j) for i in range(count) for j in range(i + 1, count)),
        reverse=True,
    )[:pairs]
    joint = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for gain, i, j in ranked if gain > 0]
    for _ in range(rounds // 6):
        for i, j, values in joint:
            g, w = slopes()
            step = rate * _pair_tree(grid(i, j, g), grid(i, j, w))[1]
            values += step
            total += step[cells[i], cells[j]]
    return Model(start, edges, tables, [(i, j, coarse[i], coarse[j], values) for i, j, values in joint])


def held_out(doc_id: str | Column) -> Column:
    """The fold that is never learnt from; a row without doc_id counts as held out."""
    column_ = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column_.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on labelled documents outside the held-out fold.

    At most ``max_rows`` label rows are used, the first by a hash of doc_id: a bounded sample that
    does not depend on how the tables are stored. Labels other than 0 and 1, and labels without a
    document, are left out; a label given twice counts twice.
    """
    chosen = settle(
        labels.select("doc_id", F.col("quality").cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & ~held_out("doc_id"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y")
        .limit(max_rows)
    )

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(column(batch, "text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "y"), pa.array(list(rows), pa.list_(pa.float64()))],
                names=["doc_id", "y", "x"],
            )

    rows = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(F.broadcast(chosen), "doc_id")  # at most max_rows rows of two numbers
        .select("doc_id", "y", "text")
        .mapInArrow(measured, "doc_id long, y int, x array<double>")
        .orderBy("doc_id", "y", "x")
        .limit(2 * max_rows)  # more only where doc_ids repeat
        .collect()
    )
    x = np.array([row.x for row in rows], dtype=np.float64).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([row.y for row in rows], dtype=np.float64))


def scored(documents: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """``documents`` with a score from 0 to 1 in column ``into``; all columns are kept.

    A null text is scored like an empty one. Equal texts get equal scores.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(_matrix(texts.tolist())), dtype="float64")

    return documents.withColumn(into, score("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents, table(spark, sf_dir, "labels"))
    return scored(documents.select("doc_id", "text"), model).select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = train(docs, table(spark, sf_dir, "labels"))
    names = docs.columns
    return scored(docs, model, into="__score").where(F.col("__score") >= THRESHOLD).select(*names)
