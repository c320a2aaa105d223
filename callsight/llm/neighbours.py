"""Approximate nearest neighbours with a permutation index.

A vector is represented by its nearest pivots in order. Every vector is posted in the inverted file of
each of its pivots with the place the pivot has for it. A query reads the files of its own pivots,
which gives the footrule distance of the two orders, ranks by it, and scores the best by the inner
product itself. For the greatest inner product, vectors are first lifted to one length by one more
coordinate, so that the nearest pivots are those of the greatest product.

The index is cut into shards of bounded size, each with its own inverted files; queries are cut into
blocks, and each block meets each shard once. Vectors of each length have pivots, shards and blocks of
their own and are searched among themselves. Equal vectors are indexed once and stand for their
smallest ids, as many as a result can show.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callsight.llm.common import groups, settle, shuffle_width, table

#: Pivots, drawn from the vectors by a hash; pivots a vector is posted under; vectors scored per query and shard.
PIVOTS, ORDER, SCORED = 384, 64, 1200
SHARD_ROWS, BLOCK_ROWS = 8192, 2048


def _usable(vector: str) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _orders(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first."""
    near = vectors @ pivots.T
    length = min(length, len(pivots))
    part = np.argpartition(-near, length - 1, axis=1)[:, :length]
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(near, part, 1), axis=1, kind="stable"), 1)


def _lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0))
    return np.hstack([vectors, rest[:, None]])


class Shard:
    """The inverted files of some vectors."""

    def __init__(self, vectors: np.ndarray, pivots: np.ndarray, longest: float, order: int):
        self.vectors, self.pivots, self.order = vectors, pivots, min(order, len(pivots))
        orders = _orders(_lifted(vectors, longest), pivots, order)
        flat = orders.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.rows, self.places = by_pivot // self.order, by_pivot % self.order
        self.begins = np.searchsorted(flat[by_pivot], np.arange(len(pivots) + 1))

    def nearest(self, query: np.ndarray, order: np.ndarray, scored: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and inner products of the ``scored`` rows whose pivots come in the most similar order."""
        count = len(self.vectors)
        if count > scored:
            slices = [slice(self.begins[pivot], self.begins[pivot + 1]) for pivot in order]
            rows = np.concatenate([self.rows[part] for part in slices])
            # What a shared pivot takes off the footrule distance of two orders without one in common.
            saved = np.concatenate([self.order - np.maximum(self.places[part], at) for at, part in enumerate(slices)])
            total = np.bincount(rows, saved, minlength=count)
            found = np.argpartition(-total, scored - 1)[:scored]
        else:
            found = np.arange(count)
        return found, self.vectors[found] @ query


def nearest(
    vectors: DataFrame, queries: Column, k: int = 20, pivots: int = PIVOTS, order: int = ORDER, scored: int = SCORED
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every query row of ``vectors`` (vec_id, embedding).

    ``queries`` selects the query rows; candidates are all other rows, whatever their id. Nearness is
    the inner product in double precision, ties go to the smaller vec_id. Rows without vec_id, and
    vectors null, empty, zero, or holding null or non-finite components take no part; candidates are of
    the length of the query. Repeated rows count once; where a vec_id stands on several vectors, it is no
    neighbour of its own. No more rows than there are candidates come back.
    """
    spark, parts = vectors.sparkSession, shuffle_width(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", queries.alias("asks")).where(
        F.col("vec_id").isNotNull() & _usable("embedding")
    )
    rows = rows.select(
        "vec_id", "asks", F.transform("embedding", lambda x: x.cast("double")).alias("v")
    ).withColumn("same", F.xxhash64("v"))
    smallest = F.row_number().over(Window.partitionBy("same").orderBy("vec_id"))
    named = rows.select("same", "vec_id").distinct().withColumn("at", smallest).where(F.col("at") <= k + 1)
    ids = named.groupBy("same").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))  # k + 1 at most
    classes = settle(rows.groupBy("same").agg(F.first("v").alias("v"), F.max("asks").alias("asks")).join(ids, "same"))
    asking = settle(rows.where("asks").select(F.col("vec_id").alias("query_id"), "same").distinct())
    length = F.size("v").alias("d")
    squared = F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    facts = classes.groupBy(length).agg(F.count("*").alias("n"), F.count_if("asks").alias("asked"), squared.alias("sq")).collect()
    longest = {row.d: float(np.sqrt(row.sq)) for row in facts}
    hashed = classes.select(length, "same", F.xxhash64("same", F.lit(7)).alias("h"))
    place = F.row_number().over(Window.partitionBy("d").orderBy("h", "same"))
    drawn = hashed.withColumn("at", place).where(F.col("at") <= pivots)
    found_pivots: dict[int, list] = {}
    for row in drawn.join(classes.select("same", "v"), "same").orderBy("d", "at").select("d", "v").collect():
        found_pivots.setdefault(row.d, []).append(row.v)
    lifted = {d: _lifted(np.array(vs, dtype=np.float64), longest[d]) for d, vs in found_pivots.items()}
    shared = spark.sparkContext.broadcast(lifted)  # for each length as many rows as pivots
    cuts = [(row.d, -(-row.n // SHARD_ROWS), -(-row.asked // BLOCK_ROWS) or 1) for row in facts]
    cuts = F.broadcast(spark.createDataFrame(cuts, "d int, shards int, blocks int"))  # a row for each length
    classes = classes.withColumn("d", F.size("v")).join(cuts, "d")
    spread = F.xxhash64("same", F.lit(1))
    posted = classes.select(
        "d",
        F.pmod(spread, "shards").cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.lit(0).alias("side"), "same", "v", "ids",
    )
    sent = classes.where("asks").select(
        "d",
        F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
        F.pmod(spread, "blocks").cast("int").alias("block"),
        F.lit(1).alias("side"), "same", "v", F.array().cast("array<long>").alias("ids"),
    )
    met = posted.union(sent).repartition(parts, "d", "shard", "block")
    met = met.sortWithinPartitions("d", "shard", "block", "side")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, ["d", "shard", "block"]):
            side = part.column("side").to_numpy()
            all_ = part.column("v").combine_chunks().flatten().to_numpy().reshape(len(side), -1)
            split = int((side == 0).sum())
            if not split or split == len(side):
                continue
            size = all_.shape[1]
            pivots_ = shared.value[size]
            index = Shard(all_[:split], pivots_, longest[size], order)
            ids = part.column("ids").to_pylist()
            asks = all_[split:]
            orders = _orders(np.hstack([asks, np.zeros((len(asks), 1))]), pivots_, order)
            for same, query, mine in zip(part.column("same").to_numpy()[split:], asks, orders):
                found, scores = index.nearest(query, mine, scored)
                best = found[np.argsort(-scores, kind="stable")]
                ordered = np.sort(-scores, kind="stable")
                # All classes as near as the last that can show; each brings k + 1 ids at most.
                last = ordered[min(k, len(ordered) - 1)]
                upto = int(np.searchsorted(ordered, last, side="right"))
                rows_ = sorted((s, i) for s, row in zip(ordered[:upto], best[:upto]) for i in ids[row])[: k + 1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(rows_), same, dtype=np.int64)),
                        pa.array([i for _, i in rows_], pa.int64()),
                        pa.array([-s for s, _ in rows_], pa.float64()),
                    ],
                    names=["same", "vec_id", "score"],
                )

    found = met.mapInArrow(search, "same long, vec_id long, score double")
    nearness = [F.desc("score"), F.asc("vec_id")]
    best = found.withColumn("at", F.row_number().over(Window.partitionBy("same").orderBy(*nearness))).where(
        F.col("at") <= k + 1
    )
    answers = best.drop("at").join(asking, "same").where(F.col("vec_id") != F.col("query_id"))
    return (
        answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*nearness)))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, F.col("vec_id") % 20 == 0)
