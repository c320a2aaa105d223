"""Near copies among vectors, by an inverted multi-index.

Vectors are cut in two halves, each with a codebook of its own; a vector's cell is the pair of its nearest
codes, so two small codebooks make a fine grid. How far a vector is from a cell at least follows from the
planes between codes, half by half, and the two add up. A multi-sequence traversal takes cells by that
sum, nearest first, and ends at ``reach``, one bound for all vectors. The bound is set so that the target
share of links is reached, for links just at the threshold and for links of sampled vectors among all
rows. Every pair met that way is verified by its cosine.

* Equal vectors are one class from the start. Of two cells the parity of their numbers says which visits
  the other, so a pair meets once and its links are counted on both sides.
* Cells are dealt to regions. A region's residents are cut to chunks and its visitors to parts of bounded
  size; every chunk meets every part. Groups of near copies of any size are spread that way.
* A meeting returns a count for each vector and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsight.llm.common import column, connected, groups, settle, shuffle_width, table

#: Share of links that the traversal is to reach.
TARGET = 0.999
#: Rows a cell holds on average, and the most codes of a half. Codebooks are fitted on a sample: rows, numbers.
CELL_ROWS, MOST_CODES, SAMPLE_ROWS, SAMPLE_VALUES = 12, 1024, 16_384, 4_000_000
#: Sampled vectors whose links among all rows are measured; bins of the measurement.
MEASURED, BINS = 256, 1000
#: Vector lengths with codebooks, the most frequent ones; any other length is a grid of one cell.
LENGTHS = 16
#: Rows of a region (about), of a chunk of residents, of a part of visitors, and of a block of visitors compared at once.
REGION_ROWS, CHUNK_ROWS, PART_ROWS, BLOCK_ROWS = 4096, 4096, 65_536, 2048
#: Codes nearest to a vector whose planes bound its distance to cells.
PLANES = 8


def unit(values: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    values = values.astype(np.float64)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def fitted(rows: np.ndarray, count: int, seed: int = 5, rounds: int = 8) -> np.ndarray:
    """``count`` codes by k-means, in the order of their first principal axis, so that neighbours have near numbers."""
    rng = np.random.default_rng(seed)
    codes = rows[rng.choice(len(rows), count, replace=False)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([_squared(part, codes).argmin(axis=1) for part in np.array_split(rows, -(-len(rows) // 2048))])
        held = np.bincount(nearest, minlength=count)
        sums = np.zeros_like(codes)
        np.add.at(sums, nearest, rows)
        codes[held > 0] = sums[held > 0] / held[held > 0][:, None]
    if not codes.shape[1]:
        return codes
    axis = np.linalg.svd(codes - codes.mean(axis=0), full_matrices=False)[2][0]
    return codes[np.argsort(codes @ axis, kind="stable")]


def _squared(rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (rows * rows).sum(axis=1)[:, None] - 2 * rows @ codes.T + (codes * codes).sum(axis=1)


class Grid:
    """Two codebooks and the cells they make."""

    def __init__(self, left: np.ndarray, right: np.ndarray, blocks: int, reach: float = 0.0):
        self.codes, self.reach = (left, right), reach
        self.split = left.shape[1]
        self.counts = (len(left), len(right))
        self.blocks = tuple(min(blocks, count) for count in self.counts)
        #: Of every code, its block; a region is a pair of blocks.
        self.block_of = tuple(np.arange(count) * blocks_ // count for count, blocks_ in zip(self.counts, self.blocks))

    def bounds(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells of unit vectors, and for each half the squared distance to every code's part of space at least."""
        codes_of, bounds = [], []
        for half, codes in zip((rows[:, : self.split], rows[:, self.split :]), self.codes):
            squared = _squared(half, codes)
            codes_of.append(squared.argmin(axis=1))
            apart = np.sqrt(np.maximum(_squared(codes, codes), 0))
            np.fill_diagonal(apart, np.inf)
            apart[apart < 1e-9] = np.inf  # equal codes: no plane between them
            bound = np.zeros_like(squared)
            near = min(PLANES, len(codes))
            for place in np.argpartition(squared, near - 1, axis=1)[:, :near].T:
                own = squared[np.arange(len(rows)), place][:, None]
                np.maximum(bound, (squared - own) / (2 * apart[place]), out=bound)
            bounds.append(bound * bound)
        return codes_of[0] * self.counts[1] + codes_of[1], bounds[0], bounds[1]

    def regions(self, cells: np.ndarray) -> np.ndarray:
        return self.block_of[0][cells // self.counts[1]] * self.blocks[1] + self.block_of[1][cells % self.counts[1]]

    def visited_regions(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which regions hold a cell within reach, for each row of bounds."""
        nearest = [
            np.minimum.reduceat(bound, np.searchsorted(block_of, np.arange(blocks)), axis=1)
            for bound, block_of, blocks in zip((left, right), self.block_of, self.blocks)
        ]
        return (nearest[0][:, :, None] + nearest[1][:, None, :] <= self.reach).reshape(len(left), -1)

    def visits(self, cells: np.ndarray, left: np.ndarray, right: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Whether a row's traversal comes to each of the cells ``asked`` before its end, and it is the row's turn to visit."""
        near = left[:, asked // self.counts[1]] + right[:, asked % self.counts[1]] <= self.reach
        own, other = cells[:, None], asked[None, :]
        turn = ((own + other) % 2 == 0) == (own < other)
        return near & (turn | (own == other))


def codes_for(rows: int) -> int:
    """Codes of a half: their square gives cells of ``CELL_ROWS`` rows, up to ``MOST_CODES``."""
    count = 1
    while count < MOST_CODES and 4 * count * count * CELL_ROWS <= 2 * rows:
        count *= 2
    return count


def grid_for(sample: np.ndarray, rows: int, threshold: float) -> Grid:
    """Codebooks of a sample of unit vectors; its reach covers the target share of pairs just at the threshold."""
    count = min(codes_for(rows), max(1, len(sample) // 8))
    half = sample.shape[1] // 2
    blocks = 1
    while blocks * blocks * REGION_ROWS < rows:
        blocks *= 2
    grid = Grid(fitted(sample[:, :half], count if half else 1), fitted(sample[:, half:], count), blocks)
    rng = np.random.default_rng(11)
    one = sample[:2048]
    aside = rng.standard_normal(one.shape)
    aside -= (aside * one).sum(axis=1, keepdims=True) * one
    aside /= np.maximum(np.sqrt((aside * aside).sum(axis=1, keepdims=True)), 1e-300)
    other = threshold * one + np.sqrt(1 - threshold * threshold) * aside
    _, left, right = grid.bounds(one)
    grid.reach = float(np.quantile(_sums(grid, left, right, grid.bounds(other)[0]), TARGET))
    return grid


def _sums(grid: Grid, left: np.ndarray, right: np.ndarray, cells: np.ndarray) -> np.ndarray:
    at = np.arange(len(cells))
    return left[at, cells // grid.counts[1]] + right[at, cells % grid.counts[1]]


def _vectors(values: pa.Array, size: int) -> np.ndarray:
    return unit(values.flatten().to_numpy(zero_copy_only=False).reshape(-1, size))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = column(batch, "v").value_lengths().to_numpy()
    for size in np.unique(sizes):
        yield int(size), batch.take(pa.array(np.flatnonzero(sizes == size)))


class Meeting:
    """Residents of a chunk, whom blocks of visitors are compared with."""

    def __init__(self, grid: Grid, threshold: float, vectors: np.ndarray, cells: np.ndarray, same: np.ndarray, copies: np.ndarray):
        order = np.argsort(cells, kind="stable")
        self.grid, self.threshold = grid, threshold
        self.vectors, self.same, self.copies = vectors[order], same[order], copies[order]
        self.cells, self.begins = np.unique(cells[order], return_index=True)
        self.ends = np.append(self.begins[1:], len(order))
        self.links = np.zeros(len(order), dtype=np.int64)
        self.label = np.arange(len(order))

    def visit(self, vectors: np.ndarray, cells: np.ndarray, same: np.ndarray, copies: np.ndarray) -> Iterator[tuple[int, int | None, int]]:
        """Edges (a, b, 0) of a forest, and (a, None, links) of visitors; links of residents are added up."""
        _, left, right = self.grid.bounds(vectors)
        meets = self.grid.visits(cells, left, right, self.cells)
        visitors, residents = [], []
        for at, (cell, begin, end) in enumerate(zip(self.cells, self.begins, self.ends)):
            rows = np.flatnonzero(meets[:, at])
            if not len(rows):
                continue
            linked = vectors[rows] @ self.vectors[begin:end].T >= self.threshold
            home = np.flatnonzero(cells[rows] == cell)  # within a cell both visit: one of them counts
            linked[home] &= same[rows[home]][:, None] < self.same[begin:end]
            one, other = np.nonzero(linked)
            visitors.append(rows[one])
            residents.append(begin + other)
        if not visitors:
            return
        one, other = np.concatenate(visitors), np.concatenate(residents)
        if not len(one):
            return
        order = np.argsort(one, kind="stable")
        one, other = one[order], other[order]
        self.links += np.bincount(other, copies[one], minlength=len(self.links)).astype(np.int64)
        starts = np.flatnonzero(np.append(True, one[1:] != one[:-1]))
        counts = np.add.reduceat(self.copies[other], starts)
        for at, total, resident in zip(one[starts], counts, other[starts]):
            yield int(same[at]), None, int(total)
            yield int(same[at]), int(self.same[resident]), 0
        labels = self.label[other]
        apart = np.flatnonzero(np.minimum.reduceat(labels, starts) != np.maximum.reduceat(labels, starts))
        ends = np.append(starts[1:], len(one))
        for at in apart:
            found = np.unique(self.label[other[starts[at] : ends[at]]])
            if len(found) > 1:  # a visitor joins residents that were not joined before
                for root in found[1:]:
                    yield int(self.same[found[0]]), int(self.same[root]), 0
                self.label[np.isin(self.label, found[1:])] = found[0]

    def resident_links(self) -> Iterator[tuple[int, None, int]]:
        for at in np.flatnonzero(self.links):
            yield int(self.same[at]), None, int(self.links[at])


def _grids(classes: DataFrame, threshold: float) -> tuple[dict[int, Grid], dict[int, np.ndarray]]:
    """A grid for each of the most frequent lengths, and the vectors its links are measured with."""
    length = F.size("v").alias("d")
    frequent = classes.groupBy(length).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(LENGTHS).collect()
    grids, asking = {}, {}
    for row in frequent:
        drawn = classes.where(F.size("v") == row.d).select("v", "same", F.xxhash64("same", F.lit(7)).alias("h"))
        bound = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // row.d))
        sample = drawn.orderBy("h", "same").limit(bound).select("v").toArrow().column("v").combine_chunks()
        sample = _vectors(sample, row.d)
        grids[row.d], asking[row.d] = grid_for(sample, row.n, threshold), sample[:MEASURED]
    return grids, asking


def _measured(classes: DataFrame, grids: dict[int, Grid], asking: dict[int, np.ndarray], threshold: float) -> None:
    """Widen each grid's reach until the target share of links between sampled vectors and all rows lies within it."""
    shared = classes.sparkSession.sparkContext.broadcast((grids, asking))
    widest = 2 - 2 * threshold

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids_, asking_ = shared.value
        seen = {size: grid.bounds(asking_[size])[1:] for size, grid in grids_.items()}
        totals = {size: np.zeros(BINS + 1, dtype=np.int64) for size in grids_}
        for batch in batches:
            for size, part in _by_length(batch):
                if size not in grids_:
                    continue
                vectors = _vectors(column(part, "v"), size)
                cosines = asking_[size] @ vectors.T
                one, other = np.nonzero((cosines >= threshold) & (cosines < 1 - 1e-12))
                if len(one):
                    left, right = seen[size]
                    sums = _sums(grids_[size], left[one], right[one], grids_[size].bounds(vectors)[0][other])
                    totals[size] += np.bincount(np.minimum(np.ceil(sums / widest * BINS), BINS).astype(int), minlength=BINS + 1)
        for size, held in totals.items():
            bins = np.flatnonzero(held)
            if len(bins):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(bins), size), pa.int32()), pa.array(bins, pa.int32()), pa.array(held[bins])],
                    names=["d", "bin", "n"],
                )

    counted = classes.select("v").mapInArrow(count, "d int, bin int, n long").groupBy("d", "bin").agg(F.sum("n").alias("n"))
    held: dict[int, np.ndarray] = {}
    for row in counted.collect():  # of as many rows as there are bins and grids at most
        held.setdefault(row.d, np.zeros(BINS + 1))[row.bin] = row.n
    for size, totals in held.items():
        enough = int(np.searchsorted(np.cumsum(totals), TARGET * totals.sum()))
        grids[size].reach = max(grids[size].reach, enough / BINS * widest)


def _placed(classes: DataFrame, grids) -> DataFrame:
    """d, same, copies, v, cell, region, visits: where each class lives and which regions it visits."""
    kind = classes.schema["v"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part in _by_length(batch):
                grid, rows = grids.value.get(size), part.num_rows
                cells, regions, visits = np.zeros(rows, int), np.zeros(rows, int), [[0]] * rows
                if grid:
                    visits = []
                    for at in range(0, rows, BLOCK_ROWS):
                        vectors = _vectors(column(part, "v").slice(at, BLOCK_ROWS), size)
                        own, left, right = grid.bounds(vectors)
                        cells[at : at + len(own)], regions[at : at + len(own)] = own, grid.regions(own)
                        near = grid.visited_regions(left, right)
                        near[np.arange(len(own)), grid.regions(own)] = True
                        visits += [np.flatnonzero(row) for row in near]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(rows, size), pa.int32()),
                        *(column(part, name) for name in ("same", "copies", "v")),
                        pa.array(cells, pa.int32()), pa.array(regions, pa.int32()), pa.array(visits, pa.list_(pa.int32())),
                    ],
                    names=["d", "same", "copies", "v", "cell", "region", "visits"],
                )

    return classes.select("same", "copies", "v").mapInArrow(
        place, f"d int, same long, copies long, v {kind}, cell int, region int, visits array<int>"
    )


def _links(placed: DataFrame, grids, threshold: float) -> DataFrame:
    """a, b, links: rows with b are edges that connect what is linked, others a number of links of a class."""
    width = shuffle_width(placed.sparkSession)
    living = placed.groupBy("d", "region").agg(F.count("*").alias("residents"))
    coming = placed.select("d", F.explode("visits").alias("region")).groupBy("d", "region").agg(F.count("*").alias("visitors"))
    plan = settle(
        living.join(coming, ["d", "region"]).select(
            "d", "region",
            F.ceil(F.col("residents") / CHUNK_ROWS).cast("int").alias("chunks"),
            F.ceil(F.col("visitors") / PART_ROWS).cast("int").alias("parts"),
        )
    )
    what = ["same", "copies", "v", "cell"]
    chunk, part = (F.pmod(F.xxhash64("same", F.lit(salt)), F.col(of)).cast("int") for salt, of in ((1, "chunks"), (2, "parts")))
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    residents = placed.join(plan, ["d", "region"]).select("d", "region", chunk.alias("chunk"), each("parts").alias("part"), F.lit(0).alias("side"), *what)
    visitors = placed.withColumn("region", F.explode("visits")).join(plan, ["d", "region"])
    visitors = visitors.select("d", "region", each("chunks").alias("chunk"), part.alias("part"), F.lit(1).alias("side"), *what)
    key = ["d", "region", "chunk", "part"]
    met = residents.union(visitors).repartition(width, *key).sortWithinPartitions(*key, "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trivial: dict[int, Grid] = {}
        for meeting in groups(batches, key):
            size = meeting.column("d")[0].as_py()
            grid = grids.value.get(size) or trivial.setdefault(size, Grid(np.zeros((1, size // 2)), np.zeros((1, size - size // 2)), 1))
            split = int((meeting.column("side").to_numpy() == 0).sum())
            if not split or split == meeting.num_rows:
                continue
            vectors = _vectors(meeting.column("v").combine_chunks(), size)
            cells, same, copies = (meeting.column(name).to_numpy() for name in ("cell", "same", "copies"))
            home = Meeting(grid, threshold, *(x[:split] for x in (vectors, cells, same, copies)))
            for at in range(split, len(same), BLOCK_ROWS):
                to = slice(at, at + BLOCK_ROWS)
                yield from _rows(home.visit(vectors[to], cells[to], same[to], copies[to]))
            yield from _rows(home.resident_links())

    return met.mapInArrow(compare, "a long, b long, links long")


def _rows(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    found = list(found)
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b", "links"])


def linked(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding).

    Two rows link when the cosine of their vectors, in double precision, is ``threshold`` or more; no other
    pair does, and links are found to the target recall. ``component_id`` is the smallest vec_id reachable
    by links, itself included; a row is kept if it is its own. A vector null, empty, zero, or holding null
    or non-finite components links with nothing, nor do vectors of different lengths. Equal vectors link,
    repeated rows included. A row without vec_id is linked and counted like any other; its component_id is
    null if no row linked with it has a vec_id, and it is kept in that case alone. Other columns are not
    read.
    """
    spark = vectors.sparkSession
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(usable, F.lit(False)).alias("usable"))
    rows = rows.withColumn("same", F.when(F.col("usable"), F.xxhash64("embedding")))
    classes = settle(
        rows.where("usable")
        .groupBy("same")
        .agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("embedding").alias("v"))
    )
    grids, asking = _grids(classes, threshold)
    _measured(classes, grids, asking, threshold)
    shared = spark.sparkContext.broadcast(grids)  # two codebooks of bounded size for a bounded number of lengths
    placed = settle(_placed(classes, shared))
    found = settle(_links(placed, shared, threshold))
    roots = connected(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy(F.col("a").alias("same")).agg(F.sum("links").alias("links"))
    known = classes.join(roots.withColumnRenamed("node", "same"), "same", "left").join(links, "same", "left").where(
        "copies > 1 or links is not null"
    )
    known = known.select("same", "least", F.coalesce("root", "same").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = settle(known)
    components = known.groupBy("root").agg(F.min("least").alias("component"))
    known = known.join(components, "root").select("same", "component", "n_links")
    return (
        rows.select("vec_id", "same")
        .join(known, "same", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component")).alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
