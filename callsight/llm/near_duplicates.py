"""N-gram Jaccard join by count vectors.

A document is the set of its word shingles. Two documents link when their sets overlap by
``num / den`` of their union or more. The join is exact:

* Equal sets fall into one class first, by a digest; only classes are compared.
* Shingles are hashed into groups; a class is the point of its group counts. For two points the sum of
  the lesser coordinates bounds the overlap from above.
* The upper levels of the tree are addressed, not walked: near copies are spread evenly over the
  groups, so no box of a few coordinates tells them from other texts. Groups are dealt to as many
  subspaces as two linked sets of that size can differ in shingles, and a few more. Some subspace then
  holds equal counts in both (with very fine groups, kept as a digest), which is the page they meet on.
* On a page, points whose bound allows a link are joined to blocks. A block, cut to nodes of bounded
  size with their bounding boxes, is compared node by node: boxes first, then points, then the sets.
* A pair of nodes returns a spanning forest of its links, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callsight.llm.common import U64, column, connected, groups, mix, settle, shuffle_width, small, table

#: Coordinates of a point.
GROUPS = 32
#: Size of a node: classes, and shingles in all.
NODE_ROWS, NODE_SHINGLES = 1024, 400_000
#: Above this many classes a page is joined whole instead of filtered; its block is a superset.
PAGE_ROWS = 20_000
#: Ids that may be broadcast.
BROADCAST_ROWS = 4_000_000


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text; none for a null or wordless text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII spaces only
    if not words:
        return np.zeros(0, dtype=U64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=U64, count=len(words))
    width = min(width, len(words))
    total = np.full(len(words) - width + 1, width, dtype=U64)
    for at in range(width):
        total = mix(total ^ hashes[at : at + len(total)])
    return np.unique(total)


def node_of(items: np.ndarray) -> int:
    """The class of a set: 64 bits of a digest."""
    return xxhash.xxh3_64_intdigest(items.tobytes()) - (1 << 63)


@lru_cache(maxsize=None)
def _band(at: int) -> int:
    """The least size of band ``at``."""
    low = 1
    for _ in range(at):
        low = max(low + 1, -(-low * 3 // 2))
    return low


@lru_cache(maxsize=None)
def band_of(size: int) -> int:
    at = 0
    while _band(at + 1) <= size:
        at += 1
    return at


@lru_cache(maxsize=None)
def subspaces(band: int, num: int, den: int) -> tuple[int, int]:
    """Subspaces for pairs whose smaller set lies in ``band``, and how many of them may be empty.

    Such a pair differs in at most ``(largest size) * (den - num) / num`` shingles; with one subspace more,
    one holds no difference. As many again as may be empty in a set, and one with shingles does.
    """
    differ = (_band(band + 1) - 1) * (den - num) // num
    if not differ:
        return 0, 0  # such sets link only when equal
    empty = 0
    for _ in range(8):
        dealt = differ + 1 + empty
        empty = 1 + int(1.5 * dealt * np.exp(-_band(band) / dealt))
    return differ + 1 + empty, empty


def pages_of(items: np.ndarray, num: int, den: int) -> np.ndarray:
    """The pages of a set: one for each band it may be paired in and each subspace."""
    size = len(items)
    found = []
    if not size:
        return np.zeros(0, dtype=np.int64)
    for band in range(band_of(-(-size * num // den)), band_of(size) + 1):
        dealt, may_be_empty = subspaces(band, num, den)
        if not dealt:
            continue
        place = (mix(items, 1) % U64(dealt)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        held, begins = np.unique(place[order], return_index=True)
        digest = np.add.reduceat(mix(items, 2)[order], begins)
        if dealt - len(held) > may_be_empty:  # rare: then its empty subspaces count as well
            missing = np.setdiff1d(np.arange(dealt), held)
            held, digest = np.concatenate([held, missing]), np.concatenate([digest, np.zeros(len(missing), U64)])
        found.append(mix(mix(digest, 3) ^ mix(held.astype(U64), 4), 5 + band))
    return np.concatenate(found).view(np.int64) if found else np.zeros(0, dtype=np.int64)


def groups_for(size: int) -> int:
    """Coordinates that tell sets of a size apart: by chance two sets differ less, the larger their groups are."""
    count = GROUPS
    while count < size // 12 and count < 4096:
        count *= 2
    return count


def point_of(items: np.ndarray, count: int) -> np.ndarray:
    """Counts of the groups. Groups of half as many coordinates are sums of two of these."""
    return np.bincount((mix(items, 9) % U64(count)).astype(np.int64), minlength=count).astype(np.int32)


def needed(left: np.ndarray, right: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least overlap that makes sets of these sizes link."""
    both = left.astype(np.int64) + right.astype(np.int64)
    return -(-both * num // (num + den))


def _points(values: pa.ChunkedArray) -> np.ndarray:
    """Points of one number of coordinates: the least that occurs."""
    values = values.combine_chunks()
    lengths = values.value_lengths().to_numpy()
    flat, least = values.flatten().to_numpy(), int(lengths.min())
    if least == lengths.max():
        return flat.reshape(-1, least)
    ends = np.cumsum(lengths)
    return np.stack([flat[a:b].reshape(-1, least).sum(axis=0) for a, b in zip(ends - lengths, ends)])


def _may_link(point: np.ndarray, size: int, points: np.ndarray, sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    least = needed(np.full(len(sizes), size), sizes, num, den)
    possible = np.minimum(size, sizes) >= least
    at = np.flatnonzero(possible)
    possible[at] = np.minimum(points[at], point).sum(axis=1) >= least[at]
    return possible


def page_edges(nodes: np.ndarray, sizes: np.ndarray, points: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Edges that connect all classes of a page which the bound lets link, directly or by others."""
    edges, left = [], np.arange(len(nodes))
    queue: list[int] = []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        at = queue.pop()
        near = _may_link(points[at], int(sizes[at]), points[left], sizes[left], num, den)
        met = left[near]
        edges += [(int(nodes[at]), int(nodes[other])) for other in met]
        queue += met.tolist()
        left = left[~near]
    return edges


def _linked(items: list[np.ndarray], sizes: np.ndarray, points: np.ndarray, split: int, num: int, den: int) -> np.ndarray:
    """Which of the first ``split`` sets link with which of the others; with ``split`` all, which link among them.

    Overlaps are counted on bit rows over the shingles that occur more than once, for pairs that the bound allows.
    """
    count = len(items)
    flat = np.concatenate(items)
    owner = np.repeat(np.arange(count), [len(x) for x in items])
    _, number, often = np.unique(flat, return_inverse=True, return_counts=True)
    shared = often[number] > 1
    position = (np.cumsum(often > 1) - 1)[number[shared]]
    width = int((often > 1).sum())
    rows = np.zeros((count, -(-max(width, 1) // 64) * 8), dtype=np.uint8)
    np.bitwise_or.at(rows, (owner[shared], position >> 3), (1 << (position & 7)).astype(np.uint8))
    rows = rows.view(np.uint64)
    links = np.zeros((split, count), dtype=bool)
    for at in range(split):
        others = np.arange(at + 1 if split == count else split, count)
        near = others[_may_link(points[at], int(sizes[at]), points[others], sizes[others], num, den)]
        if len(near):
            overlap = np.bitwise_count(rows[near] & rows[at]).sum(axis=1, dtype=np.int64)
            links[at, near] = overlap * den >= num * (int(sizes[at]) + sizes[near] - overlap)
    return links


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of symmetric links."""
    unseen, edges = np.ones(len(links), dtype=bool), []
    for start in range(len(links)):
        if not unseen[start]:
            continue
        unseen[start], stack = False, [start]
        while stack:
            at = stack.pop()
            found = np.flatnonzero(links[at] & unseen)
            unseen[found] = False
            edges += [(at, int(other)) for other in found]
            stack += found.tolist()
    return edges


def keyed(documents: DataFrame) -> DataFrame:
    """``documents`` with a key of 96 bits for the row's doc_id and text, never null."""
    doc_id = F.col("doc_id").cast("long")
    return documents.withColumn("__k1", F.xxhash64(doc_id, "text")).withColumn("__k2", F.hash("text", doc_id))


KEY = ["__k1", "__k2"]


def sets_of(documents: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Key, doc_id, n, node, point and pages of every row; a wordless text has n = 0 and no node."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, node, point, fine, pages = [], [], [], [], []
            for text in column(batch, "text").to_pylist():
                items = shingles(text, width)
                size.append(len(items))
                node.append(node_of(items) if len(items) else None)
                point.append(point_of(items, GROUPS) if len(items) else None)
                fine.append(point_of(items, groups_for(len(items))) if len(items) else None)
                pages.append(pages_of(items, num, den))
            yield pa.RecordBatch.from_arrays(
                [
                    *(column(batch, name) for name in (*KEY, "doc_id")),
                    pa.array(size, pa.int64()),
                    pa.array(node, pa.int64()),
                    pa.array(point, pa.list_(pa.int32())),
                    pa.array(fine, pa.list_(pa.int32())),
                    pa.array(pages, pa.list_(pa.int64())),
                ],
                names=[*KEY, "doc_id", "n", "node", "point", "fine", "pages"],
            )

    rows = keyed(documents).select(*KEY, F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(
        measure, "__k1 long, __k2 int, doc_id long, n long, node long, point array<int>, fine array<int>, pages array<long>"
    )


def _shared(rows: DataFrame) -> DataFrame:
    """Rows (page, node) of the pages of several classes, from rows sorted by both; pages of equal classes are one."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_page = last_node = None
        written = False  # is the last row of the page before written?
        for batch in batches:
            page = column(batch, "page").to_numpy()
            node = column(batch, "node").to_numpy()
            if last_page is not None:
                page, node = np.append(last_page, page), np.append(last_node, node)
            fresh = np.ones(len(page), dtype=bool)
            fresh[1:] = (page[1:] != page[:-1]) | (node[1:] != node[:-1])
            page, node = page[fresh], node[fresh]
            same = np.zeros(len(page) + 1, dtype=bool)
            same[1:-1] = page[1:] == page[:-1]
            keep_ = same[:-1] | same[1:]
            if last_page is not None:
                keep_[0] &= not written
            if len(page):
                written = bool(keep_[-1]) or (written and len(page) == 1)
                last_page, last_node = page[-1:], node[-1:]
            yield pa.RecordBatch.from_arrays([pa.array(page[keep_]), pa.array(node[keep_])], names=["page", "node"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages are named by their classes, so that pages of the same classes become one."""
        held_page = held_node = np.zeros(0, dtype=np.int64)

        def named(page: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
            begins = np.flatnonzero(np.append(True, page[1:] != page[:-1])) if len(page) else np.zeros(0, dtype=np.int64)
            rows_ = np.diff(np.append(begins, len(page)))
            name = mix(np.add.reduceat(mix(node, 11), begins), 12) if len(page) else np.zeros(0, dtype=U64)
            name = np.repeat(mix(name ^ rows_.astype(U64), 13), rows_).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(name), pa.array(node)], names=["page", "node"])

        for batch in batches:
            page = np.concatenate([held_page, column(batch, "page").to_numpy()])
            node = np.concatenate([held_node, column(batch, "node").to_numpy()])
            upto = int(np.searchsorted(page, page[-1])) if len(page) else 0  # the last page may go on
            held_page, held_node = page[upto:], node[upto:]
            yield named(page[:upto], node[:upto])
        yield named(held_page, held_node)

    schema = "page long, node long"
    return rows.mapInArrow(keep, schema).mapInArrow(sign, schema).distinct()


def _filtered(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) from rows (page, node, n, fine) sorted by page."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page in groups(batches, ["page"]):
            nodes, sizes = page.column("node").to_numpy(), page.column("n").to_numpy()
            edges = page_edges(nodes, sizes, _points(page.column("fine")), num, den)
            if edges:
                a, b = zip(*edges)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(join, "a long, b long")


def _verified(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Forests and link counts from rows (block, x, y, side, node, n, fine, copies, items), a pair (x, y) of nodes together.

    ``side`` 0 is node x, 1 is node y; x = y has side 0 alone. Rows with b give an edge, others a number of links.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in groups(batches, ["block", "x", "y"]):
            pair = pair.sort_by([("side", "ascending"), ("node", "ascending")])
            side = pair.column("side").to_numpy()
            nodes, sizes = pair.column("node").to_numpy(), pair.column("n").to_numpy()
            items = [np.frombuffer(x, dtype=U64) for x in pair.column("items").to_pylist()]
            split = int((side == 0).sum())
            links = np.zeros((len(nodes), len(nodes)), dtype=bool)
            if split:
                links[:split] = _linked(items, sizes, _points(pair.column("fine")), split, num, den)
            links |= links.T
            copies = pair.column("copies").to_numpy()
            a, b, n = [], [], []
            for one, other in _forest(links):
                a.append(int(nodes[one]))
                b.append(int(nodes[other]))
                n.append(0)
            for at, total in enumerate(links @ copies):
                if total:
                    a.append(int(nodes[at]))
                    b.append(None)
                    n.append(int(total))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (a, b, n)], names=["a", "b", "links"])

    return rows.mapInArrow(compare, "a long, b long, links long")


def _blocks(sets: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """node, block for every class that may link with another."""
    width = shuffle_width(sets.sparkSession)
    copies = settle(
        sets.join(classes.where("copies > 1"), "node")
        .where((F.col("__k1") != F.col("first.__k1")) | (F.col("__k2") != F.col("first.__k2")))
        .select(*KEY)
    )
    rows = (
        sets.where(F.size("pages") > 0)
        .join(small(copies, BROADCAST_ROWS), KEY, "left_anti")
        .select(F.explode("pages").alias("page"), "node")
        .repartition(width, "page")
        .sortWithinPartitions("page", "node")
    )
    shared = settle(_shared(rows))
    points = _points_of(sets, settle(shared.select("node").distinct()))
    heavy = small(settle(shared.groupBy("page").agg(F.count("*").alias("c"), F.min("node").alias("a")).where(F.col("c") > PAGE_ROWS)), BROADCAST_ROWS)
    light = shared.join(heavy, "page", "left_anti").join(points, "node")
    light = light.select("page", "node", "n", "fine").repartition(width, "page").sortWithinPartitions("page", "node")
    whole = shared.join(heavy, "page").select("a", F.col("node").alias("b"))
    edges = _filtered(light, num, den).union(whole).distinct()
    return connected(edges).select("node", F.col("root").alias("block"))


def _points_of(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n, point, fine of the given classes, one row each."""
    chosen = sets.select("node", "n", "point", "fine").join(small(nodes, BROADCAST_ROWS), "node", "left_semi")
    return chosen.groupBy("node").agg(*(F.first(name).alias(name) for name in ("n", "point", "fine")))


def _tiles(members: DataFrame) -> DataFrame:
    """Cut blocks to nodes: members with ``tile``, by size, so that boxes of a block are narrow.

    Sizes are counted per block first; a class then finds its place from the sums before its size
    and a hash within it, so no block is sorted in one place.
    """
    sized = members.groupBy("block", "n").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sized.withColumn("weight", F.greatest(F.col("rows") / NODE_ROWS, F.col("rows") * F.col("n") / NODE_SHINGLES))
        .withColumn("begin", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .select("block", "n", "begin", "weight")
    )
    spread = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) / F.lit(1 << 20)
    return members.join(placed, ["block", "n"]).withColumn(
        "tile", F.floor(F.col("begin") + spread * F.col("weight")).cast("long")
    ).drop("begin", "weight")


def _pairs(members: DataFrame, num: int, den: int) -> DataFrame:
    """block, x, y for nodes that may hold links: sizes allow them, and so do the boxes."""
    box = [F.max(F.element_at("point", at + 1)).alias(f"g{at}") for at in range(GROUPS)]
    tiles = settle(
        members.groupBy("block", "tile").agg(F.min("n").alias("low"), F.max("n").alias("high"), *box)
        .select("block", "tile", "low", "high", F.array(*(f"g{at}" for at in range(GROUPS))).alias("box"))
    )
    left = tiles.select("block", F.col("tile").alias("x"), F.col("low").alias("xl"), F.col("high").alias("xh"), F.col("box").alias("xb"))
    right = tiles.select("block", F.col("tile").alias("y"), F.col("low").alias("yl"), F.col("high").alias("yh"), F.col("box").alias("yb"))
    overlap = F.aggregate(
        F.zip_with("xb", "yb", lambda a, b: F.least(a, b).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b
    )
    least = F.greatest((F.col("xl") + F.col("yl")), F.lit(0)) * num
    return (
        left.join(right, "block")
        .where((F.col("x") <= F.col("y")) & (F.col("xh") * den >= F.col("yl") * num))
        .where((F.col("x") == F.col("y")) | (overlap * (num + den) >= least))
        .select("block", "x", "y")
    )


def grouped(documents: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Every row's key, doc_id, n, node; and for every node: root, component, first, n_links."""
    parts = shuffle_width(documents.sparkSession)
    sets = settle(sets_of(documents, width, num, den))
    classes = settle(
        sets.where("node is not null")
        .groupBy("node")
        .agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", *KEY)).alias("first"))
    )
    blocks = _blocks(sets, classes, num, den)
    members = _points_of(sets, blocks.select("node")).join(blocks, "node").join(classes.select("node", "copies", "first"), "node")
    members = settle(_tiles(members))
    pairs = _pairs(members, num, den)
    both = F.when(F.col("x") == F.col("y"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    sides = pairs.select("block", "x", "y", F.explode(both).alias("side"))
    sides = sides.withColumn("tile", F.when(F.col("side") == 0, F.col("x")).otherwise(F.col("y")))
    placed = members.join(sides, ["block", "tile"]).select("block", "x", "y", "side", "node", "n", "fine", "copies")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [shingles(text, width).tobytes() for text in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "node"), pa.array(items, pa.binary())], names=["node", "items"])

    owners = settle(members.select("first.*", "node").select(*KEY, "node"))
    items = (
        keyed(documents.select("doc_id", "text"))
        .join(small(owners, BROADCAST_ROWS), KEY)
        .select("node", "text")
        .mapInArrow(measure, "node long, items binary")
        .dropDuplicates(["node"])  # a row may stand twice
    )
    compared = placed.join(items, "node").repartition(parts, "block", "x", "y").sortWithinPartitions("block", "x", "y")
    found = settle(_verified(compared, num, den))
    roots = connected(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    rooted = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = rooted.groupBy("root").agg(F.min("least").alias("component"), F.min("first").alias("chosen"))
    known = (
        rooted.join(by_root, "root")
        .join(links, "node", "left")
        .withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    )
    return sets.select(*KEY, "doc_id", "n", "node"), settle(known.select("node", "root", "component", "chosen", "copies", "n_links"))


def linked(documents: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row of ``documents``.

    Two rows link when ``den * |A and B| >= num * |A or B|`` over their shingles of ``width`` words (a
    shorter text is one shingle). ``component_id`` is the smallest doc_id reachable by links, itself
    included; ``n_links`` counts the rows linked with. Null, empty and wordless texts link with
    nothing and are a component of their own. Equal rows link with each other. A row without doc_id is
    returned and linked like any other; its component_id is null if no linked row has a doc_id.
    """
    rows, known = grouped(documents, width, num, den)
    return rows.join(known, "node", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each(documents: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``documents`` with one row of each component: that of the smallest doc_id; wordless texts all stay."""
    rows, known = grouped(documents, width, num, den)
    shared = known.where((F.col("copies") > 1) | (F.col("n_links") > 0)).select("node", "chosen")
    judged = rows.join(shared, "node").select(
        *KEY, ((F.col("__k1") == F.col("chosen.__k1")) & (F.col("__k2") == F.col("chosen.__k2"))).alias("stays")
    )
    counted = settle(judged.groupBy(*KEY, "stays").agg(F.count("*").alias("c")))
    leaving = settle(counted.where("not stays").select(*KEY).distinct())
    kept = keyed(documents).join(small(leaving, BROADCAST_ROWS), KEY, "left_anti")
    twice = settle(counted.where("stays and c > 1").select(*KEY))
    if twice.count():  # the row that stays is there more than once
        kept = kept.join(twice, KEY, "left_anti").union(kept.join(twice, KEY, "left_semi").dropDuplicates(KEY))
    return kept.drop(*KEY)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, num=90, den=100)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, a similarity of 0.8 or more."""
    return one_of_each(docs)
