"""Links of vectors against brute force over all pairs."""

import numpy as np
import pytest

from callsight.llm import near_vectors

SCHEMA = "vec_id long, embedding array<float>, n_links string, same int, v int"


def brute(rows, threshold=0.9):
    """vec_id, n_links, component_id, kept of every row, by comparing all pairs."""
    good = []
    for at, (_, vector) in enumerate(rows):
        if vector and all(x is not None and np.isfinite(x) for x in vector) and any(vector):
            good.append(at)
    units = {at: near_vectors.unit(np.array([rows[at][1]], dtype=np.float32))[0] for at in good}
    near = {at: [o for o in good if o != at and len(units[o]) == len(units[at]) and units[o] @ units[at] >= threshold] for at in good}
    out, component = [], {}
    for at in range(len(rows)):
        if at in component:
            continue
        members, stack = {at}, [at]
        while stack:
            for other in near.get(stack.pop(), []):
                if other not in members:
                    members.add(other)
                    stack.append(other)
        least = min((rows[m][0] for m in members if rows[m][0] is not None), default=None)
        component.update(dict.fromkeys(members, least))
    for at, (vec_id, _) in enumerate(rows):
        out.append((vec_id, len(near.get(at, [])), component[at], vec_id == component[at]))
    return sorted(out, key=str)


def linked(spark, rows):
    frame = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA)
    return sorted(map(tuple, near_vectors.linked(frame).collect()), key=str)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0]),
        (8, [2.0, 0.1]), (None, [5.0, 0.0]), (None, [-1.0, 0.0]), (None, None), (9, [3.0]), (10, [-3.0]), (11, [1e-30]),
        (12, [1.0, 0.0, 0.0]), (13, [1e38, 0.0, 0.0]), (13, [1e38, 0.0, 0.0]),
    ]
    assert linked(spark, rows) == brute(rows)
    assert linked(spark, []) == []


@pytest.mark.parametrize("small", [False, True])
def test_links_at_the_threshold_are_found(spark, monkeypatch, small):
    if small:  # many codes, regions, chunks and parts
        for name, value in (("CELL_ROWS", 2), ("REGION_ROWS", 64), ("CHUNK_ROWS", 16), ("PART_ROWS", 50), ("BLOCK_ROWS", 16), ("LENGTHS", 2)):
            monkeypatch.setattr(near_vectors, name, value)
    rng, rows = np.random.default_rng(2), []
    for size in (24, 9, 5):
        base = near_vectors.unit(rng.standard_normal((120, size)))
        for at, one in enumerate(base):
            rows.append((len(rows) * 3 % 1009, one.tolist()))
            for cosine in (0.9005, 0.8995, 0.95)[: at % 4]:
                aside = rng.standard_normal(size)
                aside -= aside @ one * one
                other = cosine * one + np.sqrt(1 - cosine**2) * aside / np.linalg.norm(aside)
                rows.append((len(rows) * 3 % 1009, (other * rng.uniform(0.1, 9)).tolist()))
    centre = near_vectors.unit(rng.standard_normal((1, 24)))[0]
    rows += [(2000 + at, (centre + 0.03 * rng.standard_normal(24)).tolist()) for at in range(150)]  # a large group of near copies
    rows += [(3000 + at, centre.tolist()) for at in range(60)]
    got, expected = linked(spark, rows), brute(rows)
    found, all_ = sum(row[1] for row in got), sum(row[1] for row in expected)
    assert all_ >= found >= 0.995 * all_
    most = {row[0]: row[1] for row in expected}
    assert all(row[1] <= most[row[0]] for row in got)
    big = [row for row in got if row[0] is not None and row[0] >= 2000]
    assert big == [row for row in expected if row[0] is not None and row[0] >= 2000]


def test_bounds_hold_for_every_cell():
    rng = np.random.default_rng(3)
    rows = near_vectors.unit(rng.standard_normal((3000, 16)))
    grid = near_vectors.grid_for(rows, 3000, 0.9)
    cells, left, right = grid.bounds(rows)
    for at in range(40):
        apart = ((rows - rows[at]) ** 2).sum(axis=1)
        sums = left[at, cells // grid.counts[1]] + right[at, cells % grid.counts[1]]
        assert (sums <= apart + 1e-9).all()
        assert sums[at] == 0


def test_recall_on_the_whole_table(spark, sf):
    rows = [tuple(row) for row in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = sorted(map(tuple, near_vectors.query(spark, sf).collect()), key=str)
    assert got == brute([(i, None if v is None else list(v)) for i, v in rows])
