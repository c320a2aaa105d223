"""The leak search against a plain search, at any place, length and alignment."""

import random

import pytest

from callsight.operators import leaks

SCHEMA = "id long, leaf string"


def search(spark, texts, values):
    leaves = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    secrets = spark.createDataFrame([(value,) for value in values], "value string")
    return sorted(row.id for row in leaks.leaking_leaves(leaves, ["id"], "leaf", secrets).collect())


def plain(texts, values):
    return [at for at, text in enumerate(texts) if text and any(v and len(v) >= 6 and v in text for v in values)]


@pytest.mark.parametrize("segment", [12, 36, leaks.SEGMENT])
def test_search_finds_every_secret_at_every_place(spark, monkeypatch, segment):
    monkeypatch.setattr(leaks, "SEGMENT", segment)
    rng = random.Random(segment)
    letters = "ab😀\n€"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    values = [word(n) for n in (5, 6, 7, 8, 10, 11, 12, 13, 22, 23, 24, 30, 47)] + [None, "aaaaaa"]
    texts = [None, "", "aaaaa", "aaaaaa", "ab"]
    for at in range(150):
        value = rng.choice([v for v in values if v])
        inside = value if at % 3 else value[:-1] + "x"
        texts.append(word(rng.randint(0, 60)) + inside + word(rng.randint(0, 60)))
    assert search(spark, texts, values) == plain(texts, values)


def test_nothing_to_look_for(spark):
    assert search(spark, ["abcdefgh"], []) == []
    assert search(spark, ["abcdefgh"], ["abc", None]) == []


def test_a_text_gives_a_row_for_a_block(spark):
    leaves = spark.createDataFrame([(1, "x" * 100_000)], SCHEMA)
    for size in leaks.BLOCKS:
        assert leaks.text_blocks(leaves, ["id"], "leaf", size).count() == 100_000 // size
    index = leaks.block_index(spark.createDataFrame([("secret-%d" % at,) for at in range(1000, 3000)], "value string"))
    assert index.count() < 2000 * 6
    same = leaks.block_index(spark.createDataFrame([("x" * 12 + str(at),) for at in range(1000, 3000)], "value string"))
    assert same.count() == 6  # many secrets with one beginning are few rows
