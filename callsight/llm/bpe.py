"""Byte-level BPE: every distinct word is encoded once.

Texts are cut into pre-tokens. A chunk of texts keeps its words once and, for every text, the places
of its words; the words go by hash to the task that owns them, where each distinct word of the corpus
is encoded once, and its ids go back to the chunks that asked. Texts are put together by place, and
decoded from their ids by the table of token bytes.

Chunks hold a bounded number of characters, so a common word arrives once per chunk, not per place.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import public_tokenizers
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsight.llm.common import column, shuffle_width, table

END = 0  # the id that ends a document where documents are packed
SPECIAL = {"<|endoftext|>": 50256}
CHUNK_CHARACTERS = 6_000_000
#: The pattern of the vocabulary, with white space as Unicode defines it.
SPLIT = public_tokenizers.PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


@lru_cache(maxsize=4)
def ranks(path: str | None = None) -> dict[bytes, int]:
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def coder(path: str | None = None) -> tiktoken.Encoding:
    """Whole texts, cut by the pattern; ``<|endoftext|>`` is a special token where a caller allows it."""
    return tiktoken.Encoding("texts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens=SPECIAL)


@lru_cache(maxsize=4)
def word_coder(path: str | None = None) -> tiktoken.Encoding:
    """Words as they are, never cut again."""
    return tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def _table(path: str | None = None) -> tuple[list[bytes], list[str]]:
    """The bytes of every token, and its id in decimals."""
    token = {rank: data for data, rank in ranks(path).items()}
    return [token[rank] for rank in range(len(token))], [str(rank) for rank in range(len(token))]


def _packed_numbers(values: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed: the frequent ones are small."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _packed_words(words: list[bytes]) -> bytes:
    return zstandard.compress(np.array([len(words), *map(len, words)], dtype="<u4").tobytes() + b"".join(words), 3)


def _words(data: bytes) -> list[bytes]:
    data = zstandard.decompress(data)
    count = int(np.frombuffer(data, "<u4", 1)[0])
    ends = 4 * (count + 1) + np.cumsum(np.frombuffer(data, "<u4", count, 4), dtype=np.int64)
    return [data[a:b] for a, b in zip(chain([4 * (count + 1)], ends.tolist()), ends.tolist())]


CHUNK = "chunk string, documents array<long>, sizes binary, places binary, owners binary, words array<binary>"


def _chunked(documents: DataFrame, owners: int) -> DataFrame:
    """One row per chunk: its documents, how many words each has, the words' places, and the words by owner."""
    cut = SPLIT

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(cut).findall
        names: list[int | None] = []
        sizes: list[int] = []
        numbers: dict[str, int] = {}
        places: list[np.ndarray] = []
        characters, serial = 0, 0

        def done() -> pa.RecordBatch:
            flat = np.concatenate(places) if places else np.zeros(0, np.uint32)
            often = np.bincount(flat, minlength=len(numbers))
            order = np.argsort(-often, kind="stable")  # frequent words get small numbers
            renamed = np.empty(len(order), np.uint32)
            renamed[order] = np.arange(len(order), dtype=np.uint32)
            words = [word.encode("utf-8", "surrogatepass") for word in numbers]
            owned: list[list[bytes]] = [[] for _ in range(owners)]
            owner = np.fromiter((zlib.crc32(words[at]) % owners for at in order.tolist()), np.uint32, len(order))
            for at, own in zip(order.tolist(), owner.tolist()):
                owned[own].append(words[at])
            body = [_packed_numbers(np.array(sizes, np.uint32)), _packed_numbers(renamed[flat]), _packed_numbers(owner)]
            key = hashlib.sha256(b"".join(body) + repr((serial, names[:9])).encode()).hexdigest()[:24]
            row = [f"{TaskContext.get().partitionId()}-{serial}-{key}", names, *body, [_packed_words(part) for part in owned]]
            types = [pa.string(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays(
                [pa.array([value], kind) for value, kind in zip(row, types)],
                names=["chunk", "documents", "sizes", "places", "owners", "words"],
            )

        for batch in batches:
            for name, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist()):
                words = find(text or "")
                add = numbers.setdefault
                for word in words:
                    add(word, len(numbers))
                places.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                names.append(name)
                sizes.append(len(words))
                characters += len(text or "") + 64
                if characters >= CHUNK_CHARACTERS:
                    yield done()
                    names, sizes, numbers, places = [], [], {}, []
                    characters, serial = 0, serial + 1
        if names:
            yield done()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(chunks, CHUNK)


def _answered(asked: DataFrame, path: str | None) -> DataFrame:
    """chunk, owner, counts, ids from rows (owner, chunk, words): each distinct word of an owner is encoded once."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_coder(path).encode_ordinary
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            counts, ids = [], []
            for data in column(batch, "words").to_pylist():
                found = []
                for word in _words(data):
                    held = known.get(word)
                    if held is None:
                        held = known[word] = encode(word.decode("utf-8", "surrogatepass"))
                    found.append(held)
                counts.append(_packed_numbers(np.fromiter(map(len, found), np.uint32, len(found))))
                ids.append(_packed_numbers(np.fromiter(chain.from_iterable(found), np.uint32)))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "chunk"), column(batch, "owner"), pa.array(counts, pa.binary()), pa.array(ids, pa.binary())],
                names=["chunk", "owner", "counts", "ids"],
            )

    return asked.mapInArrow(answer, "chunk string, owner int, counts binary, ids binary")


def _asked(chunks: DataFrame) -> DataFrame:
    """chunk, owner, words: what each chunk asks of each owner.

    Takes whole rows, so that this reading and the one that puts documents together share one shuffle.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = column(batch, "words")
            at = pa.compute.list_parent_indices(words)
            owner = [own for part in words.to_pylist() for own in range(len(part))]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "chunk").take(at), pa.array(owner, pa.int32()), words.flatten()], names=["chunk", "owner", "words"]
            )

    return chunks.mapInArrow(ask, "chunk string, owner int, words binary")


def _together(chunks: DataFrame, answers: DataFrame, path: str | None) -> DataFrame:
    """The documents of each chunk, put together by place from the ids of its words."""

    def assemble(chunk: pa.Table, found: pa.Table) -> pa.Table:
        token, decimal = _table(path)
        row = {name: chunk.column(name)[0].as_py() for name in ("documents", "sizes", "places", "owners")}
        owner, sizes, places = (_numbers(row[name]) for name in ("owners", "sizes", "places"))
        ids_of, bytes_of = np.empty(len(owner), object), np.empty(len(owner), object)
        tokens_of = np.zeros(len(owner), np.int64)
        for own, counts, ids in zip(*(found.column(name).to_pylist() for name in ("owner", "counts", "ids"))):
            at, counts, ids = np.flatnonzero(owner == own), _numbers(counts), _numbers(ids).tolist()
            tokens_of[at] = counts
            ends = np.cumsum(counts, dtype=np.int64).tolist()
            parts = [ids[a:b] for a, b in zip([0, *ends], ends)]
            ids_of[at] = [" ".join([decimal[i] for i in part]) for part in parts]
            bytes_of[at] = [b"".join([token[i] for i in part]) for part in parts]
        ids_of, bytes_of = ids_of.tolist(), bytes_of.tolist()
        n_tokens, texts, decoded, begin = [], [], [], 0
        for size in sizes.tolist():
            place = places[begin : begin + size]
            begin += size
            n_tokens.append(int(tokens_of[place].sum()))
            place = place.tolist()
            texts.append(" ".join([ids_of[at] for at in place]))
            decoded.append(b"".join([bytes_of[at] for at in place]))
        return pa.table(
            [
                pa.array(row["documents"], pa.int64()),
                pa.array(n_tokens, pa.int64()),
                pa.array(texts, pa.string()),
                pa.array(decoded, pa.binary()),
            ],
            names=["doc_id", "n_tokens", "ids", "decoded"],
        )

    both = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return both.applyInArrow(assemble, "doc_id long, n_tokens long, ids string, decoded binary")


def coded(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (decimals joined by one space) and decoded (bytes, from the ids) of every row.

    ``path`` names a file of ranks. A null text is empty: no ids, no bytes. Repeated rows and rows
    without doc_id come back each for itself. Strings of special tokens are ordinary text.
    """
    parts = shuffle_width(documents.sparkSession)
    chunks = _chunked(documents, parts).repartition(parts, "chunk")
    asked = _asked(chunks).repartition(parts, "owner")
    return _together(chunks, _answered(asked, path), path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
