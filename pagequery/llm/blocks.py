"""Documents in blocks: stored once, a row for each run of documents of about as many words, their texts compressed together.

A block's number is that of the task that wrote it; what is read again later are the rows written, however many executors read
them, so all that is said of a block or of a document's place in it holds for good."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import stored

BLOCK_TOKENS = 800_000
U64 = np.uint64


@lru_cache(maxsize=1)
def codec() -> tuple:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def deflated(data: bytes) -> bytes:
    return codec()[0].compress(data)


def inflated(data: bytes) -> bytes:
    return codec()[1].decompress(data)


def squeezed(values: np.ndarray) -> bytes:
    """Small non-negative integers, compressed; those of 255 and more apart."""
    big = values >= 255
    low = np.where(big, 255, values).astype(np.uint8).tobytes()
    return deflated(low + values[big].astype("<i8").tobytes())


def loosened(data: bytes, n: int) -> np.ndarray:
    raw = inflated(data)
    values = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    values[values == 255] = np.frombuffer(raw, "<i8", offset=n)
    return values


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a * U64(0x9E3779B97F4A7C15) + (b << U64(32) | b >> U64(32))
        x = (x ^ x >> U64(30)) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> U64(27)) * U64(0x94D049BB133111EB)
        return x ^ x >> U64(31)


def runs_of(batches, columns: list[str], block_tokens: int) -> Iterator[tuple[int, list[bytes], pa.Table]]:
    """(block, texts as lower-case bytes, the batches' columns) of about block_tokens words each."""
    part, number, texts, held, size = TaskContext.get().partitionId(), 0, [], [], 0
    for batch in batches:
        start = 0
        for i, t in enumerate(batch.column("text").to_pylist()):
            b = t.encode().lower() if t else b""
            texts.append(b)
            size += len(b) // 6 + 1
            if size >= block_tokens:
                held.append(batch.slice(start, i + 1 - start).select(columns))
                yield (part << 24) + number, texts, pa.Table.from_batches(held).combine_chunks()
                start, number, texts, held, size = i + 1, number + 1, [], [], 0
        if start < len(batch):
            held.append(batch.slice(start).select(columns))
    if texts:
        yield (part << 24) + number, texts, pa.Table.from_batches(held).combine_chunks()


def one_row(table: pa.Table, column: str) -> pa.ListArray:
    """A column as the one list of a row."""
    return pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table.column(column).combine_chunks())


def blocks(df: DataFrame, columns: list[str], block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """block, the columns (arrays), n_bytes (array), texts (in lower case, one after another, compressed): a row for each block of df(columns, text)."""

    def run(batches):
        for block, texts, table in runs_of(batches, columns, block_tokens):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(one_row(table, c) for c in columns), pa.array([[*map(len, texts)]], pa.list_(pa.int64())), pa.array([deflated(b"".join(texts))], pa.binary())], ["block", *columns, "n_bytes", "texts"])

    kinds = ", ".join(f"`{c}` array<{df.schema[c].dataType.simpleString()}>" for c in columns)
    return stored(df.select(*columns, "text").mapInArrow(run, f"block long, {kinds}, n_bytes array<long>, texts binary"), "blocks")


def texts_of(n_bytes: Iterable[int], texts: bytes) -> Iterator[bytes]:
    at, data = 0, inflated(texts)
    for n in n_bytes:
        yield data[at : at + n]
        at += n


def rows_of(batches) -> Iterator[dict]:
    """The rows of Arrow batches, one at a time."""
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]
