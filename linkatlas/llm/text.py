"""Small helpers over texts inside tasks: words, hashes, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIX_A, MIX_B, MIX_C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (splitmix64's finaliser)."""
    x = x + MIX_A
    x = (x ^ (x >> np.uint64(30))) * MIX_B
    x = (x ^ (x >> np.uint64(27))) * MIX_C
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None, lower: bool) -> list[bytes]:
    """Runs of ``[^\\x20\\x09-\\x0D]+`` in UTF-8; ``lower`` lower-cases A-Z only, as ``bytes.lower`` does."""
    if not text:
        return []
    raw = text.encode()
    return (raw.lower() if lower else raw).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), dtype="<u8")


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words, in order; empty when there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = total * MIX_C + words[i:i + n]
    return mix(total)


def texts(docs: DataFrame, id_col: str, text_col: str, partitions: int | None = None) -> DataFrame:
    """Only id and text, under fixed names, so that no other column of the table can clash."""
    out = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return out if partitions is None else out.repartition(partitions)


def release() -> None:
    """Gives memory that a task no longer uses back to the system. Python workers live on from stage to stage, and what their allocators keep
    counts against the executor beside the next stage's needs. What an earlier task left in cycles, such as its vocabulary, goes first."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def batches(it: Iterable[pa.RecordBatch], chars: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same batches cut where their texts would pass ``chars`` bytes, so that work arrays stay small."""
    for batch in it:
        size = batch.nbytes
        if size <= chars or batch.num_rows <= 1:
            yield batch
            continue
        lengths = np.zeros(batch.num_rows, np.int64)
        for col in batch.columns:
            if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
                offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1]
                lengths += np.diff(offsets)
        group, start = np.cumsum(lengths) // chars, 0
        for end in [*(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]:
            yield batch.slice(start, end - start)
            start = end
    release()


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
