"""Helpers shared by the operators: table access, Arrow chunks of text, vectorised hashes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[ \t\n\u000b\f\r]"
SPACES = " \t\n\u000b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Text bytes that one step of a vectorised function holds at a time (a longer document is a step of its own).
CHUNK_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Texts without multi-byte characters take the plain, faster ``lower``."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null has none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}+|{SPACE}+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+"))


def word_count(text: Column) -> Column:
    """Number of words as a long."""
    text = F.coalesce(text, F.lit(""))
    parts = F.split(text, f"{SPACE}+")
    edge = text.rlike(f"^{SPACE}").cast("long") + text.rlike(f"{SPACE}$").cast("long")
    return F.when(~text.rlike("[^ \\t\\n\\u000b\\f\\r]"), F.lit(0).cast("long")).otherwise(
        F.size(parts).cast("long") - edge
    )


# ---------------------------------------------------------------- Arrow chunks


def release_memory() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks and serve later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # a call of glibc
        trim(0)


def text_chunks(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with the UTF-8 bytes of their texts (null: empty) and the byte offsets of the rows.

    A chunk holds whole texts of about ``limit`` bytes together, and at least one row.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(column).cast(pa.large_binary()).fill_null(b"")
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        held = text.buffers()[2]
        data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
        row = 0
        while row < batch.num_rows:
            last = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
            yield batch.slice(row, last - row), data[ends[row] : ends[last]], ends[row : last + 1] - ends[row]
            row = last
        del text, ends, held, data
        release_memory()


def longs(column: pa.Array, null: int) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


# ---------------------------------------------------------------- hashes over bytes

_RNG = np.random.RandomState(20240607)
BYTE_CODE = _RNG.randint(0, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (an invertible finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        made = []
        for base in (_BASE, _INVERSE):
            column = np.full(size, base, np.uint64)
            column[0] = 1
            made.append(np.cumprod(column))
        _POWERS[:] = made
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_sums(data: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """Running sums from which ``span_hash`` takes the hash of any byte range."""
    up, _ = powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(code[data] * up, out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes from start to end that doesn't depend on where they stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the row it belongs to."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~IS_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... of every range, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(first - starts, lengths)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def same_bits(x: np.ndarray) -> np.ndarray:
    return x.view(np.uint64)
