"""Best-fit packing of documents into sequences of a fixed capacity."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import longs, release_memory, text_chunks
from .tokens import TokenTable, process_cache

#: Pieces that one ranking window holds on average.
SLICE_ROWS = 200_000


def _pieces(tokenizer_json, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = process_cache(f"tokens_{zlib.crc32(tokenizer_json.value.encode())}", lambda: TokenTable(tokenizer_json.value))
        for batch, data, offsets in text_chunks(batches):
            ids, counts = table.encode(data, offsets)
            # every document gets its end id
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, np.uint32(end_id)).astype("<u4", copy=False)
            counts = counts + 1
            firsts = np.cumsum(counts) - counts
            pieces = -(-counts // capacity)
            row = np.repeat(np.arange(batch.num_rows), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, counts[row] - start)
            at = firsts[row] + start
            raw = memoryview(ids.tobytes())
            parts = [raw[4 * a : 4 * (a + k)] for a, k in zip(at.tolist(), length.tolist(), strict=True)]
            columns = [
                batch.column("_id").cast(pa.int64()).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                pa.array([zlib.crc32(p) for p in parts], pa.int64()),
            ]
            names = ["_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([bytes(p) for p in parts], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        # the worker goes on to other stages: it keeps the tokenizer, not the units of this task
        table.clear()
        release_memory()

    return run


@dataclass
class Bins:
    """``number`` sequences with the same contents: (length, pieces of that length) in order."""

    number: int
    gap: int
    contents: tuple[tuple[int, int], ...] = ()

    def filled(self, number: int, length: int, pieces: int) -> Bins:
        return Bins(number, self.gap - length * pieces, (*self.contents, (length, pieces)))


def pack_lengths(histogram: dict[int, int], capacity: int) -> list[Bins]:
    """The plan of all sequences, from how many pieces there are of every length.

    Pieces above a third of the capacity fit at most twice into a sequence: from the longest
    down, each is matched with the longest other one that fits beside it. The shorter ones, from
    the longest down, go to the sequence with the smallest gap that holds them; a new sequence is
    opened when none does. Equal lengths and equal sequences are handled together, so the work
    depends on the number of lengths, not on that of the pieces, and the plan has a few entries
    per length at most.
    """
    left = {length: n for length, n in sorted(histogram.items(), reverse=True) if n}
    open_bins: dict[int, list[Bins]] = defaultdict(list)
    large = [length for length in left if 3 * length > capacity]
    for length in large:
        while left[length]:
            fits = [x for x in large if x <= min(length, capacity - length) and left[x] > (x == length)]
            if not fits:
                bins = Bins(left[length], capacity).filled(left[length], length, 1)
                left[length] = 0
            elif fits[0] == length:
                bins = Bins(0, capacity).filled(left[length] // 2, length, 2)
                left[length] -= 2 * bins.number
            else:
                number = min(left[length], left[fits[0]])
                bins = Bins(0, capacity).filled(number, length, 1).filled(number, fits[0], 1)
                left[length] -= number
                left[fits[0]] -= number
            open_bins[bins.gap].append(bins)
    for length in (x for x in left if 3 * x <= capacity):
        n = left[length]
        for gap in range(length, capacity + 1):
            if not n:
                break
            for bins in open_bins.pop(gap, []):
                each = gap // length
                full = min(bins.number, n // each)
                rest = n - full * each if full < bins.number else 0
                one = 1 if 0 < rest < each else 0
                if full:
                    open_bins[gap - length * each].append(bins.filled(full, length, each))
                if one:
                    open_bins[gap - length * rest].append(bins.filled(1, length, rest))
                if bins.number > full + one:
                    open_bins[gap].append(Bins(bins.number - full - one, gap, bins.contents))
                n -= full * each + (rest if one else 0)
        if n:
            each = capacity // length
            fresh = Bins(0, capacity)
            if n // each:
                open_bins[capacity - length * each].append(fresh.filled(n // each, length, each))
            if n % each:
                open_bins[capacity - length * (n % each)].append(fresh.filled(1, length, n % each))
    return [bins for gap in sorted(open_bins) for bins in open_bins[gap]]


def layout(plan: list[Bins], capacity: int) -> dict[str, np.ndarray]:
    """Ranges of pieces, by length and number inside the length, with their place in the plan."""
    by_length: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    sequence = 0
    for bins in plan:
        offset = 0
        for length, pieces in bins.contents:
            by_length[length].append((bins.number * pieces, pieces, sequence, offset))
            offset += length * pieces
        sequence += bins.number
    rows, heads, total = [], np.zeros(capacity + 2, np.int64), 0
    for length in range(capacity + 1):
        heads[length] = total
        for n, pieces, first, offset in by_length.get(length, []):
            rows.append((total, pieces, first, offset))
            total += n
    starts, each, first, offset = np.array(rows, np.int64).reshape(-1, 4).T
    return {"heads": heads, "starts": starts, "each": each, "first": first, "offset": offset}


def _assign(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = table.value
        for batch in batches:
            length, rank = longs(batch.column("length"), 0), longs(batch.column("_rank"), 0)
            at = places["heads"][length] + rank
            k = np.searchsorted(places["starts"], at, "right") - 1
            number = at - places["starts"][k]
            each = places["each"][k]
            sequence = places["first"][k] + number // each
            offset = places["offset"][k] + number % each * length
            kept = [i for i, name in enumerate(batch.schema.names) if name != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept] + [pa.array(sequence), pa.array(offset)],
                names=[batch.schema.names[i] for i in kept] + ["sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document is its token ids and ``end_id``; only one longer than the capacity is cut, into
    pieces of the capacity. What reaches the driver is the number of pieces of every length, at
    most ``capacity`` rows; what goes out is the plan, bounded by the lengths too. Pieces of one
    length are numbered in slices that are joined by their counts, so a length that a third of all
    pieces have is no single task.

    Null and empty texts are the end id alone. Repeated rows and null ids are documents of their
    own. An empty table gives no rows. Extra columns are not read. The tokenizer's file is read on the driver.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer = spark.sparkContext.broadcast(file.read())
    kind = "_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    source = docs.select(F.col(id_col).cast("long").alias("_id"), "text")
    pieces = cut_lineage(source.mapInArrow(_pieces(tokenizer, capacity, end_id, with_ids), kind))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slices = 1 + sum(histogram.values()) // SLICE_ROWS
    sliced = pieces.withColumn("_slice", F.pmod(F.xxhash64("_id", "piece"), F.lit(slices)))
    counts = sliced.groupBy("length", "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    skips = counts.select("length", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    inside = Window.partitionBy("length", "_slice").orderBy("_id", "piece", "ids_crc32")
    ranked = (
        sliced.withColumn("_nr", F.row_number().over(inside))
        .join(skips, ["length", "_slice"])
        .withColumn("_rank", F.col("_skip") + F.col("_nr") - 1)
        .select("_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "_rank")
    )
    table = spark.sparkContext.broadcast(layout(pack_lengths(histogram, capacity), capacity))
    placed = ranked.mapInArrow(_assign(table), kind + ", sequence_id long, offset long")
    return placed.withColumnRenamed("_id", id_col)
