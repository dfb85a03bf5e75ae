"""Exact top-k inner products by block-at-a-time pruning.

Vectors are floored to whole numbers, put in an order that keeps similar ones together, and cut into ranges of blocks. A
block keeps the largest and smallest value of every component (a component is the "term"), so ``sum(max(q * hi, q * lo))`` bounds
the score of all its rows. Every query first scores its own range, which gives it a k-th score; ranges whose bound lies
below that are never shipped to it. In the others the blocks are visited in the order of their bounds and scored through
their rows until the bounds fall below the k-th score. The order only decides how much is pruned, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

BLOCK = 64
RANGE_BLOCKS = 32
#: Rows that fit the order of the vectors (only the order), and cells of that order.
ORDER_ROWS = 4096
CELLS = 64
SLICE_QUERIES = 1024
BUCKET_RANGES = 256
EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def exact_top_k(
    vectors: DataFrame, is_query: Column, k: int, scale: float, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """The ``k`` rows with the highest inner products for every row that ``is_query`` marks.

    A component x counts as floor(scale * x) in double precision. Returns query_id, rank (from 1), vec_id and score; all rows if
    there are fewer than ``k``. Ties go to the smaller id, null ids last. A query never meets its own row, but meets other
    rows with its id. Vectors that are null, hold null, NaN or infinite components, or whose scaled components overflow take
    no part; a missing trailing component counts as 0 and an empty vector scores 0. Scores beyond a long are
    shown as the nearest long and rank as equal. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    whole = F.transform(F.col(vector).cast("array<double>"), lambda x: x * F.lit(float(scale)))
    rows = cut_lineage(
        vectors.select(
            F.col(vec_id).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("query"), whole.alias("v")
        )
        .filter(F.col("v").isNotNull())
        .filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))))
        .select(F.monotonically_increasing_id().alias("row"), "*")
    )
    sample = [r.v for r in rows.orderBy(F.xxhash64("vec_id", "row"), "row").limit(ORDER_ROWS).select("v").collect()]
    centres = _centres(sample)
    placed = rows.mapInArrow(lambda batches: _place(batches, centres), "row long, vec_id long, query boolean, dim int, v binary, cell int, near double")
    ranges = cut_lineage(
        placed.repartitionByRange("cell", "near", "row").sortWithinPartitions("cell", "near", "row").mapInArrow(_pack_ranges, _RANGE)
    )
    seeds = cut_lineage(
        ranges.filter("queries > 0").mapInArrow(
            lambda batches: _seed(batches, k), "query_row long, query_id long, home long, v binary, kth long, hits array<struct<vec_id:long,row:long,score:long>>"
        )
    )
    n_queries, n_ranges = seeds.count(), ranges.count()
    slices = (
        seeds.withColumn("slice", F.pmod(F.xxhash64("query_row"), F.lit(max(1, -(-n_queries // SLICE_QUERIES)))))
        .groupBy("slice")
        .agg(F.collect_list(F.struct("query_row", "query_id", "home", "v", "kth")).alias("asked"))
    )
    buckets = max(1, -(-n_ranges // BUCKET_RANGES))
    summaries = (
        ranges.withColumn("bucket", F.pmod(F.xxhash64("range"), F.lit(buckets)))
        .groupBy("bucket")
        .agg(F.collect_list(F.struct("range", "hi", "lo")).alias("bounds"))
    )
    open_ranges = (
        slices.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
        .join(summaries, "bucket")
        .select("asked", "bounds")
        .mapInArrow(_open_ranges, "range long, query_row binary, query_id array<long>, kth array<long>, dim int, v binary")
    )
    found = open_ranges.join(ranges.select("range", "rows", "ids", "dim", "data", "hi").withColumnsRenamed({"dim": "width"}), "range").mapInArrow(
        lambda batches: _score_ranges(batches, k), "query_row long, query_id long, vec_id long, row long, score long"
    )
    home = seeds.select("query_row", "query_id", F.explode("hits").alias("hit")).select("query_row", "query_id", "hit.*")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return (
        home.unionByName(found)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


# ---------------------------------------------------------------- order


def _padded(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : min(width, len(v))] = v[:width]
    return out


def _centres(sample: list) -> np.ndarray:
    """Centres of the order's cells: a few rounds of k-means over the bounded sample."""
    width = max((len(v) for v in sample), default=0)
    x = _padded(sample, width)
    x = x / np.maximum(1e-300, np.abs(x).max(axis=1, initial=0.0))[:, None]
    centres = x[:CELLS].copy()
    for _ in range(5):
        if not len(centres):
            break
        near = (np.sum(centres * centres, 1) - 2 * (x @ centres.T)).argmin(1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = x[near == c].mean(0)
    return centres


def _place(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    width = centres.shape[1] if len(centres) else 0
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = [np.floor(np.asarray(v, float)) for v in batch.column("v").to_pylist()]
        x = _padded(whole, width)
        x /= np.maximum(1e-300, np.abs(x).max(axis=1, initial=0.0))[:, None]
        far = np.sum(centres * centres, 1) - 2 * (x @ centres.T)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row"), batch.column("vec_id"), batch.column("query"), pa.array([len(v) for v in whole], pa.int32()),
                pa.array([v.tobytes() for v in whole], pa.binary()), pa.array(far.argmin(1), pa.int32()), pa.array(far.min(1), pa.float64()),
            ],
            ["row", "vec_id", "query", "dim", "v", "cell", "near"],
        )


# ---------------------------------------------------------------- ranges of blocks

_RANGE = "range long, n int, queries int, dim int, rows binary, ids array<long>, query binary, data binary, hi binary, lo binary"


def _pack_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of RANGE_BLOCKS blocks out of sorted rows; data are the rows of the blocks, hi and lo their extremes."""
    held: list[tuple] = []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("row", "vec_id", "query", "dim", "v")]
        for item in zip(*columns, strict=True):
            held.append(item)
            if len(held) == BLOCK * RANGE_BLOCKS:
                yield _range(held)
                held = []
    if held:
        yield _range(held)


def _range(held: list[tuple]) -> pa.RecordBatch:
    width = max(item[3] for item in held)
    x = _padded([np.frombuffer(item[4]) for item in held], width)
    rows = np.array([item[0] for item in held], np.int64)
    asks = np.array([item[2] for item in held], bool)
    columns = {
        "range": [int(rows[0])], "n": [len(held)], "queries": [int(asks.sum())], "dim": [width], "rows": [rows.tobytes()],
        "ids": [[item[1] for item in held]], "query": [asks.tobytes()], "data": [x.tobytes()],
        "hi": [x.max(0).tobytes()], "lo": [x.min(0).tobytes()],
    }
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns.values(), kinds, strict=True)], list(columns))


# ---------------------------------------------------------------- bounds and scores


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    """As many components as ``width``; missing ones are 0."""
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _bounds(queries: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of every query (row) in every block (column), rounding upwards."""
    width = max(queries.shape[1], hi.shape[1])
    queries, hi, lo = _wide(queries, width), _wide(hi, width), _wide(lo, width)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    slack = np.abs(queries) @ np.maximum(np.abs(hi), np.abs(lo)).T
    return up @ hi.T + down @ lo.T + np.where(slack < EXACT, 0, slack * 1e-9)


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products as longs; products beyond 2^53 are taken in whole numbers of any size."""
    width = max(queries.shape[1], rows.shape[1])
    queries, rows = _wide(queries, width), _wide(rows, width)
    if width == 0 or np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * width < EXACT:
        return (queries @ rows.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in rows]
    out = [[sum(a * b for a, b in zip(q, row, strict=True)) for row in whole] for q in ([int(x) for x in q] for q in queries)]
    return np.array([[max(-_LONG - 1, min(_LONG, s)) for s in line] for line in out], np.int64)


def _best_in_range(
    queries: np.ndarray, own: np.ndarray, kth: np.ndarray, has_kth: np.ndarray, data: np.ndarray, rows: np.ndarray, rank: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place in the range, score) of the k best rows of every query, none below its ``kth``.

    Blocks are taken in falling order of their bounds, 1, 2, 4, ... of them at a time; ``rank`` orders rows of equal score.
    """
    cuts = np.arange(0, len(rows), BLOCK)
    bounds = _bounds(queries, np.maximum.reduceat(data, cuts, axis=0), np.minimum.reduceat(data, cuts, axis=0))
    order = np.argsort(-bounds, axis=1, kind="stable")
    top_score = np.zeros((len(queries), 0), np.int64)
    top_at = np.full((len(queries), 0), -1, np.int64)
    kth, has_kth = kth.copy(), has_kth.copy()
    start, step = 0, 1
    while start < len(cuts):
        wave = order[:, start : start + step]
        mine = np.arange(len(queries))[:, None]
        live = ~has_kth[:, None] | (bounds[mine, wave] >= kth[:, None])
        score = np.zeros((len(queries), wave.shape[1] * BLOCK), np.int64)
        at = np.full(score.shape, -1, np.int64)
        for block in np.unique(wave[live]):
            who, slot = np.nonzero((wave == block) & live)
            lo, hi = cuts[block], min(len(rows), cuts[block] + BLOCK)
            got = _scores(queries[who], data[lo:hi])
            spots = (slot * BLOCK)[:, None] + np.arange(hi - lo)
            fit = rows[lo:hi][None, :] != own[who][:, None]
            fit &= ~has_kth[who][:, None] | (got >= kth[who][:, None])
            score[who[:, None], spots] = got
            at[who[:, None], spots] = np.where(fit, np.arange(lo, hi)[None, :], -1)
        score, at = np.concatenate([top_score, score], 1), np.concatenate([top_at, at], 1)
        best = np.lexsort((np.where(at >= 0, rank[at], 0), -np.maximum(score, -_LONG), at < 0), axis=1)[:, :k]
        top_score, top_at = score[mine, best], at[mine, best]
        if top_at.shape[1] == k:
            full = top_at[:, -1] >= 0
            kth = np.where(full, top_score[:, -1], kth)
            has_kth |= full
        start, step = start + step, step * 2
    who, spot = np.nonzero(top_at >= 0)
    return who, top_at[who, spot], top_score[who, spot]


def _tie_rank(ids: list, rows: np.ndarray) -> np.ndarray:
    """Place of every row in the order of ids (null last), then rows."""
    none = np.array([i is None for i in ids], bool)
    order = np.lexsort((rows, np.array([0 if i is None else i for i in ids], np.int64), none))
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    return rank


def _unpack(row: dict, width: str = "dim") -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(row["rows"], np.int64)
    return rows, np.frombuffer(row["data"]).reshape(len(rows), row[width])


def _seed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Every query with its best rows in its own range and the k-th score there (null if it has fewer)."""
    hit = pa.list_(pa.struct([("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.int64())]))
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            rows, data = _unpack(row)
            asks = np.flatnonzero(np.frombuffer(row["query"], bool))
            none = np.zeros(len(asks), np.int64)
            who, at, score = _best_in_range(data[asks], rows[asks], none, none.astype(bool), data, rows, _tie_rank(row["ids"], rows), k)
            hits: list[list] = [[] for _ in asks]
            for q, a, s in zip(who.tolist(), at.tolist(), score.tolist(), strict=True):
                hits[q].append({"vec_id": row["ids"][a], "row": int(rows[a]), "score": s})
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows[asks]), pa.array([row["ids"][a] for a in asks], pa.int64()), pa.array([row["range"]] * len(asks), pa.int64()),
                    pa.array([data[a].tobytes() for a in asks], pa.binary()), pa.array([h[-1]["score"] if len(h) == k else None for h in hits], pa.int64()),
                    pa.array(hits, hit),
                ],
                ["query_row", "query_id", "home", "v", "kth", "hits"],
            )


def _open_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every range the queries whose bound reaches their k-th score."""
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary()]
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            asked, bounds = row["asked"], row["bounds"]
            width = max(len(x["v"]) // 8 for x in asked)
            queries = _padded([np.frombuffer(x["v"]) for x in asked], width)
            wide = max(len(x["hi"]) // 8 for x in bounds)
            hi, lo = (_padded([np.frombuffer(x[c]) for x in bounds], wide) for c in ("hi", "lo"))
            kth = np.array([-math.inf if x["kth"] is None else float(np.nextafter(x["kth"], -math.inf)) for x in asked])
            home = np.array([x["home"] for x in asked], np.int64)
            query_rows = np.array([x["query_row"] for x in asked], np.int64)
            reach = _bounds(queries, hi, lo) >= kth[:, None]
            for r, bound in enumerate(bounds):
                who = np.flatnonzero(reach[:, r] & (home != bound["range"]))
                if len(who):
                    values = [bound["range"], query_rows[who].tobytes(), [asked[q]["query_id"] for q in who], [asked[q]["kth"] for q in who], width, queries[who].tobytes()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], t) for v, t in zip(values, kinds, strict=True)], ["range", "query_row", "query_id", "kth", "dim", "v"]
                    )


def _score_ranges(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            rows, data = _unpack(row, "width")
            query_rows = np.frombuffer(row["query_row"], np.int64)
            queries = np.frombuffer(row["v"]).reshape(len(query_rows), row["dim"])
            kth = np.array([x or 0 for x in row["kth"]], np.int64)
            has = np.array([x is not None for x in row["kth"]], bool)
            who, at, score = _best_in_range(queries, query_rows, kth, has, data, rows, _tie_rank(row["ids"], rows), k)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(query_rows[who]), pa.array([row["query_id"][q] for q in who], pa.int64()),
                    pa.array([row["ids"][a] for a in at], pa.int64()), pa.array(rows[at]), pa.array(score),
                ],
                ["query_row", "query_id", "vec_id", "row", "score"],
            )
