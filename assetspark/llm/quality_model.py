"""Quality selection by importance resampling with hashed n-gram models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import BYTE_CODE, longs, mix, prefix_sums, span_hash, text_chunks, word_spans

#: Buckets of the n-gram models, and labelled rows used at most to fit target and threshold.
BUCKETS = 1 << 16
LABELLED_ROWS = 20_000
#: Features of the text length at which weights are compared, so that long texts don't outweigh short ones.
SPAN = 100
#: Steps of one unit of the selection key.
STEPS = 1024
_C = np.uint64(0xA0761D6478BD642F)


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all rows: (row, bucket).

    Byte trigrams inside a row, and for each word whether it is the word before it again (a
    bigram of two equal words is one feature, whatever the word).
    """
    n = len(data)
    inside = np.ones(max(0, n - 2), bool)
    for back in (1, 2):
        at = offsets[1:-1] - back
        inside[at[(at >= 0) & (at < len(inside))]] = False
    first = np.flatnonzero(inside)
    code = data.astype(np.uint64)
    grams = mix((code[first] << np.uint64(16)) | (code[first + 1] << np.uint64(8)) | code[first + 2]) % np.uint64(buckets - 2)
    starts, ends, rows = word_spans(data, offsets)
    words = span_hash(prefix_sums(data, BYTE_CODE), starts, ends)
    again = (rows[1:] == rows[:-1]) & (words[1:] == words[:-1])
    pair = np.flatnonzero(rows[1:] == rows[:-1])
    row = np.concatenate([np.searchsorted(offsets, first, "right") - 1, rows[1:][pair]])
    return row, np.concatenate([grams.astype(np.int64), buckets - 2 + again[pair].astype(np.int64)])


def _histograms(targets: np.ndarray, buckets: int):
    """Feature counts of one task: of all texts, and of the target texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch, data, offsets in text_chunks(batches):
            row, bucket = features(data, offsets, buckets)
            raw += np.bincount(bucket, minlength=buckets)
            wanted = np.isin(longs(batch.column("_id"), np.iinfo(np.int64).min), targets)
            if wanted.any():
                target += np.bincount(bucket[wanted[row]], minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"])

    return run


def _scores(ratio):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ratio.value
        for batch, data, offsets in text_chunks(batches):
            row, bucket = features(data, offsets, len(table))
            n = batch.num_rows
            total = SPAN * np.bincount(row, weights=table[bucket], minlength=n) / np.maximum(1, np.bincount(row, minlength=n))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").cast(pa.int64()), pa.array(total)], names=["_id", "score"]
            )

    return run


def fit_ratio(docs: DataFrame, target_ids: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """log of target over raw probability for each bucket, both from counts over all texts.

    Counts are summed per task before they are shuffled and at most ``buckets`` rows reach the
    driver. Both models are smoothed with the same small share of an even one.
    """
    rows = (
        docs.mapInArrow(_histograms(target_ids, buckets), "bucket long, raw long, target long")
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    )
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(buckets)
    even = 1e-4
    model = lambda c: (1 - even) * c / c.sum() + even / buckets
    return np.log(model(target)) - np.log(model(raw))


def threshold_of(scores: np.ndarray, good: np.ndarray) -> float:
    """The score that best splits labelled rows: half of both classes' hit rates; lowest on ties."""
    if not len(scores) or good.all() or not good.any():
        return -np.inf
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    # the cut stands after the first i rows
    rejected_bad = np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()
    kept_good = 1 - np.concatenate([[0], np.cumsum(g)]) / g.sum()
    i = int(np.argmax(rejected_bad + kept_good))
    return float(-np.inf if i == 0 else s[i - 1])


def gumbel_key(score: Column, id_col: Column, seed: int) -> Column:
    """score + standard Gumbel noise from a hash of the id, in whole steps."""
    unit = (F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 12).cast("double") + 0.5) / float(1 << 52)
    return F.floor((score - F.log(-F.log(unit))) * STEPS).cast("long")


def kth_largest(keys: DataFrame, column: str, k: int) -> int:
    """The k-th largest value of a long column, by four histograms of 16 bits each.

    Every histogram has at most 65,536 rows; the rows themselves are never ordered or gathered.
    """
    known, left = 0, k
    shifted = keys.select((F.col(column) + F.lit(1 << 62)).alias("v"))
    for level in (48, 32, 16, 0):
        part = F.shiftrightunsigned("v", level)
        rows = shifted if level == 48 else shifted.filter(F.shiftrightunsigned("v", level + 16) == known)
        counts = sorted(((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()), reverse=True)
        for p, n in counts:
            if n >= left:
                known = p
                break
            left -= n
    return known - (1 << 62)


def quality_selection(
    docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, buckets: int = BUCKETS, seed: int = 11,
    share: float | None = None, id_col: str = "doc_id",
) -> DataFrame:
    """One row per document: id, score, sample_key, kept.

    Two generative models over hashed n-grams are counted: one over the texts labelled as good,
    one over all texts. ``score`` is the log of their ratio, the importance weight of ``SPAN``
    average features of the text; adding Gumbel noise and taking the k largest keys samples k documents without
    replacement in proportion to their weights. k is ``share`` of all documents or, by default,
    the number of documents that score above the threshold that best splits the labelled rows.

    At most ``labelled_rows`` labelled ids, chosen by hash, fit the target model and the threshold; the
    raw model, the scores and k cover all documents. Without usable labels every document is kept. Keys that
    tie with the k-th stay together. Null and empty texts score 0; a null id has a key too;
    repeated rows have equal keys; extra columns are not read; an empty table gives no rows.
    """
    sample = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("q"))
        .filter("_id is not null and q is not null").orderBy(F.xxhash64("_id", F.lit(seed)), "_id", "q").limit(labelled_rows).collect()
    )
    label = {r["_id"]: r["q"] == 1 for r in sample}  # bounded by labelled_rows
    good = np.array(sorted(i for i, q in label.items() if q), np.int64)
    ids = np.array(sorted(label), np.int64)
    is_good = np.array([label[i] for i in ids.tolist()], bool)
    source = docs.select(F.col(id_col).cast("long").alias("_id"), "text")
    context = docs.sparkSession.sparkContext
    ratio = context.broadcast(fit_ratio(source, good, buckets))
    scored = cut_lineage(source.mapInArrow(_scores(ratio), "_id long, score double").withColumn("sample_key", gumbel_key(F.col("score"), F.col("_id"), seed)))
    total = scored.count()
    if share is None:
        marked = docs.sparkSession.createDataFrame([(i, q) for i, q in zip(ids.tolist(), is_good.tolist(), strict=True)], "_id long, good boolean")
        rows = scored.join(marked, "_id").select("score", "good").distinct().collect()  # bounded by labelled_rows
        limit = threshold_of(np.array([r["score"] for r in rows]), np.array([r["good"] for r in rows], bool))
        k = total if limit == -np.inf else scored.filter(F.col("score") > limit).count()
    else:
        k = round(share * total)
    lowest = kth_largest(scored, "sample_key", k) if 0 < k < total else None
    kept = F.lit(k > 0) if lowest is None else F.col("sample_key") >= lowest
    return scored.select(F.col("_id").alias(id_col), "score", "sample_key", kept.alias("kept"))
