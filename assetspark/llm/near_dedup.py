"""Near duplicates: fast similarity sketches, banding, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import BYTE_CODE, LOWER, longs, mix, prefix_sums, signed, span_hash, text_chunks, word_spans

#: Coordinates of a sketch, and coordinates in a band. A pair of similarity 0.8 misses all 32
#: bands of 4 with a probability of 5e-8.
COORDINATES = 128
BAND = 4
#: Rounds of pivots before the remaining members of unsettled buckets are joined by prefixes, and
#: pivots that the buckets of one group get in a later round.
PIVOT_ROUNDS = 2
PIVOTS = 4

_LOW_CODE = BYTE_CODE[LOWER]
_C1, _C2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every row: (row, 64-bit shingle), sorted by both.

    Words are lower-cased in A-Z; a row with fewer than ``width`` words has its whole sequence as
    its one shingle; a row without words has none.
    """
    starts, ends, rows = word_spans(data, offsets)
    n = len(offsets) - 1
    words = span_hash(prefix_sums(data, _LOW_CODE), starts, ends)
    counts = np.bincount(rows, minlength=n)
    firsts = np.cumsum(counts) - counts
    # full windows
    whole = np.arange(len(words)) + width <= (firsts + counts)[rows]
    at = np.flatnonzero(whole)
    value = np.zeros(len(at), np.uint64)
    for k in range(width):
        value = value * _C1 + words[at + k]
    row = rows[at]
    # short rows: fold the words they have, and their number
    short = np.flatnonzero((counts > 0) & (counts < width))
    folded = counts[short].astype(np.uint64) * _C2
    for k in range(width - 1):
        has = counts[short] > k
        folded[has] = folded[has] * _C1 + words[firsts[short][has] + k]
    row = np.concatenate([row, short])
    value = mix(np.concatenate([value, folded]))
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def sketches(row: np.ndarray, value: np.ndarray, n: int, t: int = COORDINATES) -> np.ndarray:
    """A sketch of ``t`` coordinates for each of n rows, by rounds of hashed bin placement.

    In round i < t every element falls into one hashed bin with the value (i, hash); in round
    t + b all elements fall into bin b, so no coordinate stays empty. A coordinate holds its
    smallest value, so a row is done once all its bins are filled: later rounds only bring larger
    values. Two rows agree in a coordinate exactly when its smallest value over both rows comes
    from an element they share. Rows without elements keep the largest number.
    """
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    bits = np.uint64(64 - int(t).bit_length() + 1)
    out = np.full((n, t), empty, np.uint64)
    flat = out.reshape(-1)
    for i in range(2 * t):
        if not len(row):
            break
        hashed = mix(value ^ mix(np.array([i + 1], np.uint64) * _C2))
        bins = (hashed >> bits).astype(np.int64) if i < t else np.full(len(row), i - t)
        placed = (np.uint64(i) << np.uint64(48)) | (hashed & np.uint64(0xFFFFFFFFFFFF))
        np.minimum.at(flat, row * t + bins, placed)
        present = np.unique(row)
        undone = np.zeros(n, bool)
        undone[present] = (out[present] == empty).any(axis=1)
        keep = undone[row]
        row, value = row[keep], value[keep]
    return out


def band_hashes(sketch: np.ndarray, size: int = BAND) -> np.ndarray:
    """One 64-bit hash for each band of ``size`` coordinates."""
    n, t = sketch.shape
    parts = sketch.reshape(n, t // size, size)
    out = np.broadcast_to(np.arange(t // size, dtype=np.uint64) * _C2, (n, t // size)).copy()
    for k in range(size):
        out = out * _C1 + mix(parts[:, :, k])
    return mix(out)


def _sums(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    np.add.at(out, row, value)
    return out


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_chunks(batches):
            n = batch.num_rows
            row, value = shingle_sets(data, offsets, width)
            sizes = np.bincount(row, minlength=n)
            bands = band_hashes(sketches(row, value, n))
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(n + 1, dtype=np.int32) * bands.shape[1]), pa.array(signed(np.ascontiguousarray(bands).reshape(-1)))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").cast(pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(signed(_sums(row, mix(value ^ _C1), n))),
                 pa.array(signed(_sums(row, mix(value ^ _C2), n))), lists],
                names=["_id", "n", "d1", "d2", "bands"],
            )

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_chunks(batches):
            row, value = shingle_sets(data, offsets, width)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(value)))], names=["_id", "shingles"]
            )

    return run


def links_of(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    A pair whose sizes differ too much for that is left out before its sets are joined.
    """
    sizes = sets.select("_id", F.size("shingles").alias("_n"))
    near = (
        pairs.join(sizes.select(F.col("_id").alias("a"), F.col("_n").alias("_na")), "a")
        .join(sizes.select(F.col("_id").alias("b"), F.col("_n").alias("_nb")), "b")
        .filter(100 * F.least("_na", "_nb") >= percent * F.greatest("_na", "_nb"))
        .select("a", "b")
    )
    both = F.size(F.array_intersect("_sa", "_sb"))
    return (
        near.join(sets.select(F.col("_id").alias("a"), F.col("shingles").alias("_sa")), "a")
        .join(sets.select(F.col("_id").alias("b"), F.col("shingles").alias("_sb")), "b")
        .filter(100 * both >= percent * (F.size("_sa") + F.size("_sb") - both))
        .select("a", "b")
    )


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links``: the smallest id reachable.

    Labels take the smallest label among the neighbours and then the label of their label, until
    nothing changes; each round is stored, links and labels stay distributed.
    """
    both = cut_lineage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("_c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("_c").alias("_near"))
        lower = labels.join(near, "id").select("id", "component", F.least("component", "_near").alias("_low"))
        roots = labels.select(F.col("id").alias("_low"), F.col("component").alias("_root"))
        new = cut_lineage(
            lower.join(roots, "_low", "left").select("id", F.least("_low", F.coalesce("_root", "_low")).alias("component"), F.col("component").alias("_old"))
        )
        labels = new.select("id", "component")
        if new.filter("component < _old").isEmpty():
            return labels


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with their component, in the buckets that still hold more than one."""
    named = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_buckets = named.groupBy("bucket").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).filter("_lo < _hi").select("bucket")
    return named.join(open_buckets, "bucket")


def _prefix_pairs(open_members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components among the given members that can be similar enough.

    Two sets of that similarity share one of their rarest shingles: of n shingles, the n -
    ceil(n * percent / 100) + 1 rarest. The first shared one, at places i and j of the two orders,
    leaves at most min(n - i, m - j) shared shingles, which must be enough for the sizes n and m.
    Joining under that condition makes few pairs, also where thousands of texts share a passage
    or are edited copies of one text just below the similarity.
    """
    nodes = open_members.select(F.col("rep").alias("_id"), "component").distinct()
    rows = sets.join(nodes, "_id").select("_id", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    counts = rows.groupBy("s").agg(F.count("*").alias("_f"))
    ranked = rows.join(counts.filter("_f > 1"), "s", "left").withColumn("_f", F.coalesce("_f", F.lit(1)))
    keep = F.col("n") - F.ceil(F.col("n") * percent / 100.0) + 1
    prefixes = (
        ranked.groupBy("_id", "component", "n")
        .agg(F.sort_array(F.collect_list(F.struct("_f", "s"))).alias("_all"))  # the shingles of one document
        .select("_id", "component", "n", F.posexplode(F.slice("_all", F.lit(1), keep.cast("int"))).alias("i", "_p"))
        .filter("_p._f > 1")
        .select("_id", "component", F.col("_p.s").alias("s"), "n", (F.col("n") - F.col("i")).alias("after"))
    )
    left, right = prefixes.alias("x"), prefixes.alias("y")
    enough = (100 + percent) * F.least("x.after", "y.after") >= percent * (F.col("x.n") + F.col("y.n"))
    return (
        left.join(right, F.expr("x.s = y.s and x.component < y.component") & enough)
        .select(F.col("x._id").alias("a"), F.col("y._id").alias("b"))
        .distinct()
    )


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text: Column | None = None) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    1. Each document gets the size and a 128-bit digest of its shingle set and the band hashes
       of its sketch; equal sets form a class, represented by the smallest id.
    2. Representatives that share a band hash stand in one bucket. Every member is compared with
       the bucket's pivot on the full sets. Buckets that still hold several components get other
       pivots, and what is left after that is joined by rare prefixes, so every pair of different
       components that shares a bucket and is similar enough is linked, without pairing all
       members of a bucket.
    3. Components of the links; classes bring them to all documents.

    A text without words is linked with nothing. A null id is never linked; its component is null
    and it is kept. Rows of one id are one document. Extra columns are not read; an empty table gives no rows.
    """
    source = docs.select(F.col(id_col).cast("long").alias("_id"), (F.col("text") if text is None else text).alias("text"))
    signed_docs = cut_lineage(source.mapInArrow(_signatures(width), "_id long, n long, d1 long, d2 long, bands array<long>"))
    classes = (
        signed_docs.filter("n > 0 and _id is not null")
        .groupBy("n", "d1", "d2")
        .agg(F.min("_id").alias("rep"), F.first("bands").alias("bands"))
    )
    placed = classes.select("rep", F.explode("bands").alias("bucket"))
    buckets = placed.groupBy("bucket").agg(F.min("rep").alias("_lo"), F.max("rep").alias("_hi")).filter("_lo < _hi").select("bucket")
    members = cut_lineage(placed.join(buckets, "bucket"))
    candidates = members.select(F.col("rep").alias("_id")).distinct()
    sets = cut_lineage(
        source.join(candidates, "_id", "left_semi").mapInArrow(_full_sets(width), "_id long, shingles array<long>").distinct()
    )

    # Round 0 takes the smallest id of a bucket as its pivot, later rounds one of a few by hash, so
    # that the many buckets of one group compare its members with several pivots.
    links = None
    labels = members.sparkSession.createDataFrame([], "id long, component long")
    for number in range(PIVOT_ROUNDS + 1):
        open_members = cut_lineage(_unsettled(members, labels))
        if open_members.isEmpty():
            break
        if number == PIVOT_ROUNDS:
            pairs = _prefix_pairs(open_members, sets, percent)
        else:
            order = F.col("rep") if number == 0 else F.xxhash64("rep", F.pmod("bucket", F.lit(PIVOTS)), F.lit(number))
            pivots = open_members.groupBy("bucket").agg(F.min_by(F.struct("rep", "component"), order).alias("_p"))
            pairs = (
                open_members.join(pivots, "bucket")
                .filter(F.col("component") != F.col("_p.component"))
                .select(F.least("rep", "_p.rep").alias("a"), F.greatest("rep", "_p.rep").alias("b"))
                .distinct()
            )
        found = cut_lineage(links_of(pairs, sets, percent))
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            labels = components(links)

    named = classes.select(F.col("n"), "d1", "d2", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "n", "d1", "d2", F.coalesce("component", "rep").alias("_component")
    )
    return (
        signed_docs.select("_id", "n", "d1", "d2")
        .join(named, ["n", "d1", "d2"], "left")
        .withColumn("component_id", F.when(F.col("_id").isNotNull(), F.when(F.col("n") > 0, F.col("_component")).otherwise(F.col("_id"))))
        .select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, one of each component, with all their columns."""
    stay = near_groups(docs, width, percent).filter("kept").select(F.col("doc_id").alias("_stay")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["_stay"]), "left_semi")
