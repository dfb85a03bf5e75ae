"""Repeated byte spans by bucket-pointer refinement of sampled suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import BYTE_CODE, longs, mix, powers, prefix_sums, signed, spread, text_chunks

#: Bytes of the q-grams that make the first buckets.
Q = 36
_C1, _C2, _C3 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
#: Starts that one node of the second refinement holds.
NODE = 8
#: Bits of a sort value that hold the place inside a chunk; more than any Spark string has.
_PLACE = 32


def bucket_ids(data: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket identifiers of all offsets: at depth q, and refined to depth ``length``.

    The first buckets are those of the q-grams. A bucket of depth d is refined by the bucket
    identifier at a later offset: (id at i, id at i + s) with s <= d names a bucket of depth
    d + s; the refined identifiers are used again for the next step until the depth is reached.
    Identifiers are made from the contents, so every task gives equal strings the same one.
    Entries whose string would leave the data are meaningless.
    """
    n = len(data)
    sums = prefix_sums(data, BYTE_CODE)
    _, down = powers(n + 1)
    first = np.zeros(n, np.uint64)
    if n >= q:
        first[: n - q + 1] = mix((sums[q:] - sums[: n - q + 1]) * down[: n - q + 1])
    ids, depth = first, q
    while depth < length:
        step = min(depth, length - depth)
        later = np.zeros(n, np.uint64)
        later[: n - step] = ids[step:]
        ids, depth = mix(ids * _C1 + later + np.uint64(step)), depth + step
    return first, ids


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, q: int) -> tuple[np.ndarray, ...]:
    """The sampled suffixes: (row, anchor, low, high, q-gram bucket, refined buckets).

    Every start s of a string of ``length`` bytes inside a row belongs to the offset in
    [s, s + length - q] with the smallest q-gram bucket (the first on ties). The starts of one
    anchor form the range low..high. Equal strings have their anchor at the same distance and in
    the same bucket, so only starts of anchors of one bucket can be equal.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    first, deep = bucket_ids(data, length, q)
    sizes = np.diff(offsets)
    fits = np.flatnonzero(sizes >= length)
    starts = spread(offsets[:-1][fits], sizes[fits] - length + 1)
    if not len(starts):
        return none, none, none, none, first, deep
    value = (mix(first ^ _C3) & ~np.uint64((1 << _PLACE) - 1)) | np.arange(n, dtype=np.uint64)
    span, width = length - q + 1, 1
    while 2 * width <= span:
        value[: n - width] = np.minimum(value[: n - width], value[width:])
        width *= 2
    rest = span - width
    if rest:
        value[: n - rest] = np.minimum(value[: n - rest], value[rest:])
    anchor = (value[starts] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(starts)) - 1
    low, high, anchor = starts[begin], starts[last], anchor[begin]
    return np.searchsorted(offsets, low, "right") - 1, anchor, low, high, first, deep


def string_checks(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A second hash of the strings at the given offsets, chained over their words of eight bytes; it shares nothing with the bucket identifiers."""
    padded = np.concatenate([data.view(np.uint8), np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))
    out = np.full(len(at), length, np.uint64)
    for j in range(0, length, 8):
        word = words[at + j]
        if length - j < 8:
            word &= np.uint64((1 << 8 * (length - j)) - 1)
        out = mix((out ^ word) * _C3 + np.uint64(j + 1))
    return out


def _first_of(keys: list[np.ndarray]) -> np.ndarray:
    """For rows sorted by the keys: true where any key changes."""
    new = np.ones(len(keys[0]), bool)
    same = np.ones(max(0, len(keys[0]) - 1), bool)
    for key in keys:
        same &= key[1:] == key[:-1]
    new[1:] = ~same
    return new


_SUFFIX = "bucket long, deep long, id long, hash long, low long, shape int"


def text_hash(doc_id: Column, text: Column) -> Column:
    """Second part of a document's key and order, after its id: a hash of the text, negative under an id and not under a null one."""
    top = F.lit(np.iinfo(np.int64).min)
    hashed = F.xxhash64(F.coalesce(text, F.lit("")))
    return F.when(doc_id.isNull(), hashed.bitwiseAND(F.lit(np.iinfo(np.int64).max))).otherwise(hashed.bitwiseOR(top))


def _documents(batch: pa.RecordBatch, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, hash) of the rows' documents; a null id is the largest."""
    return longs(batch.column("_id"), np.iinfo(np.int64).max)[row], longs(batch.column("_hash"), 0)[row]


def _emit(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _sample(length: int, q: int):
    """Sampled suffixes of the documents; shape packs high - low and anchor - low.

    Suffixes of one chunk that agree in bucket, shape and content are settled here: the first
    stays, the others come out as settled repeats (shape -1 - (high - low)), under the bucket of
    their place so that they spread. A very common string thus sends one row per chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_chunks(batches):
            row, anchor, low, high, first, deep = anchors(data, offsets, length, q)
            if not len(row):
                continue
            ids, hashes = _documents(batch, row)
            place = low - offsets[row]
            shape = ((high - low) << 10 | (anchor - low)).astype(np.int64)
            key = mix(deep[low] * _C1 + deep[high] * _C2 + shape.astype(np.uint64))
            bucket = first[anchor]
            order = np.lexsort((place, hashes, ids, key, bucket))
            # a repeated row of one document has the same places: they count once
            order = order[_first_of([bucket[order], key[order], ids[order], hashes[order], place[order]])]
            bucket, key, ids, hashes, place, shape = (x[order] for x in (bucket, key, ids, hashes, place, shape))
            new = _first_of([bucket, key])
            spot = mix(ids.view(np.uint64) * _C1 + hashes.view(np.uint64) + place.astype(np.uint64))
            yield _emit(
                ["bucket", "deep", "id", "hash", "low", "shape"],
                signed(np.where(new, bucket, spot)), signed(np.where(new, key, spot)), ids, hashes, place,
                np.where(new, shape, -1 - (shape >> 10)).astype(np.int32),
            )

    return run


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes to (id, hash, low, high, anchor): repeats (anchor -1) and open representatives.

    Inside a bucket the rows come by refined identifier and place. All but the first row of an
    identifier repeat it. The first rows of a bucket with several identifiers stay open: their
    contexts differ somewhere, but some of their strings may still be equal. Only one row is kept
    from batch to batch, however large the bucket.
    """
    held = None  # (bucket, deep, id, hash, low, shape, open) of the last representative
    names = ["id", "hash", "low", "high", "anchor", "bucket"]
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, deep, ids, hashes, low, shape = (longs(batch.column(i), 0) for i in range(6))
        opened = np.zeros(len(bucket), bool)
        if held is not None:
            bucket, deep, ids, hashes, low, shape = (
                np.concatenate([[h], x]) for h, x in zip(held[:6], (bucket, deep, ids, hashes, low, shape), strict=True)
            )
            opened = np.concatenate([[held[6]], opened])
        settled = shape < 0
        new = _first_of([bucket, deep]) & ~settled
        if held is not None:
            new[0] = True
        repeat = ~new
        lead = np.flatnonzero(new)
        # one row's sampled starts seen twice (a repeated document row) are the same place
        owner = np.searchsorted(lead, np.arange(len(new)), "right") - 1
        own = repeat & ~settled
        if len(lead):
            head = lead[np.maximum(owner, 0)]
            own &= (ids == ids[head]) & (hashes == hashes[head]) & (low == low[head])
        with_next = np.zeros(len(lead), bool)
        with_next[:-1] = bucket[lead[1:]] == bucket[lead[:-1]]
        is_open = opened[lead] | with_next
        is_open[1:] |= with_next[:-1]
        out = np.flatnonzero(repeat & ~own)
        if len(lead):
            at = lead[-1]
            held = (bucket[at], deep[at], ids[at], hashes[at], low[at], shape[at], bool(is_open[-1]))
        else:
            held = None
        extent = np.where(settled, -1 - shape, shape >> 10)
        yield _emit(names, ids[out], hashes[out], low[out], low[out] + extent[out], np.full(len(out), -1), bucket[out])
        ready = lead[:-1][is_open[:-1]]
        yield _emit(names, ids[ready], hashes[ready], low[ready], low[ready] + extent[ready], low[ready] + (shape[ready] & 1023), bucket[ready])
    if held is not None and held[6]:
        extent = held[5] >> 10
        yield _emit(names, *(np.array([x]) for x in (held[2], held[3], held[4], held[4] + extent, held[4] + (held[5] & 1023), held[0])))


def _open_spans(batch: pa.RecordBatch, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, low, high, anchor) of the spans listed with the documents."""
    spans = batch.column("_spans")
    counts = np.diff(np.frombuffer(spans.buffers()[1], np.int32)[spans.offset : spans.offset + len(spans) + 1])
    fields = spans.flatten()
    low, high, anchor = (longs(fields.field(i), 0) for i in range(3))
    row = np.repeat(np.arange(batch.num_rows), counts)
    inside = high + length <= np.diff(offsets)[row]
    return row[inside], low[inside], high[inside], anchor[inside]


def _nodes(length: int, q: int):
    """Open representatives cut into nodes of a few starts, by their distance to the anchor.

    The bucket of a node is refined by the bytes that all strings of the node share, its deep
    identifier by all its bytes. A bucket with one row then has no equal string anywhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_chunks(batches):
            row, low, high, anchor = _open_spans(batch, offsets, length)
            if not len(low):
                continue
            first, deep = bucket_ids(data, length, q)
            _, core = bucket_ids(data, length - NODE + 1, min(q, length - NODE + 1))
            # nodes of distance anchor - start: number k holds NODE * k .. NODE * k + NODE - 1
            near, far = (anchor - high) // NODE, (anchor - low) // NODE
            k = spread(near, far - near + 1)
            row, low, high, anchor = (np.repeat(x, far - near + 1) for x in (row, low, high, anchor))
            low, high = np.maximum(low, anchor - NODE * k - NODE + 1), np.minimum(high, anchor - NODE * k)
            base = offsets[row]
            bucket = mix(first[base + anchor] * _C1 + core[base + anchor - NODE * k] * _C2 + k.astype(np.uint64))
            shape = (high - low) << 10 | (anchor - low)
            key = mix(deep[base + low] * _C1 + deep[base + high] * _C2 + shape.astype(np.uint64))
            yield _emit(["bucket", "deep", "id", "hash", "low", "shape"], signed(bucket), signed(key), *_documents(batch, row), low, shape.astype(np.int32))

    return run


def _strings(length: int, q: int):
    """The single strings of open nodes: (string, check, id, hash, low), settled inside a chunk.

    Strings are equal when two hashes made in different ways are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_chunks(batches):
            row, low, high, anchor = _open_spans(batch, offsets, length)
            if not len(low):
                continue
            first, deep = bucket_ids(data, length, q)
            runs = high - low + 1
            place = spread(low, runs)
            row, anchor = np.repeat(row, runs), np.repeat(anchor, runs)
            at = offsets[row] + place
            string = mix(deep[at] * _C1 + first[offsets[row] + anchor] * _C2 + (anchor - place).astype(np.uint64))
            ids, hashes = _documents(batch, row)
            check = string_checks(data, at, length)
            order = np.lexsort((place, hashes, ids, check, string))
            order = order[_first_of([string[order], check[order], ids[order], hashes[order], place[order]])]
            string, check, ids, hashes, place = string[order], check[order], ids[order], hashes[order], place[order]
            new = _first_of([string, check])
            spot = mix(ids.view(np.uint64) * _C3 + hashes.view(np.uint64) + place.astype(np.uint64))
            yield _emit(["string", "check", "id", "hash", "low"], signed(np.where(new, string, spot)), signed(check), ids, hashes, np.where(new, place, -1 - place))

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted strings to the places that repeat an earlier one: (id, hash, low)."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        string, check, ids, hashes, low = (longs(batch.column(i), 0) for i in range(5))
        if held is not None:
            string, check, ids, hashes, low = (np.concatenate([[h], x]) for h, x in zip(held, (string, check, ids, hashes, low), strict=True))
        settled = low < 0
        new = _first_of([string, check]) & ~settled
        if held is not None:
            new[0] = True
        lead = np.flatnonzero(new)
        repeat = ~new
        if len(lead):
            owner = lead[np.maximum(np.searchsorted(lead, np.arange(len(new)), "right") - 1, 0)]
            repeat &= settled | (ids != ids[owner]) | (hashes != hashes[owner]) | (low != low[owner])
            held = (string[lead[-1]], check[lead[-1]], ids[lead[-1]], hashes[lead[-1]], low[lead[-1]])
        out = np.flatnonzero(repeat)
        yield _emit(["id", "hash", "low"], ids[out], hashes[out], np.where(low[out] < 0, -1 - low[out], low[out]))


def _cut(length: int, with_text: bool):
    """Documents without the bytes that their marked starts cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_chunks(batches):
            n = batch.num_rows
            spans = batch.column("_spans")
            counts = np.diff(np.frombuffer(spans.buffers()[1], np.int32)[spans.offset : spans.offset + len(spans) + 1])
            fields = spans.flatten()
            low, high = longs(fields.field(0), 0), longs(fields.field(1), 0)
            row = np.repeat(np.arange(n), counts)
            sizes = np.diff(offsets)
            inside = high + length <= sizes[row]
            row, low, high = row[inside], low[inside], high[inside]
            step = np.zeros(len(data) + 1, np.int32)
            np.add.at(step, offsets[row] + low, 1)
            np.add.at(step, offsets[row] + high + length, -1)
            gone = np.cumsum(step[:-1]) > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            heads = offsets[:-1][sizes > 0]
            begins[heads] = gone[heads]
            total, spans_before = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(begins)])
            removed, runs = total[offsets[1:]] - total[offsets[:-1]], spans_before[offsets[1:]] - spans_before[offsets[:-1]]
            digests, texts = [], []
            for i in range(n):
                part = data[offsets[i] : offsets[i + 1]]
                left = (part[~gone[offsets[i] : offsets[i + 1]]] if removed[i] else part).tobytes()
                digests.append(hashlib.sha256(left).hexdigest())
                if with_text:
                    texts.append(left.decode("utf-8", "replace"))
            columns = [batch.column("_id").cast(pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(removed), pa.array(runs), pa.array(digests)]
            names = ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts)] * with_text, names=names + ["kept_text"] * with_text)

    return run


def cut_repeats(docs: DataFrame, length: int = 100, q: int = Q, id_col: str = "doc_id", with_text: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text).

    Every byte covered by a string of ``length`` bytes that also starts earlier (in a document
    before it, or earlier in the same one) is removed; strings never cross documents.

    Suffixes are sampled so that all starts of a string hang on one offset, and sorted into
    buckets by their q-gram. Buckets with one member are done. The others are refined by the
    bucket identifiers of later offsets, first for the whole context of a sampled suffix, which
    settles copies in one step, then for nodes of a few starts, then for the single strings where
    nodes differ. A sorted stream keeps one row in memory, whatever the size of a bucket.

    Documents are ordered by id, null ids last, and then by ``text_hash``. Rows of the same id (null
    too) and the same text are one document and are cut alike; other rows of one id are documents of
    their own. Null text is empty; a text shorter than ``length`` stays whole; an empty table gives no rows; extra
    columns are not read. ``kept_text`` replaces a character that was cut in its middle.
    """
    if not NODE <= q <= length - NODE or length > 1000:
        raise ValueError(f"{NODE} <= q <= length - {NODE} and length <= 1000 are asked")
    source = docs.select(F.col(id_col).cast("long").alias("_id"), "text").withColumn("_hash", text_hash(F.col("_id"), F.col("text")))
    parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    refined_kind = "id long, hash long, low long, high long, anchor long, bucket long"

    def refined_of(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "deep", "id", "hash", "low").mapInArrow(_refine, refined_kind)

    def opened(refined: DataFrame) -> DataFrame:
        spans = F.collect_list(F.struct("low", "high", "anchor")).alias("_spans")  # those of one document
        of_documents = refined.filter("anchor >= 0").groupBy(F.col("id").alias("_key"), F.col("hash").alias("_hash")).agg(spans)
        return dealt.join(of_documents, ["_key", "_hash"]).select("_id", "text", "_hash", "_spans")

    # the documents are dealt by id and text once; all later passes over the texts read the same exchange
    dealt = source.withColumn("_key", F.coalesce("_id", F.lit(np.iinfo(np.int64).max))).repartition(parts, "_key", "_hash")
    contexts = cut_lineage(refined_of(source.filter(F.octet_length("text") >= length).mapInArrow(_sample(length, q), _SUFFIX)))
    nodes = refined_of(opened(contexts).mapInArrow(_nodes(length, q), _SUFFIX))
    strings = (
        opened(nodes).mapInArrow(_strings(length, q), "string long, check long, id long, hash long, low long")
        .repartition(parts, "string").sortWithinPartitions("string", "check", "id", "hash", "low").mapInArrow(_later, "id long, hash long, low long")
    )
    marks = (
        contexts.filter("anchor < 0").select("id", "hash", "low", "high")
        .union(nodes.filter("anchor < 0").select("id", "hash", "low", "high"))
        .union(strings.select("id", "hash", "low", F.col("low").alias("high")))
        .groupBy(F.col("id").alias("_key"), F.col("hash").alias("_hash"))
        .agg(F.collect_list(F.struct("low", "high")).alias("_spans"))
    )
    none = F.array().cast("array<struct<low:bigint,high:bigint>>")
    kind = "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    cut = dealt.join(marks, ["_key", "_hash"], "left").select("_id", "text", F.coalesce("_spans", none).alias("_spans")).mapInArrow(_cut(length, with_text), kind)
    return cut.withColumnRenamed("_id", id_col)
