"""Alignment of two tokenizers' tokens by the merge path of their byte ends.

Both tokenizers cut the same bytes, so the ends of their tokens are two rising sequences; where they agree a group of tokens
ends. The merge of the two sequences is a path through a grid. Diagonals at equal distances cut the path into pieces of equal
work, and a binary search along every diagonal finds where the path crosses it, so each piece knows its stretch of both
sequences and is merged by itself. Two equal ends may fall on both sides of a cut; the stitching step compares the last A end of a
piece with the first B end of the next. All texts of a chunk are one merge, since both sequences end with every text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import release_memory
from .tokens import process_cache

#: Merge steps of a piece.
PIECE = 1 << 15
#: Text bytes of a chunk (a longer text is a chunk of its own).
CHUNK = 1 << 19
#: Id pairs up to which their counts are sent to all tasks; more are joined by a shuffle.
PAIR_ROWS = 1_000_000


# ---------------------------------------------------------------- tokenizers


@dataclass
class Tokenizers:
    """What both tokenizers are made of: A's vocabulary file and splitting pattern, B's model file."""

    byte_bpe: str
    pattern: str
    piece_model: bytes

    @classmethod
    def read(cls, byte_bpe: str, pattern: str, piece_model: str) -> Tokenizers:
        with open(byte_bpe, encoding="utf-8") as a, open(piece_model, "rb") as b:
            return cls(a.read(), pattern, b.read())


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: visible Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers with the bytes of all their tokens."""

    def __init__(self, made: Tokenizers) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken

        self.json = made.byte_bpe
        spec = json.loads(made.byte_bpe)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        letters = _byte_letters()
        vocabulary = spec["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for word, i in vocabulary.items():
            self.bytes_a[i] = word.encode() if word in special else bytes(letters[c] for c in word)
        # ids of this kind of vocabulary follow the order of the merges, so they are ranks
        ranks = {self.bytes_a[i]: i for word, i in vocabulary.items() if word not in special}
        self.a = tiktoken.Encoding("bytes", pat_str=made.pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=made.piece_model)
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(self.b.id_to_piece(i) for i in range(self.b.get_piece_size()))
        ]
        self.length_a, self.length_b = (np.array([len(t) for t in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        self.whole = None

    def encode_a(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self.a.encode_to_numpy(text, disallowed_special=()), np.int64)
        except BaseException as error:  # a text too long for its regular expression ends in a panic, which is no Exception
            if isinstance(error, (KeyboardInterrupt, SystemExit)):
                raise
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_str(self.json)
                self.whole.encode_special_tokens = True
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.int64)

    def encode(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A (space + text) and of B (text); none where the tokens' bytes are not exactly space + text."""
        empty = np.zeros(0, np.int64)
        strings = []
        for raw in texts:
            try:
                strings.append(raw.decode())
            except UnicodeDecodeError:  # no tokenizer gives back such bytes
                strings.append("")
        out_a, out_b = [], []
        for raw, text, b in zip(texts, strings, self.b.encode(strings, num_threads=1) if strings else [], strict=True):
            a = self.encode_a(" " + text) if text else empty
            bytes_a, bytes_b = self.bytes_a, self.bytes_b
            want = b" " + raw
            same = text and b"".join([bytes_a[i] for i in a.tolist()]) == want and b"".join([bytes_b[i] for i in b]) == want
            out_a.append(a if same else empty)
            out_b.append(np.array(b, np.int64) if same else empty)
        return out_a, out_b


# ---------------------------------------------------------------- merge path


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many elements of ``a`` are among the first d of the merge, for every diagonal d (equal ones: ``a`` first).

    All diagonals are searched at once: the answer is the least i for which b[d - i - 1] < a[i].
    """
    low = np.maximum(0, diagonals - len(b))
    high = np.minimum(diagonals, len(a))
    while (low < high).any():
        i = (low + high) // 2
        live = low < high
        at, opposite = np.where(live, i, 0), np.where(live, diagonals - i - 1, 0)
        taken = live & (a[at] <= b[opposite])
        low = np.where(taken, i + 1, low)
        high = np.where(live & ~taken, i, high)
    return low


def _piece(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both stretches of the ends they share."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    hit = np.flatnonzero(b[at] == a)
    return hit, at[hit]


def shared_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Indexes into both rising sequences of the values they share."""
    total = len(a) + len(b)
    diagonals = np.append(np.arange(0, total, piece), total)
    in_a = crossings(a, b, diagonals)
    in_b = diagonals - in_a
    out_a, out_b = [], []
    for p in range(len(diagonals) - 1):
        a0, a1, b0, b1 = in_a[p], in_a[p + 1], in_b[p], in_b[p + 1]
        hit_a, hit_b = _piece(a[a0:a1], b[b0:b1])
        out_a.append(hit_a + a0)
        out_b.append(hit_b + b0)
        # stitch: of two equal ends A's comes first, so a cut can only part A's last from the next piece's first of B
        if 0 < a1 and b1 < len(b) and a[a1 - 1] == b[b1]:
            out_a.append(np.array([a1 - 1]))
            out_b.append(np.array([b1]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


@dataclass
class Aligned:
    """Tokens of some texts; group g of text t ends behind tokens ``last_a[g]`` and ``last_b[g]``."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray
    ends: np.ndarray
    groups: np.ndarray


def align(pair: Pair, texts: list[bytes]) -> Aligned:
    each_a, each_b = pair.encode(texts)
    none = np.zeros(0, np.int64)
    ids_a, ids_b = np.concatenate([none, *each_a]), np.concatenate([none, *each_b])
    ends_a, ends_b = np.cumsum(pair.length_a[ids_a]), np.cumsum(pair.length_b[ids_b])
    n_a, n_b = (np.array([len(x) for x in each], np.int64) for each in (each_a, each_b))
    last_a, last_b = shared_ends(ends_a, ends_b)
    text_of = np.repeat(np.arange(len(texts)), n_a)[last_a]
    size = np.array([len(t) + 1 if n else 0 for t, n in zip(texts, n_a.tolist(), strict=True)], np.int64)
    return Aligned(ids_a, ids_b, n_a, n_b, last_a, last_b, ends_a[last_a] - (np.cumsum(size) - size)[text_of], np.bincount(text_of, minlength=len(texts)))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows of about CHUNK text bytes together, with the bytes of their texts (null: empty)."""
    for batch in batches:
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        start = size = 0
        for i, text in enumerate(texts):
            if i > start and size + len(text) > CHUNK:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(text)
        if start < len(texts):
            yield batch.slice(start), texts[start:]
        del texts
        release_memory()


def _worker_pair(made: Tokenizers) -> Pair:
    key = hashlib.sha256(f"{made.pattern}\0{made.byte_bpe}".encode() + made.piece_model).hexdigest()
    return process_cache(f"pair_{key}", lambda: Pair(made))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


# ---------------------------------------------------------------- outputs


def token_groups(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """One row per group: doc_id, group (from 0), end (byte offset behind it in space + text), a_ids and b_ids.

    Texts that are null, empty, no valid UTF-8 or that a tokenizer does not give back byte for byte have no groups.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizers)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _chunks(batches):
            found = align(_worker_pair(shared.value), texts)
            first = np.repeat(np.cumsum(found.groups) - found.groups, found.groups)
            arrays = [
                batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(texts)), found.groups))),
                pa.array(np.arange(len(first)) - first, pa.int32()), pa.array(found.ends, pa.int64()),
                *(
                    pa.ListArray.from_arrays(pa.array(np.append(0, last + 1), pa.int32()), pa.array(ids, pa.int32()))
                    for last, ids in ((found.last_a, found.ids_a), (found.last_b, found.ids_b))
                ),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "group", "end", "a_ids", "b_ids"])

    return _texts(docs).drop("row").mapInArrow(rows, "doc_id long, group int, end long, a_ids array<int>, b_ids array<int>")


def _group_texts(found: Aligned, names: list[list[str]]) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of every text. names: of both tokenizers' ids, followed by a comma, a bar or a semicolon."""
    size_a, size_b = len(names[0]) // 2, len(names[1]) // 2
    code_a, code_b = found.ids_a.copy(), found.ids_b.copy()
    code_a[found.last_a] += size_a
    code_b[found.last_b] += size_b
    code_b += len(names[0])
    a_per, b_per = (np.diff(last, prepend=-1) for last in (found.last_a, found.last_b))
    # A's tokens of a group stand before B's
    to_a = np.arange(len(code_a)) + np.repeat(np.cumsum(b_per) - b_per, a_per)
    to_b = np.arange(len(code_b)) + np.repeat(np.cumsum(a_per), b_per)
    codes = np.empty(len(code_a) + len(code_b), np.int64)
    codes[to_a], codes[to_b] = code_a, code_b
    table = (names[0] + names[1]).__getitem__
    out, at = [], 0
    for n in (found.n_a + found.n_b).tolist():
        out.append("".join(map(table, codes[at : at + n].tolist()))[:-1])
        at += n
    return out


def _alignment_rows(pair: Pair) -> Callable[[pa.RecordBatch, list[bytes]], pa.RecordBatch]:
    names = [
        [f"{i}{mark}" for mark in marks for i in range(len(table))] for table, marks in ((pair.bytes_a, ",|"), (pair.bytes_b, ",;"))
    ]
    width = len(pair.bytes_b)

    def rows(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        found = align(pair, texts)
        digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in _group_texts(found, names)]
        of = np.repeat(np.arange(len(texts)), found.groups)
        # links of a text by id pair
        key = found.ids_a[found.last_a] * width + found.ids_b[found.last_b]
        order = np.lexsort((key, of))
        new = np.flatnonzero(np.append(True, (np.diff(of[order]) != 0) | (np.diff(key[order]) != 0))) if len(order) else order
        per_text = np.bincount(of[order][new], minlength=len(texts))
        links = pa.ListArray.from_arrays(
            pa.array(np.append(0, np.cumsum(per_text)), pa.int32()),
            pa.StructArray.from_arrays(
                [
                    pa.array(key[order][new] // width, pa.int32()), pa.array(key[order][new] % width, pa.int32()),
                    pa.array(np.diff(np.append(new, len(order))), pa.int32()),
                ],
                ["a", "b", "n"],
            ),
        )
        counts = [pa.array(x, pa.int64()) for x in (found.n_a, found.n_b, found.groups, found.groups)]
        return pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), *counts, pa.array(digests, pa.string()), links],
            ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"],
        )

    return rows


def align_documents(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    A link is an A and a B token whose byte ranges end together. Its count is how often its pair of ids is linked in all
    documents; n_best counts links whose count is the highest of their B id, count_sum adds the counts of all links. Every row counts,
    repeated rows and ids and null ids too. Texts that are null, empty, no valid UTF-8, or not given back byte for byte by
    both tokenizers have zeros and an empty digest. Other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizers)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = None
        for batch, texts in _chunks(batches):
            make = make or _alignment_rows(_worker_pair(shared.value))
            yield make(batch, texts)

    aligned = cut_lineage(
        _texts(docs).mapInArrow(
            rows,
            "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<a:int,b:int,n:int>>",
        )
    )
    links = aligned.select("row", F.inline("links"))
    counts = cut_lineage(links.groupBy("a", "b").agg(F.sum("n").alias("count")))
    best = counts.groupBy(F.col("b").alias("_b")).agg(F.max("count").alias("most"))
    known = counts.join(best, F.col("b") == F.col("_b")).select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    if counts.count() <= PAIR_ROWS:
        known = F.broadcast(known)
    sums = (
        links.join(known, ["a", "b"])
        .groupBy("row")
        .agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    )
    zero = F.lit(0).cast("long")
    return aligned.drop("links").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
