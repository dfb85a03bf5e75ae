"""Greedy longest-match token counts by an automaton with failure links, in linear time."""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, mix, prefix_sums, span_hash, text_chunks, word_spans
from .tokens import TABLE_ENTRIES, LongMap, process_cache

_LOST = -1


class Automaton:
    """A vocabulary trie with failure links and the number of pieces popped on each link.

    ``initial`` are the pieces that may begin a word, ``inner`` those that may follow (the same
    by default). When the trie has no child for the next byte, the longest pieces matched so far
    are popped and matching goes on at the failure node, which stands for what is left of the
    read bytes as the beginning of an inner piece. Nothing is read twice and no piece is built:
    each link only carries how many pieces it pops.
    """

    def __init__(self, initial: Iterable[bytes], inner: Iterable[bytes] | None = None) -> None:
        initial = {p for p in initial if p}
        same = inner is None
        inner = initial if same else {p for p in inner if p}
        children: list[dict[int, int]] = [{}]
        is_piece = [False]

        def grow(root: int, pieces: set[bytes]) -> None:
            for piece in pieces:
                node = root
                for byte in piece:
                    nxt = children[node].get(byte)
                    if nxt is None:
                        nxt = children[node][byte] = len(children)
                        children.append({})
                        is_piece.append(False)
                    node = nxt
                is_piece[node] = True

        grow(0, inner)
        self.inner_root = self.root = 0
        if not same:
            self.root = len(children)
            children.append({})
            is_piece.append(False)
            grow(self.root, initial)
        n = len(children)
        fail, popped = np.full(n, _LOST, np.int32), np.zeros(n, np.int32)
        todo = deque((root, byte, node) for root in {self.root, self.inner_root} for byte, node in children[root].items())
        while todo:
            parent, byte, node = todo.popleft()
            if is_piece[node]:
                fail[node], popped[node] = self.inner_root, 1
            else:
                at, count = int(fail[parent]), int(popped[parent])
                while at != _LOST and byte not in children[at]:
                    at, count = int(fail[at]), count + int(popped[at])
                if at != _LOST:
                    fail[node], popped[node] = children[at][byte], count
            todo.extend((node, b, c) for b, c in children[node].items())
        self.fail, self.popped = fail, popped
        edges = [(node * 256 + byte, child) for node, kids in enumerate(children) for byte, child in kids.items()]
        keys, values = np.array(edges, np.int64).reshape(-1, 2).T
        self.edges = LongMap(max(8, (4 * len(keys)).bit_length()))
        self.edges.put(mix(keys.astype(np.uint64)), values.astype(np.int32))

    def _child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return self.edges.get(mix(node.astype(np.uint64) * np.uint64(256) + byte.astype(np.uint64)))

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each word; a word that the vocabulary cannot spell counts as one."""
        n = len(starts)
        node = np.full(n, self.root, np.int64)
        pieces = np.zeros(n, np.int64)
        lost = np.zeros(n, bool)
        lengths = ends - starts
        order = np.argsort(-lengths, kind="stable")  # active words are a prefix
        sizes = -lengths[order]
        for k in range(int(lengths.max(initial=0))):
            active = order[: int(np.searchsorted(sizes, -k, "left"))]
            active = active[~lost[active]]
            byte = data[starts[active] + k]
            nxt = self._child(node[active], byte)
            stuck = np.flatnonzero(nxt < 0)
            while len(stuck):
                words = active[stuck]
                pieces[words] += self.popped[node[words]]
                node[words] = self.fail[node[words]]
                dead = node[words] == _LOST
                lost[words[dead]] = True
                stuck, words = stuck[~dead], words[~dead]
                nxt[stuck] = self._child(node[words], byte[stuck])
                stuck = stuck[nxt[stuck] < 0]
            alive = ~lost[active]
            node[active[alive]] = nxt[alive]
        rest = np.flatnonzero(~lost & (node != self.root) & (node != self.inner_root))
        while len(rest):
            pieces[rest] += self.popped[node[rest]]
            node[rest] = self.fail[node[rest]]
            dead = node[rest] == _LOST
            lost[rest[dead]] = True
            rest = rest[~dead & (node[rest] != self.inner_root)]
        return np.where(lost, 1, pieces)


def byte_pieces(tokenizer_json: str, word_end: str = "</w>") -> list[bytes]:
    """The vocabulary of a byte-level tokenizer file as byte strings, without the mark of word ends.

    Such files write bytes as printable characters: those that are printable in Latin-1 stand for
    themselves, the others for the code points from 256 on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    code = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    pieces = set()
    for token in json.loads(tokenizer_json)["model"]["vocab"]:
        body = token.removesuffix(word_end)
        if body and all(c in code for c in body):
            pieces.add(bytes(code[c] for c in body))
    return sorted(pieces)


class _Counts:
    """The automaton and the counts of the words seen by this Python worker."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton
        self.seen = LongMap()

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        hashes = span_hash(prefix_sums(data), starts, ends)
        out = self.seen.get(hashes)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            if self.seen.count > TABLE_ENTRIES:
                self.seen = LongMap()
                missing = np.arange(len(hashes))
            new, pick = np.unique(hashes[missing], return_index=True)
            at = missing[pick]
            self.seen.put(new, self.automaton.count(data, starts[at], ends[at]).astype(np.int32))
            out[missing] = self.seen.get(hashes[missing])
        return out


def _counting(pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"counts_{zlib.crc32(b' '.join(pieces.value))}"
        counts = process_cache(name, lambda: _Counts(Automaton(pieces.value)))
        for batch, data, offsets in text_chunks(batches):
            low = LOWER[data]
            starts, ends, rows = word_spans(low, offsets)
            n = batch.num_rows
            pieces_of = counts.of(low, starts, ends) if len(starts) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").cast(pa.int64()), pa.array(np.bincount(rows, minlength=n).astype(np.int64)),
                 pa.array(np.bincount(rows, weights=pieces_of, minlength=n).astype(np.int64))],
                names=["_id", "n_words", "n_tokens"],
            )

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, n_words, n_tokens.

    Words ``[^\\x20\\x09-\\x0D]+``, lower-cased in A-Z, are split greedily into the longest pieces
    of the file's vocabulary. Null and empty texts have no tokens; repeated rows and null ids get
    a row each; extra columns are not read; an empty table gives no rows. Nothing is shuffled: each
    text is counted where it is read. The vocabulary is read on the driver and has a fixed size.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        pieces = docs.sparkSession.sparkContext.broadcast(byte_pieces(file.read()))
    source = docs.select(F.col(id_col).cast("long").alias("_id"), "text")
    return source.mapInArrow(_counting(pieces), "_id long, n_words long, n_tokens long").withColumnRenamed("_id", id_col)
