"""Vectorised word tables: a map from 64-bit hashes, and token ids of whole texts."""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Callable

import numpy as np

from .common import LOWER, prefix_sums, span_hash, spread

#: Entries after which a table starts anew, so that its memory has a bound.
TABLE_ENTRIES = 1 << 20


def process_cache(name: str, make: Callable[[], object]) -> object:
    """A value kept for the life of the Python worker, shared by its tasks."""
    store = sys.modules.setdefault("_assetspark_process_cache", types.ModuleType("_assetspark_process_cache"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


class LongMap:
    """Unsigned 64-bit keys to 32-bit numbers, open addressing, looked up in whole arrays."""

    def __init__(self, bits: int = 16) -> None:
        self.count = 0
        self._make(bits)

    def _make(self, bits: int) -> None:
        self.bits = bits
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the keys, -1 where there is none."""
        slot = self._slot(keys)
        out = self.values[slot]
        wrong = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            out[wrong] = self.values[slot[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[slot[wrong]] != keys[wrong])]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that are not yet in the map."""
        self.count += len(keys)
        if 2 * self.count > 1 << self.bits:
            held = self.values >= 0
            keys, values = np.concatenate([self.keys[held], keys]), np.concatenate([self.values[held], values])
            self._make(max(self.bits + 1, (2 * self.count).bit_length()))
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.values[slot[todo]] < 0
            first = todo[free]
            _, pick = np.unique(slot[first], return_index=True)
            won = first[pick]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            done = np.zeros(len(keys), bool)
            done[won] = True
            todo = todo[~done[todo]]
            # move on where another key sits; a key that lost a free slot finds it taken
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)


def units_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges that a tokenizer of the word kind treats apart: (bytes, start, end, row).

    A tokenizer of that kind drops white space, lower-cases and splits words into runs of
    letters, single digits and runs of other characters. Plain words (ASCII, and the letters
    U+00C0 to U+00FF) are split that way here, with A-Z lower-cased; any other word, and one with
    an apostrophe or the sign of a special token, stays whole for the tokenizer to split.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if not n:
        return data, none, none, none
    kind = np.full(256, 3, np.uint8)  # 0 space, 1 letter, 2 digit, 3 other, 4 not plain
    kind[[9, 10, 11, 12, 13, 32]] = 0
    kind[65:91] = kind[97:123] = 1
    kind[48:58] = 2
    kind[128:] = 4
    kind[ord("'")] = 4
    cls = kind[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    cls[lead] = cls[lead + 1] = 1
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    word = cls > 0
    head = word.copy()
    head[1:] &= ~word[:-1] | cut[1:n]
    special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    cls[special] = 4
    number = np.cumsum(head) - 1
    hard = np.zeros(int(number[-1]) + 2, bool)
    hard[number[cls == 4]] = True
    split = np.zeros(n, bool)
    split[1:] = cls[1:] != cls[:-1]
    split |= cls == 2
    starts = np.flatnonzero(head | (word & split & ~hard[number]))
    tail = np.flatnonzero(word & np.append(~word[1:] | cut[1:n], True)) + 1
    ends = np.minimum(np.append(starts[1:], n), tail[number[starts]]) if len(starts) else starts
    low = LOWER[data]
    if len(special):
        raw = np.zeros(len(hard), bool)
        raw[number[special]] = True
        keep = word & raw[number]
        low[keep] = data[keep]
    return low, starts, ends, np.searchsorted(offsets, starts, "right") - 1


class TokenTable:
    """Token ids of units, each encoded once by the tokenizer and then looked up."""

    def __init__(self, tokenizer_json: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.clear()

    def clear(self) -> None:
        """Forget all units; the tokenizer stays."""
        self.map = LongMap()
        self.starts = np.zeros(1 << 16, np.int64)
        self.lengths = np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = self.filled = 0

    def _add(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = data.tobytes()
        texts = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        made = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, made), np.int32, len(made))
        flat = np.fromiter((i for ids in made for i in ids), np.uint32, int(lengths.sum()))
        for name, need in (("starts", self.used + len(made)), ("lengths", self.used + len(made)), ("ids", self.filled + len(flat))):
            held = getattr(self, name)
            if need > len(held):
                setattr(self, name, np.concatenate([held, np.zeros(max(need, 2 * len(held)) - len(held), held.dtype)]))
        self.starts[self.used : self.used + len(made)] = self.filled + np.cumsum(lengths) - lengths
        self.lengths[self.used : self.used + len(made)] = lengths
        self.ids[self.filled : self.filled + len(flat)] = flat
        self.map.put(hashes, np.arange(self.used, self.used + len(made), dtype=np.int32))
        self.used += len(made)
        self.filled += len(flat)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all rows, one after the other, and how many each row has."""
        low, starts, ends, rows = units_of(data, offsets)
        n = len(offsets) - 1
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        hashes = span_hash(prefix_sums(low), starts, ends)
        at = self.map.get(hashes)
        if (at < 0).any():
            if self.used > TABLE_ENTRIES:
                self.clear()
                at[:] = -1
            missing = np.flatnonzero(at < 0)
            new, pick = np.unique(hashes[missing], return_index=True)
            self._add(low, new, starts[missing[pick]], ends[missing[pick]])
            at[missing] = self.map.get(hashes[missing])
        lengths = self.lengths[at].astype(np.int64)
        counts = np.bincount(rows, weights=lengths, minlength=n).astype(np.int64)
        return self.ids[spread(self.starts[at], lengths)], counts
