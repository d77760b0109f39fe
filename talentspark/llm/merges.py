"""Score-ordered merging of adjacent symbol pairs, for many words at a time.

Each word keeps an agenda: the cost of every adjacent pair that the vocabulary can
merge.  In one numpy round every word of a block takes the best entry of its own
agenda (leftmost on ties), merges that pair and renews the two entries beside it,
until all agendas are empty.  Blocks hold words of like length, so memory is bounded.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable
from itertools import chain, repeat

import numpy as np


class MergeTable:
    """pairs: (left symbol, right symbol) -> (cost, merged symbol); a lower cost merges first."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[float, int]]):
        keys = np.array([a << 32 | b for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        cost, merged = zip(*pairs.values())
        self.cost = np.append(np.array(cost, dtype=np.float64)[order], np.inf)
        self.merged = np.append(np.array(merged, dtype=np.int64)[order], -1)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.cost[at], np.inf), self.merged[at]

    def merge(self, flat: np.ndarray, lengths: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all words, word after word, and their number in each word."""
        n = len(lengths)
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(lengths, kind="stable")
        out = flat.copy()
        counts = np.array(lengths, dtype=np.int64)
        for at in range(0, n, block):
            rows = order[at : at + block]
            rows = rows[lengths[rows] > 1]
            if not len(rows):
                continue
            width = int(lengths[rows].max())
            cols = np.arange(width)
            inside = cols < lengths[rows][:, None]
            where = np.where(inside, starts[rows][:, None] + cols, 0)
            symbols = np.where(inside, flat[where], -1)
            self._block(symbols, inside)
            left = symbols >= 0
            counts[rows] = left.sum(1)
            # Final symbols to the front of each word's old place.
            pos = starts[rows][:, None] + np.cumsum(left, 1) - 1
            out[pos[left]] = symbols[left]
        keep = np.arange(len(flat)) - np.repeat(starts, lengths) < np.repeat(counts, lengths)
        return out[keep], counts

    def _block(self, symbols: np.ndarray, inside: np.ndarray) -> None:
        n, width = symbols.shape
        agenda = np.full((n, width), np.inf)
        merged = np.full((n, width), -1, dtype=np.int64)
        pair = inside[:, 1:]
        agenda[:, :-1][pair], merged[:, :-1][pair] = self.find(symbols[:, :-1][pair], symbols[:, 1:][pair])
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        after = np.tile(np.arange(1, width + 1), (n, 1))
        last = inside.sum(1)
        live = np.arange(n)
        while len(live):
            i = agenda[live].argmin(1)
            ok = agenda[live, i] < np.inf
            live, i = live[ok], i[ok]
            if not len(live):
                return
            j = after[live, i]
            symbols[live, i] = merged[live, i]
            symbols[live, j] = -1
            agenda[live, j] = np.inf
            k = after[live, j]
            after[live, i] = k
            more = k < last[live]
            before[live[more], k[more]] = i[more]
            agenda[live, i] = np.inf
            r, a, b = live[more], i[more], k[more]
            agenda[r, a], merged[r, a] = self.find(symbols[r, a], symbols[r, b])
            h = before[live, i]
            less = h >= 0
            r, a, b = live[less], h[less], i[less]
            agenda[r, a], merged[r, a] = self.find(symbols[r, a], symbols[r, b])


class WordMemory:
    """Bounded memory of the ids of words; whole texts are put together by array gathers."""

    def __init__(self, encode_new: Callable[[list], tuple[np.ndarray, np.ndarray]], limit: int):
        self.encode_new, self.limit = encode_new, limit
        self._clear()

    def _clear(self) -> None:
        self.index: dict = {}
        self.start, self.length, self.flat = array("q"), array("q"), array("i")

    def encode(self, split: list[list]) -> list[np.ndarray]:
        """Ids of each text, given as its list of words."""
        words = list(chain.from_iterable(split))
        at = self._slots(words)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = list({words[i] for i in missing})
            if len(self.index) + len(new) > self.limit:
                self._clear()
                new, missing = list(set(words)), np.arange(len(words))
            flat, counts = self.encode_new(new)
            first = len(self.start)
            self.index.update(zip(new, range(first, first + len(new))))
            self.start.frombytes((len(self.flat) + np.cumsum(counts) - counts).astype(np.int64).tobytes())
            self.length.frombytes(counts.astype(np.int64).tobytes())
            self.flat.frombytes(flat.astype(np.int32).tobytes())
            at[missing] = self._slots([words[i] for i in missing])
        start, length = np.frombuffer(self.start, np.int64), np.frombuffer(self.length, np.int64)
        flat = np.frombuffer(self.flat, np.int32) if len(self.flat) else np.zeros(0, np.int32)
        n = length[at] if len(at) else np.zeros(0, np.int64)
        total = np.append(0, np.cumsum(n))
        ids = flat[np.repeat((start[at] if len(at) else n) - total[:-1], n) + np.arange(total[-1])]
        ends = total[np.cumsum([0] + [len(ws) for ws in split])].tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:])]

    def _slots(self, words: list) -> np.ndarray:
        return np.array(list(map(self.index.get, words, repeat(-1))), dtype=np.int64)
