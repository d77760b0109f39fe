"""Operator 2: SentencePiece encoding and decoding for merge-type vocabularies.

The encoder works on an agenda of adjacent symbol pairs: of all pairs whose
concatenation is a piece, the one with the best score (leftmost on ties) is merged,
until no pair is left; symbols outside the vocabulary fall back to byte pieces.  A
text is first cut where no piece can reach across (before a run of blanks, around a
line end), which changes nothing in the result and lets a worker remember the ids of
units it has met; the agendas of new units run side by side (``merges``).  The ids of
every whole text are compared with the sentencepiece library's own, an Arrow batch at a
time; a difference raises.

Defined cases: null text counts as empty; an empty text has the end id alone and
decodes to the empty text; null and repeated ids are rows like any other, encoded one by
one; of pairs of equal score the leftmost merges first; very long texts are encoded
whole; an empty table gives an empty result.  Only ``doc_id`` and ``text`` are read, so
other columns may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from .merges import MergeTable, WordMemory
from .runtime import add_columns, worker_cache

BLANK = "▁"
_UNITS = re.compile(f"{BLANK}+[^{BLANK}]*")


class AgendaEncoder:
    """Greedy best-score-first merging over one vocabulary, with a bounded memory of units."""

    def __init__(self, model_path: str, memory: int = 400_000, long_unit: int = 48):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = range(sp.get_piece_size())
        self.pieces = {sp.id_to_piece(i): i for i in size if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        self.cost = {p: -sp.get_score(i) for p, i in self.pieces.items()}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in size if sp.is_byte(i)}
        self.end, self.size, self.long_unit = sp.eos_id(), len(size), long_unit
        if (
            any(sp.is_unused(i) for i in size)
            or len(self.bytes) != 256
            or any(BLANK in p.lstrip(BLANK) or "\n" in p for p in self.pieces)
            or any(c not in self.pieces for p in self.pieces for c in p)
            or sp.normalize(" a  b\néé ﬁ") != f"{BLANK}{BLANK}a{BLANK}{BLANK}b\néé{BLANK}ﬁ"
        ):
            raise ValueError("a merge vocabulary with byte fallback and the identity normalizer is needed")
        get = self.pieces.get
        self.table = MergeTable(
            {(get(p[:k]), get(p[k:])): (self.cost[p], i) for p, i in self.pieces.items() for k in range(1, len(p)) if p[:k] in self.pieces and p[k:] in self.pieces}
        )
        self.characters = np.arange(0x110000, dtype=np.int64) + len(size)
        for p, i in self.pieces.items():
            if len(p) == 1:
                self.characters[ord(p)] = i
        self.memory = WordMemory(self._learn, memory)
        self.names = [str(i) for i in size]

    def merge_long(self, unit: str) -> list[str]:
        """The same order from a heap, with links between live symbols: n log n for long units."""
        cost = self.cost
        symbols: list[str] = list(unit)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, str]] = []

        def propose(i: int, j: int) -> None:
            if 0 <= i and j < n:
                whole = symbols[i] + symbols[j]
                c = cost.get(whole)
                if c is not None:
                    heapq.heappush(heap, (c, i, j, whole))

        for i in range(n - 1):
            propose(i, i + 1)
        while heap:
            _, i, j, whole = heapq.heappop(heap)
            if not symbols[i] or not symbols[j] or right[i] != j or symbols[i] + symbols[j] != whole:
                continue
            symbols[i], symbols[j] = whole, ""
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            propose(left[i], i)
            propose(i, right[i])
        return [s for s in symbols if s]

    def _with_bytes(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols from ``size`` on are characters outside the vocabulary: their bytes' ids take their places."""
        odd = np.flatnonzero(symbols >= self.size)
        if not len(odd):
            return symbols, counts
        own = [[self.bytes[b] for b in chr(s - self.size).encode("utf-8")] for s in symbols[odd].tolist()]
        times = np.ones(len(symbols), dtype=np.int64)
        times[odd] = [len(x) for x in own]
        out = np.repeat(symbols, times)
        out[np.repeat(symbols >= self.size, times)] = list(chain.from_iterable(own))
        total = np.append(0, np.cumsum(times))
        ends = np.cumsum(counts)
        return out, total[ends] - total[ends - counts]

    def _learn(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new units."""
        lengths = np.array(list(map(len, units)), dtype=np.int64)
        codes = np.frombuffer("".join(units).encode("utf-32-le", "replace"), dtype=np.uint32)
        flat, counts = self.characters[codes], lengths
        long = lengths > self.long_unit
        inside = np.repeat(~long, lengths)
        flat_short, counts_short = self.table.merge(flat[inside], lengths[~long])
        if long.any():
            get = self.pieces.get
            parts, at = np.split(flat_short, np.cumsum(counts_short)[:-1]), 0
            merged = []
            for u, is_long in zip(units, long):
                if is_long:
                    merged.append(np.array([get(s) or self.size + ord(s) for s in self.merge_long(u)], dtype=np.int64))
                else:
                    merged.append(parts[at])
                    at += 1
            flat, counts = np.concatenate(merged), np.array([len(m) for m in merged], dtype=np.int64)
        else:
            flat, counts = flat_short, counts_short
        return self._with_bytes(flat, counts)

    def split(self, text: str) -> list[str]:
        """Units no piece reaches across: cut before each run of blanks and around line ends."""
        if not text:
            return []
        if BLANK in text or "  " in text or text[0] == " ":
            return _UNITS.findall(BLANK + text.replace(" ", BLANK))
        return f"{BLANK}{text}".replace(" ", f" {BLANK}").replace("\n", " \n ").split(" ")

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts, without the end id."""
        return [x.tolist() for x in self.memory.encode([self.split(t) for t in texts])]


def _blocks(texts: list[str], limit: int = 300_000) -> Iterator[list[str]]:
    """Runs of whole texts of bounded total length."""
    block: list[str] = []
    size = 0
    for t in texts:
        block.append(t)
        size += len(t)
        if size > limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def encode_decode(documents: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, ids ending with the end id."""

    def start():
        coder = worker_cache(("agenda", model_path), lambda: AgendaEncoder(model_path))

        def run(column: list) -> dict:
            n, ids_hash, text_hash = [], [], []
            for texts in _blocks([t or "" for t in column]):
                encoded = coder.encode_batch(texts)
                if coder.library.encode(texts, num_threads=1) != encoded:
                    raise ValueError("the library encodes a text otherwise")
                for ids in encoded:
                    ids.append(coder.end)
                    n.append(len(ids))
                    ids_hash.append(hashlib.sha256(" ".join(map(coder.names.__getitem__, ids)).encode()).hexdigest())
                for text in coder.library.decode(encoded, num_threads=1):
                    text_hash.append(hashlib.sha256(text.encode("utf-8", "replace")).hexdigest())
            return {"n_tokens": n, "ids_sha256": ids_hash, "decoded_sha256": text_hash}

        return run

    return add_columns(documents.select("doc_id", "text"), "n_tokens long, ids_sha256 string, decoded_sha256 string", start)
