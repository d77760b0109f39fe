"""Operator 9: vector bin packing of token pieces into training sequences.

Each partition packs its own documents.  A bin has three limits at once: tokens, segments
and loss-bearing tokens.  As in instruction data, the first line of a text of several
lines is its prompt and bears no loss; everything after it, the end id included, and every
id of a text of one line does.  Pieces wait in a bounded pool, from which the open bin
takes the piece with the largest dot product of its demand and the bin's free capacity,
both as shares of the limits.  When nothing in the pool fits, or one segment is left, a
piece is cut so that the bin becomes as full as the limits let it: a bin without loss
capacity still takes prompts.  A bin that stays short of its tokens is cut into sequences
whose lengths are powers of two, which need no padding.

Sequence ids are unique over the table: partition number times 2**33 plus a counter.
A partition is packed in the order its rows are read, so a task that runs again after a
lost executor gives the same rows.

Defined cases: null text counts as empty; an empty text is one piece holding the end
id alone; null and repeated ids are rows like any other, packed one by one; of pieces of
equal worth the first in the pool goes first; a text longer than a sequence spans several;
an empty table gives an empty result.  Only ``doc_id`` and ``text`` are read, so other
columns may have any name.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merges import MergeTable, WordMemory
from .runtime import texts_of, worker_cache


class WordTokenizer:
    """Batch ids of a word-end merge vocabulary as the tokenizers library gives them.

    The vocabulary never merges across white space, so a bounded memory holds the ids of
    words.  New words of Latin-1 letters and ASCII signs (but the apostrophe) go through ``merges`` many at a time,
    one in ``check_every`` of them also through the library (a difference raises); all other
    words go through the library alone.
    """

    def __init__(self, path: str, memory: int = 400_000, check_every: int = 32, long_word: int = 48):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        vocabulary, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        get = vocabulary.__getitem__
        pairs = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pairs.setdefault((get(a), get(b)), (float(rank), get(a + b)))
        self.table = MergeTable(pairs)
        if any(not t["content"].startswith("<|") for t in spec["added_tokens"]):
            raise ValueError("special tokens are expected to begin with <|")
        # Printable stand-ins of bytes, as in byte-level vocabularies: printable Latin-1 bytes stand for themselves.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        byte = [chr(b) if b in printable else chr(next(rest)) for b in range(256)]
        self.inner = np.array([get(c) for c in byte])
        self.final = np.array([get(c + suffix) for c in byte])
        self.check_every, self.long_word = check_every, long_word
        self.memory = WordMemory(self._learn, memory)

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array(list(map(len, words)), dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        b = np.frombuffer(b"".join(words), dtype=np.uint8)
        first = np.zeros(len(b), dtype=bool)
        first[starts] = True
        # Letters: a-z and the two-byte letters of Latin-1 (lead C3, in lower case but for the signs 97 and B7).
        after_lead = np.append(False, b[:-1] == 0xC3)
        lower = ((b >= 65) & (b <= 90)) | (after_lead & (b >= 0x80) & (b <= 0x9E) & (b != 0x97))
        b = np.where(lower, b + 32, b).astype(np.uint8)
        foreign = (b < 33) | (b == 39) | (b == 127) | ((b > 127) & (b != 0xC3) & ~after_lead) | (after_lead & ((b == 0x97) | (b == 0xB7)))
        digit = (b >= 48) & (b <= 57)
        kind = np.where((b >= 128) | ((b >= 97) & (b <= 122)), 1, np.where(digit, 2, 3))
        part = first | digit | np.append(True, kind[1:] != kind[:-1])
        part_at = np.flatnonzero(part)
        part_length = np.diff(np.append(part_at, len(b)))
        foreign |= np.repeat(part_length > self.long_word, part_length)
        plain = ~np.logical_or.reduceat(foreign, starts)
        if any(s in w for s in (b"<|",) for w in words):
            plain &= np.fromiter((b"<|" not in w for w in words), dtype=bool, count=len(words))
        in_plain = np.repeat(plain, lengths)
        ends = np.append(part[1:], True)
        symbols = np.where(ends, self.final[b], self.inner[b])
        flat, counts = self.table.merge(symbols[in_plain], part_length[in_plain[part_at]])
        owner = (np.cumsum(first) - 1)[part_at]
        per_word = np.bincount(owner[in_plain[part_at]], counts, len(words)).astype(np.int64)
        ask = np.flatnonzero(~plain).tolist() + np.flatnonzero(plain)[:: self.check_every].tolist()
        theirs = self.library.encode_batch_fast([words[i].decode("utf-8", "replace") for i in ask], add_special_tokens=False)
        theirs = {i: e.ids for i, e in zip(ask, theirs)}
        total = np.cumsum(per_word)
        for i in ask:
            if plain[i] and flat[total[i] - per_word[i] : total[i]].tolist() != theirs[i]:
                raise ValueError(f"the library encodes {words[i]!r} otherwise")
        if plain.all():
            return flat, per_word
        n = per_word.copy()
        other = np.flatnonzero(~plain)
        n[other] = [len(theirs[i]) for i in other]
        out = np.empty(int(n.sum()), dtype=np.int64)
        mine = np.repeat(plain, n)
        out[mine] = flat
        out[~mine] = list(chain.from_iterable(theirs[i] for i in other))
        return out, n

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.concatenate([a, b]) for a, b in self.encode_parts([(t, "") for t in texts])]

    def encode_parts(self, parts: list[tuple[str, str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of texts given in two parts that white space divides."""
        split = []
        for t in chain.from_iterable(parts):
            raw = t.encode("utf-8", "replace")
            # Lower case comes after composition in the vocabulary's own order: texts with combining marks keep their case.
            split.append((raw if b"\xcc" in raw or b"\xcd" in raw else raw.lower()).split())
        ids = iter(self.memory.encode(split))
        return list(zip(ids, ids))


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 16
    loss: int = 4032


def prompt_and_rest(text: str) -> tuple[str, str]:
    """First line and the rest of a text of several lines; a text of one line has no prompt."""
    head, line_end, rest = text.partition("\n")
    return (head, rest) if line_end and rest.strip() else ("", text)


#: A piece: document, start in it, ids, ids of the whole document, ids of its prompt.
Piece = tuple[object, int, np.ndarray, int, int]


def prompt_left(piece: Piece) -> int:
    """Ids of a piece that bear no loss."""
    _, at, ids, _, prompt = piece
    return max(0, min(prompt - at, len(ids)))


class VectorPacker:
    """One partition's packing; ``emit`` gets (sequence number, offset, piece)."""

    def __init__(self, limits: Limits, pool: int, emit):
        self.limits, self.size, self.emit = limits, pool, emit
        self.pool: list[Piece] = []
        self.lengths, self.prompts = np.zeros(2 * pool + 2, np.int64), np.zeros(2 * pool + 2, np.int64)
        self.waiting = 0
        self.sequence = 0

    def add(self, doc: object, ids: np.ndarray, prompt: int) -> None:
        self._wait((doc, 0, ids, len(ids), prompt))
        # Bounded in pieces and, for long documents, in tokens.
        while len(self.pool) >= self.size or self.waiting > 256 * self.limits.tokens:
            self._fill()

    def _wait(self, piece: Piece) -> None:
        self.lengths[len(self.pool)], self.prompts[len(self.pool)] = len(piece[2]), prompt_left(piece)
        self.waiting += len(piece[2])
        self.pool.append(piece)

    def _take(self, k: int) -> Piece:
        piece, last = self.pool[k], self.pool.pop()
        self.waiting -= len(piece[2])
        if k < len(self.pool):
            n = len(self.pool)
            self.pool[k], self.lengths[k], self.prompts[k] = last, self.lengths[n], self.prompts[n]
        return piece

    def _fill(self) -> None:
        """Close one bin from the pool."""
        lim = self.limits
        tokens, segments, loss = lim.tokens, lim.segments, lim.loss
        taken: list[Piece] = []
        while self.pool and tokens and segments:
            n, prompt = self.lengths[: len(self.pool)], self.prompts[: len(self.pool)]
            bears = n - prompt
            fits = (n <= tokens) & (bears <= loss)
            if segments > 1 and fits.any():
                worth = n * (tokens / lim.tokens**2) + bears * (loss / lim.loss**2) + segments / lim.segments**2
                piece = self._take(int(np.where(fits, worth, -1.0).argmax()))
            else:
                head = np.minimum(np.minimum(n, tokens), prompt + loss)
                k = int(head.argmax())
                most = int(head[k])
                if most < 1:
                    break
                doc, at, ids, total, prompt_ids = self._take(k)
                piece = (doc, at, ids[:most], total, prompt_ids)
                if most < len(ids):
                    self._wait((doc, at + most, ids[most:], total, prompt_ids))
            taken.append(piece)
            tokens -= len(piece[2])
            segments -= 1
            loss -= len(piece[2]) - prompt_left(piece)
        self._close(taken)

    def _close(self, taken: list[Piece]) -> None:
        """A full bin is one sequence; any other is cut at powers of two, so that nothing is padded."""
        total = sum(len(p[2]) for p in taken)
        room = 0
        for doc, at, ids, whole, prompt in taken:
            while len(ids):
                if not room:
                    room = self.limits.tokens if total >= self.limits.tokens else 1 << (total.bit_length() - 1)
                    capacity, total = room, total - room
                head = ids[:room]
                self.emit(self.sequence, capacity - room, (doc, at, head, whole, prompt))
                room -= len(head)
                at, ids = at + len(head), ids[len(head) :]
                if not room:
                    self.sequence += 1

    def finish(self) -> None:
        while self.pool:
            self._fill()


def pack(documents: DataFrame, tokenizer_path: str, end_id: int = 2, limits: Limits = Limits(), pool: int = 512) -> DataFrame:
    """One row per piece: where it is in its document and in its sequence, with the crc32 of its ids and its loss-bearing ids."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_cache(("words", tokenizer_path), lambda: WordTokenizer(tokenizer_path))
        base = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def emit(sequence: int, offset: int, piece: Piece) -> None:
            doc, at, ids, total, _ = piece
            rows.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, base + sequence, offset, len(ids) - prompt_left(piece)))

        def done() -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
                rows.clear()

        packer = VectorPacker(limits, pool, emit)
        for b in batches:
            texts, docs = [t or "" for t in texts_of(b)], texts_of(b, "doc_id")
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and size < 400_000:
                    size += len(texts[to])
                    to += 1
                for doc, (head, rest) in zip(docs[at:to], coder.encode_parts(list(map(prompt_and_rest, texts[at:to])))):
                    packer.add(doc, np.concatenate([head, rest, [end_id]]).astype(np.uint32), len(head))
                at = to
            yield from done()
        packer.finish()
        yield from done()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))
