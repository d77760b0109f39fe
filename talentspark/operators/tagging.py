"""Subword tokens with character offsets, a plug-in tagger over windows of them, and tags joined to spans.

Words are cut greedily into the longest pieces a vocabulary has; a word no cut covers is one unknown
token as wide as the word.  A text of any length is tagged whole: windows of ``size`` tokens
overlap, and each token takes its tag from the window in which it stands farthest from an edge.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: A sign or a CJK character alone, or a run of anything else that is no blank.
_WORDS = regex.compile(r"[\p{P}\p{S}一-鿿]|[^\p{Z}\x09-\x0d\x85\p{P}\p{S}一-鿿]+")

#: Takes windows of token ids, gives for each the number of a tag and a confidence a token.
Tagger = Callable[[list[np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]


@dataclass(frozen=True)
class Vocabulary:
    """Piece to id; pieces that go on a word begin with ##.  ``unknown`` is the id of uncovered words."""

    ids: dict[str, int]
    unknown: int
    lower: bool = True

    def cut(self, word: str, longest: int) -> list[tuple[int, int]] | None:
        """(id, length) of a word's pieces; None where no cut covers it."""
        out, at = [], 0
        while at < len(word):
            head = "##" if at else ""
            for end in range(min(len(word), at + longest), at, -1):
                found = self.ids.get(head + word[at:end])
                if found is not None:
                    break
            else:
                return None
            out.append((found, end - at))
            at = end
        return out


def vocabulary(pieces: DataFrame, unknown: int = 0, lower: bool = True, most: int = 500_000) -> Vocabulary:
    """pieces(piece, id) as a dictionary that travels with the tasks; more than ``most`` raise."""
    rows = pieces.select("piece", "id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} pieces")
    return Vocabulary({r["piece"]: r["id"] for r in rows}, unknown, lower)


class _Cutter:
    """Tokens of many texts at once.  What stands between blanks and line ends is cut once and looked up by its number from then on."""

    def __init__(self, known: Vocabulary, remembered: int = 200_000):
        self.known, self.remembered = known, remembered
        self.longest = max((len(p.removeprefix("##")) for p in known.ids), default=1)
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.tokens = np.zeros((0, 3), np.int64)
        self.many = np.zeros(0, np.int64)

    def lowered(self, text: str | None) -> str:
        text = text or ""
        if not self.known.lower:
            return text
        # Characters whose lower-case form is longer stay, so that offsets hold.
        low = text.lower()
        return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)

    def cut(self, part: str) -> list[tuple[int, int, int]]:
        out = []
        for m in _WORDS.finditer(part):
            at = m.start()
            for piece, n in self.known.cut(m[0], self.longest) or [(self.known.unknown, len(m[0]))]:
                out.append((piece, at, at + n))
                at += n
        return out

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """How many tokens each text has, and their ids, starts and stops, in code points."""
        parts = [self.lowered(t).replace("\n", " ").split(" ") for t in texts]
        if len(self.seen) >= self.remembered:
            self.forget()
        new = [p for p in dict.fromkeys(chain.from_iterable(parts)) if p not in self.seen]
        if new:
            cuts = [self.cut(p) for p in new]
            self.seen.update(zip(new, range(len(self.seen), len(self.seen) + len(new))))
            self.tokens = np.concatenate([self.tokens, np.array(list(chain.from_iterable(cuts)), np.int64).reshape(-1, 3)])
            self.many = np.concatenate([self.many, np.fromiter(map(len, cuts), np.int64, len(cuts))])
        tokens, many = self.tokens, self.many
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        total = int(sizes.sum())
        part = np.fromiter(map(self.seen.__getitem__, chain.from_iterable(parts)), np.int64, total)
        width = np.fromiter(map(len, chain.from_iterable(parts)), np.int64, total) + 1
        first = np.cumsum(sizes) - sizes
        start = np.cumsum(width) - width
        start -= np.repeat(start[first], sizes)
        n = many[part]
        own = tokens[np.arange(n.sum()) + np.repeat((np.cumsum(many) - many)[part] - (np.cumsum(n) - n), n)]
        shift = np.repeat(start, n)
        return np.add.reduceat(n, first) if len(first) else n, own[:, 0], (own[:, 1] + shift).astype(np.int32), (own[:, 2] + shift).astype(np.int32)


def _slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, list[str | None]]]:
    """Rows (numbers) and texts, about ``most`` characters or one longer text together."""
    begun, size, texts = 0, 0, []
    for i, text in enumerate(column):
        texts.append(text.as_py())
        size += len(texts[-1] or "")
        if size >= most or i + 1 == len(column):
            yield np.arange(begun, i + 1), texts
            begun, size, texts = i + 1, 0, []


def _id_field(docs: DataFrame, id_col: str) -> StructField:
    return StructField(id_col, docs.schema[id_col].dataType)


def wordpieces(docs: DataFrame, id_col: str, known: Vocabulary) -> DataFrame:
    """(id, pos, piece, start, stop) of every token of every text; a null or empty text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _Cutter(known)
        for b in batches:
            for rows, texts in _slices(b.column("text")):
                many, ids, starts, stops = cut(texts)
                owner = b.column(0).take(pa.array(np.repeat(rows, many)))
                pos = np.arange(len(ids)) - np.repeat(np.cumsum(many) - many, many)
                yield pa.RecordBatch.from_arrays([owner, pa.array(pos.astype(np.int32)), pa.array(ids), pa.array(starts), pa.array(stops)], [id_col, "pos", "piece", "start", "stop"])

    schema = StructType([_id_field(docs, id_col)]).add("pos", "integer").add("piece", "long").add("start", "integer").add("stop", "integer")
    return docs.select(id_col, "text").mapInArrow(run, schema)


def window_starts(n: int, size: int, overlap: int) -> list[int]:
    """Where windows of ``size`` over n tokens begin; the last ends with the text."""
    if n <= size:
        return [0] if n else []
    return [*range(0, n - size, size - overlap), n - size]


def _tagged(ids: np.ndarray, tagger: Tagger, size: int, overlap: int, together: int) -> tuple[np.ndarray, np.ndarray]:
    tags, sure = np.zeros(len(ids), np.int64), np.zeros(len(ids))
    starts = window_starts(len(ids), size, overlap)
    # Windows are equally long, so a token stands deepest where it is nearest the middle, in the first of two such windows.
    bounds = [0, *((a + b + size - 1) // 2 + 1 for a, b in zip(starts, starts[1:])), len(ids)]
    for k in range(0, len(starts), together):
        some = starts[k : k + together]
        for at, low, high, (t, c) in zip(some, bounds[k:], bounds[k + 1 :], tagger([ids[a : a + size] for a in some])):
            tags[low:high], sure[low:high] = t[low - at : high - at], c[low - at : high - at]
    return tags, sure


def tagged_tokens(docs: DataFrame, id_col: str, known: Vocabulary, tagger: Tagger, labels: list[str], size: int = 510, overlap: int = 128, together: int = 32) -> DataFrame:
    """(id, pos, start, stop, label, confidence) of the tokens whose label is not O.

    ``tagger`` sees up to ``together`` windows at a time and gives numbers into ``labels``; tags do not cross texts.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap has to be shorter than a window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, names = _Cutter(known), pa.array(labels)
        outside = np.array([x == "O" for x in labels])
        for b in batches:
            for rows, texts in _slices(b.column("text")):
                many, ids, starts, stops = cut(texts)
                tags, sure, upto = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.cumsum(many)
                for low, high in zip((upto - many).tolist(), upto.tolist()):
                    tags[low:high], sure[low:high] = _tagged(ids[low:high], tagger, size, overlap, together)
                at = np.flatnonzero(~outside[tags])
                owner, pos = np.repeat(rows, many)[at], at - np.repeat(upto - many, many)[at]
                columns = [b.column(0).take(pa.array(owner)), pa.array(pos.astype(np.int32)), pa.array(starts[at]), pa.array(stops[at]), names.take(pa.array(tags[at])), pa.array(sure[at])]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "pos", "start", "stop", "label", "confidence"])

    schema = StructType([_id_field(docs, id_col)]).add("pos", "integer").add("start", "integer").add("stop", "integer").add("label", "string").add("confidence", "double")
    return docs.select(id_col, "text").mapInArrow(run, schema)


def joined_tags(tokens: DataFrame, id_col: str, least: float = 0.5) -> DataFrame:
    """Spans (id, kind, start, stop, tokens, confidence) of tokens tagged B-kind or I-kind, of unique ids.

    A B, a gap of tokens or another kind (case does not count) begins a span; its confidence is the mean of its tokens', and
    spans below ``least`` go.  Spark deals the tokens by id and sorts them; batches of them are joined, the last span of each with the next.
    """
    columns = [id_col, "pos", "start", "stop", "label", "confidence"]
    schema = StructType([_id_field(tokens, id_col)]).add("kind", "string").add("start", "integer").add("stop", "integer").add("tokens", "long").add("confidence", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not len(b):
                continue
            rows = pa.Table.from_batches([*held, b]).combine_chunks()
            first = np.flatnonzero(_opens(rows))
            whole = int(first[-1])
            yield from _spans(rows.slice(0, whole), first[:-1])
            held = rows.slice(whole).to_batches()
        if held:
            yield from _spans(pa.Table.from_batches(held), np.zeros(1, np.int64))

    def _opens(rows: pa.Table) -> np.ndarray:
        ids, label = rows[id_col].combine_chunks(), rows["label"].combine_chunks().dictionary_encode()
        same = pc.fill_null(pc.equal(ids[1:], ids[:-1]), False).to_numpy(zero_copy_only=False) | (pc.is_null(ids[1:]).to_numpy(zero_copy_only=False) & pc.is_null(ids[:-1]).to_numpy(zero_copy_only=False))
        names = label.dictionary.to_pylist()
        lows = [x[2:].lower() for x in names]
        number = {x: i for i, x in enumerate(dict.fromkeys(lows))}
        at = label.indices.to_numpy()
        kind, inside = np.array([number[x] for x in lows])[at], np.array([x.startswith("I-") for x in names])[at]
        pos = rows["pos"].to_numpy()
        goes_on = inside[1:] & same & (np.diff(pos) == 1) & (kind[1:] == kind[:-1])
        return np.append(True, ~goes_on)

    def _spans(rows: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(first):
            start, stop, sure = (rows[c].to_numpy() for c in ("start", "stop", "confidence"))
            n = np.diff(np.append(first, len(rows)))
            mean = np.add.reduceat(sure, first) / n
            kept = np.round(mean, 9) >= least
            opening = rows.select([id_col, "label"]).take(pa.array(first[kept]))
            parts = [np.minimum.reduceat(start, first)[kept], np.maximum.reduceat(stop, first)[kept], n[kept], mean[kept]]
            kind = pc.utf8_slice_codeunits(opening["label"], 2)
            yield from pa.table([opening[id_col], kind, *map(pa.array, parts)], names=schema.names).combine_chunks().to_batches()

    return tokens.select(*columns).repartition(id_col).sortWithinPartitions(id_col, "pos").mapInArrow(run, schema)


def with_values(spans: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    """Spans with the text they cover, in its own case."""
    return spans.join(docs.select(id_col, "text"), id_col).withColumn("value", F.substring("text", F.col("start") + 1, F.col("stop") - F.col("start"))).drop("text")
