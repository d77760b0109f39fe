"""Operator 11: alignment of two tokenizers' tokens over the bytes of every text.

Tokens of both sides are rows; windowed sums of their byte lengths give their ends; an equi-join on piece and end
finds the offsets where both sides end; the running count of these cuts numbers the groups, and a join on the group,
ranges overlapping, gives the links.  All of this is relational (``align``).

It runs on distinct pieces of the texts.  A text is cut before every run of white space that begins with a blank or a
line end and follows something else: neither tokenizer has a token across such a place, so both sides end there, and no
group or link reaches across.  A text is thus the sequence of its pieces, and a piece has the same tokens wherever it
stands.  Texts are read in chunks of bounded size, each with a list of its own distinct pieces; distinct pieces of all
chunks are aligned once.  Results go back by chunk, where numpy adds them up per document and counts, a chunk at a time,
the documents that hold a linked id pair.  These counts are added up over the corpus by Spark, and the totals go back by
chunk once more.  A very common piece or pair is one row a chunk, whatever number of texts holds it.

Defined cases: null and empty texts, and texts of which one side's joined bytes differ (such as those with U+2581), have
no tokens: zeros and an empty digest.  Null and repeated ids are rows like any other, and each counts as a document.  Ties
for an A id's highest count all count as best.  A text without a cut is one piece, aligned by the same joins.  An empty
table gives an empty result.  Only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize, texts_of, with_conf, worker_cache

#: White space by any of the engines' definitions: no cut is made behind it.
_SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Ids as they travel.
_ID = np.dtype("<u4")
#: Noncharacters, one of which marks the cuts.
_MARKS = [chr(c) for c in range(0xFDD0, 0xFDF0)]


def pieces_of(text: str) -> list[str]:
    """Blank and text, cut before each run of blanks or line ends that follows something else."""
    s = " " + text
    mark = next((m for m in _MARKS if m not in s), None)
    if mark is None:
        return [s]
    s = " " + text.replace(" ", f"{mark} ").replace("\n", f"{mark}\n")
    for w in _SPACES:
        if w + mark in s:
            s = s.replace(w + mark, w)
    return s.split(mark)


class _Numbers(dict):
    """Numbers of pieces in order of first appearance."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


def chunked(documents: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """Rows of texts (chunk, doc_id, codes, none) and of their distinct pieces (chunk, none, none, piece, code).

    A chunk holds whole texts of one task, ``most_bytes`` together or one longer text.
    """
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        ids, rows, numbers, size = [], [], _Numbers(), 0

        def out() -> Iterator[pa.RecordBatch]:
            chunk, doc_ids, pieces = (task << 24) + made, pa.concat_arrays(ids), list(numbers)
            for at in range(0, len(rows), 2000):
                own = pa.array(rows[at : at + 2000], pa.binary())
                yield batch(chunk, len(own), doc_id=doc_ids.slice(at, len(own)), codes=own)
            for at in range(0, len(pieces), 20_000):
                own = pa.array(pieces[at : at + 20_000], pa.string())
                yield batch(chunk, len(own), piece=own, code=pa.array(range(at, at + len(own)), pa.int32()))

        def batch(chunk: int, n: int, **columns: pa.Array) -> pa.RecordBatch:
            types = {"doc_id": ids[0].type, "codes": pa.binary(), "piece": pa.string(), "code": pa.int32()}
            return pa.RecordBatch.from_pydict({"chunk": pa.array([chunk] * n, pa.int64())} | {c: columns.get(c, pa.nulls(n, t)) for c, t in types.items()})

        for b in batches:
            column = b.column(b.schema.get_field_index("doc_id"))
            begun = 0
            for i, t in enumerate(texts_of(b)):
                rows.append(_packed(np.fromiter(map(numbers.__getitem__, pieces_of(t)), np.int32)) if t else b"")
                size += len(t or "")
                if size >= most_bytes:
                    ids.append(column.slice(begun, i + 1 - begun))
                    yield from out()
                    made, begun = made + 1, i + 1
                    ids, rows, numbers, size = [], [], _Numbers(), 0
            ids.append(column.slice(begun))
        if rows:
            yield from out()

    return documents.select("doc_id", "text").mapInArrow(run, f"chunk long, doc_id {id_type}, codes binary, piece string, code int")


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of int32 of one length as compressed bytes."""
    raw = np.concatenate(arrays).astype(np.int32).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(data: bytes, parts: int = 1) -> np.ndarray:
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.int32).reshape(parts, -1)


class _Sides:
    """Both tokenizers on pieces."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        # Byte-level entries stand for bytes: those that print as themselves, the others from 256 on, in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.bytes_a = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.b = sp = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]
        self.before = sp.encode("\n")

    def tokens(self, pieces: list[str]) -> dict[str, list]:
        a = [x.ids for x in self.a.encode_batch(pieces, add_special_tokens=False)]
        # The library puts a blank before a text; behind a line end a piece stands as it does inside one.
        b = [x[len(self.before) :] for x in self.b.encode(["\n" + p for p in pieces], num_threads=1)]
        own_a, own_b = ([[byte[i] for i in ids] for ids in side] for byte, side in ((self.bytes_a, a), (self.bytes_b, b)))
        out: dict[str, list] = {"a": [], "a_bytes": [], "b": [], "b_bytes": []}
        for piece, ids_a, ids_b, x, y in zip(pieces, a, b, own_a, own_b):
            good = b"".join(x) == b"".join(y) == piece.encode()
            for name, ids, own in (("a", ids_a, x), ("b", ids_b, y)):
                out[name].append(np.array(ids, _ID).tobytes() if good else b"")
                out[f"{name}_bytes"].append(list(map(len, own)) if good else [])
        return out


def tokenized(pieces: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(piece, a, a_bytes, b, b_bytes): packed ids and byte lengths of both sides; none where joined bytes differ from the piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        sides = worker_cache(("sides", path_a, path_b), lambda: _Sides(path_a, path_b))
        for b in batches:
            own = b.column(0)
            for at in range(0, len(own), 2000):
                part = own.slice(at, 2000)
                found = sides.tokens(part.to_pylist())
                types = {c: pa.list_(pa.int32()) if c.endswith("bytes") else pa.binary() for c in found}
                yield pa.RecordBatch.from_arrays([part, *(pa.array(v, types[c]) for c, v in found.items())], names=["piece", *found])

    return pieces.select("piece").mapInArrow(run, "piece string, a binary, a_bytes array<int>, b binary, b_bytes array<int>")


def align(tokens: DataFrame, partitions: int) -> DataFrame:
    """(key, path) of tokens (key, a_bytes, b_bytes): a letter for every link, in order of offsets.

    ``a``: the link's A token ends first, so the next link has the next A token; ``b`` likewise; ``c``: both end, a cut.
    """
    dealt = tokens.select("key", "a_bytes", "b_bytes").repartition(partitions, "key")
    in_order = Window.partitionBy("key").orderBy("pos")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def side(s: str) -> DataFrame:
        rows = dealt.select("key", F.posexplode(f"{s}_bytes").alias("pos", "bytes"))
        return rows.withColumn("end", F.sum("bytes").over(so_far))

    def grouped(own: DataFrame, other: DataFrame, s: str) -> DataFrame:
        cuts = other.select("key", "end", F.lit(1).alias("cut")).hint("shuffle_hash")
        rows = own.join(cuts, ["key", "end"], "left")
        before = F.count("cut").over(so_far) - F.when(F.col("cut").isNull(), 0).otherwise(1)
        return rows.select("key", before.alias("g"), (F.col("end") - F.col("bytes")).alias(f"{s}_from"), F.col("end").alias(f"{s}_to"))

    links = grouped(side("a"), side("b"), "a").join(grouped(side("b"), side("a"), "b").hint("shuffle_hash"), ["key", "g"])
    links = links.where((F.col("a_from") < F.col("b_to")) & (F.col("b_from") < F.col("a_to")))
    step = F.when(F.col("a_to") < F.col("b_to"), "a").when(F.col("a_to") > F.col("b_to"), "b").otherwise("c")
    steps = links.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.least("a_to", "b_to").alias("at"), step.alias("step")))).alias("steps"))
    return steps.select("key", F.array_join(F.transform("steps", lambda x: x["step"]), "").alias("path"))


class _Pieces:
    """The aligned pieces of one chunk, by number."""

    def __init__(self, pieces: pa.Table):
        pieces = pieces.sort_by("code")
        path = pieces["path"].to_pylist()
        steps = np.frombuffer("".join(path).encode(), np.uint8)
        a, b = (np.frombuffer(b"".join(pieces[c].to_pylist()), _ID).astype(np.int64) for c in ("a", "b"))
        # Every piece ends with a cut, which leads on to the first tokens of the next one.
        ends_a, ends_b, cut = steps != ord("b"), steps != ord("a"), steps == ord("c")
        self.links = np.fromiter(map(len, path), np.int64, len(path))
        self.ends = np.cumsum(self.links)
        whole = lambda x: np.diff(np.append(0, np.cumsum(x))[self.ends], prepend=0)
        self.n_a, self.n_b, self.n_groups = whole(ends_a), whole(ends_b), whole(cut)
        pairs = a[np.cumsum(ends_a) - ends_a] << 32 | b[np.cumsum(ends_b) - ends_b]
        self.pairs, self.pair = np.unique(pairs, return_inverse=True)
        # Texts of groups: tokens by group, side and place, each with the sign behind it.
        group = np.cumsum(cut) - cut
        slot = np.concatenate([2 * group[ends_a], 2 * group[ends_b] + 1])
        order = np.argsort(slot, kind="stable")
        slot = slot[order]
        sign = np.where(np.diff(slot, append=-1) == 0, ",", np.where(slot % 2 == 0, "|", ";"))
        ids = np.concatenate([a, b])[order]
        # One string an id, however many tokens have it, and some pieces at a time.
        names = [str(i) for i in range(int(ids.max(initial=0)) + 1)]
        upto = np.append(0, np.cumsum(self.n_a + self.n_b))
        self.texts: list[str] = []
        for at in range(0, len(path), 20_000):
            stops = upto[at : at + 20_001]
            own = slice(stops[0], stops[-1])
            words = [""] * int(2 * (stops[-1] - stops[0]))
            words[::2], words[1::2] = map(names.__getitem__, ids[own].tolist()), sign[own].tolist()
            stops = (2 * (stops - stops[0])).tolist()
            self.texts += ["".join(words[i : j - 1]) for i, j in zip(stops, stops[1:])]

    def links_of(self, codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the linked pairs of a text of these pieces, and how often each is linked."""
        many = self.links[codes]
        at = np.arange(many.sum()) + np.repeat(self.ends[codes] - np.cumsum(many), many)
        linked, which = np.unique(self.pair[at], return_inverse=True)
        return linked, np.bincount(which, np.repeat(times, many)).astype(np.int64)


def _rolled(docs: pa.Table, pieces: pa.Table) -> pa.Table:
    """Of one chunk: sums and packed links of its documents, and the documents of each of its linked pairs."""
    found = _Pieces(pieces)
    held = np.zeros(len(found.pairs), np.int64)
    out: dict[str, list] = {c: [] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")}
    for packed in docs["codes"].to_pylist():
        codes = _unpacked(packed)[0] if packed else np.zeros(0, np.int32)
        own, times = np.unique(codes, return_counts=True)
        if not len(own) or not found.links[own].all():
            row = (0, 0, 0, 0, "", b"")
        else:
            linked, weight = found.links_of(own, times)
            held[linked] += 1
            digest = hashlib.sha256(";".join(map(found.texts.__getitem__, codes.tolist())).encode()).hexdigest()
            sums = [int(n[own] @ times) for n in (found.n_a, found.n_b, found.n_groups)]
            row = (*sums, int(weight.sum()), digest, _packed(np.diff(linked, prepend=0), weight))
        for c, v in zip(out, row):
            out[c].append(v)
    hit = np.flatnonzero(held)
    sums = {c: pa.array(out[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")} | {"groups_sha256": pa.array(out["groups_sha256"], pa.string()), "links": pa.array(out["links"], pa.binary())}
    rows = pa.table({"chunk": docs["chunk"], "doc_id": docs["doc_id"], **sums})
    chunk = pa.array([docs["chunk"][0].as_py()] * len(hit), pa.int64())
    counts = pa.table({"chunk": chunk, "pair": pa.array(hit, pa.int32()), "a": pa.array(found.pairs[hit] >> 32, pa.int32()), "b": pa.array(found.pairs[hit] & 0xFFFFFFFF, pa.int32()), "docs": pa.array(held[hit], pa.int64())})
    return pa.concat_tables([rows, counts], promote_options="default")


def _weighed(docs: pa.Table, totals: pa.Table) -> pa.Table:
    """Of one chunk: its documents' links at their A id's highest count, and the sum of counts over links."""
    at, count, top = (totals[c].to_numpy() for c in ("pair", "count", "best"))
    size = int(at.max()) + 1 if len(at) else 0
    counts, best = np.zeros(size, np.int64), np.zeros(size, bool)
    counts[at], best[at] = count, top
    n_best, count_sum = [], []
    for packed in docs["links"].to_pylist():
        linked, weight = _unpacked(packed, 2) if packed else np.zeros((2, 0), np.int32)
        linked, weight = np.cumsum(linked), weight.astype(np.int64)
        n_best.append(int(weight[best[linked]].sum()))
        count_sum.append(int(weight @ counts[linked]))
    kept = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64())).append_column("groups_sha256", docs["groups_sha256"])


def alignment(documents: DataFrame, path_a: str, path_b: str, share: int = 100_000) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    ``share`` is the number of pieces that a task aligns.
    """
    id_type = documents.schema["doc_id"].dataType.simpleString()
    rows = materialize(chunked(documents), "chunks")
    docs, own = rows.where("code IS NULL").selectExpr("chunk", "doc_id", "codes"), rows.where("code IS NOT NULL").selectExpr("chunk AS chunk", "code", "piece")
    tokens = materialize(tokenized(own.select("piece").distinct(), path_a, path_b), "pieces")
    with with_conf(documents.sparkSession, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        # One exchange of byte lengths serves all windows, joins and groups below it.
        aligned = materialize(align(tokens.withColumnRenamed("piece", "key"), 1 + tokens.count() // share), "aligned")
    ids = tokens.select("piece", "a", "b").join(aligned.withColumnRenamed("key", "piece"), "piece", "left")
    sent = own.join(ids, "piece").select("chunk", "code", "a", "b", F.coalesce("path", F.lit("")).alias("path"))
    rolled = materialize(
        docs.groupBy("chunk").cogroup(sent.groupBy("chunk")).applyInArrow(
            _rolled, f"chunk long, doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pair int, a int, b int, docs long"
        ), "rolled"
    )
    pairs = rolled.where("pair IS NOT NULL").selectExpr("chunk AS chunk", "pair", "a", "b", "docs")
    counts = materialize(pairs.groupBy("a", "b").agg(F.sum("docs").alias("count")), "counts")
    best = counts.groupBy("a").agg(F.max("count").alias("most"))
    counts = counts.join(best, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    totals = pairs.join(counts, ["a", "b"]).select("chunk", "pair", "count", "best")
    done = rolled.where("pair IS NULL").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")
    return done.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(
        _weighed, f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )

