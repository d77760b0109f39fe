"""Token alignment against a plain scan over whole texts."""

import collections
import hashlib
import os

import pytest

pytest.importorskip("talentspark.llm")
from talentspark.llm import token_alignment  # noqa: E402

tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " ", "  ", "a", " a ", "\n", "\n\n", "x\n\ny  z\t\tq \n w", "don't we'll  <|endoftext|> </s> <s>", "▁a b", "日本語 テキスト 🙂  naïve café　x y z", "é" * 50 + " ok",
    "a" * 3000, "tab\there \x1c y\x85 z \x0b w", "123 456  7,8.9 --- ... !!! ''' 's 'S", "\x00 nul \x00x", "﷐ marks ﷑", "".join(token_alignment._MARKS) + " all marks", "word and the other of it in a long text " * 1500,
]


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    held, per = collections.Counter(), []
    for i, t in rows:
        s = " " + (t or "")
        a = [(x, bytes(byte[c] for c in one.id_to_token(x))) for x in one.encode(s, add_special_tokens=False).ids]
        b = [(x, bytes([int(two.id_to_piece(x)[3:5], 16)]) if two.is_byte(x) else two.id_to_piece(x).replace("▁", " ").encode()) for x in two.encode(t or "")]
        if not t or any(b"".join(x for _, x in side) != s.encode() for side in (a, b)):
            per.append((i, None))
            continue
        spans = []
        for side in (a, b):
            at, own = 0, []
            for x, raw in side:
                own.append((x, at, at := at + len(raw)))
            spans.append(own)
        cuts = sorted({x[2] for x in spans[0]} & {x[2] for x in spans[1]})
        group = {}
        for k, own in enumerate(spans):
            g = 0
            for x, _, end in own:
                while end > cuts[g]:
                    g += 1
                group.setdefault(g, ([], []))[k].append(str(x))
        links, first = [], 0
        for x, begin, end in spans[0]:
            while spans[1][first][2] <= begin:
                first += 1
            j = first
            while j < len(b) and spans[1][j][1] < end:
                links.append((x, spans[1][j][0]))
                j += 1
        held.update(set(links))
        digest = hashlib.sha256(";".join(f"{','.join(x)}|{','.join(y)}" for x, y in group.values()).encode()).hexdigest()
        per.append((i, (len(a), len(b), len(cuts), links, digest)))
    top = collections.Counter()
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for i, p in per:
        if p:
            n_a, n_b, n_groups, links, digest = p
            out.append((i, n_a, n_b, n_groups, len(links), sum(held[x] == top[x[0]] for x in links), sum(held[x] for x in links), digest))
        else:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
    return sorted(out, key=str)


def aligned(docs, **more):
    return sorted(map(tuple, token_alignment.alignment(docs, tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model"), **more).collect()), key=str)


def test_edge_texts(spark):
    rows = [*enumerate(TEXTS), (None, "don't we'll"), (5, "a"), (5, "a b")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_a int, piece string")
    assert aligned(docs, share=20) == brute(rows)
    assert aligned(docs.where("false")) == []


def test_chunks(spark):
    """Cut into many chunks, counts are still of the whole corpus."""
    rows = [(i, f"the word{i % 7} of unhappiness and ünïcode {'x' * (i % 5)}\nend") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    chunks = token_alignment.chunked(docs, most_bytes=500)
    assert chunks.select("chunk").distinct().count() > 10 and chunks.where("codes IS NOT NULL").count() == 200
    assert aligned(docs) == brute(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert aligned(docs) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_pieces():
    for t in TEXTS[1:]:
        found = token_alignment.pieces_of(t)
        assert "".join(found) == " " + t and not any(p[:-1].endswith(" ") and not p.strip() for p in found[1:-1])
    assert token_alignment.pieces_of("a  b\n\nc\td \n e") == [" a", "  b", "\n\nc\td", " \n e"]
