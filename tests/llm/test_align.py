import hashlib
from bisect import bisect_left
from collections import Counter

import pytest

from tessera.llm.align import A_FILE, B_FILE, align, byte_level

SF = "/root/testdata/sf0.001"


def brute(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    of = byte_level()
    out, links = [], Counter()
    for t in texts:
        own, digest, sizes = [], "", (0, 0, 0)
        if t:
            x = a.encode(" " + t, add_special_tokens=False).ids
            y = b.encode(t)
            xb = [bytes(of[c] for c in a.id_to_token(i)) for i in x]
            yb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
            if b"".join(xb) == b"".join(yb) == (" " + t).encode():
                ends = []
                for spelt in (xb, yb):
                    at, e = 0, []
                    for s in spelt:
                        at += len(s)
                        e.append(at)
                    ends.append(e)
                cuts = sorted(set(ends[0]) & set(ends[1]))
                number = [[bisect_left(cuts, e) for e in es] for es in ends]
                parts = [[[] for _ in cuts] for _ in ends]
                for side, (ids, ns) in enumerate(zip((x, y), number)):
                    for i, n in zip(ids, ns):
                        parts[side][n].append(str(i))
                groups = [",".join(p) + "|" + ",".join(q) for p, q in zip(*parts)]
                ending = [dict(zip(es, ids)) for es, ids in zip(ends, (x, y))]
                own = [(ending[0][c], ending[1][c]) for c in cuts]
                sizes, digest = (len(x), len(y), len(cuts)), hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((sizes, own, digest))
        links.update(own)
    best = {}
    for (i, j), n in links.items():
        best[j] = max(best.get(j, 0), n)
    return [(*s, len(o), sum(links[p] == best[p[1]] for p in o), sum(links[p] for p in o), d) for s, o, d in out]


ODD = [
    None, "", " ", "  ", "a", "word ", " word", "two  spaces   here ", "line\nbreak \n  indented\ttab", "<|endoftext|> <s> </s> <unk> <0x41>", "a ▁ mark", "naïve 日本語 \U0001f600\U0001f44d‍", "café é", " nbsp em\x1cfs\x85nel x",
    "x" * 3000, "it's we'll DON'T 12345 67,890.12", "\x00nul \x7f", "ends with newline\n", "\r\n crlf \r\n", "ﬁ ligature Ａ", "a b   c", "　wide",
]


def test_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(5, "word "), (None, "it's we'll")]
    docs = spark.createDataFrame([("x", i, t, 3) for i, t in rows], "n string, doc_id bigint, text string, row int").repartition(3)
    want = sorted(((i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows]))), key=str)
    assert sorted(map(tuple, align(docs).collect()), key=str) == want
    assert align(docs.limit(0)).collect() == []
    assert [tuple(x) for x in align(docs.where("text is null")).collect()] == [(0, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("pieces", [250_000, 50])
def test_real_texts(spark, monkeypatch, pieces):
    import tessera.llm.align as module

    monkeypatch.setattr(module, "PIECES", pieces)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(x) for x in docs.collect()]
    want = sorted((i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows])))
    assert sorted(map(tuple, align(docs.repartition(4)).collect())) == want
    assert sum(x[1] for x in want) > 10_000
