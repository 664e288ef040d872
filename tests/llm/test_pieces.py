from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tessera.llm.pieces import ALPHA, VOCABULARY, Lattices, Vocabulary, decode, encode, segmentations, vocabulary_bytes


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(vocabulary_bytes(VOCABULARY))


def every(text):
    """All segmentations of a text of one unit with their probabilities, from the library's own pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    s = "▁" + text
    found = []

    def go(at, ids, w):
        if at == len(s):
            found.append((tuple(ids), w))
        for e in range(at + 1, len(s) + 1):
            i = sp.piece_to_id(s[at:e])
            if i != sp.unk_id():
                go(e, ids + [i], w - ALPHA * np.log(2 + i - 259))

    go(0, [], 0.0)
    top = np.exp([w for _, w in found])
    return {i: p for (i, _), p in zip(found, top / top.sum())}


def drawn(vocabulary, text, keys, k):
    lattices, out = Lattices(vocabulary), {}
    for t, i, path, lp, inc in segmentations(lattices, np.array(keys, np.int64), [text] * len(keys), k):
        ids = tuple(int(x) for e in path for x in lattices.pool[lattices.id_at[e] : lattices.id_at[e] + lattices.id_n[e]])
        out.setdefault(t, []).append((ids, lp, inc))
    return out


def test_probabilities_and_draws_without_replacement(vocabulary):
    truth = every("their")
    n, k = 4000, 3
    got = drawn(vocabulary, "their", range(n), k)
    for rows in got.values():
        assert len({i for i, _, _ in rows}) == k
        for ids, lp, inc in rows:
            assert abs(np.exp(lp) - truth[ids]) < 1e-9 and 0 < inc <= 1
    first = Counter(rows[0][0] for rows in got.values())
    top = sorted(truth, key=truth.get)[-6:]
    for ids in top:
        assert abs(first[ids] / n - truth[ids]) < 5 * np.sqrt(truth[ids] / n) + 1e-3
    # the second draw, given the first
    second = Counter((rows[0][0], rows[1][0]) for rows in got.values())
    for a, b in combinations(top, 2):
        for x, y in ((a, b), (b, a)):
            p = truth[x] * truth[y] / (1 - truth[x])
            assert abs(second[x, y] / n - p) < 5 * np.sqrt(p / n) + 1e-3
    # inclusion scores weigh samples without bias: sum of p / inclusion is 1 on average
    weights = [sum(np.exp(lp) / inc for _, lp, inc in rows) for rows in got.values()]
    assert abs(np.mean(weights) - 1) < 0.06


def test_few_segmentations(vocabulary):
    assert [len(x) for x in drawn(vocabulary, "é", [1, 2], 9).values()] == [len(every("é"))] * 2
    assert all(inc == 1 for _, _, inc in drawn(vocabulary, "é", [1], 9)[0])


def test_round_trip(spark):
    texts = ["Hello  world\nfoo\tbar é 你好 \U0001f600 ", " lead", "", None, "x" * 5000, "\n\n", "a " * 3000, "▁"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "null key", 1), (0, texts[0], 2)], "doc_id bigint, text string, sample int").repartition(3)
    out = encode(df, k=2)
    rows = out.collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert [len(by[i]) for i in (2, 3)] == [1, 1] and by[3][0]["ids"] is None and by[2][0]["ids"] == []
    assert len(by[0]) == 4 and len({tuple(r["ids"]) for r in by[0]}) == 2
    back = {(r["doc_id"], r["sample"]): r["text"] for r in decode(out).collect()}
    for r in rows:
        want = "null key" if r["doc_id"] is None else texts[r["doc_id"]]
        assert r["exact"] == (None if want is None else "▁" not in want)
        assert back[r["doc_id"], r["sample"]] == (want if r["exact"] in (True, None) else " ")
    assert encode(df.limit(0)).collect() == []


def test_samples_depend_on_key_and_text_alone(vocabulary):
    r = np.random.default_rng(5)
    words = ["".join(chr(97 + c) for c in r.integers(0, 26, r.integers(1, 12))) for _ in range(300)]
    texts = [" ".join(words[i] for i in r.integers(0, 300, r.integers(0, 60))) for _ in range(60)]
    keys = list(range(60))

    def rows(groups):
        found = {}
        for own in groups:
            lattices = Lattices(vocabulary)
            for t, i, path, lp, inc in segmentations(lattices, np.array([keys[j] for j in own], np.int64), [texts[j] for j in own], 3):
                ids = [int(x) for e in path for x in lattices.pool[lattices.id_at[e] : lattices.id_at[e] + lattices.id_n[e]]]
                found[own[t], i] = (ids, lp, inc)
        return found

    assert rows([range(60)]) == rows([[j] for j in reversed(range(60))])
