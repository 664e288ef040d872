import random

from tessera.llm.repeats import MIN_WORDS, repeats


def brute(rows):
    docs = {i: (t or "").lower().split() for i, t in rows}
    where = {}
    for i, w in docs.items():
        for k in range(len(w) - MIN_WORDS + 1):
            where.setdefault(tuple(w[k : k + MIN_WORDS]), set()).add(i)
    spans = set()
    for i, w in docs.items():
        marks = [any(len(where[tuple(w[k : k + MIN_WORDS])]) > 1 for k in range(max(0, p - MIN_WORDS + 1), min(p, len(w) - MIN_WORDS) + 1)) for p in range(len(w))]
        start = None
        for p, m in enumerate(marks + [False]):
            if m and start is None:
                start = p
            if not m and start is not None:
                spans.add((i, start, p))
                start = None
    return spans


def test_against_brute_force(spark):
    r = random.Random(3)
    word = lambda: "w%d" % r.randrange(3000)
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 400)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(r.choice([0, 30, 200]))]
        for _ in range(r.randrange(3)):
            at = r.randrange(len(w) + 1)
            w[at:at] = r.choice(passages)
        rows.append((i, (" " if i % 2 else "\n").join(w)))
    rows += [(100 + i, " ".join(w)) for i, w in enumerate([passages[4], passages[4][:200] + ["x"] + passages[4][200:], passages[4][10:120]])]
    rows += [(200, None), (201, ""), (202, "same " * 300), (203, " ".join(passages[3] + passages[3]))]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows] + [(203, rows[-1][1], 6)], "doc_id bigint, text string, h int").repartition(5)
    got = {(x["doc_id"], x["start_word"], x["end_word"]) for x in repeats(df).collect()}
    assert got == brute(rows)
    assert all(x["other_doc"] != x["doc_id"] for x in repeats(df).collect())


def test_no_rows(spark):
    assert repeats(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    assert repeats(spark.createDataFrame([(None, "a " * 60), (1, "a " * 60)], "doc_id bigint, text string")).collect() == []


def partners(rows):
    """(doc, window's first word) -> smallest other document that has the window."""
    docs = {i: t.lower().split() for i, t in rows}
    where = {}
    for i, w in docs.items():
        for k in range(len(w) - MIN_WORDS + 1):
            where.setdefault(tuple(w[k : k + MIN_WORDS]), []).append(i)
    return {(i, k): min((x for x in where[tuple(w[k : k + MIN_WORDS])] if x != i), default=None) for i, w in docs.items() for k in range(len(w) - MIN_WORDS + 1)}


def test_passages_that_repeat_within_a_document_too(spark, monkeypatch):
    import tessera.llm.repeats as module

    r = random.Random(8)
    words = lambda n: ["v%d" % r.randrange(5000) for _ in range(n)]
    spam, long = words(60), words(120)
    rows = [(1, spam * 40), (2, words(30) + spam * 40 + words(30)), (3, spam * 20 + long), (4, long * 15)]
    # one head, many halves: the partner of a whole window is far away in any order of the suffixes
    rows += [(10 + i, words(45) + long[40:66] + words(45)) for i in range(40)]
    rows += [(60 + i, words(30) + long[20:90] + words(30)) for i in range(3)]
    r.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in rows]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    other = partners(rows)
    for most in (module.MOST, 100, 0):
        monkeypatch.setattr(module, "MOST", most)
        got = [tuple(x) for x in repeats(df).collect()]
        assert {(i, s, e) for i, s, e, _, _ in got} == brute(rows)
        assert all(o == min(filter(None, (other[i, k] for k in range(s, e - MIN_WORDS + 1)))) for i, s, e, _, o in got)
