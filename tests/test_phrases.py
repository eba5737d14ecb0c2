"""Phrase search by anchors against a comparison of all with all."""

import random

import pytest

from rankloom.operators import phrases

DOCS, ASKED = "doc_id long, doc string, query string", "query_id long, query string, doc string"
WORDS = ["red", "fox", "foxes", "a", "of", "the", "über", "日本", "re", "d fox", "x\ty", "line\nfeed", "end."]


def plain(docs, asked):
    return {(q, d) for q, p, _ in asked for d, t, _ in docs if None not in (q, d, p, t) and p in t}


def found(spark, docs, asked):
    rows = phrases.containing(spark.createDataFrame(docs, DOCS), spark.createDataFrame(asked, ASKED)).collect()
    got = {(r.query_id, r.doc_id) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("broadcast", [True, False])
def test_equal_to_all_pairs(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(phrases, "BROADCAST_RUNS", -1)
    r = random.Random(2)
    text = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    docs = [(i, text(r.randrange(0, 40)), "x") for i in range(60)] + [(60, None, "x"), (61, "", "x"), (61, "red fox", "x"), (62, "word " * 20_000 + "the very end", "x"), (None, "red fox of the", "x")]
    asked = []
    for i in range(80):
        whole = docs[r.randrange(60)][1]
        a = r.randrange(len(whole) + 1)
        asked.append((i, whole[a : a + r.randrange(40)], "y"))
    asked += [(100, None, "y"), (101, "", "y"), (102, " ", "y"), (103, " \n", "y"), (104, "absent words of it", "y"), (105, "o", "y"), (106, " fox ", "y"), (107, "word the very", "y"), (108, "red fox of the", "y"), (109, "red fox of the", "y")]
    assert found(spark, docs, asked) == plain(docs, asked)


def test_edges(spark):
    assert found(spark, [], [(1, "a b c", "y")]) == set() == found(spark, [(1, "a b c", "x")], [])
    assert found(spark, [(1, "a b c d", "x")], [(1, "a b c", "y"), (2, "b", "y")]) == {(1, 1), (2, 1)}
    # no comparison of all with all
    df = phrases.containing(spark.createDataFrame([(1, "a b c d", "x")], DOCS), spark.createDataFrame([(1, "a b c", "y"), (2, "b", "y")], ASKED))
    assert "NestedLoop" not in df._jdf.queryExecution().toString() and "Cartesian" not in df._jdf.queryExecution().toString()
