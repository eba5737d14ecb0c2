"""Vocabulary tokens against a plain search, folded embeddings, literal answers, and strategies with latency."""

import regex
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.functions import vectors as V
from rankloom.functions import vocabulary
from rankloom.operators import strategies
from rankloom.plans import QUERIES

FILE = public_tokenizers.path("word_bpe_49k.json")
WORD = regex.compile(vocabulary.WORD.replace(r"\s", r"\t-\r ").replace(r"[^\t-\r ", r"[^\t-\r "))
TEXTS = ["Plain words, and MORE of them!", "it's we'll 2024 x1y2", "naïve Größe 日本語 🙂", "", "   \n\t", "antidisestablishmentarianism " * 50, "a" * 300, "!!!??...", "tab\tand\nfeed"]


def plain(v, text):
    out = []
    for word in WORD.findall(text.lower()):
        raw = word.encode()
        while raw:
            best = max((n for n in range(1, len(raw) + 1) if raw[:n] in (v.final if n == len(raw) else v.inner)), default=0)
            out.append((v.final if best == len(raw) else v.inner)[raw[:best]] if best else -1)
            raw = raw[max(best, 1) :]
    return out


def test_ids_equal_plain(spark):
    v = vocabulary.Vocabulary.read(FILE)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[0]), (None, "null id"), (20, None)]
    got = vocabulary.vocabulary_ids(spark.createDataFrame(rows, "id long, t string").repartition(2), "id", "t", FILE).collect()
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((r.id, list(r.ids)) for r in got), key=key) == sorted(((i, plain(v, t or "")) for i, t in rows), key=key)
    assert vocabulary.vocabulary_ids(spark.createDataFrame([], "id long, t string"), "id", "t", FILE).count() == 0
    v.known.clear()
    assert v.match("zzzqqq") == v.match("zzzqqq") and v.match("\x00") == plain(v, "\x00")
    words = vocabulary.tokens_of(spark.createDataFrame([(1, "Red fox"), (2, None)], "id long, t string"), "id", "t").collect()
    assert [list(r.tokens) for r in words] == [["red", "fox"], []]


def test_registered_query_equals_plain(spark, sf):
    v = vocabulary.Vocabulary.read(FILE)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["b03_vocabulary_tokens"](spark, sf).collect()
    assert len(rows) == len(texts) and all(list(r.ids) == plain(v, texts[r.doc_id] or "") for r in rows)


def test_folded_embeddings_equal_each_dimension(spark):
    df = spark.createDataFrame([(1, "red fox runs over the red hill"), (2, "日本 whale!"), (3, ""), (4, None)], "id int, t string")
    grid = {(r.dimension, r.id, r.bucket): r.w for r in V.embed_grid(df, "id", "t", [8, 64, 256]).collect()}
    for size in (8, 64, 256):
        one = {(size, r.id, r.bucket): r.w for r in V.embed(df, "id", "t", size).collect()}
        assert {k: v for k, v in grid.items() if k[0] == size} == pytest.approx(one)


def test_literal_answers(spark):
    said = ["{'score': 3, 'ok': True, 'why': None}", "```python\n{'score': 2, 'ok': False, 'why': 'True, it is'}\n```", 'So: {"score": 1, "ok": true, "why": "x"}.', "nothing", "{'score': 4, 'ok': True}"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    got = [r.r and tuple(r.r) for r in df.select("i", T.json_object(F.col("s"), "score int, ok boolean, why string").alias("r")).orderBy("i").collect()]
    assert got == [(3, True, None), (2, False, "True, it is"), (1, True, "x"), None, (4, True, None)]


def test_strategies_with_latency_and_trees(spark):
    docs = ["red fox runs", "a red fox", "blue whale swims", "nothing at all"]
    rows = [(q, "red fox" if q % 2 else "blue whale", 10 * q + i, d, i + 1, int(("fox" in d) == bool(q % 2) and i < 3) * 2) for q in range(4) for i, d in enumerate(docs)]
    judged = spark.createDataFrame(rows, "query_id int, query string, doc_id int, doc string, pos int, rel int")
    report = {r.variant: r for r in strategies.measured(judged, {"bm25": {}, "boosted": {"rounds": 2}}).collect()}
    assert set(report) == {"bm25", "boosted"} and all(r.queries == 4 and r.seconds > 0 and 0 < r.ndcg <= 1 for r in report.values())
    sizes = {r.variant: r for r in strategies.dimensions(judged, [16, 256]).collect()}
    assert set(sizes) == {16, 256} and sizes[256].ndcg > 0.9
