"""Known values and invariants of BM25, rankers, combinators and metrics."""

import math

import pytest
from pyspark.sql import functions as F

from rankloom.operators import bm25, combine, metrics, rankers, training
from rankloom.operators import features as X

CANDIDATES = "query_id int, query string, doc_id int, doc string, pos int"


def candidates(spark, *lists):
    rows = [(q, query, d + 100 * q, doc, d) for q, (query, docs) in enumerate(lists) for d, doc in enumerate(docs)]
    return spark.createDataFrame(rows, CANDIDATES)


@pytest.fixture(scope="module")
def two(spark):
    docs = ["python dataclass default factory", "ocean current weather patterns", "machine learning model training", "python python training"]
    return candidates(spark, ("python dataclass", docs), ("machine training", docs))


def scores(df, column="score"):
    return [r[column] for r in df.orderBy("query_id", "doc_id").collect()]


def test_bm25_values(spark):
    c = candidates(spark, ("python dataclass", ["python dataclass default factory", "ocean current weather patterns", "machine learning model training"]))
    assert scores(bm25.score_candidates(c), "bm25") == pytest.approx([1.961659, 0, 0], abs=1e-6)
    c = candidates(spark, ("python", ["python programming", "java development"]))
    r = bm25.rerank(c)
    assert scores(r, "bm25") == pytest.approx([0.693147, 0], abs=1e-6)
    assert scores(r) == [1, 0]
    assert scores(bm25.rerank(candidates(spark, ("test", ["test document"]))), "bm25") == pytest.approx([0.287682], abs=1e-6)
    assert scores(bm25.rerank(candidates(spark, ("", ["a", "b"])))) == [0, 0]


def test_search_equals_candidates_over_all(spark, two):
    q, d = two.select("query_id", "query").distinct(), two.filter("query_id = 0").select("doc_id", "doc")
    found = {r.doc_id: r.bm25 for r in bm25.search(q, d).filter("query_id = 0").collect()}
    all_of = {r.doc_id: r.bm25 for r in bm25.score_candidates(two).filter("query_id = 0 AND bm25 > 0").collect()}
    assert found == pytest.approx(all_of)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_splits_texts_once_and_sums_scores_where_documents_lie(spark, two, monkeypatch):
    q, d = two.select("query_id", "query").distinct(), two.filter("query_id = 0").select("doc_id", "doc")
    plans, write = {}, bm25.stage
    monkeypatch.setattr(bm25, "stage", lambda df, name, *by: (plans.setdefault(name, plan(df)), write(df, name, *by))[1])
    found = plan(bm25.top(q, d, 2))
    assert plans["postings"].count("split(") == 1
    assert "hashpartitioning(query_id" in found and not [line for line in found.splitlines() if "Exchange hashpartitioning(query_id" in line and "doc_id" in line]


def test_search_of_many_terms_equals_that_of_few(spark, two, monkeypatch):
    more = two.select("query_id", "query").distinct().unionByName(spark.createDataFrame([(7, "nothing here"), (8, ""), (9, None)], "query_id int, query string"))
    d = two.filter("query_id = 0").select("doc_id", "doc").unionByName(spark.createDataFrame([(50, None), (51, ""), (52, " \u00a0 ")], "doc_id int, doc string"))
    few = {(r.query_id, r.doc_id): r.bm25 for r in bm25.search(more, d).collect()}
    monkeypatch.setattr(bm25, "BROADCAST_TOKENS", 0)
    monkeypatch.setattr(bm25, "HEAVY_ROWS", 1)
    many = {(r.query_id, r.doc_id): r.bm25 for r in bm25.search(more, d).collect()}
    assert few and many == pytest.approx(few)
    # three documents without words count in the number of documents, the null one not in the mean length
    n, avgdl = 7, (4 + 4 + 4 + 3) / 6
    one = lambda df, f, dl: math.log((n - df + 0.5) / (df + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl))
    assert few[0, 0] == pytest.approx(one(2, 1, 4) + one(1, 1, 4))


def test_search_without_documents_or_words(spark, two):
    q = two.select("query_id", "query").distinct()
    assert bm25.search(q, two.select("doc_id", "doc").limit(0)).count() == 0
    assert bm25.top(q.filter("query_id > 10"), two.filter("query_id = 0").select("doc_id", "doc"), 2).count() == 0


def test_top_sorts_no_score_below_a_bound(spark, monkeypatch):
    """The first k, ties included, are those of all scores, though most scores are dropped before they are ranked."""
    words = ["alpha", "beta", "gamma", "delta"]
    texts = [(i, " ".join(words[j] for j in range(4) if i >> j & 1) + " filler" * (i % 7)) for i in range(600)] + [(600, None)]
    docs = spark.createDataFrame(texts, "doc_id int, doc string")
    asked = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta"), (3, "nothing"), (4, "filler alpha")], "query_id int, query string")
    scores = bm25.search(asked, docs)
    want = {(r.query_id, r.doc_id, r["rank"]) for r in bm25.rank(scores, "bm25", "doc_id", 5).collect()}
    seen, plain = [], bm25.rank

    def watched(rows, *args):
        seen.append(rows.count())
        return plain(rows, *args)

    monkeypatch.setattr(bm25, "rank", watched)
    assert {(r.query_id, r.doc_id, r["rank"]) for r in bm25.top(asked, docs, 5).collect()} == want and len(want) == 15
    assert seen[-1] < scores.count() / 2
    assert bm25.top(asked, docs, 1000).count() == scores.count()


def test_candidates_are_split_into_words_once(two):
    calls = []

    def tokens(text):
        calls.append(text)
        return bm25.whitespace_tokens(text)

    bm25.score_candidates(two, tokens)
    assert len(calls) == 2  # the queries' texts and the documents'


def test_lengths_count_documents_without_words(spark):
    """An empty document counts among the candidates and in their mean length; a candidate given twice counts twice."""
    c = candidates(spark, ("fox", ["fox owl", "", "owl", "fox fox fox"]), ("", ["fox", "owl"]))
    got = {(r.query_id, r.pos): r.bm25 for r in bm25.score_candidates(c).collect()}
    idf, avg = math.log((4 - 2 + 0.5) / (2 + 0.5) + 1), 6 / 4
    weight = lambda f, n: idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * max(n, 1) / avg))
    assert got == pytest.approx({(0, 0): weight(1, 2), (0, 1): 0, (0, 2): 0, (0, 3): weight(3, 3), (1, 0): 0, (1, 1): 0})


def test_rank_is_a_permutation_and_ties_keep_order(spark, two):
    c = candidates(spark, ("x", ["same", "same", "same"]))
    for ranker in (bm25.rerank, rankers.hybrid, rankers.binary_quantized, rankers.late_interaction, rankers.sparse):
        ranked = ranker(two).collect()
        for q in (0, 1):
            assert sorted(r["rank"] for r in ranked if r.query_id == q) == [1, 2, 3, 4]
        assert [r["rank"] for r in ranker(c).orderBy("pos").collect()] == [1, 2, 3]


def test_top_k_must_be_positive(two):
    with pytest.raises(ValueError):
        bm25.rank(bm25.rerank(two).drop("rank"), "score", top_k=0)
    with pytest.raises(ValueError):
        combine.Stage("x", bm25.rerank, 0)


def test_tournament_credit(spark, two):
    pairs = rankers.document_pairs(two)
    probability = rankers.logistic([2.0, -2.0, 1.0, 0.1, 0.01, -0.01, 0.0], 0.1)
    ranked = rankers.tournament(pairs, two, probability)
    assert ranked.groupBy("query_id").agg(F.sum("score")).collect()[0][1] == pytest.approx(4 * 3 / 2)
    merged = rankers.merge_tournament(pairs, two, probability)
    assert sorted(r["rank"] for r in merged.filter("query_id = 0").collect()) == [1, 2, 3, 4]


def test_late_interaction_equals_dense_definition(spark, two):
    from rankloom.functions import vectors as V
    from rankloom.functions.text import unicode_tokens

    docs = {r.doc_id: (r.query, r.doc) for r in two.collect()}
    got = {r.doc_id: r.score for r in rankers.late_interaction(two).collect()}
    words = sorted({w for q, d in docs.values() for w in (q + " " + d).split()})
    hashed = {r.t: (r.b, r.s) for r in spark.createDataFrame([(w,) for w in words], "t string").select("t", V.token_bucket(F.col("t")).alias("b"), V.token_sign(F.col("t")).alias("s")).collect()}
    assert unicode_tokens is not None
    for doc_id, (q, d) in docs.items():
        want = sum(max((hashed[w][1] * hashed[t][1] if hashed[w][0] == hashed[t][0] else 0) for t in d.split()) for w in q.split())
        assert got[doc_id] == want


def test_kept_tokens_are_dealt_by_document_once(two):
    index = rankers.token_index(two.select("doc_id", "doc").distinct().localCheckpoint())
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_salience(spark):
    index = rankers.token_index(spark.createDataFrame([(1, "the cat the dog the")], "doc_id int, doc string"))
    got = {(r.token, round(r.salience, 6)) for r in index.collect()}
    assert got == {("the", 2.432791), ("cat", 1.252763), ("dog", 1.252763)}
    assert rankers.token_index(spark.createDataFrame([(1, "a b c d e f")], "doc_id int, doc string"), 3).count() == 3


def test_quantized_late_interaction_ternary_equals_plain(two):
    plain = scores(rankers.late_interaction(two))
    assert scores(rankers.late_interaction_quantized(two, "ternary")) == pytest.approx(plain)
    assert scores(rankers.late_interaction_quantized(two, "none")) == pytest.approx(plain)


def test_reciprocal_rank_fusion(spark):
    lists = [spark.createDataFrame([(0, d, i + 1) for i, d in enumerate(x)], "query_id int, doc_id string, rank int") for x in ("ABC", "BCD")]
    got = {r.doc_id: r.rrf for r in combine.reciprocal_rank_fusion(lists).collect()}
    assert got == pytest.approx({"B": 0.032522, "C": 0.032002, "A": 0.016393, "D": 0.015873}, abs=1e-6)
    assert got == pytest.approx({r.doc_id: r.rrf for r in combine.reciprocal_rank_fusion(lists[::-1]).collect()})
    with pytest.raises(ValueError):
        combine.reciprocal_rank_fusion(lists, weights=[1.0])


def test_weights_cannot_reorder(two):
    a = combine.fused(two, [bm25.rerank, rankers.late_interaction])
    b = combine.fused(two, [bm25.rerank, rankers.late_interaction], weights=[1.0, 5.0])
    assert {(r.doc_id, r["rank"]) for r in a.collect()} == {(r.doc_id, r["rank"]) for r in b.collect()}


def ranked(spark, *rels):
    return spark.createDataFrame([(q, i + 1, float(r)) for q, x in enumerate(rels) for i, r in enumerate(x)], "query_id int, rank int, rel double")


def value(df, column):
    return [r[column] for r in df.orderBy("query_id").collect()]


def test_metrics(spark):
    assert value(metrics.dcg(ranked(spark, [3, 2]), 2), "dcg") == pytest.approx([7 + 3 / math.log2(3)])
    got = value(metrics.ndcg(ranked(spark, [0, 1, 2, 3], [3, 2, 1], [0, 0])), "ndcg")
    assert got == pytest.approx([0.547831, 1, 0], abs=1e-6)
    assert value(metrics.ndcg(ranked(spark, [3, 0, 2, 1]), 3), "ndcg") == pytest.approx([0.904950], abs=1e-6)
    assert value(metrics.reciprocal_rank(ranked(spark, [0, 1, 0], [0, 0, 1], [0, 0, 0])), "rr") == pytest.approx([1 / 2, 1 / 3, 0])
    assert value(metrics.reciprocal_rank(ranked(spark, [0, 0, 1]), 2), "rr") == [0]
    assert value(metrics.average_precision(ranked(spark, [1, 0, 1], [0, 1, 1], [0, 0, 0])), "ap") == pytest.approx([0.833333, 0.583333, 0], abs=1e-6)
    assert value(metrics.precision_at(ranked(spark, [1, 0]), 5), "precision") == [0.5]
    row = metrics.evaluate(ranked(spark, [1, 0], [0, 0]), only_with_relevant=True).first()
    assert (row.queries, row.ndcg, row.mrr, row.p_at_1) == (2, 1, 1, 1)
    row = metrics.evaluate(ranked(spark, [0, 0]), only_with_relevant=True).first()
    assert (row.queries, row.ndcg, row.mrr, row.p_at_1) == (1, 0, 0, 0)


def test_latency(spark):
    row = metrics.latency(spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40, 50)], "ms double"), "ms").first()
    assert (row.p50, row.p99, row["mean"]) == (30, 50, 30)


def test_confidence_and_cascade(spark, two):
    rows = spark.createDataFrame([(0, 0.9), (0, 0.3), (1, 0.7), (1, 0.6), (2, 0.5)], "query_id int, score double")
    get = lambda m: value(combine.confidence(rows, m), "confidence")
    assert get("score_variance")[0] == pytest.approx(0.18)
    assert get("normalized_max")[0] == pytest.approx(1.5)
    assert get("normalized_max")[2] == 1.0
    assert get("top_margin") == pytest.approx([0.6, 0.1, 0.5])
    for mode, used in (("always", 2), ("never", 0)):
        routed = combine.cascade(two, bm25.rerank, rankers.late_interaction, 0.5, mode=mode)
        stats = combine.cascade_statistics(routed).first()
        assert (stats.total_queries, stats.fallback_count) == (2, used)
        assert routed.count() == two.count()


def test_staged(two):
    stages = [combine.Stage("bm25", bm25.rerank, 3), combine.Stage("late", rankers.late_interaction, 2)]
    assert combine.staged(two, stages).filter("rank <= 2").count() == 4
    assert {r.score for r in combine.staged(two, []).collect()} == {0.0}
    assert [(r.n_in, r.n_out) for r in combine.stage_counts(two, stages).filter("query_id = 0").orderBy("stage").collect()] == [(4, 3), (3, 2)]


def test_training(spark, two):
    rows = X.features(two).withColumn("label", (F.col("doc").contains("python")).cast("double"))
    scorer = training.pointwise_hybrid(rows, "label", maxIter=3)
    assert scorer(rows).filter("model_score IS NULL").count() == 0
    constant = training.pointwise_hybrid(rows.withColumn("label", F.lit(1.0)), "label", classify=True)
    assert {r.model_score for r in constant(rows).collect()} == {0.0}
    assert training.Router().predict(X.router_features(two.select("query_id", "query").distinct())).filter("category = 0").count() == 2
    assert rankers.hybrid_with_model(two, None, "learned").filter("score <> 0").count() == 0
    mean = rankers.hybrid_with_model(two, scorer)
    assert mean.count() == two.count()
    weights = training.bilinear_weights(two.withColumn("label", F.lit(1)), "label")
    assert {r.weight for r in weights.collect()} == {1.0}


def test_empty_candidates(spark):
    none = spark.createDataFrame([], CANDIDATES)
    for ranker in (bm25.rerank, rankers.hybrid, rankers.binary_quantized, rankers.late_interaction, rankers.sparse):
        assert ranker(none).count() == 0
