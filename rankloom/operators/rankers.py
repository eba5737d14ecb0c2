"""Ranking strategies: candidates(query_id, query, doc_id, doc, pos) to ranked candidates with score and rank.

Every strategy is a lazy plan over all queries at once. Equal scores (to 6 places) keep the input order, pos.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..functions import quantize as Z
from ..functions import vectors as V
from ..functions.text import unicode_tokens
from ..session import stage
from .bm25 import rank
from .features import STATIC_WEIGHTS, blend, candidate_vectors, features, pairwise_features, token_rows_of

Ranker = Callable[[DataFrame], DataFrame]
FULL_TOURNAMENT = 50
TOP_TOKENS = 128
TOP_TERMS = 128


def hybrid(candidates: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Fusion of the features with fixed weights."""
    scored = features(candidates).withColumn("score", blend(weights or STATIC_WEIGHTS))
    return rank(scored, "score")


def hybrid_with_model(candidates: DataFrame, model, mode: str = "static", weights: dict[str, float] | None = None) -> DataFrame:
    """model: a function that adds model_score to feature rows, or None if unfitted. Mode learned gives the model's
    score alone (0 if unfitted); else the mean of model and blend (the blend if unfitted)."""
    rows = features(candidates)
    if mode == "learned":
        return rank(model(rows).withColumn("score", F.col("model_score")) if model else rows.withColumn("score", F.lit(0.0)), "score")
    rows = rows.withColumn("blend", blend(weights or STATIC_WEIGHTS))
    return rank(model(rows).withColumn("score", (F.col("model_score") + F.col("blend")) / 2) if model else rows.withColumn("score", F.col("blend")), "score")


def document_pairs(candidates: DataFrame) -> DataFrame:
    """All pairs i < j (by pos) of a query's candidates with the seven pairwise features. The products of documents
    are counted once for each pair of documents that some query has."""
    q, d = candidate_vectors(candidates)
    semantic = V.dot(candidates.select("query_id", "doc_id", "pos"), q, "query_id", d, "doc_id")
    length = candidates.select("doc_id", "doc").distinct().select("doc_id", F.size(unicode_tokens(F.col("doc"))).alias("len"))
    norm = d.groupBy("doc_id").agg(F.sum(F.col("w") * F.col("w")).alias("n2"))
    side = stage(semantic.join(length, "doc_id").join(norm, "doc_id", "left").fillna(0.0, ["n2"]), "pair-sides", "query_id")
    a = side.select("query_id", F.col("doc_id").alias("a"), F.col("pos").alias("pos_a"), F.col("dot").alias("qa"), F.col("n2").alias("a2"), F.col("len").alias("la"))
    b = side.select("query_id", F.col("doc_id").alias("b"), F.col("pos").alias("pos_b"), F.col("dot").alias("qb"), F.col("n2").alias("b2"), F.col("len").alias("lb"))
    pairs = a.join(b, "query_id").filter("pos_a < pos_b")
    products = V.dot(pairs.select("a", "b").distinct(), d.withColumnRenamed("doc_id", "a"), "a", d.withColumnRenamed("doc_id", "b"), "b")
    return stage(pairwise_features(pairs.join(products.withColumnRenamed("dot", "ab"), ["a", "b"])), "pairs", "query_id", "a")


def tournament(pairs: DataFrame, candidates: DataFrame, probability: Column) -> DataFrame:
    """Full tournament: of each pair the first gets the probability that it is better, the second the rest."""
    p = pairs.withColumn("p", probability)
    credit = p.select("query_id", F.explode(F.array(F.struct(F.col("a").alias("doc_id"), F.col("p").alias("c")), F.struct(F.col("b").alias("doc_id"), (1 - F.col("p")).alias("c")))).alias("e"))
    sums = credit.groupBy("query_id", "e.doc_id").agg(F.sum("e.c").alias("score"))
    return rank(candidates.join(sums, ["query_id", "doc_id"], "left").fillna(0.0, ["score"]), "score")


def logistic(weights: list[float], intercept: float) -> Column:
    z = sum((F.lit(w) * F.col(f"f{i}") for i, w in enumerate(weights, 1)), F.lit(float(intercept)))
    return 1 / (1 + F.exp(-z))


def merge_tournament(pairs: DataFrame, candidates: DataFrame, probability: Column) -> DataFrame:
    """Merge-sort tournament, for long candidate lists: sequential within a query, so one task ranks one query's list."""
    p = pairs.select("query_id", "a", "b", probability.alias("p"))
    lists = candidates.select("query_id", "doc_id", "pos")
    schema = T.StructType([lists.schema["query_id"], lists.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def ranked(key: tuple, docs: pd.DataFrame, won: pd.DataFrame) -> pd.DataFrame:
        chance = {(a, b): x for a, b, x in zip(won["a"], won["b"], won["p"], strict=True)}
        chance |= {(b, a): 1.0 - x for (a, b), x in chance.items()}
        items = docs.sort_values("pos")["doc_id"].tolist()
        credit = dict.fromkeys(items, 0.0)
        # runs by their first place, joined level by level: the cuts halve the list until every run is one document
        runs = {i: deque([d]) for i, d in enumerate(items)}
        levels = [[0, len(items)]]
        while max(np.diff(levels[-1]), default=0) > 1:
            levels.append(sorted({*levels[-1], *((a + b) // 2 for a, b in pairwise(levels[-1]))}))
        for cuts, finer in zip(levels[-2::-1], levels[:0:-1], strict=True):
            for start in cuts[:-1]:
                middle = finer[finer.index(start) + 1]
                if middle not in cuts:
                    left, right, out = runs[start], runs.pop(middle), deque()
                    while left and right:
                        x = chance[left[0], right[0]]
                        credit[left[0]] += x
                        credit[right[0]] += 1.0 - x
                        out.append((left if x >= 0.5 else right).popleft())
                    runs[start] = out + left + right
        order = runs[0] if items else []
        return pd.DataFrame([(key[0], d, credit[d] + len(items) - n) for n, d in enumerate(order)], columns=["query_id", "doc_id", "score"])

    scored = lists.groupBy("query_id").cogroup(p.groupBy("query_id")).applyInPandas(ranked, schema)
    return rank(candidates.join(scored, ["query_id", "doc_id"]), "score")


def binary_quantized(candidates: DataFrame, hamming_top_k: int = 500, bilinear_top_k: int = 50, weights: DataFrame | None = None) -> DataFrame:
    """Hamming scores of sign bits; the first bilinear_top_k of the first hamming_top_k get a weighted product instead.
    weights: (bucket, weight); none means all ones."""
    q, d = candidate_vectors(candidates)
    bits_q, bits_d = V.positive_bits(q, "query_id"), V.positive_bits(d, "doc_id").withColumnRenamed("bits", "doc_bits")
    none = F.array().cast("array<int>")
    rows = candidates.join(bits_q, "query_id", "left").join(bits_d, "doc_id", "left")
    rows = rows.withColumn("hamming", V.hamming(F.coalesce("bits", none), F.coalesce("doc_bits", none))).drop("bits", "doc_bits")
    far = F.greatest(F.max("hamming").over(W.Window.partitionBy("query_id")), F.lit(1))
    rows = rows.withColumn("near", 1.0 - F.col("hamming") / far)
    order = W.Window.partitionBy("query_id").orderBy(F.desc(F.round("near", 6)), F.desc("pos"))
    rows = rows.withColumn("__n", F.row_number().over(order))
    if weights is not None:
        d = d.join(weights, "bucket").select("doc_id", "bucket", (F.col("w") * F.col("weight")).alias("w"))
    rows = V.dot(rows, q, "query_id", d, "doc_id")
    score = F.when(F.col("__n") <= min(hamming_top_k, bilinear_top_k), F.col("dot")).otherwise(F.col("near"))
    return rank(rows.withColumn("score", score).drop("__n", "dot", "near"), "score")


def token_index(docs: DataFrame, top_k: int = TOP_TOKENS, use_salience: bool = True) -> DataFrame:
    """docs(doc_id, doc) to kept token occurrences (doc_id, at, token, bucket, sign, salience): the top_k by salience,
    ties to later occurrences; or simply the first top_k. Tokens are dealt by document once, and the few that are kept
    are hashed where they lie."""
    rows = docs.select("doc_id", F.posexplode(unicode_tokens(F.col("doc"))).alias("place", "token"))
    tf = F.count("*").over(W.Window.partitionBy("doc_id", "token"))
    n = F.count("*").over(W.Window.partitionBy("doc_id"))
    rows = rows.withColumn("n", n).withColumn("tf", tf).withColumn("salience", F.col("tf") * F.log(1 + F.col("n") / (F.col("tf") + 1))).drop("n")
    first = [F.desc(F.round("salience", 6)), F.desc("place")] if use_salience else [F.asc("place")]
    kept = rows.withColumn("__n", F.row_number().over(W.Window.partitionBy("doc_id").orderBy(*first))).filter(F.col("__n") <= top_k).drop("__n", "tf")
    return kept.withColumns({"bucket": V.token_bucket(F.col("token")), "sign": V.token_sign(F.col("token"))})


def max_sim(candidates: DataFrame, index: DataFrame) -> DataFrame:
    """Adds score: for each query token 1 if the document keeps its bucket with its sign, -1 if every kept token is
    its bucket with the other sign, else 0; which is what the greatest cosine of signed unit vectors comes to."""
    q = candidates.select("query_id", "query").distinct().select("query_id", F.explode(unicode_tokens(F.col("query"))).alias("token"))
    q = q.join(V.hashed_vocabulary(q), "token").groupBy("query_id", "bucket", "sign").agg(F.count("*").alias("qf"))
    signs = index.groupBy("doc_id", "bucket", "sign").agg(F.lit(1).alias("has"))
    kinds = signs.groupBy("doc_id").agg(F.count("*").alias("kinds"))
    pairs = candidates.select("query_id", "doc_id").distinct().join(q, "query_id")
    same = pairs.join(signs, ["doc_id", "bucket", "sign"], "left")
    other = signs.select("doc_id", "bucket", (-F.col("sign")).alias("sign"), F.lit(1).alias("opposed"))
    both = same.join(other, ["doc_id", "bucket", "sign"], "left").join(kinds, "doc_id", "left")
    one = F.when(F.col("has") == 1, 1).when((F.col("opposed") == 1) & (F.col("kinds") == 1), -1).otherwise(0)
    sums = both.groupBy("query_id", "doc_id").agg(F.sum(F.col("qf") * one).cast("double").alias("score"))
    return candidates.join(sums, ["query_id", "doc_id"], "left").fillna(0.0, ["score"])


def late_interaction(candidates: DataFrame, top_k: int = TOP_TOKENS, use_salience: bool = True, index: DataFrame | None = None) -> DataFrame:
    """Token-level matching against an index of the candidates' documents, or a given one (unknown documents score 0)."""
    if index is None:
        index = token_index(candidates.select("doc_id", "doc").distinct(), top_k, use_salience)
    return rank(max_sim(candidates, index), "score")


def late_interaction_quantized(candidates: DataFrame, mode: str, top_k: int = TOP_TOKENS) -> DataFrame:
    """As late_interaction, on vectors quantized per document and dimension over its kept tokens, then restored.

    A kept token's vector has one entry besides zeros, but zeros are restored as some value too, so for each document
    the products are taken over the dimensions that any of its kept tokens has."""
    index = token_index(candidates.select("doc_id", "doc").distinct(), top_k)
    dims = index.select("doc_id", F.col("bucket").alias("dim")).distinct()
    dense = index.join(dims, "doc_id").select("doc_id", F.col("place").alias("id"), "dim", F.when(F.col("dim") == F.col("bucket"), F.col("sign")).otherwise(0).cast("float").alias("x"))
    restored = Z.dequantize(Z.quantize(dense, ["doc_id"], mode), mode).select("doc_id", "id", "dim", F.col("x").cast("double").alias("x"))
    norms = restored.groupBy("doc_id", "id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    q = candidates.select("query_id", "query").distinct().select("query_id", F.explode(unicode_tokens(F.col("query"))).alias("token"))
    q = q.join(V.hashed_vocabulary(q), "token").groupBy("query_id", "bucket", "sign").agg(F.count("*").alias("qf"))
    entry = candidates.select("query_id", "doc_id").distinct().join(q, "query_id").withColumnRenamed("bucket", "dim")
    unit = restored.join(norms, ["doc_id", "id"]).withColumn("x", F.col("x") / F.when(F.col("norm") == 0, F.lit(1.0)).otherwise(F.col("norm")))
    best = entry.join(unit, ["doc_id", "dim"], "left").groupBy("query_id", "doc_id", "dim", "sign", "qf").agg(F.coalesce(F.max(F.col("sign") * F.col("x")), F.lit(0.0)).alias("best"))
    sums = best.groupBy("query_id", "doc_id").agg(F.sum(F.col("qf") * F.col("best")).alias("score"))
    return rank(candidates.join(sums, ["query_id", "doc_id"], "left").fillna(0.0, ["score"]), "score")


def sparse_terms(texts: DataFrame, key: str, text: str, top_k: int = TOP_TERMS) -> DataFrame:
    """(key, term, w): a text's top_k terms by weight log(1 + tf), ties by term. A learned encoder's weights in the
    same columns can take its place."""
    rows = token_rows_of(texts, key, text).select(key, F.col("token").alias("term"), F.log1p(F.col("f")).alias("w"))
    order = W.Window.partitionBy(key).orderBy(F.desc(F.round("w", 6)), "term")
    return rows.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= top_k).drop("__n")


def sparse(candidates: DataFrame, top_k: int = TOP_TERMS) -> DataFrame:
    """Sum over shared terms of the smaller weight."""
    q = sparse_terms(candidates.select("query_id", "query").distinct(), "query_id", "query", top_k)
    d = sparse_terms(candidates.select("doc_id", "doc").distinct(), "doc_id", "doc", top_k).withColumnRenamed("w", "v")
    sums = candidates.select("query_id", "doc_id").join(q, "query_id").join(d, ["doc_id", "term"]).groupBy("query_id", "doc_id").agg(F.sum(F.least("w", "v")).alias("score"))
    return rank(candidates.join(sums, ["query_id", "doc_id"], "left").fillna(0.0, ["score"]), "score")


def semantic_choice(pairs: DataFrame) -> Column:
    """1 if the query is at least as near to the first document as to the second."""
    return (F.round("qa", 6) >= F.round("qb", 6)).cast("int")


def external(candidates: DataFrame, score: Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """Rank by an outside model: score(queries, docs) gives the scores of a batch."""

    @F.pandas_udf(T.DoubleType())
    def outside(queries: pd.Series, docs: pd.Series) -> pd.Series:
        return score(queries, docs).astype("float64")

    return rank(candidates.withColumn("score", outside("query", "doc")), "score")


def ensemble(candidates: DataFrame, teachers: list[Ranker]) -> DataFrame:
    """The mean of the teachers' scores."""
    scores = [t(candidates).select("query_id", "doc_id", "score") for t in teachers]
    union = scores[0]
    for s in scores[1:]:
        union = union.unionByName(s)
    return rank(candidates.join(union.groupBy("query_id", "doc_id").agg(F.avg("score").alias("score")), ["query_id", "doc_id"]), "score")
