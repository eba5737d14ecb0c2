"""Relevance features of candidates(query_id, query, doc_id, doc, pos, ...) and the static blend.

Texts are tokenised, embedded and hashed once per distinct query and document, then joined to the candidates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import char_ngrams, contains_phrase, query_shape, unicode_tokens, whitespace_tokens
from ..session import stage
from .bm25 import max_normalized, score_candidates

#: Fixed: weights of the static blend and of the router's profiles.
STATIC_WEIGHTS = {
    "sem_score": 0.25,
    "bm25_score": 0.20,
    "token_overlap_ratio": 0.15,
    "query_coverage_ratio": 0.20,
    "shared_token_char_sum": 0.10,
    "exact_phrase_match": 0.10,
    "keyword_hit_rate": 0.05,
}
PROFILES = {
    "navigational": {"sem_score": 0.10, "bm25_score": 0.40, "token_overlap_ratio": 0.15, "query_coverage_ratio": 0.15, "shared_token_char_sum": 0.05, "exact_phrase_match": 0.10, "keyword_hit_rate": 0.05},
    "informational": {"sem_score": 0.40, "bm25_score": 0.10, "token_overlap_ratio": 0.10, "query_coverage_ratio": 0.10, "shared_token_char_sum": 0.05, "exact_phrase_match": 0.05, "keyword_hit_rate": 0.20},
    "balanced": {"sem_score": 0.25, "bm25_score": 0.20, "token_overlap_ratio": 0.15, "query_coverage_ratio": 0.20, "shared_token_char_sum": 0.10, "exact_phrase_match": 0.05, "keyword_hit_rate": 0.05},
}
BASE_FEATURES = ["sem_score", "bm25_score", "vec_norm_diff", "token_overlap_ratio", "query_coverage_ratio", "shared_token_char_sum", "exact_phrase_match", "query_len", "doc_len"]

Adapter = Callable[[Column, Column], dict[str, Column]]


def keyword_hit_rate(query: Column, doc: Column) -> Column:
    """Share of the query's words, repeats included, that the lower-cased document holds as substrings."""
    terms, lowered = whitespace_tokens(query), F.lower(doc)
    return F.size(F.filter(terms, lambda t: F.contains(lowered, t))) / F.greatest(F.size(terms), F.lit(1))


def keyword_adapter(query: Column, doc: Column) -> dict[str, Column]:
    return {"keyword_hit_rate": keyword_hit_rate(query, doc)}


def gram_adapter(query: Column, doc: Column, n: int = 3) -> dict[str, Column]:
    """Exact Jaccard of character n-gram sets."""
    return {"lsh_jaccard": V.jaccard(char_ngrams(query, n), char_ngrams(doc, n))}


def token_features(query_tokens: Column, doc_tokens: Column) -> dict[str, Column]:
    shared, union = F.array_intersect(query_tokens, doc_tokens), F.array_union(query_tokens, doc_tokens)
    return {
        "token_overlap_ratio": F.size(shared) / F.greatest(F.size(union), F.lit(1)),
        "query_coverage_ratio": F.size(shared) / F.greatest(F.size(F.array_distinct(query_tokens)), F.lit(1)),
        "shared_token_char_sum": F.aggregate(shared, F.lit(0), lambda n, t: n + F.length(t)).cast("double"),
        "query_len": F.size(query_tokens).cast("double"),
        "doc_len": F.size(doc_tokens).cast("double"),
    }


def candidate_vectors(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unit vectors (query_id, bucket, w) and (doc_id, bucket, w) of the distinct texts, staged."""
    q = V.embed(candidates.select("query_id", "query").distinct(), "query_id", "query")
    d = V.embed(candidates.select("doc_id", "doc").distinct(), "doc_id", "doc")
    return stage(q, "query-vectors", "query_id"), stage(d, "document-vectors", "doc_id")


def semantic(candidates: DataFrame) -> DataFrame:
    """Adds sem_score (unclipped) and vec_norm_diff."""
    q, d = candidate_vectors(candidates)
    rows = V.dot(candidates, q, "query_id", d, "doc_id").withColumnRenamed("dot", "sem_score")
    some_q, some_d = q.select("query_id").distinct().withColumn("q2", F.lit(1.0)), d.select("doc_id").distinct().withColumn("d2", F.lit(1.0))
    rows = rows.join(some_q, "query_id", "left").join(some_d, "doc_id", "left").fillna(0.0, ["q2", "d2"])
    return rows.withColumn("vec_norm_diff", V.l2_distance(F.col("q2"), F.col("d2"), F.col("sem_score"))).drop("q2", "d2")


def features(candidates: DataFrame, adapters: tuple[Adapter, ...] = (keyword_adapter,), single_doc_bm25: bool = False) -> DataFrame:
    """Adds the nine base features and the adapters'. BM25 is over each query's candidates; with single_doc_bm25 each
    document is a corpus of its own, so that its normalised score is 0 or 1."""
    scored = max_normalized(score_candidates(candidates, unicode_tokens))
    bm25 = (F.col("bm25") > 0).cast("double") if single_doc_bm25 else F.col("bm25_norm")
    scored = semantic(scored.withColumn("bm25_score", bm25).drop("bm25", "bm25_norm"))
    q = candidates.select("query_id", "query").distinct().select("query_id", unicode_tokens(F.col("query")).alias("__qt"))
    d = candidates.select("doc_id", "doc").distinct().select("doc_id", unicode_tokens(F.col("doc")).alias("__dt"))
    rows = scored.join(q, "query_id").join(d, "doc_id")
    more = token_features(F.col("__qt"), F.col("__dt")) | {"exact_phrase_match": contains_phrase(F.col("query"), F.col("doc"))}
    for adapter in adapters:
        more |= adapter(F.col("query"), F.col("doc"))
    return rows.withColumns(more).drop("__qt", "__dt")


def blend(weights: dict[str, float | Column], query: Column | None = None) -> Column:
    """The weighted sum of features; shared characters count per word of the query."""
    query = F.col("query") if query is None else query
    words = F.greatest(F.size(whitespace_tokens(F.regexp_replace(query, "_", " "))), F.lit(1))

    def value(name: str) -> Column:
        return F.col(name) / words if name == "shared_token_char_sum" else F.col(name)

    return sum((F.lit(weights[n]) * value(n) for n in STATIC_WEIGHTS), F.lit(0.0))


def pairwise_features(pairs: DataFrame) -> DataFrame:
    """pairs(query, a, b vectors' products and lengths: qa, qb, ab, a2, b2, la, lb) to the seven pairwise features."""
    return pairs.withColumns({"f1": F.col("qa"), "f2": F.col("qb"), "f3": F.col("qa") - F.col("qb"), "f4": V.l2_distance(F.col("a2"), F.col("b2"), F.col("ab")), "f5": F.col("la").cast("double"), "f6": F.col("lb").cast("double"), "f7": (F.col("la") - F.col("lb")).cast("double")})


def router_features(queries: DataFrame, dimension: int = V.DIMENSION) -> DataFrame:
    """queries(query_id, query) with the seven features of the query router; mean and deviation of the embedding
    count its zeros too."""
    tokens = unicode_tokens(F.col("query"))
    vectors = V.embed(queries, "query_id", "query", dimension).groupBy("query_id").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("s2"))
    rows = queries.join(vectors, "query_id", "left").fillna(0.0, ["s", "s2"])
    mean = F.col("s") / dimension
    length = F.aggregate(tokens, F.lit(0), lambda n, t: n + F.length(t)) / F.greatest(F.size(tokens), F.lit(1))
    return rows.select("query_id", "query", F.size(tokens).cast("double").alias("n_tokens"), length.alias("avg_token_len"), mean.alias("vec_mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / dimension - mean * mean)).alias("vec_std"), *[c.alias(n) for n, c in query_shape(F.col("query")).items()])


def token_rows_of(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, f) by the Unicode tokenizer."""
    return texts.select(key, F.explode(unicode_tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("f"))
