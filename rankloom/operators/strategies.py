"""Strategies by name, fitted on judged candidates where they need it, and the grids that compare them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import stage
from . import bm25, boosting, metrics, rankers, training
from .features import STATIC_WEIGHTS, blend, features

Ranker = Callable[[DataFrame], DataFrame]


def _hybrid(judged: DataFrame, mode: str = "mean", **options) -> Ranker:
    scorer = training.pointwise_hybrid(features(judged).withColumn("label", (F.col("rel") > 0).cast("double")), "label", **options)
    return lambda candidates: rankers.hybrid_with_model(candidates, scorer, mode)


def _binary(judged: DataFrame, hamming_top_k: int = 500, bilinear_top_k: int = 50, **options) -> Ranker:
    weights = training.bilinear_weights(judged.withColumn("label", (F.col("rel") > 0).cast("int")), "label", **options)
    return lambda candidates: rankers.binary_quantized(candidates, hamming_top_k, bilinear_top_k, weights)


def _distilled(judged: DataFrame, **options) -> Ranker:
    """Compares pairs by a logistic model of which has the greater label; long lists by the merge-sort tournament."""
    rel = judged.select("query_id", "doc_id", "rel")
    pairs = rankers.document_pairs(judged).join(rel.toDF("query_id", "a", "ra"), ["query_id", "a"]).join(rel.toDF("query_id", "b", "rb"), ["query_id", "b"])
    fitted = training.logistic_pairs(pairs.filter("ra <> rb").withColumn("label", (F.col("ra") > F.col("rb")).cast("double")), **options)
    probability = rankers.logistic(*fitted) if isinstance(fitted, tuple) else F.lit(fitted)

    def ranker(candidates: DataFrame) -> DataFrame:
        longest = candidates.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
        method = rankers.tournament if longest <= rankers.FULL_TOURNAMENT else rankers.merge_tournament
        return method(rankers.document_pairs(candidates), candidates, probability)

    return ranker


def _listwise(judged: DataFrame, **options) -> Ranker:
    weights = training.listwise_weights(features(judged), "rel", **options)
    return lambda candidates: bm25.rank(features(candidates).withColumn("score", sum((F.lit(w) * F.coalesce(n, F.lit(0.0)) for n, w in weights.items()), F.lit(0.0))), "score")


def _boosted(judged: DataFrame, **options) -> Ranker:
    trees = boosting.fit(features(judged), "rel", training.HYBRID_FEATURES, **options)
    return lambda candidates: bm25.rank(trees.score(features(candidates)).withColumnRenamed("model_score", "score"), "score")


#: What takes judged(query_id, query, doc_id, doc, pos, rel) and options, and gives a ranker of candidates.
FITTED: dict[str, Callable[..., Ranker]] = {"hybrid": _hybrid, "binary": _binary, "distilled": _distilled, "listwise": _listwise, "boosted": _boosted}
#: Rankers that need no fitting.
PLAIN: dict[str, Callable[..., DataFrame]] = {"bm25": bm25.rerank, "static_hybrid": rankers.hybrid, "late_interaction": rankers.late_interaction, "sparse": rankers.sparse}


def build(judged: DataFrame, wanted: dict[str, dict]) -> dict[str, Ranker]:
    """Rankers by name, each with the options given for it; an unknown name, or nothing wanted, is an error."""
    if not wanted:
        raise ValueError("no strategies are asked for")
    if unknown := set(wanted) - set(FITTED) - set(PLAIN):
        raise ValueError(f"unknown strategies: {', '.join(sorted(unknown))}")
    plain = lambda f, options: lambda candidates: f(candidates, **options)
    return {n: FITTED[n](judged, **o) if n in FITTED else plain(PLAIN[n], o) for n, o in wanted.items()}


def ablation(judged: DataFrame) -> DataFrame:
    """(variant, queries, ndcg, mrr, map, p_at_1) of the static fusion whole ("all") and without each feature in turn.
    Features are computed once; a list of each variant is a query of its own."""
    weights = {"all": STATIC_WEIGHTS} | {n: STATIC_WEIGHTS | {n: 0.0} for n in STATIC_WEIGHTS}
    scores = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), blend(w).alias("score")) for v, w in weights.items()]))
    rows = features(judged).select("query_id", "doc_id", "pos", "rel", scores.alias("e")).select(F.struct("e.variant", "query_id").alias("query_id"), "doc_id", "pos", "rel", "e.score")
    return metrics.evaluate(bm25.rank(rows, "score"), by=F.col("query_id.variant"))


def scaling(judged: DataFrame, ranker: Ranker, sizes: Iterable[int] = (20, 50, 100, 200)) -> DataFrame:
    """(variant, queries, ndcg, ...) of a ranker over the first documents of each list, for each size."""
    copies = F.explode(F.array(*map(F.lit, sizes)))
    rows = judged.withColumn("__size", copies).filter(F.col("pos") <= F.col("__size")).withColumn("query_id", F.struct(F.col("__size").alias("size"), "query_id")).drop("__size")
    ranked = ranker(rows.drop("rel")).select("query_id", "doc_id", "rank").join(rows.select("query_id", "doc_id", "rel"), ["query_id", "doc_id"])
    return metrics.evaluate(ranked, by=F.col("query_id.size"))


def dimensions(judged: DataFrame, sizes: list[int]) -> DataFrame:
    """(variant, queries, ndcg, ...) of ranking each list by cosine of hashed embeddings, for each dimension. All vectors
    are folded from one pass over the tokens, and all dimensions are ranked by one plan."""
    q = V.embed_grid(judged.select("query_id", "query").distinct(), "query_id", "query", sizes)
    d = V.embed_grid(judged.select("doc_id", "doc").distinct(), "doc_id", "doc", sizes).withColumnRenamed("w", "v")
    pairs = judged.select("query_id", "doc_id").distinct()
    dots = pairs.join(q, "query_id").join(d, ["dimension", "doc_id", "bucket"]).groupBy("dimension", "query_id", "doc_id").agg(F.sum(F.col("w") * F.col("v")).alias("score"))
    rows = judged.select("query_id", "doc_id", "pos", "rel").withColumn("dimension", F.explode(F.array(*map(F.lit, sizes))))
    rows = rows.join(dots, ["dimension", "query_id", "doc_id"], "left").fillna(0.0, ["score"])
    lists = rows.select(F.struct("dimension", "query_id").alias("query_id"), "doc_id", "pos", "rel", "score")
    return metrics.evaluate(bm25.rank(lists, "score"), by=F.col("query_id.dimension"))


def measured(judged: DataFrame, wanted: dict[str, dict]) -> DataFrame:
    """(variant, queries, ndcg, mrr, map, p_at_1, seconds) of strategies by name: each ranks the judged lists once, written, and
    seconds is the time to the end of that write, fitting left out."""
    out, rel = None, judged.select("query_id", "doc_id", "rel")
    for name, ranker in build(judged, wanted).items():
        began = time.monotonic()
        ranked = stage(ranker(judged.drop("rel")).select("query_id", "doc_id", "rank"), f"ranked-{name}")
        seconds = time.monotonic() - began
        one = metrics.evaluate(ranked.join(rel, ["query_id", "doc_id"])).select(F.lit(name).alias("variant"), "*", F.lit(seconds).alias("seconds"))
        out = one if out is None else out.unionByName(one)
    return out
