"""Combinators of rankings: staged pipelines, rank fusion, confidence cascades and query routing."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..session import stage as staged_rows
from .bm25 import rank
from .features import PROFILES, blend, features

RRF_K = 60
STAGE_TOP_K = 200


@dataclass(frozen=True)
class Stage:
    name: str
    ranker: Callable[[DataFrame], DataFrame]
    top_k: int = STAGE_TOP_K

    def __post_init__(self) -> None:
        if self.top_k <= 0:
            raise ValueError("top_k must be positive")


def staged(candidates: DataFrame, stages: list[Stage]) -> DataFrame:
    """Each stage ranks what the one before has left, by documents alone; the last stage's scores stand. Without
    stages the input order stands, with score 0. What a stage hands on is staged, since the next uses it many times."""
    if not stages:
        return candidates.withColumn("score", F.lit(0.0)).withColumn("rank", F.row_number().over(W.Window.partitionBy("query_id").orderBy("pos")))
    columns = ["query_id", "query", "doc_id", "doc"]
    rows = candidates
    for i, stage in enumerate(stages):
        ranked = stage.ranker(rows).filter(F.col("rank") <= stage.top_k)
        if i + 1 == len(stages):
            return ranked.select(*columns, "pos", "score", "rank")
        rows = staged_rows(ranked.select(*columns, F.col("rank").alias("pos")), f"stage-{stage.name}", "query_id", "doc_id")
    raise AssertionError


def staged_measured(candidates: DataFrame, stages: list[Stage]) -> tuple[DataFrame, DataFrame]:
    """As staged, with every stage's result written once, and a report of stage, name, queries, n_in, n_out and seconds.

    Counts are observed while a stage is written, so they cost no job and no pass of their own; seconds are the time to
    the end of that write. The first stage's n_in is counted from the candidates."""
    columns, report, rows = ["query_id", "query", "doc_id", "doc"], [], candidates
    n_in, ranked = candidates.count(), candidates.withColumns({"score": F.lit(0.0), "rank": F.row_number().over(W.Window.partitionBy("query_id").orderBy("pos"))})
    for i, one in enumerate(stages):
        seen, began = Observation(f"stage-{i}-{one.name}"), time.monotonic()
        kept = one.ranker(rows).filter(F.col("rank") <= one.top_k).select(*columns, "pos", "score", "rank")
        counted = kept.observe(seen, F.count(F.lit(1)).alias("n_out"), F.count(F.when(F.col("rank") == 1, 1)).alias("queries"))
        ranked = staged_rows(counted, f"measured-{one.name}")
        report.append((i, one.name, int(seen.get["queries"]), int(n_in), int(seen.get["n_out"]), time.monotonic() - began))
        n_in = seen.get["n_out"]
        rows = ranked.select(*columns, F.col("rank").alias("pos"))
    return ranked, candidates.sparkSession.createDataFrame(report, "stage int, name string, queries bigint, n_in bigint, n_out bigint, seconds double")


def stage_counts(candidates: DataFrame, stages: list[Stage]) -> DataFrame:
    """(query_id, stage, name, n_in, n_out) of a staged ranking."""
    rows, out = candidates.groupBy("query_id").agg(F.count("*").cast("int").alias("n")), None
    for i, stage in enumerate(stages):
        one = rows.select("query_id", F.lit(i).alias("stage"), F.lit(stage.name).alias("name"), F.col("n").alias("n_in"), F.least("n", F.lit(stage.top_k)).alias("n_out"))
        out = one if out is None else out.unionByName(one)
        rows = one.select("query_id", F.col("n_out").alias("n"))
    return out


def reciprocal_rank_fusion(rankings: list[DataFrame], k: int = RRF_K, weights: list[float] | None = None) -> DataFrame:
    """(query_id, doc_id, rrf) of rankings(query_id, doc_id, rank): a document missing from a ranking gets nothing
    there. weights, if given, scale each ranking's part."""
    weights = weights or [1.0] * len(rankings)
    if len(weights) != len(rankings):
        raise ValueError("one weight per ranking")
    union = None
    for r, w in zip(rankings, weights, strict=True):
        one = r.select("query_id", "doc_id", (F.lit(float(w)) / (F.lit(k) + F.col("rank"))).alias("part"))
        union = one if union is None else union.unionByName(one)
    return union.groupBy("query_id", "doc_id").agg(F.sum("part").alias("rrf"))


def fused(candidates: DataFrame, rankers: list[Callable[[DataFrame], DataFrame]], k: int = RRF_K, weights: list[float] | None = None) -> DataFrame:
    """Rank by fused ranks of all rankers' scores. A weight other than 1 clips scores at 0 and scales them before they
    are ranked, which can only create ties. A single ranker passes through."""
    weights = weights or [1.0] * len(rankers)
    if len(weights) != len(rankers):
        raise ValueError("one weight per ranker")
    if len(rankers) == 1:
        return rankers[0](candidates)
    lists = []
    for ranker, weight in zip(rankers, weights, strict=True):
        scored = ranker(candidates).drop("rank")
        if weight != 1.0:
            scored = scored.withColumn("score", F.greatest("score", F.lit(0.0)) * weight)
        lists.append(rank(scored, "score"))
    both = candidates.join(reciprocal_rank_fusion(lists, k), ["query_id", "doc_id"]).withColumn("score", F.col("rrf"))
    return rank(both, "rrf").drop("rrf")


def confidence(ranked: DataFrame, metric: str = "top_margin") -> DataFrame:
    """(query_id, confidence) by max_score, top_margin, score_variance or normalized_max."""
    order = W.Window.partitionBy("query_id").orderBy(F.desc("score"))
    rows = ranked.select("query_id", "score", F.row_number().over(order).alias("n"))
    top = F.max("score")
    second = F.max(F.when(F.col("n") == 2, F.col("score")))
    spread = top - F.min("score")
    value = {
        "max_score": top,
        "top_margin": F.coalesce(top - second, top),
        "score_variance": F.coalesce(F.var_samp("score"), F.lit(0.0)),
        "normalized_max": F.when(spread == 0, F.lit(1.0)).otherwise(top / spread),
    }[metric]
    return rows.groupBy("query_id").agg(value.alias("confidence"))


def cascade(candidates: DataFrame, primary: Callable[[DataFrame], DataFrame], fallback: Callable[[DataFrame], DataFrame], threshold: float, metric: str = "top_margin", mode: str = "low_confidence") -> DataFrame:
    """The primary ranking, but the fallback's for queries whose confidence is below the threshold (mode always or
    never: for all or none). The fallback is only computed for the queries routed to it."""
    first = staged_rows(primary(candidates), "cascade-primary", "query_id")
    sure = confidence(first, metric)
    routed = {"low_confidence": F.round("confidence", 9) < threshold, "always": F.lit(True), "never": F.lit(False)}[mode]
    route = staged_rows(sure.withColumn("fallback_used", routed), "cascade-route")
    low = route.filter("fallback_used").select("query_id")
    columns = ["query_id", "query", "doc_id", "doc", "pos", "score", "rank"]
    second = fallback(candidates.join(low, "query_id", "left_semi")).select(*columns)
    rows = first.join(low, "query_id", "left_anti").select(*columns).unionByName(second)
    return rows.join(route, "query_id")


def cascade_statistics(routed: DataFrame) -> DataFrame:
    """Queries, fallbacks, their rate and the mean confidence, of a cascade's rows."""
    per = routed.groupBy("query_id").agg(F.first("fallback_used").alias("used"), F.first("confidence").alias("confidence"))
    return per.agg(F.count("*").alias("total_queries"), F.sum(F.col("used").cast("int")).alias("fallback_count"), F.avg(F.col("used").cast("double")).alias("fallback_rate"), F.avg("confidence").alias("avg_confidence"))


def profile_weights(category: Column) -> dict[str, Column]:
    """The weight of each feature for a router category 0, 1, 2 (in the order of the profiles); balanced beyond."""
    names = list(PROFILES)
    return {f: F.when(category == 0, PROFILES[names[0]][f]).when(category == 1, PROFILES[names[1]][f]).otherwise(F.lit(PROFILES["balanced"][f])) for f in PROFILES["balanced"]}


def routed_hybrid(candidates: DataFrame, categories: DataFrame) -> DataFrame:
    """Hybrid ranking with each query's own profile; categories(query_id, category), balanced where there is none."""
    rows = features(candidates).join(categories.select("query_id", "category"), "query_id", "left")
    weights = profile_weights(F.coalesce("category", F.lit(2)))
    return rank(rows.withColumn("score", blend(weights)), "score")


def auto_labels(candidates_with_rel: DataFrame, categories: int = 3) -> DataFrame:
    """(query_id, category): 0 if the best BM25 score beats the semantic score of the best-judged document, else 1; 2
    if they are within a tenth (with three categories); 0 for a query with one candidate."""
    rows = features(candidates_with_rel.withColumnRenamed("rel", "__rel"))
    best = F.max_by(F.least(F.greatest("sem_score", F.lit(0.0)), F.lit(1.0)), F.struct("__rel", -F.col("pos")))
    per = rows.groupBy("query_id").agg(F.max("bm25_score").alias("bm25_best"), best.alias("sem"), F.count("*").alias("n"))
    gap, scale = F.abs(F.col("bm25_best") - F.col("sem")), F.greatest(F.abs("bm25_best"), F.abs("sem"), F.lit(1.0))
    close = (gap <= 0.1 * scale) if categories >= 3 else F.lit(False)
    category = F.when(F.col("n") < 2, 0).when(close, 2).when(F.col("bm25_best") > F.col("sem"), 0).otherwise(1)
    return per.select("query_id", "bm25_best", "sem", category.alias("category"))
