"""Ranking metrics over ranked(query_id, rank, rel): one row per query, then averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..session import discard, stage

#: Ranges that one pass of a selection counts, and states of groups, counted, up to which they are broadcast.
BINS = 1024
BROADCAST_GROUPS = 10_000


def gain(rel: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + F.lit(1.0))


def dcg(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.groupBy("query_id").agg(F.coalesce(F.sum(F.when(F.col("rank") <= k, gain(F.col("rel"), F.col("rank")))), F.lit(0.0)).alias("dcg"))


def ndcg(ranked: DataFrame, k: int = 10) -> DataFrame:
    """dcg, ideal and ndcg; the ideal reorders the ranked list itself; 0 where the ideal is 0."""
    best = F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.desc("rel"), "rank"))
    rows = ranked.select("query_id", "rank", "rel", best.alias("best"))
    sums = rows.groupBy("query_id").agg(*[F.coalesce(F.sum(F.when(F.col(r) <= k, gain(F.col("rel"), F.col(r)))), F.lit(0.0)).alias(n) for r, n in (("rank", "dcg"), ("best", "ideal"))])
    return sums.withColumn("ndcg", F.when(F.col("ideal") == 0, F.lit(0.0)).otherwise(F.col("dcg") / F.col("ideal")))


def reciprocal_rank(ranked: DataFrame, k: int | None = None, above: float = 0) -> DataFrame:
    hit = (F.col("rel") > above) & (F.lit(True) if k is None else F.col("rank") <= k)
    return ranked.groupBy("query_id").agg(F.coalesce(1.0 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("rr"))


def average_precision(ranked: DataFrame, k: int | None = None, above: float = 0) -> DataFrame:
    """Mean precision at the relevant documents that were found."""
    rows = ranked if k is None else ranked.filter(F.col("rank") <= k)
    hit = (F.col("rel") > above).cast("int")
    so_far = F.sum(hit).over(W.Window.partitionBy("query_id").orderBy("rank").rowsBetween(W.Window.unboundedPreceding, 0))
    rows = rows.withColumn("p", F.when(F.col("rel") > above, so_far / F.col("rank")))
    found = rows.groupBy("query_id").agg(F.avg("p").alias("ap"))
    return ranked.select("query_id").distinct().join(found, "query_id", "left").fillna(0.0, ["ap"])


def precision_at(ranked: DataFrame, k: int, above: float = 0) -> DataFrame:
    """Share of relevant documents among the first k, or among all if there are fewer."""
    return ranked.filter(F.col("rank") <= k).groupBy("query_id").agg(F.avg((F.col("rel") > above).cast("double")).alias("precision"))


def accuracy(pairs: DataFrame, truth: str, predicted: str) -> DataFrame:
    return pairs.agg(F.coalesce(F.avg((F.col(truth) == F.col(predicted)).cast("double")), F.lit(0.0)).alias("accuracy"))


def per_query(ranked: DataFrame, k: int = 10, precision_above: float = 0) -> DataFrame:
    """(query_id, ndcg, rr, ap, precision, some): each query's metrics, and whether it has a relevant document."""
    per = ndcg(ranked, k).select("query_id", "ndcg").join(reciprocal_rank(ranked), "query_id").join(average_precision(ranked), "query_id").join(precision_at(ranked, 1, precision_above), "query_id")
    some = ranked.groupBy("query_id").agg(F.max((F.col("rel") > 0).cast("int")).alias("some"))
    return per.join(some, "query_id")


def evaluate(ranked: DataFrame, k: int = 10, only_with_relevant: bool = False, precision_above: float = 0, by: Column | None = None) -> DataFrame:
    """One row, or one for each value of by (an expression of query_id, as variant): queries and the means of ndcg, mrr,
    map and precision at 1. With only_with_relevant the means, but not the count, leave out queries without a relevant
    document."""
    per = per_query(ranked, k, precision_above)
    use = F.col("some") == 1 if only_with_relevant else F.lit(True)
    mean = lambda c: F.coalesce(F.avg(F.when(use, F.col(c))), F.lit(0.0))
    return per.groupBy(*([by.alias("variant")] if by is not None else [])).agg(F.count("*").alias("queries"), mean("ndcg").alias("ndcg"), mean("rr").alias("mrr"), mean("ap").alias("map"), mean("precision").alias("p_at_1"))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Recall, precision, F1, false-positive rate and accuracy of boolean columns."""
    t, p = F.col(truth), F.col(predicted)
    count = lambda c: F.sum(c.cast("int"))
    sums = rows.agg(count(t & p).alias("tp"), count(~t & p).alias("fp"), count(t & ~p).alias("fn"), count(~t & ~p).alias("tn"))
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    sums = sums.withColumns({"recall": ratio(tp, tp + fn), "precision": ratio(tp, tp + fp), "fpr": ratio(fp, fp + tn), "accuracy": ratio(tp + tn, tp + fp + fn + tn)})
    return sums.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def nearest_samples(samples: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """by, share and x: for each share p the sample at place round(p * (n - 1)) of the group's n in order, halves to even.

    By selection: each pass counts the samples of the range that holds the place in BINS ranges of equal width, and
    goes on with the one that the place falls into, from its smallest to its largest sample, until they are equal. A
    pass is one grouping with partial sums, at most BINS rows for each group and share; samples are never sorted. Samples
    that are null or not finite are left out."""
    by, x = by or [], F.col(value).cast("double")
    groups = [F.col(c) for c in by] or [F.lit(0).alias("__one")]
    names = by or ["__one"]
    data = stage(samples.select(*groups, x.alias("x")).filter("abs(x) < double('infinity')"), "samples")
    sizes = data.groupBy(*names).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    place = F.bround((F.col("n") - 1) * F.col("share")).cast("bigint")
    state = stage(sizes.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).select(*names, "share", place.alias("place"), "low", "high"), "selection")
    while not state.filter("low < high").isEmpty():
        open_state = state.filter("low < high")
        # halves first, so that the width of the widest range is finite
        unit = (F.col("x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        inside = _on(data, open_state, names).filter("x BETWEEN low AND high").withColumn("bin", F.least(F.floor(unit * BINS), F.lit(BINS - 1)))
        bins = inside.groupBy(*names, "share", "place", "bin").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        upto = F.sum("n").over(W.Window.partitionBy(*names, "share").orderBy("bin"))
        found = bins.withColumn("upto", upto).filter("place < upto AND place >= upto - n")
        done = state.filter("low >= high").select(*names, "share", "place", "low", "high")
        after = stage(found.select(*names, "share", (F.col("place") - F.col("upto") + F.col("n")).alias("place"), "low", "high").unionByName(done), "selection")
        discard(state)
        state = after
    return state.select(*by, "share", F.col("low").alias("x"))


def _on(data: DataFrame, state: DataFrame, names: list[str]) -> DataFrame:
    """Samples with their groups' states, which are counted before they are broadcast. Groups may be null."""
    few = F.broadcast(state) if state.count() <= BROADCAST_GROUPS else state
    on = [data[c].eqNullSafe(few[c]) for c in names]
    return data.join(few, on).select(*[data[c] for c in names], "share", "place", "low", "high", "x")


def latency(samples: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """p50 and p99 as the nearest sample, and the mean, of all samples or of each group."""
    by = by or []
    near = nearest_samples(samples, value, [0.5, 0.99], by)
    at = lambda p: F.max(F.when(F.col("share") == p, F.col("x")))
    picked = near.groupBy(*by).agg(at(0.5).alias("p50"), at(0.99).alias("p99"))
    means = samples.groupBy(*by).agg(F.avg(value).alias("mean"))
    on = [picked[c].eqNullSafe(means[c]) for c in by] if by else F.lit(True)
    return means.join(picked, on, "left").select(*[means[c] for c in by], "p50", "p99", "mean")


def summary(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean, population deviation and interpolated percentiles."""
    v = F.col(value).cast("double")
    return rows.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.percentile(v, F.lit(0.5)).alias("p50"), F.percentile(v, F.lit(0.99)).alias("p99"))
