"""Trained scorers, by MLlib, as functions from training rows to a scorer of feature rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import vectors as V
from . import newton
from .combine import profile_weights
from .features import BASE_FEATURES, features

Scorer = Callable[[DataFrame], DataFrame]
PAIR_FEATURES = [f"f{i}" for i in range(1, 8)]
HYBRID_FEATURES = [*BASE_FEATURES, "keyword_hit_rate"]
ROUTER_FEATURES = ["n_tokens", "avg_token_len", "vec_mean", "vec_std", "has_numbers", "has_special", "capital_ratio"]
TREES = {"maxIter": 120, "maxDepth": 4, "stepSize": 0.08, "subsamplingRate": 0.9, "featureSubsetStrategy": "0.9", "seed": 42}


def _assembled(rows: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="__x", handleInvalid="error").transform(rows.fillna(0.0, names))


def _classes(rows: DataFrame, label: str) -> list:
    return sorted(r[0] for r in rows.select(label).distinct().limit(2).collect())


def _constant(value: float) -> Scorer:
    return lambda rows: rows.withColumn("model_score", F.lit(float(value)))


def _probability(model, names: list[str]) -> Scorer:
    def score(rows: DataFrame) -> DataFrame:
        out = model.transform(_assembled(rows, names))
        return out.withColumn("model_score", vector_to_array("probability")[1]).drop("__x", "rawPrediction", "probability", "prediction")

    return score


def pairwise_hybrid(pairs: DataFrame, names: list[str] = HYBRID_FEATURES, **options) -> Scorer:
    """Boosted trees on differences of the features of a pair's documents, label 1 where the first is preferred; pairs
    has the names with _a and _b. With one class the scorer is that constant."""
    rows = pairs.select("label", *[(F.col(f"{n}_a") - F.col(f"{n}_b")).alias(n) for n in names])
    classes = _classes(rows, "label")
    if len(classes) < 2:
        return _constant(classes[0] if classes else 0)
    return _probability(GBTClassifier(featuresCol="__x", labelCol="label", **(TREES | options)).fit(_assembled(rows, names)), names)


def pointwise_hybrid(rows: DataFrame, label: str, names: list[str] = HYBRID_FEATURES, classify: bool = False, **options) -> Scorer:
    """Boosted trees on the features themselves: regression of the label, or classification above its median."""
    data = _assembled(rows.withColumn("label", F.col(label).cast("double")), names)
    if not classify:
        model = GBTRegressor(featuresCol="__x", labelCol="label", **(TREES | options)).fit(data)
        return lambda r: model.transform(_assembled(r, names)).withColumnRenamed("prediction", "model_score").drop("__x")
    middle = data.agg(F.percentile("label", F.lit(0.5))).first()[0]
    data = data.withColumn("label", (F.col("label") > middle).cast("double"))
    classes = _classes(data, "label")
    if len(classes) < 2:
        return _constant(classes[0] if classes else 0)
    return _probability(GBTClassifier(featuresCol="__x", labelCol="label", **(TREES | options)).fit(data), names)


def logistic_pairs(pairs: DataFrame, c: float = 1.0, steps: int = newton.MOST_STEPS) -> tuple[list[float], float] | float:
    """(weights, intercept) of a logistic comparison on the seven pairwise features, at its optimum, with a ridge of
    1 / c; a constant for one class."""
    classes = _classes(pairs, "label")
    if len(classes) < 2:
        return float(classes[0]) if classes else 0.0
    numbers = F.array(*[F.lit(i) for i in range(len(PAIR_FEATURES))])
    return newton.logistic(pairs.select("label", numbers.alias("i"), F.array(*PAIR_FEATURES).alias("x")), len(PAIR_FEATURES), 1.0 / c, steps)


def bilinear_weights(candidates: DataFrame, label: str, dimension: int = V.DIMENSION, steps: int = newton.MOST_STEPS) -> DataFrame:
    """(bucket, weight): absolute logistic coefficients, at their optimum, on products of query and document vectors; all
    ones for one class."""
    spark = candidates.sparkSession
    if len(_classes(candidates, label)) < 2:
        return spark.range(dimension).select(F.col("id").cast("int").alias("bucket"), F.lit(1.0).alias("weight"))
    q = V.embed(candidates.select("query_id", "query").distinct(), "query_id", "query", dimension)
    d = V.embed(candidates.select("doc_id", "doc").distinct(), "doc_id", "doc", dimension).withColumnRenamed("w", "v")
    products = candidates.select("query_id", "doc_id").join(q, "query_id").join(d, ["doc_id", "bucket"]).groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list(F.struct("bucket", (F.col("w") * F.col("v")).alias("x")))).alias("m"))
    rows = candidates.join(products, ["query_id", "doc_id"], "left").withColumn("m", F.coalesce("m", F.array().cast(products.schema["m"].dataType)))
    weights, _ = newton.logistic(rows.select(F.col(label).cast("double").alias("label"), F.col("m.bucket").alias("i"), F.col("m.x").alias("x")), dimension, 1.0, steps)
    return spark.createDataFrame([(i, abs(w)) for i, w in enumerate(weights)], "bucket int, weight double")


def listwise_weights(rows: DataFrame, label: str, names: list[str] = HYBRID_FEATURES, loss: str = "listwise", steps: int = 30, rate: float = 0.5) -> dict[str, float]:
    """Weights of a linear scorer, by gradient ascent over whole lists: listwise raises the likelihood of the order by
    label (equal labels: by pos), lambdaloss weighs each pair's logistic loss by what its exchange changes in NDCG.
    rows(query_id, pos, label and features); each step is one aggregation, only sums come to the driver. Features are
    scaled to a deviation of one; a constant feature and rows without a list of two get no weight."""
    from ..session import stage

    if loss not in ("listwise", "lambdaloss"):
        raise ValueError(f"unknown loss: {loss}")
    rows = rows.fillna(0.0, names).withColumn("__y", F.col(label).cast("double"))
    spread = rows.agg(*[F.coalesce(F.stddev_pop(n), F.lit(0.0)).alias(n) for n in names]).first()
    scale = {n: 1.0 / spread[n] if spread[n] > 1e-12 else 0.0 for n in names}
    xs = [f"x{i}" for i in range(len(names))]
    data = stage(rows.select("query_id", "pos", "__y", *[(F.col(n) * scale[n]).alias(x) for n, x in zip(names, xs, strict=True)]), "lists", "query_id")
    lists = max(data.agg(F.count_distinct("query_id")).first()[0], 1)
    weights = [0.0] * len(names)
    for _ in range(steps):
        scored = data.withColumn("__s", sum((F.lit(w) * F.col(x) for w, x in zip(weights, xs, strict=True)), F.lit(0.0)))
        pulled = _likelihood_pull(scored) if loss == "listwise" else _exchange_pull(scored, xs)
        sums = pulled.agg(*[F.coalesce(F.sum(F.col("__g") * F.col(x)), F.lit(0.0)).alias(x) for x in xs]).first()
        weights = [w + rate * sums[x] / lists for w, x in zip(weights, xs, strict=True)]
    return {n: w * scale[n] for n, w in zip(names, weights, strict=True)}


def _likelihood_pull(scored: DataFrame) -> DataFrame:
    """Adds __g: the derivative of the log-likelihood of each list's order by its row's score, per row of the list."""
    by = W.Window.partitionBy("query_id")
    order = by.orderBy(F.desc("__y"), "pos")
    rows = scored.withColumn("__e", F.exp(F.col("__s") - F.max("__s").over(by))).withColumn("__n", F.count("*").over(by))
    rows = rows.withColumn("__z", F.sum("__e").over(order.rowsBetween(0, W.Window.unboundedFollowing)))
    passed = F.sum(1.0 / F.col("__z")).over(order.rowsBetween(W.Window.unboundedPreceding, 0))
    return rows.withColumn("__g", (1.0 - F.col("__e") * passed) / F.col("__n"))


def _exchange_pull(scored: DataFrame, xs: list[str]) -> DataFrame:
    """Pairs with different labels: __g, how far the better is to be pulled up, and the differences of features."""
    by = W.Window.partitionBy("query_id")
    place = lambda c: F.row_number().over(by.orderBy(F.desc(F.round(c, 9)), "pos"))
    rows = scored.withColumns({"__r": place("__s"), "__b": place("__y"), "__v": F.pow(F.lit(2.0), "__y") - 1}).withColumn("__d", 1.0 / F.log2(F.col("__r") + 1.0))
    rows = rows.withColumn("__i", F.sum(F.col("__v") / F.log2(F.col("__b") + 1.0)).over(by))
    b = rows.select("query_id", F.col("__y").alias("__yb"), F.col("__s").alias("__sb"), F.col("__v").alias("__vb"), F.col("__d").alias("__db"), *[F.col(x).alias(f"{x}_b") for x in xs])
    pairs = rows.join(b, "query_id").filter("__y > __yb")
    change = (F.col("__v") - F.col("__vb")) * F.abs(F.col("__d") - F.col("__db")) / F.col("__i")
    return pairs.select((change / (1.0 + F.exp(F.col("__s") - F.col("__sb")))).alias("__g"), *[(F.col(x) - F.col(f"{x}_b")).alias(x) for x in xs])


class Router:
    """Sends a query to a weight profile by its shape; unfitted it takes the balanced one."""

    def __init__(self) -> None:
        self.model = None

    def fit(self, queries: DataFrame, category: str = "category", min_leaf: int = 5) -> Router:
        """queries with the router features and a category; with one category the router stays unfitted."""
        self.model = None
        if len(_classes(queries, category)) > 1:
            data = _assembled(queries.withColumn("label", F.col(category).cast("double")), ROUTER_FEATURES)
            self.model = DecisionTreeClassifier(featuresCol="__x", labelCol="label", maxDepth=2, minInstancesPerNode=min_leaf, seed=42).fit(data)
        return self

    def predict(self, queries: DataFrame) -> DataFrame:
        """(query_id, category, probability array)."""
        if self.model is None:
            return queries.select("query_id", F.lit(0).alias("category"), F.array(*[F.lit(1 / 3)] * 3).alias("probability"))
        out = self.model.transform(_assembled(queries, ROUTER_FEATURES))
        return out.select("query_id", F.col("prediction").cast("int").alias("category"), vector_to_array("probability").alias("probability"))

    def weights(self, queries: DataFrame) -> DataFrame:
        """(query_id, weight of each feature)."""
        category: Column = F.col("category") if self.model is not None else F.lit(2)
        return self.predict(queries).select("query_id", *[w.alias(n) for n, w in profile_weights(category).items()])


def hybrid_scorer(candidates: DataFrame, label: str, **options) -> Scorer:
    """A pointwise scorer fitted on judged candidates."""
    return pointwise_hybrid(features(candidates), label, **options)
