"""Synthetic training records, from seed relations, in hash order where an order is free."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..session import few
from .mining import numbered

SEED = 42

#: Subjects of generated contradictions, with a field and two values.
SUBJECTS = [
    ("Model2Vec Potion-8M", "latency_ms", "2", "7"),
    ("Fusion Ranker", "best_metric", "NDCG@10", "MRR"),
    ("Project Atlas", "release_year", "2025", "2026"),
    ("Northwind Clinic", "screening_status", "approved", "pending"),
    ("Potion-32M Embedder", "embedding_dim", "256", "512"),
    ("BM25 Engine", "k1_parameter", "1.2", "2.0"),
    ("Kubernetes Cluster", "max_pods_per_node", "110", "250"),
    ("Type 1 Diabetes", "onset_age", "childhood", "adulthood"),
    ("OAuth2 Flow", "token_expiry", "3600", "7200"),
    ("Bloom Taxonomy", "total_levels", "5", "6"),
    ("Spark DAG Optimizer", "stage_count", "3", "7"),
    ("Fair Use Doctrine", "max_quotation_words", "100", "400"),
    ("Star Schema", "fact_table_count", "1", "3"),
    ("Bayes Classifier", "independence_assumption", "strict", "relaxed"),
    ("React useEffect", "cleanup_timing", "before_unmount", "after_unmount"),
]
SUFFIXES = ["This note adds practical detail.", "This explanation stays high level.", "This example is intentionally compact.", "This statement includes a nearby concept."]
LIST_SCORES = [0.4, 0.3, 0.2, 0.1]

#: Record schemas as DDL, and the checks that a record must pass.
SCHEMAS = {
    "pairs": "query string, doc string, score int, rationale string, generation_seed int, generation_mode string, teacher_model string",
    "preferences": "query string, doc_a string, doc_b string, preferred string, confidence double, generation_seed int, generation_mode string, teacher_model string",
    "contradictions": "subject string, doc_a string, doc_b string, contradicted_field string, value_a string, value_b string, is_contradiction boolean, generation_seed int, generation_mode string, teacher_model string",
    "listwise_preferences": "query string, docs array<string>, scores array<double>, generation_seed int, generation_mode string, teacher_model string",
    "hard_negatives": "query string, positive string, hard_negative string, easy_negative string, generation_seed int, generation_mode string, teacher_model string",
    "query_expansions": "original_query string, expanded_queries array<string>, generation_seed int, generation_mode string, teacher_model string",
}
CHECKS = {
    "pairs": "query IS NOT NULL AND doc IS NOT NULL AND rationale IS NOT NULL AND score BETWEEN 0 AND 3 AND generation_mode IN ('offline', 'teacher')",
    "preferences": "query IS NOT NULL AND doc_a IS NOT NULL AND doc_b IS NOT NULL AND preferred IN ('A', 'B') AND confidence BETWEEN 0 AND 1 AND generation_mode IN ('offline', 'teacher')",
    "contradictions": "subject IS NOT NULL AND doc_a IS NOT NULL AND doc_b IS NOT NULL AND value_a IS NOT NULL AND value_b IS NOT NULL AND is_contradiction IS NOT NULL AND generation_mode IN ('offline', 'teacher')",
    "listwise_preferences": "query IS NOT NULL AND size(docs) = size(scores) AND generation_mode IN ('offline', 'teacher')",
    "hard_negatives": "query IS NOT NULL AND positive IS NOT NULL AND hard_negative IS NOT NULL AND easy_negative IS NOT NULL AND generation_mode IN ('offline', 'teacher')",
    "query_expansions": "original_query IS NOT NULL AND expanded_queries IS NOT NULL AND generation_mode IN ('offline', 'teacher')",
}


def validate(records: DataFrame, kind: str) -> DataFrame:
    """Adds valid: whether the record passes its kind's checks."""
    return records.withColumn("valid", F.coalesce(F.expr(CHECKS[kind]), F.lit(False)))


def _offline(seed: int) -> list[Column]:
    return [F.lit(seed).alias("generation_seed"), F.lit("offline").alias("generation_mode"), F.lit(None).cast("string").alias("teacher_model")]


def _hash(seed: int, *parts: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256), 1, 12), 16, 10).cast("bigint")


def pairs(seeds: DataFrame, target: int, seed: int = SEED) -> DataFrame:
    """seeds(seed_id, query, positive, negative): each seed's positive with 3 and negative with 0, then suffixed
    variants with scores in turn, target records in all."""
    n = seeds.count()
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("seed_id").cast("string")), 256)
    ordered = seeds.join(numbered(seeds.select(F.col("seed_id").alias("doc_id"), order.alias("h"))).withColumnRenamed("doc_id", "seed_id"), "seed_id")
    plain = ordered.select("query", F.explode(F.array(F.struct(F.col("positive").alias("doc"), F.lit(3).alias("score"), F.lit("Directly addresses the query with the relevant concept.").alias("rationale"), (2 * F.col("i")).alias("idx")), F.struct(F.col("negative").alias("doc"), F.lit(0).alias("score"), F.lit("Discusses a different topic from the query.").alias("rationale"), (2 * F.col("i") + 1).alias("idx")))).alias("r")).select("query", "r.*")
    more = seeds.sparkSession.range(2 * n, max(target, 2 * n)).select(F.col("id").alias("idx")).withColumns({"i": F.pmod(_hash(seed, F.lit("seed"), F.col("idx")), F.lit(max(n, 1))).cast("int"), "score": (F.col("idx") % 4).cast("int")})
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.pmod(_hash(seed, F.lit("suffix"), F.col("idx")), F.lit(len(SUFFIXES))) + 1).cast("int"))
    varied = more.join(ordered, "i").select("query", F.concat_ws(" ", F.when(F.col("score") >= 2, F.col("positive")).otherwise(F.col("negative")), suffix).alias("doc"), "score", F.lit("Offline synthetic label generated from seeded examples.").alias("rationale"), F.col("idx").cast("int").alias("idx"))
    return plain.unionByName(varied).filter(F.col("idx") < target).select("idx", "query", "doc", "score", "rationale", *_offline(seed))


def best_and_worst(examples: DataFrame, seed: int = SEED) -> DataFrame:
    """examples(query_id, query, doc, score, pos): the last of the best against the first of the worst of each query
    with two or more, with confidence 0.95."""
    per = examples.groupBy("query_id", "query").agg(F.max_by("doc", F.struct("score", "pos")).alias("doc_a"), F.min_by("doc", F.struct("score", "pos")).alias("doc_b"), F.count("*").alias("n")).filter("n >= 2")
    return per.select("query_id", "query", "doc_a", "doc_b", F.lit("A").alias("preferred"), F.lit(0.95).alias("confidence"), *_offline(seed))


def random_preferences(examples: DataFrame, per_query: int = 1, seed: int = SEED) -> DataFrame:
    """per_query hash-chosen pairs of each query's examples; the better (or first) one is preferred, with confidence
    0.55 and 0.15 more for each step of score."""
    order = F.row_number().over(W.Window.partitionBy("query_id").orderBy(_hash(seed, F.col("query_id"), F.col("pos"))))
    rows = examples.withColumn("k", order)
    a, b = rows.filter(F.col("k") % 2 == 1), rows.filter(F.col("k") % 2 == 0)
    both = a.select("query_id", "query", F.col("doc").alias("doc_a"), F.col("score").alias("sa"), ((F.col("k") + 1) / 2).cast("int").alias("pair")).join(b.select("query_id", F.col("doc").alias("doc_b"), F.col("score").alias("sb"), (F.col("k") / 2).cast("int").alias("pair")), ["query_id", "pair"]).filter(F.col("pair") <= per_query)
    confidence = F.round(F.least(F.lit(1.0), F.lit(0.55) + F.abs(F.col("sa") - F.col("sb")) * 0.15), 2)
    return both.select("query_id", "pair", "query", "doc_a", "doc_b", F.when(F.col("sa") >= F.col("sb"), "A").otherwise("B").alias("preferred"), confidence.alias("confidence"), *_offline(seed))


def swap(preferences: DataFrame, swapped: Column) -> DataFrame:
    """Documents exchanged and the label turned where swapped holds."""
    return preferences.withColumns({"doc_a": F.when(swapped, F.col("doc_b")).otherwise(F.col("doc_a")), "doc_b": F.when(swapped, F.col("doc_a")).otherwise(F.col("doc_b")), "preferred": F.when(swapped, F.when(F.col("preferred") == "A", "B").otherwise("A")).otherwise(F.col("preferred"))})


def contradictions(spark: SparkSession, count: int, controls: int, seed: int = SEED) -> DataFrame:
    """count contradicting and then controls agreeing record pairs, over the subjects in turn."""
    subjects = spark.createDataFrame([(i, *s) for i, s in enumerate(SUBJECTS)], "i int, subject string, field string, a string, b string")
    rows = spark.range(count + controls).withColumn("is_contradiction", F.col("id") < count)
    rows = rows.withColumn("i", (F.when(F.col("is_contradiction"), F.col("id")).otherwise(F.col("id") - count) % len(SUBJECTS)).cast("int")).join(F.broadcast(subjects), "i")
    bad = F.col("is_contradiction")
    value_b = F.when(bad, F.col("b")).otherwise(F.col("a"))
    doc_a = F.when(bad, F.format_string("%s reports %s as %s. The rest of the setup is unchanged.", "subject", "field", "a")).otherwise(F.format_string("%s lists %s as %s. Supporting context is similar.", "subject", "field", "a"))
    doc_b = F.when(bad, F.format_string("%s reports %s as %s. The rest of the setup is unchanged.", "subject", "field", "b")).otherwise(F.format_string("%s again lists %s as %s. Supporting context is similar.", "subject", "field", "a"))
    return rows.select(F.col("id").alias("idx"), "subject", doc_a.alias("doc_a"), doc_b.alias("doc_b"), F.col("field").alias("contradicted_field"), F.col("a").alias("value_a"), value_b.alias("value_b"), "is_contradiction", *_offline(seed))


def expanded_contradictions(templates: DataFrame, controls: DataFrame, count: int = 1000, control_count: int = 400, seed: int = SEED) -> DataFrame:
    """templates(subject, field, value_a, value_b) and controls(subject, field, value), each copied so that all of a
    kind make about as many records as asked for (one each at least); count + control_count of them in a hash order."""

    def copies(rows: DataFrame, total: int) -> DataFrame:
        each = rows.count()
        return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(max(1, total // max(each, 1))))))

    s, f = F.col("subject"), F.col("field")
    a = copies(templates, count).select("subject", F.format_string("%s states %s is %s.", s, f, "value_a").alias("doc_a"), F.format_string("%s specifies %s as %s.", s, f, "value_b").alias("doc_b"), f.alias("contradicted_field"), "value_a", "value_b", F.lit(True).alias("is_contradiction"), "copy")
    b = copies(controls, control_count).select("subject", F.format_string("%s confirms %s %s.", s, f, "value").alias("doc_a"), F.format_string("%s states %s %s.", s, f, "value").alias("doc_b"), f.alias("contradicted_field"), F.col("value").alias("value_a"), F.col("value").alias("value_b"), F.lit(False).alias("is_contradiction"), "copy")
    key = F.concat_ws(":", F.lit(str(seed)), "subject", "contradicted_field", "is_contradiction", "copy")
    rows = a.unionByName(b).withColumn("__h", F.sha2(key, 256)).orderBy("__h", "value_a", "value_b").limit(count + control_count)
    return rows.drop("__h", "copy")


def stabilize(records: DataFrame) -> DataFrame:
    """records(subject, field_name, value_a, value_b, is_contradiction, doc_a, doc_b, said_b): documents that don't
    state their values as they should are written anew."""
    bad = F.col("is_contradiction")
    clean = lambda c: F.lower(F.trim(c))
    want_b = F.when(bad, F.col("value_b")).otherwise(F.col("value_a"))
    label = F.replace(F.col("field_name"), F.lit("_"), F.lit(" "))
    holds = lambda d, v: F.contains(F.lower(d), clean(v))
    a, b = F.col("doc_a"), F.col("doc_b")
    wrong = F.when(bad, (clean("value_a") == clean("value_b")) | ~holds(a, F.col("value_a")) | ~holds(b, F.col("value_b"))).otherwise((clean("value_a") != clean(F.coalesce("said_b", "value_a"))) | ~holds(a, F.col("value_a")) | ~holds(b, F.col("value_a")))
    said = lambda verb, v: F.concat(F.col("subject"), F.lit(f" {verb} "), label, F.lit(" as "), v, F.lit(". Supporting context remains stable."))
    new_b = F.when(bad, said("reports", F.col("value_b"))).otherwise(said("again reports", F.col("value_a")))
    return records.withColumns({"doc_a": F.when(wrong, said("reports", F.col("value_a"))).otherwise(a), "doc_b": F.when(wrong, new_b).otherwise(b), "value_b": want_b})


def hard_negatives(examples: DataFrame, pools: DataFrame, easy: list[str], default: str, seed: int = SEED) -> DataFrame:
    """examples(idx, query, positive, domain) with the hard negative at idx of their domain's pool(domain, place, text)
    and the easy one at idx of the list; a domain without a pool takes the default's."""
    sizes = few(pools.groupBy("domain").agg(F.count("*").alias("size")))
    rows = examples.join(sizes, "domain", "left")
    rows = rows.withColumn("domain", F.when(F.col("size").isNull(), F.lit(default)).otherwise(F.col("domain"))).drop("size").join(sizes, "domain")
    rows = rows.withColumn("place", F.pmod("idx", "size")).join(pools.withColumnRenamed("text", "hard_negative"), ["domain", "place"])
    easy_one = F.element_at(F.array(*map(F.lit, easy)), (F.pmod(F.col("idx"), F.lit(len(easy))) + 1).cast("int"))
    return rows.select("idx", "query", "positive", "hard_negative", easy_one.alias("easy_negative"), *_offline(seed))


def listwise(examples: DataFrame, seed: int = SEED) -> DataFrame:
    """The four best documents of each query with three or more, with fixed list scores."""
    by = W.Window.partitionBy("query_id")
    rows = examples.withColumn("n", F.count("*").over(by)).withColumn("k", F.row_number().over(by.orderBy(F.desc("score"), "pos"))).filter("n >= 3 AND k <= 4")
    lists = rows.groupBy("query_id", "query").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "doc"))), lambda x: x["doc"]).alias("docs"))
    return lists.select("query_id", "query", "docs", F.slice(F.array(*map(F.lit, LIST_SCORES)), F.lit(1), F.size("docs")).alias("scores"), *_offline(seed))


def expansions(queries: DataFrame, seed: int = SEED) -> DataFrame:
    """Three rewordings of each distinct query."""
    q = F.col("query")
    return queries.select("query").distinct().select(q.alias("original_query"), F.array(F.concat(F.lit("how to "), q), F.concat(q, F.lit(" best practices")), F.concat(q, F.lit(" example"))).alias("expanded_queries"), *_offline(seed))


def expanded_pairs(topics: DataFrame, cross: DataFrame) -> DataFrame:
    """topics(topic_id, domain, query, d0, d1, d2, d3) and cross(topic_id, other_id): a topic's own documents by score;
    its domain's other topics' d2 as 2, d1 as 1 and d0 as 0, with its own d3 again for each; and other domains' d0."""
    own = topics.select("topic_id", "domain", "query", F.explode(F.array(*[F.struct(F.col(f"d{i}").alias("doc"), F.lit(i).alias("score")) for i in range(4)])).alias("e")).select("topic_id", "domain", "query", "e.*")
    others = topics.select("domain", F.col("topic_id").alias("other"), *[F.col(f"d{i}").alias(f"o{i}") for i in range(3)])
    near = topics.join(others, "domain").filter("topic_id <> other")
    near = near.select("topic_id", "domain", "query", F.explode(F.array(F.struct(F.col("o1").alias("doc"), F.lit(1).alias("score")), F.struct(F.col("o0").alias("doc"), F.lit(0).alias("score")), F.struct(F.col("o2").alias("doc"), F.lit(2).alias("score")), F.struct(F.col("d3").alias("doc"), F.lit(3).alias("score")))).alias("e")).select("topic_id", "domain", "query", "e.*")
    far = topics.join(cross, "topic_id").join(topics.select(F.col("topic_id").alias("other_id"), F.col("d0").alias("doc")), "other_id").select("topic_id", "domain", "query", "doc", F.lit(0).alias("score"))
    return own.unionByName(near).unionByName(far)


def expanded_preferences(topics: DataFrame, seed: int = SEED) -> DataFrame:
    """All pairs of a topic's documents, the higher preferred with confidence by distance; each pair's sides in hash order."""
    graded = topics.select("topic_id", "domain", "query", F.explode(F.array(*[F.struct(F.lit(i).alias("score"), F.col(f"d{i}").alias("doc")) for i in range(4)])).alias("e")).select("topic_id", "domain", "query", "e.*")
    low = graded.select("topic_id", F.col("score").alias("low"), F.col("doc").alias("doc_b"))
    rows = graded.withColumnsRenamed({"score": "high", "doc": "doc_a"}).join(low, "topic_id").filter("low < high")
    rows = rows.withColumns({"preferred": F.lit("A"), "confidence": F.round((F.col("high") - F.col("low")) / 3.0, 2)})
    return swap(rows, F.pmod(_hash(seed, F.col("topic_id"), F.col("low"), F.col("high")), F.lit(2)) == 1)


def distribution(records: DataFrame, label: str) -> DataFrame:
    """label, count, proportion, and the whole's imbalance ratio and whether it is at most 3."""
    counts = records.groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("count"))
    whole = counts.agg(F.sum("count").alias("total"), F.round(F.max("count") / F.greatest(F.min("count"), F.lit(1)), 4).alias("imbalance_ratio"))
    rows = counts.crossJoin(F.broadcast(whole))
    return rows.select("label", "count", F.round(F.col("count") / F.greatest("total", F.lit(1)), 4).alias("proportion"), "imbalance_ratio", (F.col("imbalance_ratio") <= 3.0).alias("is_balanced_enough"))


def bars(report: DataFrame, width: int = 40) -> DataFrame:
    """A text bar for each label, by its proportion."""
    return report.select("label", "count", F.repeat(F.lit("#"), F.round(F.col("proportion") * width).cast("int")).alias("bar"))


def cost_summary(costs: DataFrame, judgments: int, dataset: str = "preferences", per_judgment: float = 0.002, monthly_queries: int = 100_000) -> DataFrame:
    """costs(dataset, cost_usd): the logged cost of a dataset, or an estimate if nothing is logged; per judgment and per
    month."""
    one = costs.filter(F.col("dataset") == dataset).agg(F.count("*").alias("n"), F.sum("cost_usd").alias("logged"))
    total = F.when(F.col("n") > 0, F.col("logged")).otherwise(F.lit(max(judgments, 1) * per_judgment))
    rows = one.select(F.when(F.col("n") > 0, "logged_api_costs").otherwise("configured_estimate").alias("source"), total.alias("cost_usd"))
    return rows.withColumn("cost_per_judgment_usd", F.col("cost_usd") / max(judgments, 1)).withColumn("monthly_cost_usd", F.col("cost_per_judgment_usd") * monthly_queries)
