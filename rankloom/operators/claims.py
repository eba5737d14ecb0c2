"""Claims: extraction of (entity, attribute, value) from text, normalisation, and joins that find contradictions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..functions import vectors as V
from ..functions.text import OUTER, normalize_space, sentences
from ..session import stage
from . import claim_patterns as P
from .bm25 import rank

TOLERANCE = 0.01
SIMILARITY = 0.95
#: Claims of one vector that lie in one row when pairs are listed, and that a task takes on each side; pairs tried by a task.
BLOCK, CHUNK, TASK_PAIRS = 64, 16_384, 100_000_000


def normalize_entity(value: Column) -> Column:
    """Without outer marks, leading narrative phrases, and trailing verbs."""
    c = normalize_space(F.btrim(value, F.lit(OUTER)))
    prefixes = "|".join(P.NARRATIVE_PREFIXES)
    c = F.regexp_replace(c, rf"(?i)^(?:(?:{prefixes})\s+)+", "")
    c = F.regexp_replace(c, r"(?i)\s+(?:is|has|was|will|again)\b.*$", "")
    return F.regexp_replace(c, r"(?i)\s+actually$", "")


def normalize_attribute(value: Column) -> Column:
    """Lower case, words joined by _, without articles and degrees; any latency is latency, release is release_year."""
    c = F.regexp_replace(F.lower(normalize_space(F.btrim(value, F.lit(OUTER)))), r"[\s\-]+", "_")
    for lead in ("a|an|the", "actual", "low|high", "recent_tests_show_that|latest_results_indicate_that|latest_tests_indicate_that", "the"):
        c = F.regexp_replace(c, f"^(?:{lead})_", "")
    return F.when(F.contains(c, F.lit("latency")), F.lit("latency")).when(c == "release", F.lit("release_year")).otherwise(F.btrim(c, F.lit("_")))


def normalize_value(value: Column) -> Column:
    """Without reporting verbs, hedges and trailing clauses."""
    c = normalize_space(F.btrim(value, F.lit(OUTER)))
    for pattern in (r"(?i)^(?:reported|confirmed|measured|recorded)\s+(?:to\s+be|as|at)\s+", r"(?i)^(?:only|just|actual(?:ly)?|approximately|around)\s+", r"(?i)^(?:an?|the)\s+impressive\s+", r"(?i)^now\s+", r"(?i)\s+(?:in|during|which|making|ensuring|indicating)\b.*$"):
        c = F.regexp_replace(c, pattern, "")
    return c


def canonical_value(value: Column) -> Column:
    """A synonym, or the value without units that stand as words of their own."""
    raw = F.lower(F.trim(value))
    words = "|".join(u for u in P.UNITS if u != "%")
    stripped = F.regexp_replace(raw, rf"\b(?:{words})\b|(?<=\w)%(?=\w)", "")
    synonyms = F.create_map(*[F.lit(x) for pair in P.SYNONYMS.items() for x in pair])
    return F.coalesce(synonyms[raw], F.trim(stripped))


def facets(value: Column) -> Column:
    """What values_conflict compares of a value: itself as a number, its canonical form, and that as a number."""
    canonical = canonical_value(value)
    return F.struct(value.try_cast("double").alias("number"), canonical.alias("canonical"), canonical.try_cast("double").alias("canonical_number"))


def facets_conflict(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """Numbers conflict beyond the tolerance; else their canonical forms, as numbers or as strings."""
    def apart(name: str) -> Column:
        x, y = a[name], b[name]
        return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) > tolerance)

    same = a["canonical"] == b["canonical"]
    return F.coalesce(apart("number"), F.when(same, F.lit(False)), apart("canonical_number"), ~same)


def values_conflict(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    return facets_conflict(facets(a), facets(b), tolerance)


def finished_claims(matches: DataFrame) -> DataFrame:
    """matches(doc_id, segment order columns, whole, entity, attribute, value as matched) to normalised claims; those
    without an entity, attribute or value, or with the attribute which or that, are dropped."""
    lowered = F.lower(F.col("whole"))
    implied = F.when(F.contains(lowered, F.lit("release")), "release_year").when(F.contains(lowered, F.lit("screening status")), "screening_status").when(F.contains(lowered, F.lit("best metric")), "best_metric").otherwise("")
    rows = matches.withColumns({"entity": normalize_entity(F.col("entity")), "attribute": normalize_attribute(F.coalesce("attribute", F.lit(""))), "value": normalize_value(F.col("value"))})
    rows = rows.withColumn("attribute", F.when(F.col("attribute") == "", implied).otherwise(F.col("attribute")))
    return rows.filter("entity <> '' AND attribute <> '' AND value <> '' AND attribute NOT IN ('which', 'that')")


FOUND = T.ArrayType(T.StructType([T.StructField("pattern_no", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in ("whole", "entity", "attribute", "value")]]))


def _finditer(text: str, pattern: re.Pattern, rest: tuple[re.Pattern, re.Pattern] | None) -> Iterator[re.Match]:
    """pattern.finditer(text). A lead of many words would be tried from each of its characters to the last, in time that
    grows with the square of the text; so the search begins with the run of words before a place where the rest matches."""
    if rest is None:
        yield from pattern.finditer(text)
        return
    ends, of_lead = rest
    at = 0
    while place := ends.search(text, at):
        start = place.start()
        while start > at and of_lead.match(text, start - 1):
            start -= 1
        found = pattern.search(text, start)
        if not found:
            return
        yield found
        at = found.end()


def _search(text: str, patterns: list[tuple[int, re.Pattern, tuple[int, int, int], tuple[re.Pattern, re.Pattern] | None]]) -> list[tuple]:
    """All matches of the patterns, in order. A pattern is only tried on a text that holds one of its own verbs."""
    out = []
    for i, pattern, groups, rest in patterns:
        out += [(i, m[0], *(m[g] if g else "" for g in groups)) for m in _finditer(text, pattern, rest)]
    return out


def _compiled() -> list[tuple]:
    rests = [P.rest(p) for p in P.PATTERNS]
    numbered = [P.numbered(p) for p in P.PATTERNS]
    return [(i, re.compile(text), (e, a, v), rest and tuple(map(re.compile, rest))) for i, ((text, e, a, v), rest) in enumerate(zip(numbered, rests, strict=True))]


def _segment_matches(all_patterns: bool) -> Callable[[Column], Column]:
    """Matches of a segment by the sentence patterns. Java's engine recurses on repeated groups and overflows its stack
    on long segments, so this runs in Python workers, on Arrow batches."""

    @F.pandas_udf(FOUND)
    def segment_matches(segments: pd.Series) -> pd.Series:
        patterns = _compiled()
        needs = [re.compile(n, re.IGNORECASE) for n in P.NEEDS]
        out = []
        for segment in segments:
            padded = f" {segment.lower()} "
            hinted = [i for i, hints in enumerate(P.HINTS) if any(h in padded for h in hints)]
            use = range(len(patterns)) if all_patterns or not hinted else hinted
            out.append(_search(segment, [patterns[i] for i in use if i not in P.NEVER and needs[i].search(segment)]))
        return pd.Series(out)

    return segment_matches


@F.pandas_udf(FOUND)
def _generic_matches(docs: pd.Series) -> pd.Series:
    need, pattern, rest = re.compile("reports|lists|states|shows"), re.compile(P.GENERIC), tuple(map(re.compile, P.GENERIC_REST))
    return pd.Series([_search(d, [(0, pattern, (1, 2, 3), rest)]) if need.search(d) else [] for d in docs])


def structured_claims(docs: DataFrame, all_patterns: bool = False) -> DataFrame:
    """docs(doc_id, doc) to claims(doc_id, entity, attribute, value, n) by the sentence patterns, in order, the first
    of equal ones (letter case aside) kept. Hints spare most segments most patterns; with all_patterns every pattern
    is tried on every segment."""
    segments = docs.filter("doc IS NOT NULL").select("doc_id", F.posexplode(sentences(F.col("doc"))).alias("segment_no", "segment"))
    rows = segments.select("doc_id", "segment_no", _segment_matches(all_patterns)(F.col("segment")).alias("found"))
    rows = rows.select("doc_id", "segment_no", F.posexplode("found").alias("match_no", "m")).select("doc_id", "segment_no", "match_no", "m.*")
    return _first(finished_claims(rows), "segment_no", "match_no")


def _first(claims: DataFrame, *order: str) -> DataFrame:
    same = W.Window.partitionBy("doc_id", F.lower("entity"), "attribute", F.lower("value")).orderBy(*order)
    kept = claims.withColumn("__n", F.row_number().over(same)).filter("__n = 1")
    return kept.select("doc_id", "entity", "attribute", "value", F.row_number().over(W.Window.partitionBy("doc_id").orderBy(*order)).alias("n"))


def extract_claims(docs: DataFrame) -> DataFrame:
    """Structured claims, then those of the generic pattern, and for a document without any its text as one claim."""
    first = structured_claims(docs).withColumn("source", F.lit(0))
    texts = docs.filter("doc IS NOT NULL").select("doc_id", _generic_matches(F.col("doc")).alias("found"))
    whole = texts.select("doc_id", F.posexplode("found").alias("n", "m")).select("doc_id", "n", "m.*")
    generic = finished_claims(whole).select("doc_id", "entity", "attribute", "value", "n", F.lit(1).alias("source"))
    claims = stage(_first(first.unionByName(generic), "source", "n"), "claims")
    rest = docs.join(claims.select("doc_id").distinct(), "doc_id", "left_anti")
    raw = rest.select("doc_id", F.col("doc_id").cast("string").alias("entity"), F.lit("raw_text").alias("attribute"), F.trim(F.coalesce("doc", F.lit(""))).alias("value"), F.lit(1).alias("n"))
    return claims.unionByName(raw)


def _pairs(claims: DataFrame, on: list[str]) -> DataFrame:
    a = claims.select(*on, *[F.col(c).alias(f"{c}_a") for c in ("claim_id", "doc_id", "value")])
    b = claims.select(*on, *[F.col(c).alias(f"{c}_b") for c in ("claim_id", "doc_id", "value")])
    return a.join(b, on).filter("claim_id_a < claim_id_b AND doc_id_a <> doc_id_b")


def contradictions(claims: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """claims(claim_id, doc_id, entity, attribute, value): pairs of different documents that give one entity's
    attribute conflicting values. An equi-join on entity and attribute."""
    rows = claims.filter("attribute <> 'raw_text'").withColumn("entity_key", F.lower(F.trim("entity")))
    return _pairs(rows, ["entity_key", "attribute"]).filter(values_conflict(F.col("value_a"), F.col("value_b"), tolerance))


def similar_attributes(claims: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(attribute, other): distinct attributes of one entity whose embeddings' cosine distance is at most 1 - similarity;
    an attribute without a vector is near to all."""
    rows = claims.filter("attribute <> 'raw_text'").select(F.lower(F.trim("entity")).alias("entity_key"), "attribute").distinct()
    pairs = rows.join(rows.withColumnRenamed("attribute", "other"), "entity_key").filter("attribute < other").select("attribute", "other").distinct()
    names = rows.select("attribute").distinct()
    vectors = V.embed(names.withColumn("text", F.col("attribute")), "attribute", "text")
    near = V.dot(pairs, vectors, "attribute", vectors.withColumnRenamed("attribute", "other"), "other")
    some = vectors.select("attribute").distinct()
    near = near.join(some.withColumn("has_a", F.lit(True)), "attribute", "left").join(some.select(F.col("attribute").alias("other"), F.lit(True).alias("has_b")), "other", "left")
    aligned = (F.round(F.col("dot"), 9) >= similarity) | F.col("has_a").isNull() | F.col("has_b").isNull()
    return near.filter(aligned).select("attribute", "other")


def fuzzy_contradictions(claims: DataFrame, similarity: float = SIMILARITY, tolerance: float = TOLERANCE) -> DataFrame:
    """As contradictions, across an entity's similar attributes: the attribute pairs are found first, then joined back."""
    rows = claims.filter("attribute <> 'raw_text'").withColumn("entity_key", F.lower(F.trim("entity")))
    a = rows.select("entity_key", "attribute", *[F.col(c).alias(f"{c}_a") for c in ("claim_id", "doc_id", "value")])
    b = rows.select("entity_key", F.col("attribute").alias("other"), *[F.col(c).alias(f"{c}_b") for c in ("claim_id", "doc_id", "value")])
    both = a.join(similar_attributes(claims, similarity), "attribute").join(b, ["entity_key", "other"]).filter("doc_id_a <> doc_id_b")
    return both.filter(values_conflict(F.col("value_a"), F.col("value_b"), tolerance))


def label_vectors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(label, vector) of rows(label), and (vector, bucket, w): labels with the same token counts have one vector, named by the
    least of them. A label without a vector is in neither."""
    labels = rows.select("label").distinct().withColumn("text", F.col("label"))
    counts = V.embed(labels, "label", "text", normalize=False)
    whole = stage(counts.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("bucket", "w"))).alias("v")), "label-vectors")
    named = stage(whole.groupBy("v").agg(F.min("label").alias("vector")), "vectors")
    return stage(whole.join(named, "v").select("label", "vector"), "vectors-of-labels"), V.unit(named.select("vector", F.explode("v").alias("x")).select("vector", "x.*"), "vector")


def aligned_vectors(v: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(vector, other): pairs of unit vectors(vector, bucket, w) with this cosine, each both ways and with itself. Found by
    a join on shared buckets."""
    v = stage(v, "unit-vectors")
    # Without its most common buckets, of less than similarity in length, a unit vector still shares a bucket with any
    # vector that it aligns with; so only the rest of one side is joined.
    common = W.Window.partitionBy("vector").orderBy(F.desc("n"), "bucket").rowsBetween(W.Window.unboundedPreceding, 0)
    counted = v.join(v.groupBy("bucket").agg(F.count("*").alias("n")), "bucket")
    rare = counted.withColumn("norm", F.sum(F.col("w") * F.col("w")).over(common)).filter(F.col("norm") >= similarity * similarity - 1e-9)
    whole = v.groupBy("vector").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "w"))).alias("m"))
    tried = rare.select("vector", "bucket").join(v.select(F.col("vector").alias("other"), "bucket"), "bucket").filter("vector <= other").select("vector", "other").distinct()
    both = tried.join(whole, "vector").join(whole.withColumnsRenamed({"vector": "other", "m": "o"}), "other")
    product = F.aggregate(F.map_keys("m"), F.lit(0.0), lambda s, k: s + F.col("m")[k] * F.coalesce(F.col("o")[k], F.lit(0.0)))
    near = both.filter(F.round(product, 9) >= similarity).select("vector", "other")
    return stage(near.unionByName(near.filter("vector < other").select(F.col("other").alias("vector"), F.col("vector").alias("other"))), "aligned-vectors")


def _blocks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows(vector, columns), claim_id the first of them, as (vector, chunk, n, lo, hi, claims): up to BLOCK claims of one
    vector in a row and CHUNK of them in a chunk, both of consecutive claim_ids from lo to hi, however many a vector has."""
    placed = rows.repartitionByRange("vector", "claim_id").sortWithinPartitions("vector", *columns).withColumn("place", F.monotonically_increasing_id())
    placed = placed.withColumns({"chunk": F.floor(F.col("place") / CHUNK), "block": F.floor(F.col("place") / BLOCK)})
    met = placed.groupBy("vector", "chunk", "block").agg(F.count("*").alias("n"), F.min("claim_id").alias("lo"), F.max("claim_id").alias("hi"), F.collect_list(F.struct(*columns)).alias("claims"))
    return stage(met.drop("block"), "claim-blocks")


def raw_contradictions(claims: DataFrame, similarity: float = SIMILARITY, tolerance: float = TOLERANCE, carry: tuple[str, ...] = ("label", "claim_id", "doc_id", "value")) -> DataFrame:
    """Pairs of raw-text claims of different documents with aligned "entity attribute" texts and conflicting values; of each
    claim these columns (the other's label is other). Claims meet by the vectors of their texts, of which there are far
    fewer than texts.

    All pairs are given, so rows grow with the square of the claims, and they are most of what is written. So a task gets
    two chunks of claims, whatever a vector's share of them, and lists pairs by blocks: each claim of one block with all
    of the other. In this order a column repeats one value, the other one a short sequence, which Parquet stores in a
    fraction of the bytes of longer ones."""
    rows = claims.filter("attribute = 'raw_text' AND claim_id IS NOT NULL AND doc_id IS NOT NULL AND value IS NOT NULL").withColumn("label", F.concat_ws(" ", "entity", "attribute"))
    names, vectors = label_vectors(rows)
    columns = list(dict.fromkeys(["claim_id", "doc_id", "facets", *carry]))
    blocks = _blocks(rows.join(names, "label").withColumn("facets", facets(F.col("value"))), columns)
    first = {"vector": "vector", "chunk": "chunk", "n": "n", "lo": "lo", "claims": "__a"}
    second = {"vector": "other_vector", "chunk": "other_chunk", "n": "other_n", "hi": "hi", "claims": "__b"}
    side = lambda of: blocks.select(*[F.col(c).alias(name) for c, name in of.items()])
    a, b = side(first), side(second)
    aligned = aligned_vectors(vectors, similarity).withColumnRenamed("other", "other_vector")
    one, two = a.groupBy("vector", "chunk").agg(F.sum("n").alias("n"), F.min("lo").alias("lo")), b.groupBy("other_vector", "other_chunk").agg(F.sum("other_n").alias("other_n"), F.max("hi").alias("hi"))
    tasks = stage(one.join(aligned, "vector").join(two, "other_vector").filter("lo < hi"), "chunk-pairs")
    tried = tasks.agg(F.sum(F.col("n").cast("double") * F.col("other_n"))).first()[0] or 0
    n = max(int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(tried / TASK_PAIRS) + 1)
    keys = ["vector", "chunk", "other_vector", "other_chunk"]
    a = a.drop("n").join(tasks.select(*keys), ["vector", "chunk"]).repartition(n, *keys)
    b = b.drop("other_n").join(tasks.select(*keys), ["other_vector", "other_chunk"]).repartition(n, *keys)
    # the left side's rows come one by one, each with all blocks of the right side: a block of b stays while those of a change
    met = b.hint("merge").join(a, keys).filter("lo < hi").select("__b", F.filter("__a", lambda x: x["claim_id"] < F.col("hi")).alias("__a"))
    each = met.select("__b", F.inline("__a")).withColumnsRenamed({c: f"{c}_a" for c in columns})
    both = each.select(*[f"{c}_a" for c in columns], F.inline("__b")).withColumnsRenamed({c: f"{c}_b" for c in columns}).filter("claim_id_a < claim_id_b AND doc_id_a <> doc_id_b")
    found = both.filter(facets_conflict(F.col("facets_a"), F.col("facets_b"), tolerance))
    return found.select(*[f"{c}_{s}" for s in "ab" for c in carry]).withColumnsRenamed({"label_a": "label", "label_b": "other"})


def check(claims: DataFrame) -> DataFrame:
    """(claim_id_a, claim_id_b, reason) of all contradictions."""
    same = contradictions(claims).unionByName(fuzzy_contradictions(claims), allowMissingColumns=True)
    one = same.select("claim_id_a", "claim_id_b", F.lit("Structured claims report conflicting values for the same entity and attribute.").alias("reason"))
    return one.unionByName(raw_contradictions(claims, carry=("claim_id",)).select("claim_id_a", "claim_id_b", F.lit("Semantically aligned claims report conflicting values.").alias("reason")))


def penalties(pairs: DataFrame) -> DataFrame:
    """(doc_id, penalty): contradictions that each document takes part in."""
    sides = pairs.select(F.explode(F.array("doc_id_a", "doc_id_b")).alias("doc_id"))
    return sides.groupBy("doc_id").agg(F.count("*").cast("double").alias("penalty"))


def consistency_rank(candidates: DataFrame, penalty: DataFrame) -> DataFrame:
    """Documents with the fewest contradictions first."""
    rows = candidates.join(penalty, "doc_id", "left").fillna(0.0, ["penalty"]).withColumn("score", -F.col("penalty"))
    return rank(rows, "score")


def diagnose(rows: DataFrame) -> DataFrame:
    """rows(id, doc_a, doc_b, is_contradiction): what each pair's detection missed, and why; only misses."""
    docs = rows.select(F.concat("id", F.lit("/a")).alias("doc_id"), F.col("doc_a").alias("doc")).unionByName(rows.select(F.concat("id", F.lit("/b")).alias("doc_id"), F.col("doc_b").alias("doc")))
    claims = extract_claims(docs).filter("attribute <> 'raw_text'").withColumn("id", F.regexp_replace("doc_id", "/[ab]$", "")).withColumn("side", F.substring("doc_id", -1, 1))
    counts = claims.groupBy("id").agg(F.sum((F.col("side") == "a").cast("int")).alias("claims_a"), F.sum((F.col("side") == "b").cast("int")).alias("claims_b"))
    a, b = (claims.filter(F.col("side") == s).select("id", *[F.col(c).alias(f"{c}_{s}") for c in ("entity", "attribute", "value", "n")]) for s in "ab")
    both = a.join(b, "id").withColumn("conflict", values_conflict(F.col("value_a"), F.col("value_b")))
    hit = (F.lower(F.trim("entity_a")) == F.lower(F.trim("entity_b"))) & (F.col("attribute_a") == F.col("attribute_b")) & F.col("conflict")
    match = F.contains(F.col("attribute_a"), F.col("attribute_b")) | F.contains(F.col("attribute_b"), F.col("attribute_a"))
    first = F.min(F.when(match, F.struct("n_a", "n_b", "conflict", "value_a", "value_b")))
    per = both.groupBy("id").agg(F.max(hit).alias("was_detected"), first.alias("first"))
    out = rows.join(counts, "id", "left").join(per, "id", "left").fillna(0, ["claims_a", "claims_b"]).withColumn("was_detected", F.coalesce("was_detected", F.lit(False)))
    missed = F.col("is_contradiction") & ~F.col("was_detected")
    said = F.concat(F.lit("values_did_not_conflict("), "first.value_a", F.lit(" vs "), "first.value_b", F.lit(")"))
    reason = F.when(
        missed,
        F.when((F.col("claims_a") == 0) & (F.col("claims_b") == 0), "no_structured_claims_extracted")
        .when(F.col("claims_a") == 0, "no_claims_from_doc_a")
        .when(F.col("claims_b") == 0, "no_claims_from_doc_b")
        .when(F.col("first").isNull(), "no_matching_attributes_between_docs")
        .when(~F.col("first.conflict"), said),
    ).when(~F.col("is_contradiction") & F.col("was_detected"), "false_positive_detected")
    return out.withColumn("miss_reason", reason).filter(F.col("miss_reason").isNotNull() | (F.col("is_contradiction") != F.col("was_detected"))).drop("first")
