"""Mixing sources to target weights by Poisson replication, in native expressions only.

A source's rate is the mean number of times that each of its documents is to appear. The number for one document
is the inverse of the Poisson distribution with that mean at a uniform number hashed from the seed, doc_id and text, so
it needs no state, no order and no second pass, and a rerun gives the same copies. A rate above MOST_RATE, as of a source
of a few documents in a large corpus, is the sum of as many draws of equal rates below it, so tables stay short: sums of
Poisson numbers are Poisson numbers. Copies are exploded and dealt
over all partitions by a hashed position, whose order is the global shuffle.

Sizes are aggregated map-side to one row per source; those rows are joined back by a counted broadcast (salted
beyond its bound), so a source with most of all rows stays spread as its files are.

Defined cases: a null source is a source of its own; a null text has size 1 (every document counts its UTF-8 bytes
plus 1); doc_ids that are null or occur often are told apart by their texts, in counts as in positions; rows of one
source with equal doc_id and text are drawn and placed alike; a source without a weight has weight 0 and goes; an
empty table gives no rows. Columns named mix_* are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import join_small, partitions, text_key, unit52

SEED = 17
TEMPERATURE = 0.5
EPOCHS = 1.0
UNIT = 1 << 52
MOST_RATE = 64


def source_rates(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = EPOCHS) -> DataFrame:
    """__key, mix_rate: copies per document so that a source's share of all bytes is its target weight and the
    whole is epochs times the input. Without weights the target is proportional to size ** temperature."""
    size = F.coalesce(F.octet_length("text").cast("bigint"), F.lit(0)) + 1
    sizes = docs.groupBy(text_key(source).alias("__key")).agg(F.sum(size).alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(float(temperature))))
    else:
        named = F.create_map(*[x for k, v in weights.items() for x in (F.lit("n" if k is None else f"v:{k}"), F.lit(float(v)))])
        sizes = sizes.withColumn("weight", F.coalesce(named[F.col("__key")], F.lit(0.0)))
    total, weight = sizes.agg(F.sum("size"), F.sum("weight")).first()
    if not weight:
        return sizes.select("__key", F.lit(0.0).alias("mix_rate"))
    return sizes.select("__key", (F.lit(float(epochs)) * F.lit(float(total)) * F.col("weight") / F.lit(float(weight)) / F.col("size")).alias("mix_rate"))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """Adds __draws, and __cdf: the cumulative Poisson probabilities of 0, 1, 2, ... copies by one draw, up to beyond any
    hashed number."""
    rates = rates.withColumn("__draws", F.greatest(F.ceil(F.col("mix_rate") / MOST_RATE), F.lit(1)).cast("int"))
    rates = rates.withColumn("rate", F.col("mix_rate") / F.col("__draws"))
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 24).cast("int")
    k = rates.filter("mix_rate > 0").withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    up_to = W.Window.partitionBy("__key").orderBy("k").rowsBetween(W.Window.unboundedPreceding, 0)
    log_factorial = F.sum(F.when(F.col("k") > 0, F.log("k")).otherwise(F.lit(0.0))).over(up_to)
    k = k.withColumn("p", F.exp(-F.col("rate") + F.col("k") * F.log("rate") - log_factorial))
    k = k.withColumn("c", F.sum("p").over(up_to))
    return k.groupBy("__key", "mix_rate", "__draws").agg(F.sort_array(F.collect_list("c")).alias("__cdf"))


def uniform(purpose: str, seed: int, *parts: Column) -> Column:
    return unit52(F.lit(purpose), F.lit(str(seed)), *parts)


def row_key() -> Column:
    """Tells rows apart: doc_id and text."""
    return F.concat_ws(":", text_key("doc_id"), F.md5(text_key("text")))


def mix(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """docs repeated to the target weights, globally shuffled; adds mix_rate, mix_copy (from 1), mix_position."""
    docs = docs.drop("mix_rate", "mix_copy", "mix_position")
    tables = poisson_tables(source_rates(docs, source, weights, temperature, epochs))
    joined = join_small(docs.withColumn("__key", text_key(source)).withColumn("__one", row_key()), tables, "__key", "inner")
    below = lambda u: F.size(F.filter("__cdf", lambda c: c <= u / F.lit(float(UNIT))))
    one = F.col("__one")
    once = below(uniform("count", seed, one))
    more = F.aggregate(F.sequence(F.lit(2), F.col("__draws")), once, lambda n, i: n + below(uniform("count", seed, one, i.cast("string"))))
    counted = joined.withColumn("__n", F.when(F.col("__draws") == 1, once).otherwise(more)).filter("__n > 0").drop("__cdf", "__draws", "__key")
    copies = counted.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n")
    placed = copies.withColumn("mix_position", uniform("place", seed, one, F.col("mix_copy").cast("string")))
    n = partitions(docs.sparkSession)
    share = F.floor(F.col("mix_position") / F.lit(float(UNIT)) * n).cast("int")
    return placed.repartitionById(n, share).sortWithinPartitions("mix_position").select(*docs.columns, "mix_rate", "mix_copy", "mix_position")


ORACLE_SQL = f"""
WITH sized AS (
  SELECT source, CAST(sum(coalesce(strlen(text), 0) + 1) AS DOUBLE) AS size FROM documents GROUP BY source),
rates AS (
  SELECT source, {EPOCHS}e0 * sum(size) OVER () * pow(size, {TEMPERATURE}e0) / sum(pow(size, {TEMPERATURE}e0)) OVER () / size AS rate FROM sized),
draws AS (
  SELECT *, rate / draws AS part FROM (SELECT *, greatest(ceil(rate / {MOST_RATE}e0), 1) AS draws FROM rates)),
cdf AS (
  SELECT source, k, sum(exp(-part + k * ln(part) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM draws, range(0, {3 * MOST_RATE}) AS t(k) WHERE k <= ceil(part + 12 * sqrt(part) + 24)),
named AS (
  SELECT *, coalesce('v:' || doc_id, 'n') || ':' || md5(coalesce('v:' || text, 'n')) AS one FROM documents),
each AS (
  SELECT DISTINCT d.one, d.source, unnest(range(1, CAST(r.draws AS BIGINT) + 1)) AS i FROM named d JOIN draws r ON r.source IS NOT DISTINCT FROM d.source),
drawn AS (
  SELECT *, CAST('0x' || substr(md5('count:{SEED}:' || one || CASE WHEN i > 1 THEN ':' || i ELSE '' END), 1, 13) AS BIGINT) / {UNIT}e0 AS u FROM each),
counted AS (
  SELECT d.one, d.source, count(*) AS n FROM drawn d JOIN cdf ON cdf.source IS NOT DISTINCT FROM d.source AND cdf.c <= d.u GROUP BY ALL),
copies AS (SELECT one, source, unnest(range(1, n + 1)) AS copy FROM counted)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, round(r.rate, 9) AS mix_rate, CAST(t.copy AS INTEGER) AS mix_copy,
  CAST('0x' || substr(md5('place:{SEED}:' || d.one || ':' || t.copy), 1, 13) AS BIGINT) AS mix_position
FROM named d JOIN copies t ON t.one = d.one AND t.source IS NOT DISTINCT FROM d.source JOIN rates r ON r.source IS NOT DISTINCT FROM d.source
"""
