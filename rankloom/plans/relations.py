"""The relations that queries run on, from the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..operators import bm25
from ..session import few, stage

#: Documents that retrieval hands to the rankers, for each query.
RETRIEVED = 50


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.col("text").alias("doc"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def retrieved(spark: SparkSession, sf: str, k: int = RETRIEVED) -> DataFrame:
    """(query_id, doc_id, bm25, pos): each query's first k documents by BM25 over the whole corpus."""
    return bm25.top(questions(spark, sf), corpus(spark, sf), k).withColumnRenamed("rank", "pos")


def candidates(spark: SparkSession, sf: str, k: int = RETRIEVED) -> DataFrame:
    """(query_id, query, doc_id, doc, pos), ordered as retrieved; staged, since rankers use it many times."""
    found = few(stage(retrieved(spark, sf, k).select("query_id", "doc_id", "pos"), "found"), bm25.BROADCAST_TOKENS)
    rows = corpus(spark, sf).join(found, "doc_id").join(questions(spark, sf), "query_id").select("query_id", "query", "doc_id", "doc", "pos")
    return stage(rows, "candidates", "query_id", "doc_id")


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates with rel."""
    return judge(candidates(spark, sf))


def judge(rows: DataFrame) -> DataFrame:
    """Adds rel: 3 if the document holds the whole query, else 2 or 1 by the share of its words held."""
    terms = F.array_distinct(bm25.whitespace_tokens(F.col("query")))
    held = F.size(F.array_intersect(terms, bm25.whitespace_tokens(F.col("doc")))) / F.greatest(F.size(terms), F.lit(1))
    rel = F.when(F.contains(F.col("doc"), F.col("query")), 3).when(held >= 0.5, 2).when(held >= 0.25, 1).otherwise(0)
    return rows.withColumn("rel", rel)


def exchanges(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, query, doc_id, doc, pos): each user turn with the turn that follows it."""
    turns = table(spark, sf, "conversations")
    after = W.Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumn("doc", F.lead("text").over(after)).filter("role = 'user' AND doc IS NOT NULL")
    key = F.col("conv_id") * 10_000 + F.col("turn")
    return rows.select(key.alias("query_id"), F.col("text").alias("query"), key.alias("doc_id"), "doc", F.lit(1).alias("pos"))


def dense(spark: SparkSession, sf: str) -> DataFrame:
    """(group, id, dim, x) of the embeddings table, one matrix."""
    return table(spark, sf, "embeddings").select(F.lit(0).alias("grp"), F.col("vec_id").alias("id"), F.posexplode("embedding").alias("dim", "x"))


SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TOKEN = r"([a-z][a-z0-9]*|[^\x00-\x7F\x85\p{Z}][^\x00-\x7F]*|[\x00-\x08\x0e-\x1b\x21-\x7f])"


def sql_words(column: str) -> str:
    return f"[x FOR x IN string_split_regex(lower({column}), '{SPACE}+') IF x <> '']"


def sql_tokens(column: str) -> str:
    return rf"flatten([CASE WHEN regexp_matches(m, '^[^\x00-\x7F]{{2}}') THEN [substring(m, i, 2) FOR i IN range(1, length(m))] ELSE [m] END FOR m IN regexp_extract_all(lower({column}), '{TOKEN}', 1)])"


def sql_stripped(column: str) -> str:
    return f"regexp_replace({column}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_grams(column: str, n: int = 3) -> str:
    s = sql_stripped(f"lower({column})")
    return f"CASE WHEN length({s}) = 0 THEN CAST([] AS VARCHAR[]) WHEN length({s}) < {n} THEN [{s}] ELSE list_distinct([substring({s}, i, {n}) FOR i IN range(1, length({s}) - {n - 2})]) END"


def sql_bucket(token: str) -> str:
    b = lambda i: f"CAST('0x' || substr(sha256({token}), {2 * i + 1}, 2) AS BIGINT)"
    return f"CAST(({b(0)} + {b(1)} * 256 + {b(2)} * 65536 + {b(3)} * 16777216) % 256 AS INTEGER)"


def sql_sign(token: str) -> str:
    return f"CASE WHEN CAST('0x' || substr(sha256({token}), 9, 2) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END"


BM25_TERM = "qf * ln((n - df + 0.5e0) / (df + 0.5e0) + 1) * f * 2.5e0 / (f + 1.5e0 * (0.25e0 + 0.75e0 * greatest(dl, 1) / avgdl))"

SQL_RETRIEVED = f"""
q AS (SELECT item_id AS query_id, text AS query FROM benchmark),
d AS (SELECT doc_id, text AS doc FROM documents),
dt AS (SELECT doc_id, unnest({sql_words("doc")}) AS token FROM d),
tf AS (SELECT doc_id, token, count(*) AS f FROM dt GROUP BY ALL),
dl AS (SELECT doc_id, len({sql_words("doc")}) AS dl FROM d),
st AS (SELECT count(*) AS n, greatest(avg(dl), 1e0) AS avgdl FROM dl),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY ALL),
qt AS (SELECT query_id, unnest({sql_words("query")}) AS token FROM q),
qf AS (SELECT query_id, token, count(*) AS qf FROM qt GROUP BY ALL),
bm AS (SELECT query_id, doc_id, sum({BM25_TERM}) AS bm25 FROM qf JOIN tf USING (token) JOIN df USING (token) JOIN dl USING (doc_id) CROSS JOIN st GROUP BY ALL),
ret AS (SELECT query_id, doc_id, bm25, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id) AS INTEGER) AS pos FROM bm QUALIFY pos <= {RETRIEVED})"""

SQL_CANDIDATES = SQL_RETRIEVED + """,
cand AS (SELECT query_id, query, doc_id, doc, pos FROM ret JOIN q USING (query_id) JOIN d USING (doc_id))"""

SQL_JUDGED = SQL_CANDIDATES + f""",
held AS (SELECT *, CAST(len([x FOR x IN list_distinct({sql_words("query")}) IF list_contains({sql_words("doc")}, x)]) AS DOUBLE) / greatest(len(list_distinct({sql_words("query")})), 1) AS held FROM cand),
judged AS (SELECT query_id, query, doc_id, doc, pos, CASE WHEN contains(doc, query) THEN 3 WHEN held >= 0.5e0 THEN 2 WHEN held >= 0.25e0 THEN 1 ELSE 0 END AS rel FROM held)"""

SQL_EXCHANGES = """
ex AS (SELECT conv_id * 10000 + turn AS query_id, text AS query, conv_id * 10000 + turn AS doc_id, doc, 1 AS pos
  FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS doc FROM conversations) WHERE role = 'user' AND doc IS NOT NULL)"""


def sql_embedding(source: str, key: str, text: str, name: str) -> str:
    """CTEs <name>(key, bucket, w): unit vectors of a relation's texts."""
    return f"""
{name}_t AS (SELECT {key}, unnest({sql_tokens(text)}) AS token FROM (SELECT DISTINCT {key}, {text} FROM {source})),
{name}_v AS (SELECT token, {sql_bucket("token")} AS bucket, {sql_sign("token")} AS sign FROM (SELECT DISTINCT token FROM {name}_t)),
{name}_n AS (SELECT {key}, bucket, CAST(sum(sign) AS DOUBLE) AS n FROM {name}_t JOIN {name}_v USING (token) GROUP BY ALL HAVING sum(sign) <> 0),
{name} AS (SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS w FROM {name}_n)"""
