"""BM25 as relations: term counts, document frequencies, lengths, and an equi-join of query terms with postings.

The corpus that frequencies and lengths are counted over is all documents, or each query's own candidates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import whitespace_tokens
from ..session import few, spread, stage

K1, B = 1.5, 0.75
#: Distinct query words, counted, up to which they are broadcast.
BROADCAST_TOKENS = 100_000
#: A term in more documents than this is dealt over SALTS tasks.
HEAVY_ROWS = 10_000
SALTS = 32
#: One document in so many gives the first bound of what can be among a query's first documents.
SLICES = 16


def term_counts(texts: DataFrame, key: list[str], text: str, tokens: Callable[[Column], Column] = whitespace_tokens) -> DataFrame:
    """(key, token, f)."""
    return texts.select(*key, F.explode(tokens(F.col(text))).alias("token")).groupBy(*key, "token").agg(F.count("*").alias("f"))


def document_lengths(texts: DataFrame, key: list[str], text: str, tokens: Callable[[Column], Column] = whitespace_tokens) -> DataFrame:
    return texts.select(*key, F.size(tokens(F.col(text))).cast("bigint").alias("dl"))


def statistics(lengths: DataFrame, corpus: list[str]) -> DataFrame:
    """(corpus, n, avgdl): one row for each corpus; the mean length is at least 1."""
    return lengths.groupBy(*corpus).agg(F.count("*").alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"))


def document_frequencies(counts: DataFrame, corpus: list[str]) -> DataFrame:
    return counts.groupBy(*corpus, "token").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def term_weight(f: Column, n: Column, df: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.greatest(dl, F.lit(1)) / avgdl)
    return idf(n, df) * f * F.lit(k1 + 1.0) / (f + norm)


def _postings(texts: DataFrame, key: list[str], tokens: Callable[[Column], Column], wanted: DataFrame, on: list[str]) -> DataFrame:
    """(key, token, dl, f) of the wanted tokens alone: others are dropped before anything is counted or shuffled. Each text
    has the token that no word is, the empty one, too, so that its length comes with the same pass."""
    rows = texts.select(*key, tokens(F.col("doc")).alias("t"))
    marked = F.explode(F.array_append(F.coalesce("t", F.array().cast("array<string>")), F.lit("")))
    rows = rows.select(*key, F.size("t").cast("bigint").alias("dl"), marked.alias("token"))
    return rows.join(wanted.select(*on).distinct(), on, "left_semi").groupBy(*key, "token", "dl").agg(F.count("*").alias("f"))


def _indexed(queries: DataFrame, documents: DataFrame, tokens: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, float]:
    """(query_id, token, qf, n, df) and (doc_id, dl, token, f) of the queries' tokens, both staged, and the mean length.
    Texts are split into words once: a document's length comes with a row of the token that no word is, the empty one."""
    wanted = stage(term_counts(queries, ["query_id"], "query", tokens).withColumnRenamed("f", "qf"), "query-terms")
    length = documents.sparkSession.range(1).select(F.lit("").alias("token"))
    some = wanted.select("token").distinct().unionByName(length)
    some = F.broadcast(some) if wanted.count() <= BROADCAST_TOKENS else some
    rows = spread(documents).select("doc_id", tokens(F.col("doc")).alias("t"))
    marked = F.explode(F.array_append(F.coalesce("t", F.array().cast("array<string>")), F.lit("")))
    words = rows.select("doc_id", F.size("t").cast("bigint").alias("dl"), marked.alias("token"))
    counts = stage(words.join(some, "token", "left_semi").groupBy("doc_id", "dl", "token").agg(F.count("*").alias("f")), "postings")
    sums = [F.count("*").alias("df"), F.sum("f").alias("n"), F.sum(F.col("dl") * F.col("f")).alias("words"), F.sum(F.when(F.col("dl").isNotNull(), F.col("f"))).alias("known")]
    kinds = stage(counts.groupBy("token").agg(*sums), "frequencies")
    n, avgdl = kinds.filter("token = ''").agg(F.coalesce(F.sum("n"), F.lit(0)), F.greatest(F.sum("words") / F.sum("known"), F.lit(1.0))).first()
    asked = wanted.join(few(kinds.select("token", "df"), BROADCAST_TOKENS), "token").withColumn("n", F.lit(n))
    return stage(asked, "asked"), counts.filter("token <> ''"), avgdl


def search(queries: DataFrame, documents: DataFrame, tokens: Callable[[Column], Column] = whitespace_tokens, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, bm25) of queries(query_id, query) against documents(doc_id, doc), frequencies over all
    documents; only documents that share a term with the query, others score 0.

    Up to BROADCAST_TOKENS query terms go to where a document's terms lie, so scores are summed there and pairs of query
    and document are never shuffled. Beyond that a term of many documents is one of many queries too, so its rows are
    dealt over SALTS tasks by document, and its queries go to each."""
    return _scored(*_indexed(queries, documents, tokens), k1, b)


def _scored(asked: DataFrame, posts: DataFrame, avgdl: float, k1: float, b: float) -> DataFrame:
    if asked.count() <= BROADCAST_TOKENS:
        partitions = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = posts.repartition(partitions, "doc_id").join(F.broadcast(asked), "token")
    else:
        salt = F.when(F.col("df") > HEAVY_ROWS, F.lit(SALTS)).otherwise(F.lit(1))
        left = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), salt - 1)))
        kinds = asked.select("token", "df").distinct()
        right = posts.join(kinds, "token").withColumn("salt", F.pmod(F.xxhash64("doc_id"), salt).cast("int")).drop("df")
        rows = left.join(right, ["token", "salt"])
    w = term_weight(F.col("f"), F.col("n"), F.col("df"), F.col("dl"), F.lit(avgdl), k1, b)
    return rows.groupBy("query_id", "doc_id").agg(F.sum(F.col("qf") * w).alias("bm25"))


def top(queries: DataFrame, documents: DataFrame, k: int, tokens: Callable[[Column], Column] = whitespace_tokens, k1: float = K1, b: float = B) -> DataFrame:
    """The first k of search, ranked. One document in SLICES is scored first: a query's k-th score there is no greater
    than its k-th of all, so scores below it can't be among the first k and are never sorted. Where search sums scores
    beside the documents, each task hands on the first k of each query alone."""
    asked, posts, avgdl = _indexed(queries, documents, tokens)
    some = posts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)) == 0)
    last = rank(_scored(asked, some, avgdl, k1, b), "bm25", "doc_id", k).filter(F.col("rank") == k)
    # sums in another order may differ in the last place that rank rounds to
    bounds = few(stage(last.select("query_id", (F.round("bm25", 6) - 2e-6).alias("least")), "least-scores"))
    scores = _scored(asked, posts, avgdl, k1, b).join(bounds, "query_id", "left")
    above = scores.filter(F.col("least").isNull() | (F.col("bm25") >= F.col("least"))).drop("least")
    return rank(above, "bm25", "doc_id", k)


def score_candidates(candidates: DataFrame, tokens: Callable[[Column], Column] = whitespace_tokens, k1: float = K1, b: float = B) -> DataFrame:
    """candidates(query_id, query, doc_id, doc, ...) with bm25: frequencies over each query's own candidates."""
    key = ["query_id", "doc_id"]
    texts = candidates.select("query_id", "query").distinct()
    wanted = term_counts(texts, ["query_id"], "query", tokens).withColumnRenamed("f", "qf")
    marks = texts.select("query_id", F.lit("").alias("token"))
    counts = stage(_postings(candidates, key, tokens, wanted.select("query_id", "token").unionByName(marks), ["query_id", "token"]), "candidate-postings")
    posts = counts.filter("token <> ''")
    known = F.sum(F.when(F.col("dl").isNotNull(), F.col("f")))
    mean = F.greatest(F.sum(F.col("dl") * F.col("f")) / known, F.lit(1.0))
    stats = counts.filter("token = ''").groupBy("query_id").agg(F.sum("f").alias("n"), mean.alias("avgdl"))
    scored = posts.join(wanted, ["query_id", "token"]).join(document_frequencies(posts, ["query_id"]), ["query_id", "token"]).join(stats, "query_id")
    w = term_weight(F.col("f"), F.col("n"), F.col("df"), F.col("dl"), F.col("avgdl"), k1, b)
    sums = scored.groupBy(*key).agg(F.sum(F.col("qf") * w).alias("bm25"))
    return candidates.join(sums, key, "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))


def max_normalized(scores: DataFrame, score: str = "bm25") -> DataFrame:
    """Adds <score>_norm: clipped at 0 and divided by the query's greatest."""
    top = F.max(F.greatest(F.col(score), F.lit(0.0))).over(W.Window.partitionBy("query_id"))
    return scores.withColumn(f"{score}_norm", F.when(top > 0, F.greatest(F.col(score), F.lit(0.0)) / top).otherwise(F.lit(0.0)))


def rank(scores: DataFrame, score: str, ties: str = "pos", top_k: int | None = None, descending: bool = True) -> DataFrame:
    """Adds rank: by the score rounded to 6 places, then by ties; top_k keeps only the first."""
    if top_k is not None and top_k <= 0:
        raise ValueError("top_k must be positive")
    rounded = F.round(F.col(score), 6)
    order = W.Window.partitionBy("query_id").orderBy(rounded.desc() if descending else rounded.asc(), F.col(ties).asc())
    ranked = scores.withColumn("rank", F.row_number().over(order))
    return ranked if top_k is None else ranked.filter(F.col("rank") <= top_k)


def rerank(candidates: DataFrame, tokens: Callable[[Column], Column] = whitespace_tokens) -> DataFrame:
    """Candidates ranked by max-normalised BM25 over each query's own candidates."""
    return rank(max_normalized(score_candidates(candidates, tokens)), "bm25_norm").withColumn("score", F.col("bm25_norm"))
