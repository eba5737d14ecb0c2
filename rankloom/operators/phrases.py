"""Which documents hold which phrases, by an anchor index in place of a comparison of all documents with all phrases.

A phrase's inner words - between white space of its own - stand whole in any document that holds it. Its anchor is its rarest
run of up to RUN adjacent inner words, by the number of documents with that run; documents are turned into runs of
words, of which only those that some phrase has are kept. Anchors and runs meet in an equi-join, and what meets is compared as strings. A
phrase of one or two words has no inner word: its longest word is a part of a word of the document, so the distinct
words of all documents are searched for it, by the first characters of the phrase's word, and the words found are its
anchors. Phrases without a word (empty, or white space alone) are compared with each document.

Runs of phrases are broadcast up to a counted BROADCAST_RUNS, else joined by a shuffle; anchors are rare by choice, and a
common run (of a phrase that has no rare one) is dealt over SALTS tasks.

Defined cases: a null phrase, text or id matches nothing; equal phrases under several ids match alike; repeated rows of one
doc_id match once; matching is exact on characters (lower-case both sides first for a caseless search).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import FAST_SPACE
from ..session import spread, stage

RUN = 3
BROADCAST_RUNS = 200_000
SALTS = 32
#: Leading characters by which a short phrase's word is found inside the documents' words.
GRAM = 3
INNER, PART, NONE = "inner", "part", "none"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, FAST_SPACE + "+"), "")


def _inner(text: Column) -> Column:
    """The words of a phrase that have white space before and after them in it."""
    pieces = F.split(text, FAST_SPACE + "+")
    return F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0)))


def _run(of: Column, first: Column, n: int) -> Column:
    return F.concat_ws(" ", F.slice(of, first, n))


def _runs(of: Column, n: int) -> Column:
    """All runs of n adjacent words."""
    return F.when(F.size(of) >= n, F.transform(F.sequence(F.lit(1), F.size(of) - (n - 1)), lambda i: _run(of, i, n))).otherwise(F.array().cast("array<string>"))


def _grams(word: Column, n: int) -> Column:
    return F.when(F.length(word) >= n, F.transform(F.sequence(F.lit(1), F.length(word) - (n - 1)), lambda i: F.substring(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _kinds(phrases: DataFrame) -> DataFrame:
    kind = F.when(F.size(words(F.col("phrase"))) == 0, NONE).when(F.size(_inner(F.col("phrase"))) > 0, INNER).otherwise(PART)
    return phrases.select("query_id", F.col("query").alias("phrase")).filter("query_id IS NOT NULL AND phrase IS NOT NULL").withColumn("kind", kind)


def _joined(rows: DataFrame, wanted: DataFrame, how: str) -> DataFrame:
    """rows(run) with the wanted runs, a staged table of distinct ones; only the counted few are broadcast."""
    return rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_RUNS else wanted, "run", how)


def _anchored(documents: DataFrame, phrases: DataFrame) -> DataFrame:
    """(query_id, doc_id) of phrases with inner words and documents that hold their anchor."""
    inner = phrases.withColumn("inner", _inner(F.col("phrase"))).withColumn("n", F.least(F.size("inner"), F.lit(RUN)))
    longest = F.coalesce(*[F.when(F.col("n") == n, _runs(F.col("inner"), n)) for n in range(RUN, 0, -1)])
    runs = stage(inner.select("query_id", F.explode(F.array_distinct(longest)).alias("run")), "phrase-runs")
    wanted = stage(runs.select("run").distinct(), "wanted-runs")
    sizes = sorted(r.n for r in inner.select("n").distinct().collect())
    found = documents.select("doc_id", words(F.col("doc")).alias("w")).select("doc_id", F.explode(F.array_distinct(F.concat(*[_runs(F.col("w"), n) for n in sizes]))).alias("run"))
    postings = stage(_joined(found, wanted, "left_semi"), "run-postings")
    counts = postings.groupBy("run").agg(F.count("*").alias("df"))
    first = W.Window.partitionBy("query_id").orderBy("df", "run")
    # a run that no document holds is the rarest: its phrase is in none
    anchors = runs.join(counts, "run", "left").fillna(0, ["df"]).withColumn("place", F.row_number().over(first)).filter("place = 1 AND df > 0").select("query_id", "run")
    salted = anchors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return postings.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["run", "salt"]).select("query_id", "doc_id").distinct()


def _in_words(documents: DataFrame, phrases: DataFrame) -> DataFrame:
    """(query_id, doc_id) of phrases of one or two words and documents with a word that holds their longest word."""
    longest = F.array_max(F.transform(words(F.col("phrase")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = stage(phrases.select("query_id", longest.alias("part")).withColumn("gram", F.substring("part", 1, GRAM)), "phrase-parts")
    each = documents.select("doc_id", F.explode(F.array_distinct(words(F.col("doc")))).alias("word"))
    vocabulary = each.select("word").distinct()
    grams = F.concat(*[_grams(F.col("word"), n) for n in range(1, GRAM + 1)])
    of_word = vocabulary.select("word", F.explode(F.array_distinct(grams)).alias("gram")).join(asked.select("gram").distinct(), "gram", "left_semi")
    held = of_word.join(asked, "gram").filter(F.contains("word", "part")).select("query_id", F.col("word").alias("run"))
    held = stage(held.distinct(), "phrase-words")
    salted = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    near = _joined(each.withColumnRenamed("word", "run"), stage(held.select("run").distinct(), "held-words"), "left_semi")
    return near.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["run", "salt"]).select("query_id", "doc_id").distinct()


def containing(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id): documents(doc_id, doc) that hold the phrase of queries(query_id, query) as a string."""
    documents = spread(documents.select("doc_id", "doc").filter("doc_id IS NOT NULL AND doc IS NOT NULL"))
    phrases = stage(_kinds(queries), "phrases")
    kinds = {r.kind for r in phrases.select("kind").distinct().collect()}
    candidates = None
    for kind, near in ((INNER, _anchored), (PART, _in_words)):
        if kind in kinds:
            found = near(documents, phrases.filter(F.col("kind") == kind))
            candidates = found if candidates is None else candidates.unionByName(found)
    out = None
    if candidates is not None:
        tried = candidates.join(phrases.select("query_id", "phrase"), "query_id").join(documents, "doc_id")
        out = tried.filter(F.contains("doc", "phrase")).select("query_id", "doc_id").distinct()
    if NONE in kinds:
        # white space alone: few distinct phrases, each with its ids
        blank = phrases.filter(F.col("kind") == NONE).groupBy("phrase").agg(F.collect_set("query_id").alias("ids")).collect()
        each = F.flatten(F.array(*[F.when(F.contains("doc", F.lit(r.phrase)), F.array(*map(F.lit, r.ids))).otherwise(F.array().cast(f"array<{queries.schema['query_id'].dataType.simpleString()}>")) for r in blank]))
        more = documents.select(F.explode(each).alias("query_id"), "doc_id").distinct()
        out = more if out is None else out.unionByName(more)
    if out is None:
        return phrases.select("query_id", F.lit(None).cast(documents.schema["doc_id"].dataType).alias("doc_id")).limit(0)
    return out
