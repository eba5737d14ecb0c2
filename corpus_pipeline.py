"""The corpus pipeline: documents to packed training sequences, each stage written and read again.

Quality classifier and quality rules drop what they reject; near-duplicates leave one document of each group; mixing
repeats documents to the target weights of their sources, globally shuffled; packing returns the pieces of sequences.

The near-duplicate stage is SimHash on five-word shingles at a similarity of 0.8 or more (llm/similar): wide
fingerprints compared by tiles, links checked on the shingles.

Defined cases, in order of the stages: a null or empty text has no words and fails the base rules; documents without
labels are judged like others, and without any labels the classifier keeps all and only the base rules act; of the
rows of a near-duplicate group one stays, whatever their doc_ids: the smallest doc_id, null after all others, then by
hashes of text and row, and one of wholly equal rows; rows with equal doc_id in one source are repeated alike; a null
source is a source of its own. Further columns of documents pass through all stages but the last, whatever their names
(packing returns pieces); names beginning with two underscores and mix_ are the operators'. Empty documents give an
empty result.

The stages run one after another on the same executors, so what one leaves in memory is lacking to the next: they hand
rows to Python workers in small batches (common.small_batches, a setting of the session), and packing's workers remember
fewer parts of texts than op5's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import mixing, packing, quality_classifier, quality_rules, simhash
from rankloom.llm.common import load, materialize, small_batches
from rankloom.llm.queries import tokenizer_file
from rankloom.session import ship

#: Parts of texts whose ids a packing worker remembers: 44 MB; with op5's 700,000, 154 MB.
REMEMBERED = 200_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    small_batches(spark)
    return quality_classifier.keep_good(docs, load(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    small_batches(spark)
    return quality_rules.keep_good(docs, load(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    small_batches(spark)
    return simhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mixing.mix(docs).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    small_batches(spark)
    return packing.pack(docs, tokenizer_file(), remembered=REMEMBERED)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("quality_rules", rules),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: Classifiers, certified cutoffs, fingerprints and token ids can't be expressed in SQL; tests hold the run against
#: a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
