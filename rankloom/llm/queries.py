"""One query for each training-data operator, with its production parameters, and the SQL to hold it against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, itemsets, language_id, language_model, licenses, mixing, packing, quality_classifier, quality_rules, sharding, simhash, token_files, vector_search
from .common import load, shared_path


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(load(spark, sf_dir, "documents"))


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(load(spark, sf_dir, "documents"))
    return mixed.withColumn("mix_rate", F.round("mix_rate", 9))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_files.write_tokens(load(spark, sf_dir, "documents"), path, tokenizer_file(), end_id=2)
    return token_files.digest(token_files.read_tokens(spark, path))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), tokenizer_file())


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(load(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(load(spark, sf_dir, "embeddings"), is_query="id % 50 = 0")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir, "documents").select("doc_id", licenses.tree_path().alias("path"), "text")
    return licenses.scan(files).drop("text")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(load(spark, sf_dir, "documents"))


def op12_basket_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itemsets.digest(itemsets.mine(load(spark, sf_dir, "sale_lines")))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
    return alignment.link_statistics(load(spark, sf_dir, "documents"), *files)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_token_files": op3_token_files,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_packing": op5_packing,
    "op6_sharding": op6_sharding,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_vector_search": op8_vector_search,
    "op9_quality_rules": op9_quality_rules,
    "op10_license_scan": op10_license_scan,
    "op11_language_id": op11_language_id,
    "op12_basket_itemsets": op12_basket_itemsets,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.ORACLE_SQL,
    "op8_vector_search": vector_search.ORACLE_SQL,
    "op10_license_scan": licenses.ORACLE_SQL,
    "op12_basket_itemsets": itemsets.ORACLE_SQL,
}
