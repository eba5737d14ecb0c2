"""Contradictions in a stream of claims: each micro-batch is checked against what earlier batches stated."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.claims import values_conflict


def statements(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """stream(ts, claim_id, doc_id, entity, attribute, value) without repeated claims, late ones dropped."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["claim_id"])


def check_stream(stream: DataFrame, state_path: str, out_path: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Append each batch's contradictions, within it and with earlier claims, to out_path. Claims are kept in
    state_path by batch, so a batch that is run again overwrites what it wrote."""

    def check(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("entity_key", F.lower(F.trim("entity")))
        new.write.mode("overwrite").parquet(f"{state_path}/batch={number}")
        try:
            known = spark.read.parquet(state_path).filter(F.col("batch") <= number)
        except AnalysisException:
            known = new.withColumn("batch", F.lit(number))
        a = known.filter(F.col("batch") == number).select("entity_key", "attribute", F.col("claim_id").alias("claim_id_a"), F.col("doc_id").alias("doc_a"), F.col("value").alias("value_a"))
        b = known.select("entity_key", "attribute", F.col("claim_id").alias("claim_id_b"), F.col("doc_id").alias("doc_b"), F.col("value").alias("value_b"), F.col("batch").alias("batch_b"))
        pairs = a.join(b, ["entity_key", "attribute"]).filter("doc_a <> doc_b").filter((F.col("batch_b") < number) | (F.col("claim_id_a") < F.col("claim_id_b")))
        found = pairs.filter(values_conflict(F.col("value_a"), F.col("value_b")))
        found.select("entity_key", "attribute", F.least("claim_id_a", "claim_id_b").alias("claim_id_a"), F.greatest("claim_id_a", "claim_id_b").alias("claim_id_b")).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return statements(stream, delay).writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
