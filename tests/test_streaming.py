"""Streamed claims give the contradictions of the whole table."""

from pyspark.sql import functions as F

from rankloom.operators import claims as C
from rankloom.streaming.claims import check_stream


def test_stream_equals_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    claims = e.select("ts", F.col("event_id").alias("claim_id"), F.col("event_id").alias("doc_id"), F.concat(F.lit("user "), F.col("user_id")).alias("entity"), F.col("event_type").alias("attribute"), F.round("value", 0).cast("bigint").cast("string").alias("value"))
    source = str(tmp_path / "in")
    for i in range(3):
        claims.filter(F.col("claim_id") % 3 == i).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(claims.schema).option("maxFilesPerTrigger", 1).parquet(source)
    check_stream(stream, str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "cp"), "1000 days").awaitTermination()
    got = {(r.claim_id_a, r.claim_id_b) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.claim_id_a, r.claim_id_b) for r in C.contradictions(claims).collect()}
    assert got == want and got
