"""A stored index for late interaction: documents are added in batches, queries read the parts that they need.

A document's kept tokens come to the set of its (bucket, sign); a row is (doc_id, bucket, sign, kinds), kinds being how many
of them the document has. Rows lie in a folder for each batch, partitioned by `part`, a range of buckets, so a
query reads only the parts of its own buckets, by the names of folders. A batch is written to its own folder, whose completion mark
comes last: one that failed is not read, and writing it again replaces it.

Defined cases: a document that is added again is known by its last batch alone, in the order of their names; one without
a token is known without rows and scores 0 or below as any other; a null doc_id is not indexed; repeated rows of a batch
are one document's only if their texts are equal, else their tokens are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import unicode_tokens
from ..functions.vectors import DIMENSION, hashed_vocabulary
from ..session import stage
from ..sources.readers import path_exists
from .bm25 import rank
from .rankers import TOP_TOKENS, token_index

PARTS = 32


def _part(bucket):
    return F.floor(bucket * PARTS / DIMENSION).cast("int")


class LateIndex:
    def __init__(self, spark: SparkSession, root: str, top_k: int = TOP_TOKENS, use_salience: bool = True) -> None:
        self.spark, self.root, self.top_k, self.use_salience = spark, root.rstrip("/"), top_k, use_salience

    def add(self, documents: DataFrame, batch: str) -> None:
        """Index documents(doc_id, doc) under this batch name."""
        known = stage(documents.select("doc_id", "doc").filter("doc_id IS NOT NULL").distinct(), "index-documents", "doc_id")
        signs = token_index(known, self.top_k, self.use_salience).select("doc_id", "bucket", "sign").distinct()
        kinds = F.count("*").over(W.Window.partitionBy("doc_id"))
        rows = signs.withColumn("kinds", kinds).withColumn("part", _part(F.col("bucket")))
        folder = f"{self.root}/{batch}"
        rows.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/signs")
        known.select("doc_id").distinct().write.mode("overwrite").parquet(f"{folder}/documents")

    def batches(self) -> list[str]:
        """Complete batches, oldest name first."""
        if not path_exists(self.spark, self.root):
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        names = [f.getPath().getName() for f in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)]
        return sorted(n for n in names if path_exists(self.spark, f"{self.root}/{n}/documents/_SUCCESS"))

    def _latest(self) -> DataFrame | None:
        """doc_id, batch."""
        names = self.batches()
        rows = [self.spark.read.parquet(f"{self.root}/{n}/documents").select("doc_id", F.lit(n).alias("batch")) for n in names]
        if not rows:
            return None
        all_rows = rows[0]
        for more in rows[1:]:
            all_rows = all_rows.unionByName(more)
        return all_rows if len(rows) == 1 else all_rows.groupBy("doc_id").agg(F.max("batch").alias("batch"))

    def read(self, buckets: list[int]) -> DataFrame | None:
        """doc_id, bucket, sign, kinds of these buckets' parts alone, each document's last batch."""
        latest, out = self._latest(), None
        parts = sorted({b * PARTS // DIMENSION for b in buckets})
        for n in self.batches():
            kind = self.spark.read.parquet(f"{self.root}/{n}/documents").schema["doc_id"].dataType.simpleString()
            rows = self.spark.read.schema(f"doc_id {kind}, bucket int, sign int, kinds long, part int").parquet(f"{self.root}/{n}/signs")
            rows = rows.filter(F.col("part").isin(parts) & F.col("bucket").isin(sorted(buckets))).withColumn("batch", F.lit(n)).drop("part")
            out = rows if out is None else out.unionByName(rows)
        if out is None or len(self.batches()) == 1:
            return None if out is None else out.drop("batch")
        return out.join(latest, ["doc_id", "batch"], "left_semi").drop("batch")

    def rank(self, candidates: DataFrame) -> DataFrame:
        """candidates(query_id, query, doc_id, pos) by the sum over a query's tokens of their best cosine with the
        document's tokens: 1 for the bucket with its sign, -1 if the document has nothing but that bucket with the other."""
        q = candidates.select("query_id", "query").distinct().select("query_id", F.explode(unicode_tokens(F.col("query"))).alias("token"))
        q = q.join(hashed_vocabulary(q), "token").groupBy("query_id", "bucket", "sign").agg(F.count("*").alias("qf"))
        rows = self.read([r.bucket for r in q.select("bucket").distinct().collect()])
        if rows is None:
            return rank(candidates.withColumn("score", F.lit(0.0)), "score")
        # a document's row answers the queries of its sign, and, if it is the only one, those of the other sign
        same = rows.select("doc_id", "bucket", "sign", F.lit(1).alias("cosine"))
        other = rows.filter("kinds = 1").select("doc_id", "bucket", (-F.col("sign")).alias("sign"), F.lit(-1).alias("cosine"))
        found = candidates.select("query_id", "doc_id").distinct().join(q, "query_id").join(same.unionByName(other), ["doc_id", "bucket", "sign"])
        sums = found.groupBy("query_id", "doc_id").agg(F.sum(F.col("qf") * F.col("cosine")).cast("double").alias("score"))
        return rank(candidates.join(sums, ["query_id", "doc_id"], "left").fillna(0.0, ["score"]), "score")
