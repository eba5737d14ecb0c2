"""Token ids as Parquet list columns, in ascending document order, with selective reads.

File format: one row per document with doc_id, n_tokens, part, local_start and ids (a list of 32-bit integers),
format version 2, all delta-encoded (about 17 bits an id for a 50k vocabulary; writing is a third faster than with a
dictionary). Row groups and pages have fixed target sizes, and page indexes are written, so that
a reader of a range of doc_ids touches only the pages of that range, and a reader of metadata never touches ids.

Documents are range-partitioned and sorted by doc_id and a hash of the text before they are encoded, at quantiles that
are read from the doc_id column alone (a repeated or null doc_id is cut at steps of the hash); a document's place among all ids
is its place in its part file plus the ids of the parts before, of which there is one row per part.

Defined cases: a null or empty text has only the end id; documents with equal doc_id are ordered by a hash of
their text; a null doc_id comes first; other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import by_range, join_small, partitions
from .encode import batches_of, encoder

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
#: Text that a task encodes at a time; its ids and their arrays are about ten times as large.
BATCH_BYTES = 6_000_000
SCHEMA = "doc_id bigint, part int, local_start bigint, n_tokens bigint, ids array<int>"


def parquet_options(row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> dict[str, object]:
    return {
        "compression": "snappy",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.enable.dictionary": "false",
    }


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> None:
    """Encode docs(doc_id, text) and write the token files to path."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = by_range(texts, "doc_id", F.xxhash64("text"), partitions(docs.sparkSession))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, start = encoder(tokenizer_file), 0
        for batch in batches:
            doc_ids, text = batch.column(0), batch.column(1)
            for a, b in batches_of(text, BATCH_BYTES):
                ids = of.encode(text.slice(a, b - a))
                n = np.fromiter(map(len, ids), np.int64, b - a) + 1
                ends = np.cumsum(n)
                end = np.asarray([end_id], "<u4")
                flat = np.concatenate([x for document in ids for x in (document, end)]).view("<i4")
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([doc_ids.slice(a, b - a), pa.array(start + ends - n), pa.array(n), lists], ["doc_id", "local_start", "n_tokens", "ids"])
                start += int(ends[-1])

    rows = ordered.mapInArrow(encode, "doc_id bigint, local_start bigint, n_tokens bigint, ids array<int>")
    rows.select("doc_id", F.spark_partition_id().alias("part"), "local_start", "n_tokens", "ids").write.options(**parquet_options(row_group_bytes, page_bytes)).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, part: the place of each document among all ids. Reads no ids."""
    return _placed(read_tokens(spark, path)).select("doc_id", "start", "n_tokens", "part")


def _placed(tokens: DataFrame) -> DataFrame:
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    return join_small(tokens, offsets, "part", "inner").withColumn("start", F.col("before") + F.col("local_start"))


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from the ids that the files hold."""

    def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            raw = memoryview(np.ascontiguousarray(values)).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _placed(tokens).select("doc_id", "start", "ids").mapInArrow(checksums, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
