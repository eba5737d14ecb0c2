"""Exact top-k inner products by a vector-approximation file.

Vectors are integers, floor(256 * x). They are dealt by hash to blocks; a block's approximation file has, for each
dimension, a grid of CELLS equal cells between the block's own least and greatest value, and one byte a component: the
cell. A query's inner product with any point of a cell box lies within sums of products with the boxes' middles and
half widths, so scanning one block gives every candidate an upper and a lower bound. Files are scanned in groups; a
candidate survives its group if its upper bound reaches the k-th greatest lower bound there, and survives altogether if
it reaches that of all groups. Exact vectors are then read in order of the upper bounds: first READ_FIRST a query; then
only those whose upper bound still reaches the k-th exact score found, after which the result is certain.

A unit of work is a group of files, of up to GROUP_BYTES, against a part of up to QUERY_PART queries. Files are copied
once for each part of the queries, a fiftieth of the rows by the contract, and queries once for each group; both sides are
dealt by these numbers, and neither is gathered or broadcast. Survivors of one query are never brought together: the first
ones are picked with partial limits, and a query's bounds are joined to its survivors where they are if they are many.

Defined cases: vectors that are null or hold null or non-finite components, and rows without vec_id, take no part;
components beyond 2^200 in integer form count as 2^200, and scores that no 64-bit integer holds as the nearest one;
rows with one vec_id are one vector (the smallest in array order); vectors meet those of equal length only; equal
scores go to the smaller vec_id; long vectors (2^31 or more) lie in files of their own, lest they coarsen the cells of
others, and their products are exact integers of any size; fewer than k candidates are all returned; other columns are not looked at; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import join_hot, materialize, partitions

K = 5
SCALE = 256
CELLS = 64
BLOCK = 4096
GROUP_BYTES, GROUP_BLOCKS = 32 << 20, 64
QUERY_PART = 8192
#: Queries that are scanned at a time.
QUERY_STEP = 512
READ_FIRST = 12
LONG = float(1 << 31)
GREATEST = float(1 << 200)
LEAST_SCORE, MOST_SCORE = -(1 << 63), (1 << 63) - 1


def integer_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """id, v (array<double>, of whole numbers), dim and long, from rows(vec_id, embedding)."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(~bad)
    held = lambda x: F.greatest(F.lit(-GREATEST), F.least(F.lit(GREATEST), x))
    floor = lambda y: F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)  # noqa: E731 - beyond, doubles are whole
    whole = F.transform("embedding", lambda x: held(floor(F.lit(float(scale)) * x.cast("double"))))
    good = good.select(F.col("vec_id").cast("bigint").alias("id"), whole.alias("v")).groupBy("id").agg(F.min("v").alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return good.withColumn("dim", F.size("v")).withColumn("long", square >= LONG * LONG)


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    rows = table.column("v").combine_chunks()
    return ids[order], rows.flatten().to_numpy().reshape(len(ids), -1)[order]


def _approximate(table: pa.Table) -> pa.Table:
    ids, v = _matrix(table)
    low = v.min(0).astype(np.float64)
    width = np.maximum((v.max(0) - low) / CELLS, 1e-9)
    cells = np.clip(np.floor((v - low) / width), 0, CELLS - 1).astype(np.uint8)
    one = {"dim": table.column("dim")[0].as_py(), "block": table.column("block")[0].as_py(), "ids": ids.tobytes(), "low": low.tobytes(), "width": width.tobytes(), "cells": cells.tobytes()}
    return pa.Table.from_pylist([one], pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("ids", pa.binary()), ("low", pa.binary()), ("width", pa.binary()), ("cells", pa.binary())]))


def _exact(table: pa.Table) -> pa.Table:
    ids, v = _matrix(table)
    one = {"dim": table.column("dim")[0].as_py(), "part": table.column("part")[0].as_py(), "query_ids": ids.tobytes(), "queries": v.tobytes()}
    return pa.Table.from_pylist([one], pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("query_ids", pa.binary()), ("queries", pa.binary())]))


def bounds(queries: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray) -> Iterator[np.ndarray]:
    """Lower and upper bounds of the inner products of all queries with all approximated vectors."""
    middle = queries @ (low + (cells + 0.5) * width).T
    slack = np.abs(queries) @ (width / 2) * (1 + 1e-9) + 1e-9 * (np.abs(queries) @ (np.abs(low) + CELLS * width)) + 1e-6
    return (np.clip(x, float(LEAST_SCORE), float(MOST_SCORE)) for x in (middle - slack[:, None], middle + slack[:, None]))


def _scan(k: int):
    def scan(files: pa.Table, asked: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2]
        for r in asked.to_pylist():
            query_ids = np.frombuffer(r["query_ids"], np.int64)
            queries = np.frombuffer(r["queries"], np.float64).reshape(len(query_ids), r["dim"])
            for first in range(0, len(query_ids), QUERY_STEP):
                found.append(_survivors(files, query_ids[first : first + QUERY_STEP], queries[first : first + QUERY_STEP], k))
        return pa.table([np.concatenate(x) for x in zip(*found, strict=True)], names=["query_id", "vec_id", "lower", "upper"])

    return scan


def _survivors(files: pa.Table, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """query_id, vec_id, lower, upper of candidates that reach the k-th greatest lower bound of all these files."""
    best = np.full((len(query_ids), k), -np.inf)  # the k greatest lower bounds so far
    found = []
    for i in range(files.num_rows):
        ids, cells, low, width = (np.frombuffer(files.column(c)[i].as_py(), t) for c, t in (("ids", np.int64), ("cells", np.uint8), ("low", np.float64), ("width", np.float64)))
        lower, upper = bounds(queries, low, width, cells.reshape(len(ids), -1))
        own = query_ids[:, None] == ids[None, :]
        lower[own], upper[own] = -np.inf, -np.inf
        both = np.concatenate([best, lower], axis=1)
        best = -np.partition(-both, k - 1, axis=1)[:, :k]
        q, c = np.nonzero((upper >= best.min(1)[:, None]) & ~own)
        found.append((q, ids[c], lower[q, c], upper[q, c]))
    q, c, lower, upper = (np.concatenate(x) for x in zip(*found, strict=True))
    alive = upper >= best.min(1)[q]
    return query_ids[q[alive]], c[alive], lower[alive], upper[alive]


@F.pandas_udf(T.LongType())
def _whole_product(a: pd.Series, b: pd.Series) -> pd.Series:
    """Exact inner products of whole numbers of any size, held to 64 bits."""
    exact = (sum(int(x) * int(y) for x, y in zip(v, w, strict=True)) for v, w in zip(a, b, strict=True))
    return pd.Series([min(max(s, LEAST_SCORE), MOST_SCORE) for s in exact], dtype="int64")


def _scores(pairs: DataFrame, vectors: DataFrame, queries: DataFrame, rare: bool) -> DataFrame:
    """pairs, a staged table, with score. rare: whether there are long vectors."""
    named = materialize(join_hot(pairs, vectors.select(F.col("id").alias("vec_id"), "v"), "vec_id"), "va-named")
    named = join_hot(named, queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: a.cast("bigint") * b.cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    if rare:
        # by Cauchy and Schwarz two vectors below LONG have a product, and partial sums, that a long holds
        named = named.withColumn("__rare", F.exists(F.array("q", "v"), lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y * y) >= LONG * LONG))
        split = [named.filter("__rare").withColumn("score", _whole_product("q", "v")), named.filter("NOT __rare").withColumn("score", product)]
        return split[0].unionByName(split[1]).select("query_id", "vec_id", "upper", "score")
    return named.select("query_id", "vec_id", "upper", product.alias("score"))


def _first(rows: DataFrame, by: str, n: int) -> DataFrame:
    """The first n rows of each query, with their place; the limit acts in each task before the shuffle."""
    order = W.Window.partitionBy("query_id").orderBy(F.desc(by), "vec_id")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def top_k(rows: DataFrame, is_query: str, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a condition on vec_id (named id there)."""
    vectors = materialize(integer_vectors(rows, scale), "vectors")
    queries = vectors.filter(is_query)
    n, m = vectors.count(), queries.count()
    dim, rare = vectors.agg(F.coalesce(F.max("dim"), F.lit(1)), F.coalesce(F.max("long"), F.lit(False))).first()
    blocks, parts = max(1, -(-n // BLOCK)), max(1, -(-m // QUERY_PART))
    fewest = -(-2 * partitions(rows.sparkSession) // parts)  # groups that keep all tasks busy
    together = max(1, min(GROUP_BLOCKS, GROUP_BYTES // (BLOCK * max(dim, 1)), blocks // fewest))
    groups = -(-blocks // together)
    files = vectors.withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int")).groupBy("dim", "long", "block").applyInArrow(_approximate, "dim int, block int, ids binary, low binary, width binary, cells binary")
    asked = queries.withColumn("part", F.pmod(F.xxhash64("id", F.lit("query")), F.lit(parts)).cast("int")).groupBy("dim", "part").applyInArrow(_exact, "dim int, part int, query_ids binary, queries binary")
    files = materialize(files, "va-files").withColumn("grp", F.col("block") % groups).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = materialize(asked, "va-queries").withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    work = files.groupBy("dim", "part", "grp").cogroup(asked.groupBy("dim", "part", "grp"))
    alive = materialize(work.applyInArrow(_scan(k), "query_id long, vec_id long, lower double, upper double"), "va-alive")
    kth = _first(alive, "lower", k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("lower")).otherwise(F.lit(float("-inf"))).alias("kth"))
    alive = materialize(join_hot(alive, kth, "query_id").filter("upper >= kth").select("query_id", "vec_id", "upper"), "va-survivors")
    first = materialize(_first(alive, "upper", max(READ_FIRST, k)), "va-first")
    read = materialize(_scores(first.select("query_id", "vec_id", "upper"), vectors, queries, rare), "va-read")
    kth = _first(read, "score", k).groupBy("query_id").agg(F.min("score").alias("kth"))
    last = first.groupBy("query_id").agg(F.max_by(F.struct("upper", "vec_id"), "place").alias("last"))
    unread = (F.col("upper") < F.col("last.upper")) | ((F.col("upper") == F.col("last.upper")) & (F.col("vec_id") > F.col("last.vec_id")))
    rest = join_hot(alive, kth.join(last, "query_id"), "query_id").filter(unread & (F.col("upper") >= F.col("kth")))
    rest = materialize(rest.select("query_id", "vec_id", "upper"), "va-rest")
    scored = read.unionByName(_scores(rest, vectors, queries, rare))
    return _first(scored, "score", k).select("query_id", F.col("place").alias("rank"), "vec_id", "score")


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
