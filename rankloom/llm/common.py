"""What the training-data operators share: shared storage, checked broadcasts, hot keys, ranges, row identity."""

from __future__ import annotations

import ctypes
import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if a count has shown at most this many (narrow) rows.
BROADCAST_ROWS = 10_000
SALTS = 32
#: A key with more rows than this, and than one in BROADCAST_ROWS of all rows, is hot.
HOT_ROWS = 256
#: Quantiles that make one expression; more partitions are dealt by Spark's own range partitioner, in the same order.
MOST_BOUNDS = 512
#: Bytes of rows that small_batches hands to a Python worker at once.
BATCH_BYTES = 3_500_000
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**options).parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    if _TEMPORARY:
        _TEMPORARY[-1].append(path)
    return staged


_TEMPORARY: list[list[str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def discard(*staged: DataFrame) -> None:
    """Delete tables that materialize wrote and nothing reads any more. What a lazy result reads must stay."""
    for df in staged:
        _delete(df.sparkSession, df.staged_path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that materialize writes inside are deleted at the end, but for those given to the function that this
    yields: what a lazy result reads."""
    paths: list[str] = []
    _TEMPORARY.append(paths)

    def keep(df: DataFrame) -> DataFrame:
        paths.remove(df.staged_path)
        if len(_TEMPORARY) > 1:
            _TEMPORARY[-2].append(df.staged_path)
        return df

    try:
        yield keep
    finally:
        _TEMPORARY.pop()
        for path in paths:
            _delete(spark, path)


def give_back() -> None:
    """Return what this Python worker has freed to the system, at the end of a task: Spark reuses workers, so an idle
    one would hold it while later stages need the memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """From now on this session hands rows to Python workers BATCH_BYTES at a time, one row at least, unless it has a limit
    of its own. Spark's 64 MB, twice as much while a buffer grows, are held by each running task's JVM side and by its
    worker, and the JVM keeps the rows of a batch until the worker has answered. No result depends on it."""
    if spark.conf.get(_ARROW_BYTES, str(BATCH_BYTES)) == str(BATCH_BYTES):
        spark.conf.set(_ARROW_BYTES, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_small(left: DataFrame, small: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join left with one row per key. The small side is counted; it is broadcast up to BROADCAST_ROWS. Beyond that
    left's rows are counted by key, and those of a hot key meet a broadcast of the hot keys' rows, at most BROADCAST_ROWS,
    where they are; rows without a key meet nothing and aren't shuffled. Nothing is dealt at random, so a task that is
    run again deals its rows as before."""
    if small.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(small), key, how)
    counts = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = materialize(counts.filter(F.col("n") > hot_from(total)).select(key), "hot-keys")
    broad = F.broadcast(small.join(F.broadcast(hot), key, "left_semi"))
    spread = left.filter(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left_anti").join(small.hint("merge"), key, how)
    joined = left.join(F.broadcast(hot), key, "left_semi").join(broad, key, how).unionByName(spread)
    return joined if how == "inner" else joined.unionByName(left.filter(F.col(key).isNull()), allowMissingColumns=True)


def hot_from(total: int) -> int:
    """A key with more rows than this, of total rows, is hot; at most BROADCAST_ROWS keys are."""
    return max(HOT_ROWS, total // BROADCAST_ROWS)


def join_counted(left: DataFrame, right: DataFrame, key: str, total: int, most: int | None = None) -> DataFrame:
    """Inner join of left, of about total rows, with right, which has one row for each key and in column n the number
    of left's rows with that key. Rows of a hot key stay where they are: their right side is broadcast, and there are at
    most BROADCAST_ROWS hot keys, since each has more than total / BROADCAST_ROWS of the rows. All other keys are
    shuffled, none of them with a large share. left is read twice, so it should be a staged table; once, if most, the
    greatest n, shows that no key is hot."""
    if most is not None and most <= hot_from(total):
        return left.join(right.hint("merge"), key)
    hot = F.col("n") > hot_from(total)
    broad = F.broadcast(right.filter(hot))
    spread = left.join(broad.select(key), key, "left_anti").join(right.filter(~hot).hint("merge"), key)
    return left.join(broad, key).unionByName(spread)


def join_hot(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """join_counted with the counts taken from left, a staged table; right has one row for each key, and no column n."""
    counts = left.groupBy(key).agg(F.count("*").alias("n"))
    total, most = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if most <= hot_from(total):
        return left.join(right, key)
    return join_counted(left, right.join(counts.hint("merge"), key), key, total).drop("n")


def by_range(rows: DataFrame, key: str, tie: Column, n: int, keys: DataFrame | None = None) -> DataFrame:
    """rows in n partitions by ascending (key, tie), nulls first, sorted inside. tie is a hash: a key with more rows
    than a partition should have is cut at equal steps of it. Bounds are quantiles of the key column alone; Spark's own
    range partitioner would read all columns once more, and takes over where the bounds would make too large an
    expression. keys: a narrow table of the key column, if rows are costly to compute."""
    rows = rows.withColumn("__tie", tie)
    k = F.coalesce(F.col(key), F.lit(-(1 << 63)))
    bounds = sorted((rows if keys is None else keys).agg(F.percentile_approx(k, [i / n for i in range(1, n)], 10_000)).first()[0] or []) if 1 < n <= MOST_BOUNDS else []
    if not bounds:
        return rows.repartitionByRange(n, key, "__tie").sortWithinPartitions(key, "__tie").drop("__tie")
    distinct = sorted(set(bounds))
    first = [bounds.index(b) for b in distinct]
    unit = (F.shiftrightunsigned("__tie", 12) / F.lit(float(1 << 52)) + 0.5) % 1  # ascending as the signed hash is

    def part(low: int, high: int) -> Column:
        """The partition of keys above distinct[low - 1] and up to distinct[high], or beyond all."""
        if low == high:
            slices = bounds.count(distinct[low]) if low < len(distinct) else 0
            if slices < 2:
                return F.lit(first[low] if slices else len(bounds))
            return F.when(k == distinct[low], first[low] + F.floor(unit * slices).cast("int")).otherwise(first[low])
        middle = (low + high) // 2
        return F.when(k <= distinct[middle], part(low, middle)).otherwise(part(middle + 1, high))

    return rows.repartitionById(n, part(0, len(distinct))).sortWithinPartitions(key, "__tie").drop("__tie")


def literal_table(spark: SparkSession, rows: list[tuple], types: dict[str, str]) -> DataFrame:
    """A few rows, a bounded parameter, read from one literal: no task of another kind makes them."""
    text = json.dumps([dict(zip(types, r, strict=True)) for r in rows])
    schema = f"array<struct<{', '.join(f'{n}: {t}' for n, t in types.items())}>>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), schema)).alias("r")).select("r.*")


def text_key(column: str) -> Column:
    """A never-null string for a nullable key: null and the empty string stay apart."""
    c = F.col(column).cast("string")
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v:"), c))


def unit52(*parts: Column) -> Column:
    """52 hash bits of the parts as a bigint: the first 13 hex digits of their md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("bigint")
