"""4-bit and ternary quantization of vectors as relations (group, id, dim, x), per dimension of a group.

A group is one matrix: a whole table, or one document's tokens. Arithmetic is in single precision, step by step,
which decides half-way cases. Codes, scales and minima are columns, and dequantization needs nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

DELTA = 0.7


def _single(c: Column) -> Column:
    return c.cast("float")


def quantize_4bit(vectors: DataFrame, group: list[str]) -> DataFrame:
    """Adds low, scale and code (0 to 15)."""
    by = W.Window.partitionBy(*group, "dim")
    low, high = F.min(_single(F.col("x"))).over(by), F.max(_single(F.col("x"))).over(by)
    rows = vectors.withColumn("low", low).withColumn("high", high)
    scale = _single(_single(F.col("high") - F.col("low")) / F.lit(15.0))
    rows = rows.withColumn("scale", F.when(scale == 0, F.lit(1.0).cast("float")).otherwise(scale))
    code = F.bround(_single(_single(_single(F.col("x")) - F.col("low")) / F.col("scale")).cast("double"))
    return rows.withColumn("code", F.least(F.greatest(code, F.lit(0.0)), F.lit(15.0)).cast("int")).drop("high")


def dequantize_4bit(codes: DataFrame) -> DataFrame:
    return codes.withColumn("x", _single(_single(F.col("code").cast("float") * F.col("scale")) + F.col("low")))


def pack_4bit(codes: DataFrame, key: list[str]) -> DataFrame:
    """(key, byte, packed): two codes a byte, the even dimension in the low half."""
    return codes.groupBy(*key, (F.col("dim") / 2).cast("int").alias("byte")).agg(F.sum(F.when(F.col("dim") % 2 == 0, F.col("code")).otherwise(F.col("code") * 16)).cast("int").alias("packed"))


def unpack_4bit(packed: Column, dim: Column) -> Column:
    return F.when(dim % 2 == 0, packed.bitwiseAND(15)).otherwise(F.shiftright(packed, 4))


def quantize_ternary(vectors: DataFrame, group: list[str], delta: float = DELTA) -> DataFrame:
    """Adds scale, delta and code (-1, 0, 1)."""
    top = F.max(F.abs(_single(F.col("x")))).over(W.Window.partitionBy(*group, "dim"))
    rows = vectors.withColumn("scale", F.when(top == 0, F.lit(1.0).cast("float")).otherwise(top)).withColumn("delta", F.lit(delta).cast("float"))
    edge = _single(F.col("scale") * F.col("delta"))
    x = _single(F.col("x"))
    return rows.withColumn("code", F.when(x > edge, 1).when(x < -edge, -1).otherwise(0))


def dequantize_ternary(codes: DataFrame) -> DataFrame:
    return codes.withColumn("x", _single(_single(F.col("code").cast("float") * F.col("scale")) * F.col("delta")))


def quantize(vectors: DataFrame, group: list[str], mode: str = "none") -> DataFrame:
    """4bit, ternary, or unchanged for any other mode."""
    if mode == "4bit":
        return quantize_4bit(vectors, group)
    if mode == "ternary":
        return quantize_ternary(vectors, group)
    return vectors


def dequantize(codes: DataFrame, mode: str = "none") -> DataFrame:
    if mode == "4bit":
        return dequantize_4bit(codes)
    if mode == "ternary":
        return dequantize_ternary(codes)
    return codes


def memory_bytes(n: Column, d: Column, mode: str) -> Column:
    if mode == "4bit":
        return n * F.ceil(d / 2)
    return n * d * (1 if mode == "ternary" else 4)


def compression_ratio(n: Column, d: Column, mode: str) -> Column:
    return n * d * 4 / F.greatest(memory_bytes(n, d, mode), F.lit(1))
