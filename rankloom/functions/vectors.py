"""Hashed embeddings as sparse relations, and vector arithmetic on sparse relations and arrays.

A text's vector is the bag of its tokens' hash buckets, each with the token's sign. So vectors are rows
(id, bucket, w), products are equi-joins on bucket, and every distinct token is hashed once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import few, spread, stage
from .text import unicode_tokens

DIMENSION = 256


def _byte(hexes: Column, i: int) -> Column:
    return F.conv(F.substring(hexes, 2 * i + 1, 2), 16, 10).cast("bigint")


def token_hash(token: Column) -> Column:
    """The first four bytes of SHA-256, little-endian."""
    h = F.sha2(token, 256)
    return _byte(h, 0) + _byte(h, 1) * 256 + _byte(h, 2) * 65536 + _byte(h, 3) * 16777216


def token_bucket(token: Column, dimension: int = DIMENSION) -> Column:
    """The hash modulo the dimension."""
    return (token_hash(token) % dimension).cast("int")


def token_sign(token: Column) -> Column:
    """+1 if the fifth byte of SHA-256 is even, else -1."""
    return F.when(_byte(F.sha2(token, 256), 4) % 2 == 0, F.lit(1)).otherwise(F.lit(-1))


def token_rows(texts: DataFrame, key: str, text: str, tokens=unicode_tokens) -> DataFrame:
    """(key, token, tf) of all texts."""
    return texts.select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def hashed_vocabulary(rows: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """(token, bucket, sign): each distinct token hashed once."""
    return rows.select("token").distinct().select("token", token_bucket(F.col("token"), dimension).alias("bucket"), token_sign(F.col("token")).alias("sign"))


def embed(texts: DataFrame, key: str, text: str, dimension: int = DIMENSION, normalize: bool = True) -> DataFrame:
    """(key, bucket, w), without zeros; normalised to length 1 (an all-zero vector has no rows)."""
    rows = token_rows(texts, key, text)
    counts = rows.join(hashed_vocabulary(rows, dimension), "token").groupBy(key, "bucket").agg(F.sum(F.col("tf") * F.col("sign")).alias("n")).filter("n <> 0")
    if not normalize:
        return counts.select(key, "bucket", F.col("n").cast("double").alias("w"))
    return unit(counts.select(key, "bucket", F.col("n").cast("double").alias("w")), key)


def embed_grid(texts: DataFrame, key: str, text: str, dimensions: list[int]) -> DataFrame:
    """(dimension, key, bucket, w): unit vectors of several dimensions, from one pass over the tokens. Every distinct token is
    hashed once; sums of the whole hash are folded into each dimension's buckets."""
    rows = token_rows(texts, key, text)
    hashed = rows.select("token").distinct().select("token", token_hash(F.col("token")).alias("h"), token_sign(F.col("token")).alias("sign"))
    whole = rows.join(hashed, "token").groupBy(key, "h").agg(F.sum(F.col("tf") * F.col("sign")).alias("n"))
    each = whole.withColumn("dimension", F.explode(F.array(*map(F.lit, dimensions))))
    counts = each.groupBy("dimension", key, (F.col("h") % F.col("dimension")).cast("int").alias("bucket")).agg(F.sum("n").cast("double").alias("n")).filter("n <> 0")
    norms = counts.groupBy("dimension", key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norms, ["dimension", key]).select("dimension", key, "bucket", (F.col("n") / F.col("norm")).alias("w"))


def unit(vectors: DataFrame, key: str) -> DataFrame:
    norms = vectors.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return vectors.join(norms, key).select(key, "bucket", (F.col("w") / F.col("norm")).alias("w"))


def dot(pairs: DataFrame, left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """pairs(left_key, right_key) with dot: the product of their sparse vectors (0 without a common bucket)."""
    a = left.select(left_key, "bucket", F.col("w").alias("wa"))
    b = right.select(right_key, "bucket", F.col("w").alias("wb"))
    products = pairs.select(left_key, right_key).distinct().join(a, left_key).join(b, [right_key, "bucket"]).groupBy(left_key, right_key).agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    return pairs.join(products, [left_key, right_key], "left").withColumn("dot", F.coalesce("dot", F.lit(0.0)))


def clipped(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def l2_distance(a2: Column, b2: Column, product: Column) -> Column:
    """Distance from squared lengths and the inner product."""
    return F.sqrt(F.greatest(F.lit(0.0), a2 + b2 - 2 * product))


def positive_bits(vectors: DataFrame, key: str) -> DataFrame:
    """(key, bits): the buckets whose component is positive."""
    return vectors.filter("w > 0").groupBy(key).agg(F.sort_array(F.collect_set("bucket")).alias("bits"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two sets of positive buckets."""
    return F.size(a) + F.size(b) - 2 * F.size(F.array_intersect(a, b))


def dense_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_bits(v: Column) -> Column:
    """Bit array of v > 0."""
    return F.transform(v, lambda x: (x > 0).cast("int"))


def dense_hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def minhash(gram: Column, permutation: Column) -> Column:
    """A gram's hash under a permutation: 16 hex digits, which sort like the unsigned number."""
    return F.substring(F.sha2(F.concat(gram, F.lit("|"), permutation.cast("string")), 256), 1, 16)


#: A signature starts at the greatest signed 64-bit number.
SENTINEL = "7fffffffffffffff"


#: Grams whose hashes a worker remembers, and grams of a batch that are looked up at once.
REMEMBERED, STRETCH = 65_536, 8_192
_HASHES: dict[int, tuple[dict[str, int], np.ndarray]] = {}


def _gram_hashes(grams: list[str], permutations: int) -> np.ndarray:
    """The hashes of distinct grams, one row each; a worker hashes a gram again only when its table has been full."""
    if permutations not in _HASHES or len(_HASHES[permutations][0]) + len(grams) > REMEMBERED:
        _HASHES[permutations] = {}, np.empty((REMEMBERED, permutations), np.uint64)
    places, hashes = _HASHES[permutations]
    ends = [b"|%d" % p for p in range(permutations)]
    for gram in grams:
        if gram not in places:
            text = gram.encode()
            heads = b"".join([hashlib.sha256(text + end).digest()[:8] for end in ends])
            hashes[len(places)] = np.frombuffer(heads, ">u8")
            places[gram] = len(places)
    return hashes[[places[gram] for gram in grams]]


def _signatures(grams: pa.ListArray, permutations: int) -> pa.ListArray:
    """Of each list its signature, in stretches of the batch, so that memory is bounded for any text; none: null."""
    offsets = grams.offsets.to_numpy()
    flat, offsets = grams.flatten(), offsets - offsets[0]
    least = np.full((len(grams), permutations), int(SENTINEL, 16), np.uint64)
    for start in range(0, len(flat), STRETCH):
        coded = flat.slice(start, STRETCH).dictionary_encode()
        codes, hashes = coded.indices.to_numpy(), _gram_hashes(coded.dictionary.to_pylist(), permutations)
        first = np.searchsorted(offsets, start, "right") - 1
        last = np.searchsorted(offsets, start + len(codes), "left")
        for row in range(first, last):
            own = codes[max(offsets[row] - start, 0) : max(offsets[row + 1] - start, 0)]
            if len(own):
                np.minimum(least[row], hashes[own].min(axis=0), out=least[row])
    some = np.diff(offsets) > 0
    least = least[some]
    entries = pa.StringArray.from_buffers(least.size, pa.py_buffer(np.arange(0, 16 * least.size + 1, 16, np.int32)), pa.py_buffer(least.astype(">u8").tobytes().hex().encode()))
    ends = np.concatenate([[0], np.cumsum(some)]) * permutations
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), entries, mask=pa.array(~some))


def signature(grams: Column, permutations: int = 128) -> Column:
    """The minhashes of an array of grams, by permutation; null without grams. Made where the text lies: as rows, a text
    would be shuffled once for each of its grams and permutations."""

    @F.arrow_udf("array<string>")
    def of_batch(batch: pa.Array) -> pa.Array:
        return _signatures(batch, permutations)

    return of_batch(F.coalesce(grams, F.array().cast("array<string>")))


def _by_repeats(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key occurs once, and the others, if any."""
    several = few(stage(rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(F.col(key).alias("__repeated")), "repeated-keys"))
    if several.isEmpty():
        return rows, None
    same = F.col(key).eqNullSafe(F.col("__repeated"))
    return rows.join(several, same, "left_anti"), rows.join(several, same, "left_semi")


def minhash_signatures(texts: DataFrame, key: str, grams: Column, permutations: int = 128) -> DataFrame:
    """(key, perm, h) for texts with grams; only texts that share a key are merged by a shuffle."""
    once, more = _by_repeats(spread(texts), key)
    rows = lambda part: part.select(key, signature(grams, permutations).alias("signature")).select(key, F.posexplode("signature").alias("perm", "h"))
    return rows(once) if more is None else rows(once).unionByName(rows(more).groupBy(key, "perm").agg(F.min("h").alias("h")))


def minhash_jaccard(pairs: DataFrame, left_key: str, left: Column, right_key: str, right: Column, permutations: int = 128) -> DataFrame:
    """pairs(left_key, right_key, ...), one key for both sides of a row, with lsh_score of the grams of both sides; the
    texts of one key count as one."""
    once, more = _by_repeats(spread(pairs), left_key)
    signed = once.withColumn("__a", signature(left, permutations)).withColumn("__b", signature(right, permutations))
    equal = F.size(F.filter(F.zip_with("__a", "__b", lambda x, y: x == y), lambda x: x)) / permutations
    score = F.when(F.col(left_key).isNotNull() & F.col("__a").isNotNull() & F.col("__b").isNotNull(), equal).otherwise(F.lit(0.0))
    out = signed.withColumn("lsh_score", score).drop("__a", "__b")
    if more is None:
        return out
    a, b = minhash_signatures(more, left_key, left, permutations), minhash_signatures(more, right_key, right, permutations)
    return out.unionByName(signature_jaccard(more, a, left_key, b, right_key, permutations))


def signature_jaccard(pairs: DataFrame, left: DataFrame, left_key: str, right: DataFrame, right_key: str, permutations: int = 128) -> DataFrame:
    """pairs with lsh_score: the share of equal signature entries; 0 if a side has no grams."""
    a, b = left.select(left_key, "perm", "h"), right.select(right_key, "perm", F.col("h").alias("hb"))
    equal = pairs.select(left_key, right_key).distinct().join(a, left_key).join(b, [right_key, "perm"]).groupBy(left_key, right_key).agg((F.sum((F.col("h") == F.col("hb")).cast("int")) / permutations).alias("lsh_score"))
    return pairs.join(equal, [left_key, right_key], "left").withColumn("lsh_score", F.coalesce("lsh_score", F.lit(0.0)))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def content_key(*parts: Column) -> Column:
    """16 hex digits of SHA-256."""
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 16)


def multiset_key(text: Column) -> Column:
    """An aggregate: 16 hex digits for a group of texts, whatever their order; only a sum and a count are kept."""
    number = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return content_key(F.sum(number).cast("string"), F.count("*").cast("string"))
