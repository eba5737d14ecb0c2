"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are reduced to distinct values first, so that exact copies never meet each other. Two
fingerprints at distance <= radius agree on at least one of radius + 1 bit blocks, so each distinct value
is dealt to one group for each block; nothing within the radius is lost. Groups are compared by tiles (see
tiles): a task sorts its tiles by population count, compares strips with numpy exclusive-or and bit counts,
skips strips whose population counts differ by more than the radius (their distance must exceed it), and
emits a spanning forest of the links that it found. Components come from alternating star contraction on
those links, checkpointed each round. A fingerprint or component with a large share of all rows is joined
by a broadcast whose size is bounded (common.join_counted).

near_duplicates links fingerprints at a radius. drop_near_duplicates, for texts, uses wide fingerprints of the
distinct shingles and checks their links on the shingles themselves (see similar).

Defined cases: null or empty text (no word) has fingerprint zero, linked like any other; fewer words than
the shingle make one shingle; repeated shingles count repeatedly; repeated rows with one doc_id all get
that document's component; rows with null doc_id take part and get the smallest non-null doc_id of their
component, or null if there is none; other columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tiles
from .common import join_counted, materialize, temporary

SEED = 42
SHINGLE = 4
RADIUS = 4
BITS = 64
TILE = 4096
STRIP = 512


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of the shingles of the lower-cased words, in order."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(len(words) - shingle + 1, 1)
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, n)


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one whole text."""
    return majority(shingle_hashes(text, shingle))


_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes; each of the eight bytes by a histogram of its 256 values."""
    if len(hashes) < 2:
        return int(hashes.sum())
    columns = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    out = 0
    if len(hashes) < 200:
        counts = np.unpackbits(columns, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(columns[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
    for bit in np.flatnonzero(counts * 2 > len(hashes)).tolist():
        out |= 1 << bit
    return out


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """A bigint column (two's complement) of the texts' fingerprints."""

    @F.pandas_udf(T.LongType())
    def simhash(texts: pd.Series) -> pd.Series:
        values = np.fromiter((fingerprint_of(t, shingle) for t in texts), np.uint64, len(texts))
        return pd.Series(values.view(np.int64))

    return simhash(text)


def _blocks(radius: int) -> list[tuple[int, int]]:
    """radius + 1 runs of bits that cover all 64: (first bit, number of bits)."""
    cuts = [round(i * BITS / (radius + 1)) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of all rows of a (rows, words) with all rows of b."""
    out = np.zeros((len(a), len(b)), np.uint16 if a.shape[1] > 3 else np.uint8)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


def spanning_links(values: np.ndarray, split: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (child, root), by numbers, that connect all fingerprints (rows, words) at distance <= radius. Those from
    split on are a second tile, compared with the first only; a split of all compares one tile with itself."""
    alone = split == len(values)
    pop = np.bitwise_count(values).sum(1, dtype=np.int64)
    halves = [np.arange(split)] if alone else [np.arange(split), np.arange(split, len(values))]
    halves = [h[np.argsort(pop[h], kind="stable")] for h in halves]
    a_side, b_side = halves[0], halves[-1]
    label = np.arange(len(values))
    for i in range(0, len(a_side), STRIP):
        a = a_side[i : i + STRIP]
        for j in range(i if alone else 0, len(b_side), STRIP):
            b = b_side[j : j + STRIP]
            if pop[b[0]] - pop[a[-1]] > radius or pop[a[0]] - pop[b[-1]] > radius:
                continue
            x, y = np.nonzero(distances(values[a], values[b]) <= radius)
            x, y = label[a[x]], label[b[y]]
            if not (apart := x != y).any():
                continue
            pairs = np.unique(np.stack([np.minimum(x[apart], y[apart]), np.maximum(x[apart], y[apart])]), axis=1)
            parent: dict[int, int] = {}
            for p, q in pairs.T.tolist():
                p, q = tiles.root(parent, p), tiles.root(parent, q)
                if p != q:
                    parent[max(p, q)] = min(p, q)
            to = np.arange(len(values))
            for p in list(parent):
                to[p] = tiles.root(parent, p)
            label = to[label]
    child = np.flatnonzero(label != np.arange(len(values)))
    return child, label[child]


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): a spanning set of the links between the distinct fingerprints of column fp."""
    runs = [F.xxhash64(F.lit(k), F.shiftrightunsigned("fp", first).bitwiseAND((1 << n) - 1)) for k, (first, n) in enumerate(_blocks(radius))]
    rows = materialize(distinct.select(F.col("fp").alias("key"), F.explode(F.array(*runs)).alias("grp")), "simhash-blocks")
    members = tiles.dealt(rows, rows.count(), F.ceil(F.count("*") / tile)).withColumn("value", F.col("key"))

    def compare(values: pa.Array, split: int) -> tuple[np.ndarray, np.ndarray]:
        return spanning_links(values.to_numpy().view(np.uint64)[:, None], split, radius)

    return tiles.forests(members, compare, "simhash")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, fingerprint (hex), component_id for every row of docs(doc_id, text)."""
    prints = materialize(docs.select("doc_id", fingerprints(F.col("text"), shingle).alias("fp")), "simhash")
    with temporary(docs.sparkSession) as keep:
        classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")), "simhash-classes")
        rows, total = classes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
        found = tiles.components(links(classes.select("fp"), radius))
        known = tiles.named(classes.withColumnRenamed("fp", "key"), found, total, F.min("least").alias("component_id"))
        known = keep(materialize(known.select(F.col("key").alias("fp"), F.col("size").alias("n"), "component_id"), "simhash-named"))
    return join_counted(prints, known, "fp", rows).select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """docs with one row of each group of texts so similar: SimHash with wide fingerprints, and an exact check."""
    from . import similar

    return similar.drop_near_duplicates(docs, shingle, least)
