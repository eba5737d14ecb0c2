"""One document of each group of texts whose word shingles have a Jaccard similarity of 0.8 or more, by SimHash.

Fingerprints of 64 bits can't tell such pairs from others: at 0.8 they differ in 10 bits on average, in 18 at times, as
do too many unrelated texts. So a text's fingerprint has WIDTH words here, from its distinct shingles, and its radius is
that below which nearly all pairs at 0.8 fall (a pair at exactly 0.8 exceeds it with a chance of 4e-6; computed for
independent bits). No such radius leaves bit blocks that two texts must share, so texts are dealt to groups by the
minima of their shingles under random permutations: BANDS groups of ROWS minima each, of which a pair at 0.8 shares none
with a chance of 3e-5. Inside the groups fingerprints are compared by SimHash's tiles. Components of the links found hold
every candidate pair; in them, by tiles again, all pairs are compared by their whole shingle sets, so that clean texts
stay, and the links that remain make the final components.

Defined cases: null or empty text (no word) is one class; texts with equal words are one class; fewer words than the
shingle make one shingle; repeated shingles count once. Of a component the row with the smallest doc_id stays, of equal
ones that with the smallest text hash, then row hash, and one of wholly equal rows; null doc_ids come after all others.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tiles
from .common import give_back, join_counted, materialize, temporary
from .simhash import BITS, SEED, TILE, majority, shingle_hashes, spanning_links

SHINGLE = 5
LEAST = 0.8
WIDTH = 4
BANDS, ROWS = 20, 4
#: Texts of a tile of the exact check, and their bytes (one text at least).
SET_TILE, SET_BYTES = 256, 4 << 20
STRIP = 128
COLUMNS = 4096
_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def radius_for(least: float, bits: int = WIDTH * BITS) -> int:
    """Differing bits that a pair at this similarity exceeds by 4.5 standard deviations at most."""
    p = np.arccos(2 * least / (1 + least)) / np.pi
    return int(np.ceil(bits * p + 4.5 * np.sqrt(bits * p * (1 - p))))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the text's shingles, ascending."""
    return np.unique(shingle_hashes(text, shingle))


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """WIDTH words of 64 bits: the SimHash of the hashes, and of further mixtures of them."""
    out = []
    for k in range(WIDTH):
        h = hashes + np.uint64((k * 0x9E3779B97F4A7C15) % (1 << 64))
        if k:
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
        out.append(majority(h))
    return np.asarray(out, "<u8").tobytes()


def minima(hashes: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        out = np.minimum(out, (hashes[i : i + 2048, None] * _TIMES + _PLUS).min(0))
    return out


def _prints(text: Column, shingle: int) -> Column:
    """key: a hash of the words; fp: the wide fingerprint; groups: the bands' hashes."""

    @F.pandas_udf(T.StructType().add("key", T.LongType()).add("fp", T.BinaryType()).add("groups", T.ArrayType(T.LongType())))
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        for texts in batches:
            keys, fps, groups = [], [], []
            for t in texts:
                keys.append(xxh64_intdigest(b" ".join((t or "").encode().lower().split()), SEED))
                h = shingles(t, shingle)
                fps.append(wide_fingerprint(h))
                least = minima(h)
                groups.append(np.asarray([xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64))
            yield pd.DataFrame({"key": np.asarray(keys, np.uint64).view(np.int64), "fp": fps, "groups": groups})
        give_back()

    return prints.asNondeterministic()(text)


def similar_sets(sets: list[np.ndarray], least: float, a: slice, b: slice) -> np.ndarray:
    """Which pairs have a Jaccard similarity of least or more; counts of shared shingles by products of 0/1 blocks."""
    sides = [sets[s] for s in (a, b)]
    sizes = [np.fromiter(map(len, side), np.int64, len(side)) for side in sides]
    flat = [np.concatenate(side) for side in sides]
    owner = [np.repeat(np.arange(len(n)), n) for n in sizes]
    common = np.intersect1d(*map(np.unique, flat), assume_unique=True)
    shared = np.zeros((len(sides[0]), len(sides[1])), np.float32)
    at = [np.searchsorted(common, x) for x in flat]
    for i in range(2):
        held = at[i] < len(common)
        held[held] = common[at[i][held]] == flat[i][held]
        at[i], owner[i] = at[i][held], owner[i][held]
    for first in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - first)
        block = []
        for i in range(2):
            inside = (at[i] >= first) & (at[i] < first + width)
            block.append(np.zeros((len(sides[i]), width), np.float32))
            block[i][owner[i][inside], at[i][inside] - first] = 1
        shared += block[0] @ block[1].T
    either = sizes[0][:, None] + sizes[1][None, :] - shared
    return (either == 0) | (shared >= least * either - 1e-6)


def spanning_sets(sets: list[np.ndarray], split: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links, by numbers, that connect all sets at least so similar; split as in simhash.spanning_links."""
    n, alone = len(sets), split == len(sets)
    parent: dict[int, int] = {}
    found = []
    for i in range(0, split, STRIP):
        for j in range(i if alone else split, n, STRIP):
            a, b = slice(i, min(i + STRIP, split)), slice(j, min(j + STRIP, n))
            if len({tiles.root(parent, x) for s in (a, b) for x in range(s.start, s.stop)}) == 1:
                continue
            x, y = np.nonzero(similar_sets(sets, least, a, b))
            for p, q in zip((x + i).tolist(), (y + j).tolist(), strict=True):
                v, w = tiles.root(parent, p), tiles.root(parent, q)
                if v != w:
                    parent[max(v, w)] = min(v, w)
                    found.append((p, q))
    return tuple(np.asarray(found, np.int64).reshape(-1, 2).T)


def candidates(classes: DataFrame, total: int, radius: int, tile: int) -> DataFrame:
    """(key, grp, bytes): components of the classes whose fingerprints lie within the radius."""
    rows = materialize(classes.select("key", F.explode("groups").alias("grp")), "similar-bands")
    values = classes.select("key", F.col("fp").alias("value"))
    members = tiles.dealt(rows, BANDS * total, F.ceil(F.count("*") / tile)).join(values.hint("merge"), "key")

    def compare(values: pa.Array, split: int) -> tuple[np.ndarray, np.ndarray]:
        prints = np.frombuffer(b"".join(values.to_pylist()), "<u8").reshape(len(values), WIDTH)
        return spanning_links(prints, split, radius)

    tree = tiles.components(tiles.forests(members, compare, "similar-candidates"))
    both = tree.select(F.col("node").alias("key"), F.col("root").alias("grp")).unionByName(tree.select(F.col("root").alias("key"), F.col("root").alias("grp")).distinct())
    return materialize(both.join(classes.select("key", "bytes").hint("merge"), "key"), "similar-groups")


def _row(docs: DataFrame) -> Column:
    return F.xxhash64(*[F.col(c) for c in docs.columns]).alias("__row")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST, tile: int = TILE) -> DataFrame:
    """One row for each distinct row of docs(doc_id, text, ...): __row, a hash of its columns; copies, how often it is
    there; doc_id; key, a hash of its words; and root, its component."""
    texts = docs.select(_row(docs), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    prints = texts.select("__row", "doc_id", F.octet_length("text").cast("long").alias("bytes"), _prints(F.col("text"), shingle).alias("p"))
    prints = materialize(prints.select("__row", "doc_id", "bytes", "p.*"), "similar-prints")
    rows = materialize(prints.groupBy("__row").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), F.count("*").alias("copies")), "similar-rows")
    classes = prints.groupBy("key").agg(F.max("bytes").alias("bytes"), F.min("fp").alias("fp"), F.min("groups").alias("groups"))
    classes = materialize(classes, "similar-classes")
    total, n_rows = classes.count(), rows.count()
    groups = candidates(classes, total, radius_for(least), tile)
    set_tiles = F.greatest(F.ceil(F.count("*") / min(tile, SET_TILE)), F.ceil(F.sum("bytes") / SET_BYTES))
    members = tiles.dealt(groups, total, set_tiles).select("key", "grp", "tiles", "tile")
    # the row with the smallest hash brings its class's text
    members = members.join(rows.groupBy("key").agg(F.min("__row").alias("__row")).hint("merge"), "key")
    bearers = materialize(rows.select("__row", F.col("copies").alias("n")).join(members.hint("merge"), "__row", "left"), "similar-bearers")
    some = join_counted(texts.select("__row", F.col("text").alias("value")), bearers, "__row", n_rows).filter("key IS NOT NULL")
    some = some.dropDuplicates(["key"]) if rows.filter("copies > 1").limit(1).count() else some

    def compare(values: pa.Array, split: int) -> tuple[np.ndarray, np.ndarray]:
        return spanning_sets([shingles(t, shingle) for t in values.to_pylist()], split, least)

    found = tiles.components(tiles.forests(some, compare, "similar"))
    known = tiles.named(classes.select("key"), found, total).select("key", "root")
    known = materialize(known.join(rows.groupBy("key").agg(F.count("*").alias("n")).hint("merge"), "key"), "similar-named")
    return join_counted(rows, known, "key", n_rows).select("__row", "copies", "doc_id", "key", "root")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """docs with one row of each component."""
    with temporary(docs.sparkSession) as keep_table:
        found = materialize(near_duplicates(docs, shingle, least), "similar-found")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "__row")).alias("first")
        keep = found.groupBy("root").agg(first).select(F.col("first.__row").alias("__row"), F.lit(True).alias("keep"))
        marks = keep_table(materialize(found.select("__row", F.col("copies").alias("n")).join(keep.hint("merge"), "__row", "left"), "similar-marks"))
    hashed = docs.withColumn("__row", _row(docs))
    rows, repeated = marks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n") > 1, F.lit(False))).first()
    kept = join_counted(hashed, marks, "__row", rows).filter("keep")
    return (kept.dropDuplicates(["__row"]) if repeated else kept).select(docs.columns)
