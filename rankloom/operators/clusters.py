"""Seeded k-means over sparse vectors, the same on every run and any layout of partitions.

Seeding: from the point with the smallest hash, rounds take every point whose hashed uniform number is below its share of
all squared distances times OVER * k, so expected OVER * k points a round; each taken point weighs as many points as
are nearest to it, and the driver picks k of them, each time the one whose weighed squared distance to those picked is
greatest. Then rounds assign each point to its nearest centre and take means, until no point moves.

Points are rows (id, bucket, w); a round joins them with the centres' buckets, at most k * dimension broadcast rows, and sums by
point and centre. The driver holds centres and candidates only: their number depends on k, not on the points.

Defined cases: a point without rows is the zero vector; ties go to the smaller centre number, and in the choice of a
centre's point to the smaller id; a centre without points stays where it is and has no nearest one; with fewer distinct
points than k there are as many centres as distinct points that were taken.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..session import discard, stage

ROUNDS = 20
SEEDING = 4
OVER = 2


def _uniform(seed: int, purpose: str, key: Column) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _distances(points: DataFrame, vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """id, n2, nearest and d (its squared distance) of points(id, n2) and vectors(id, bucket, w)."""
    spark = points.sparkSession
    entries = [(int(c), int(b), float(centres[c, b])) for c, b in zip(*np.nonzero(centres), strict=True)]
    table = F.broadcast(spark.createDataFrame(entries, "centre int, bucket int, x double"))
    dots = vectors.join(table, "bucket").groupBy("id", "centre").agg(F.sum(F.col("w") * F.col("x")).alias("dot"))
    dots = dots.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("centre", "dot"))).alias("dots"))
    norms = F.array(*[F.lit(float(x)) for x in (centres * centres).sum(1)])
    each = F.transform(norms, lambda n, c: F.struct(F.round(F.greatest(F.col("n2") + n - 2 * F.coalesce(F.try_element_at("dots", c.cast("int")), F.lit(0.0)), F.lit(0.0)), 9).alias("d"), c.cast("int").alias("c")))
    return points.join(dots, "id", "left").withColumn("best", F.array_min(each)).select("id", "n2", F.col("best.c").alias("nearest"), F.col("best.d").alias("d"))


def _dense(rows: DataFrame, key: str, dimension: int) -> dict:
    """Vectors of a bounded number of keys."""
    out: dict = {}
    for k, b, w in rows.select(key, "bucket", "w").collect():
        out.setdefault(k, np.zeros(dimension))[b] = w
    return out


def _spread_out(candidates: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    chosen = [int(np.argmax(weights))]
    far = ((candidates - candidates[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(k, len(candidates)):
        best = int(np.argmax(np.round(weights * far, 9)))
        if far[best] < 1e-12:
            break
        chosen.append(best)
        far = np.minimum(far, ((candidates - candidates[best]) ** 2).sum(1))
    return candidates[chosen]


def seeds(points: DataFrame, vectors: DataFrame, k: int, dimension: int, seed: int) -> np.ndarray:
    first = points.orderBy(_uniform(seed, "first", F.col("id")), "id").limit(1).collect()
    ids = [first[0].id]
    found = _dense(vectors.filter(F.col("id").isin(ids)), "id", dimension)
    for i in range(SEEDING):
        near = _distances(points, vectors, np.stack([found.get(x, np.zeros(dimension)) for x in ids]))
        total = near.agg(F.sum("d")).first()[0]
        if not total:
            break
        taken = near.filter(_uniform(seed, f"round {i}", F.col("id")) < F.col("d") * float(OVER * k) / float(round(total, 6))).select("id")
        new = sorted(r.id for r in taken.collect())
        ids += new
        found |= _dense(vectors.filter(F.col("id").isin(new)), "id", dimension)
    candidates = np.stack([found.get(x, np.zeros(dimension)) for x in ids])
    held = {r.nearest: r.n for r in _distances(points, vectors, candidates).groupBy("nearest").agg(F.count("*").alias("n")).collect()}
    return _spread_out(candidates, np.asarray([held.get(i, 0) for i in range(len(ids))], float), k)


def k_means(points: DataFrame, vectors: DataFrame, k: int, dimension: int, seed: int = 42, rounds: int = ROUNDS) -> tuple[np.ndarray, DataFrame]:
    """Centres, and the staged (id, n2, nearest, d) of all points(id), whose vectors are (id, bucket, w)."""
    vectors = stage(vectors.select("id", "bucket", "w"), "cluster-vectors", "id")
    norms = vectors.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("n2"))
    points = stage(points.select("id").distinct().join(norms, "id", "left").fillna(0.0, ["n2"]), "cluster-points", "id")
    if points.isEmpty():
        return np.zeros((0, dimension)), points.select("id", "n2", F.lit(0).alias("nearest"), F.lit(0.0).alias("d"))
    centres, before = seeds(points, vectors, k, dimension, seed), None
    for _ in range(rounds):
        near = stage(_distances(points, vectors, centres), "nearest", "id")
        moved = before is None or not near.join(before.select("id", F.col("nearest").alias("old")), "id").filter("nearest <> old").isEmpty()
        if before is not None:
            discard(before)
        before = near
        if not moved:
            break
        size = {r.nearest: r.n for r in near.groupBy("nearest").agg(F.count("*").alias("n")).collect()}
        sums = _dense(vectors.join(near.select("id", "nearest"), "id").groupBy("nearest", "bucket").agg(F.round(F.sum("w"), 12).alias("w")), "nearest", dimension)
        centres = np.stack([sums.get(c, np.zeros(dimension)) / size[c] if c in size else centres[c] for c in range(len(centres))])
    discard(before)
    last = stage(_distances(points, vectors, centres), "nearest", "id")
    discard(points, vectors)
    return centres, last


def representatives(near: DataFrame) -> DataFrame:
    """cluster, id: each centre's nearest point."""
    order = F.min(F.struct("d", "id")).alias("first")
    return near.groupBy(F.col("nearest").alias("cluster")).agg(order).select("cluster", F.col("first.id").alias("id"))
