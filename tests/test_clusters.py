"""Seeded k-means against a plain version on dense arrays."""

import hashlib

import numpy as np

from rankloom.operators import clusters, mining
from rankloom.plans import QUERIES

DIM = 6


def uniform(seed, purpose, key):
    return int(hashlib.md5(f"{seed}:{purpose}:{key}".encode()).hexdigest()[:13], 16) / 2**52


def nearest(x, centres):
    d = np.round(np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * x @ centres.T, 0), 9)
    return d.argmin(1), d.min(1)


def plain(x, k, seed=42, rounds=clusters.ROUNDS):
    n = len(x)
    ids = [min(range(n), key=lambda i: (uniform(seed, "first", i), i))]
    for i in range(clusters.SEEDING):
        _, d = nearest(x, x[ids])
        total = d.sum()
        if not total:
            break
        ids += [j for j in range(n) if uniform(seed, f"round {i}", j) < d[j] * clusters.OVER * k / round(total, 6)]
    held = np.bincount(nearest(x, x[ids])[0], minlength=len(ids)).astype(float)
    chosen = [int(held.argmax())]
    far = ((x[ids] - x[ids][chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(k, len(ids)):
        best = int(np.round(held * far, 9).argmax())
        if far[best] < 1e-12:
            break
        chosen.append(best)
        far = np.minimum(far, ((x[ids] - x[ids][best]) ** 2).sum(1))
    centres, before = x[ids][chosen], None
    for _ in range(rounds):
        near, _ = nearest(x, centres)
        if before is not None and (near == before).all():
            break
        before = near
        centres = np.stack([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
    return centres, *nearest(x, centres)


def frames(spark, x):
    points = spark.createDataFrame([(i,) for i in range(len(x))], "id long").repartition(3)
    rows = [(i, b, float(x[i, b])) for i, b in zip(*map(lambda v: v.tolist(), np.nonzero(x)), strict=True)]
    return points, spark.createDataFrame(rows, "id long, bucket int, w double").repartition(3)


def test_equals_plain(spark):
    r = np.random.default_rng(7)
    x = np.repeat(r.normal(size=(4, DIM)) * 3, 12, 0) + r.normal(size=(48, DIM)) * 0.4
    x[r.random(x.shape) < 0.2] = 0
    x[5] = 0
    x[40:44] = x[3]
    for k in (1, 5):
        want, labels, distances = plain(x, k)
        centres, near = clusters.k_means(*frames(spark, x), k, DIM)
        got = {row.id: row for row in near.collect()}
        assert np.allclose(centres, want, atol=1e-9)
        assert [got[i].nearest for i in range(48)] == labels.tolist() and np.allclose([got[i].d for i in range(48)], distances)
        chosen = {row.cluster: row.id for row in clusters.representatives(near).collect()}
        assert chosen == {int(c): min(np.flatnonzero(labels == c), key=lambda i: (distances[i], i)) for c in set(labels)}


def test_few_distinct_points(spark):
    same = np.ones((5, DIM))
    centres, near = clusters.k_means(*frames(spark, same), 3, DIM)
    assert len(centres) == 1 and near.filter("nearest <> 0 OR d <> 0").count() == 0
    centres, near = clusters.k_means(*(f.limit(0) for f in frames(spark, same)), 3, DIM)
    assert len(centres) == 0 and near.count() == 0
    none = spark.createDataFrame([], "query_id long, query string, doc_id long, doc string, pos int")
    assert mining.diverse(none).count() == 0


def test_registered_query(spark, sf):
    rows = QUERIES["i03_diverse"](spark, sf).collect()
    assert 2 <= len(rows) <= 10 and len({r.cluster for r in rows}) == len(rows)
