"""Logistic fits at their optimum, against dense numpy, and a stored index that grows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import newton, rankers, training
from rankloom.operators.late_index import LateIndex


def optimum(x, y, penalty=1.0):
    """By plain gradient descent with a fixed step, until nothing moves."""
    data = np.column_stack([x, np.ones(len(x))])
    ridge = np.append(np.full(x.shape[1], penalty), 0.0)
    w, rate = np.zeros(data.shape[1]), 1 / (np.linalg.norm(data, 2) ** 2 / 4 + penalty)
    for _ in range(400_000):
        g = data.T @ (1 / (1 + np.exp(-data @ w)) - y) + ridge * w
        w -= rate * g
        if np.abs(g).max() < 1e-10:
            break
    return w


def sparse_rows(seed=3, n=80, size=6):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, size)) * (r.random((n, size)) < 0.5)
    x[:, 4] = 0
    y = (x @ r.normal(size=size) + 0.3 + r.normal(size=n) > 0).astype(float)
    return x, y


def test_fit_equals_dense_optimum(spark):
    x, y = sparse_rows()
    rows = [([int(k) for k in np.flatnonzero(v)], [float(v[k]) for k in np.flatnonzero(v)], float(t)) for v, t in zip(x, y, strict=True)]
    rows += [([0, 2], [None, 0.0], None), ([1], [5.0], None)]
    df = spark.createDataFrame(rows, "i array<int>, x array<double>, label double").repartition(4)
    weights, constant = newton.logistic(df, 6)
    assert np.allclose([*weights, constant], optimum(x, y), atol=1e-6) and weights[4] == 0
    heavy, _ = newton.logistic(df, 6, penalty=50.0)
    assert np.abs(heavy).max() < np.abs(weights).max()


def test_separable_rows_and_nulls(spark):
    df = spark.createDataFrame([([0], [float(v)], float(v > 0)) for v in (-100, -50, 60, 90)] + [([0], [None], 1.0)], "i array<int>, x array<double>, label double")
    weights, constant = newton.logistic(df, 1)
    x = np.array([-100.0, -50, 60, 90, 0])
    z = weights[0] * x + constant
    g = np.array([x, np.ones(5)]) @ (1 / (1 + np.exp(-z)) - (np.array([0, 0, 1, 1, 1]))) + np.array([weights[0], 0])
    assert np.abs(g).max() < 1e-6


def test_pairwise_fit_equals_dense_optimum(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(60, 7))
    y = (x[:, 0] - x[:, 1] > r.normal(size=60)).astype(float)
    df = spark.createDataFrame([(*map(float, v), float(t)) for v, t in zip(x, y, strict=True)], ", ".join(f"{n} double" for n in [*training.PAIR_FEATURES, "label"]))
    weights, constant = training.logistic_pairs(df, 0.5)
    assert np.allclose([*weights, constant], optimum(x, y, 2.0), atol=1e-6)
    assert training.logistic_pairs(df.filter("label = 1")) == 1.0 and training.logistic_pairs(df.limit(0)) == 0.0


def test_bilinear_weights_equal_dense_optimum(spark):
    docs = ["red fox runs", "a red fox", "blue whale swims", "nothing at all", "fox and whale"]
    rows = [(q, "red fox" if q % 2 else "blue whale", 10 * q + i, d, i + 1, int((i + q) % 3 == 0)) for q in range(6) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "query_id int, query string, doc_id int, doc string, pos int, label int")
    q = {(r.query_id, r.bucket): r.w for r in rankers.V.embed(df.select("query_id", "query").distinct(), "query_id", "query").collect()}
    d = {(r.doc_id, r.bucket): r.w for r in rankers.V.embed(df.select("doc_id", "doc").distinct(), "doc_id", "doc").collect()}
    x = np.array([[q.get((r[0], b), 0) * d.get((r[2], b), 0) for b in range(256)] for r in rows])
    got = {r.bucket: r.weight for r in training.bilinear_weights(df, "label").collect()}
    assert np.allclose([got[b] for b in range(256)], np.abs(optimum(x, np.array([r[5] for r in rows], float))[:-1]), atol=1e-6)


CANDIDATES = "query_id int, query string, doc_id int, doc string, pos int"


def test_stored_index_ranks_as_a_rebuild(spark, tmp_path):
    docs = {1: "red fox runs fast", 2: "a blue whale", 3: "fox", 4: "", 5: "whale fox red", 6: None, 7: "x", 8: "blue " * 500}
    rows = [(q, t, i, d, i) for q, t in ((1, "red fox"), (2, "blue whale x"), (3, ""), (4, "unknown words")) for i, d in docs.items()]
    candidates = spark.createDataFrame(rows, CANDIDATES)
    index = LateIndex(spark, str(tmp_path / "index"))
    assert index.batches() == [] and index.rank(candidates).filter("score <> 0").count() == 0
    known = candidates.select("doc_id", "doc").distinct()
    index.add(known.filter("doc_id <= 4").withColumn("doc", F.lit("blue whale that is replaced")), "a")
    index.add(known.filter("doc_id > 4"), "b")
    index.add(known.filter("doc_id <= 4"), "c")
    index.add(known.filter("doc_id <= 4"), "c")  # written again after a failure
    index.add(known.limit(0), "d")
    order = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())
    assert order(index.rank(candidates)) == order(rankers.late_interaction(candidates))
    assert index.batches() == ["a", "b", "c", "d"]
    # only the folders of the asked buckets are read
    plan = index.read([3])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    (tmp_path / "index" / "b" / "documents" / "_SUCCESS").unlink()
    assert index.batches() == ["a", "c", "d"]


@pytest.mark.parametrize("name", ["h03_learned_tournament", "h04_bilinear", "h05_appended_index"])
def test_registered_queries(spark, sf, name):
    from rankloom.plans import QUERIES

    rows = QUERIES[name](spark, sf).collect()
    assert rows and all(np.isfinite(r.score) for r in rows)
