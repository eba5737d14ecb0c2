"""Logistic regression to its optimum by Newton's method: each step is one aggregation of gradient and Gram sums.

A row has ascending feature numbers with values; the constant is the last feature of every row. The products of a
row's features are exploded and summed by pair of features, map-side first, so a step sends at most (size + 1)^2 / 2
sums to the driver, whatever the number of rows; the driver solves for the step. The loss is that of a ridge
with the weight `penalty` on all but the constant, summed over rows; a step that would raise it is halved. It ends when
no weight moves by more than TOLERANCE: six to ten steps usually, so a fit is its optimum and not where it was cut off.

Defined cases: rows without a label are left out, null features are 0; a feature that is 0 in all rows has weight 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stage

TOLERANCE = 1e-10
MOST_STEPS = 100


def _sums(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gram matrix of the features weighted by p (1 - p), gradient, and loss, at these weights."""
    last = len(weights) - 1
    w = F.array(*[F.lit(float(x)) for x in weights])
    z = F.aggregate("e", F.lit(0.0), lambda total, e: total + F.get(w, e["i"]) * e["x"])
    scored = rows.select("y", "e", z.alias("z")).withColumn("p", 1 / (1 + F.exp(-F.col("z"))))
    loss = F.greatest("z", F.lit(0.0)) - F.col("y") * F.col("z") + F.log1p(F.exp(-F.abs("z")))
    scored = scored.select("e", (F.col("p") * (1 - F.col("p"))).alias("q"), (F.col("p") - F.col("y")).alias("r"), loss.alias("loss"))
    left = scored.select("e", "q", "r", "loss", F.posexplode("e").alias("k", "a"))
    pairs = left.select("q", "r", "loss", "a", F.explode(F.slice("e", F.col("k") + 1, F.size("e"))).alias("b"))
    found = pairs.groupBy(F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(F.sum(F.col("q") * F.col("a.x") * F.col("b.x")), F.sum(F.col("r") * F.col("a.x")), F.sum("loss"))
    gram, gradient, total = np.zeros((last + 1, last + 1)), np.zeros(last + 1), 0.0
    for i, j, h, g, at in found.collect():
        gram[i, j] = gram[j, i] = h
        if j == last:
            gradient[i] = g
            total = at if i == last else total
    return gram, gradient, total


def logistic(rows: DataFrame, size: int, penalty: float = 1.0, steps: int = MOST_STEPS) -> tuple[list[float], float]:
    """(weights, constant) for rows(label, i, x): i ascending numbers below size, x their values."""
    entries = F.filter(F.arrays_zip("i", F.transform("x", lambda v: F.coalesce(v, F.lit(0.0))).alias("x")), lambda e: e["x"] != 0)
    entries = F.transform(entries, lambda e: F.struct(e["i"].cast("int").alias("i"), e["x"].cast("double").alias("x")))
    constant = F.array(F.struct(F.lit(size).alias("i"), F.lit(1.0).alias("x")))
    data = stage(rows.filter("label IS NOT NULL").select(F.col("label").cast("double").alias("y"), F.concat(entries, constant).alias("e")), "newton-rows")
    ridge = np.append(np.full(size, float(penalty)), 0.0)
    w = np.zeros(size + 1)
    gram, gradient, loss = _sums(data, w)
    for _ in range(steps):
        whole = gram + np.diag(ridge)
        whole[-1, -1] += 1e-12
        step = np.linalg.solve(whole, gradient + ridge * w)
        before = loss + 0.5 * float(ridge @ (w * w))
        share = 1.0
        while True:
            tried = w - share * step
            gram, gradient, loss = _sums(data, tried)
            if loss + 0.5 * float(ridge @ (tried * tried)) <= before + 1e-9 * (1 + abs(before)) or share < 1e-6:
                break
            share /= 2
        w = tried
        if np.abs(share * step).max() < TOLERANCE:
            break
    discard(data)
    return [float(x) for x in w[:-1]], float(w[-1])
