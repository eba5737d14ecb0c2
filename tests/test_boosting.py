"""Boosted trees on list gradients against a plain version, and better lists than a linear scorer's."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rankloom.operators import boosting, metrics, training
from rankloom.plans import QUERIES

NAMES = ["u", "v", "w"]


def lists(n=12, size=14, seed=4):
    """A label that no linear scorer of the features gives: high where u and v are both far from the middle, or both near."""
    r = random.Random(seed)
    rows = []
    for q in range(n):
        for pos in range(1, size + 1):
            u, v = round(r.random(), 3), round(r.random(), 3)
            rows.append((q, pos, u, v, 1.0, float((u > 0.5) == (v > 0.5)) * 2 + float(u > 0.8)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "query_id int, pos int, u double, v double, w double, label double")


def plain_lambda(group, s, top):
    n = len(group)
    by_s = sorted(range(n), key=lambda i: (-round(s[i], 9), group[i][1]))
    by_y = sorted(range(n), key=lambda i: (-round(group[i][5], 9), group[i][1]))
    d = lambda r: 1 / math.log2(r + 2) if r < top else 0.0
    rank = {i: k for k, i in enumerate(by_s)}
    gain = [2 ** x[5] - 1 for x in group]
    ideal = sum(gain[i] * d(k) for k, i in enumerate(by_y))
    g, h = [0.0] * n, [0.0] * n
    for i in range(n):
        for j in range(n):
            if ideal > 0 and group[i][5] > group[j][5]:
                change = (gain[i] - gain[j]) * abs(d(rank[i]) - d(rank[j])) / ideal
                p = 1 / (1 + math.exp(s[i] - s[j]))
                g[i] += change * p
                g[j] -= change * p
                h[i] += change * p * (1 - p)
                h[j] += change * p * (1 - p)
    return g, h


def plain_likelihood(group, s, top):
    order = sorted(range(len(group)), key=lambda i: (-group[i][5], group[i][1]))
    g, h = [0.0] * len(group), [0.0] * len(group)
    for k in range(len(order)):
        z = sum(math.exp(s[i]) for i in order[k:])
        for i in order[k:]:
            p = math.exp(s[i]) / z
            g[i] += (i == order[k]) - p
            h[i] += p * (1 - p)
    return g, h


def plain_trees(rows, cuts, gradient, rounds, depth, rate, top):
    s = [0.0] * len(rows)
    trees = []
    for _ in range(rounds):
        g, h = [0.0] * len(rows), [0.0] * len(rows)
        for q in {r[0] for r in rows}:
            at = [i for i, r in enumerate(rows) if r[0] == q]
            for i, a, b in zip(at, *gradient([rows[i] for i in at], [s[i] for i in at], top), strict=True):
                g[i], h[i] = a, b

        def grow(members, level):
            total = [sum(x[i] for i in members) for x in (g, h)]
            value = rate * total[0] / (total[1] + 1)
            best, found = 1e-9, None
            if level < depth:
                for f, name in enumerate(NAMES):
                    for cut in cuts[name]:
                        low = [i for i in members if rows[i][2 + f] <= cut]
                        high = [i for i in members if rows[i][2 + f] > cut]
                        if min(len(low), len(high)) < 2:
                            continue
                        part = lambda m: sum(g[i] for i in m) ** 2 / (sum(h[i] for i in m) + 1)
                        gain = round(part(low) + part(high) - total[0] ** 2 / (total[1] + 1), 9)
                        if gain > best:
                            best, found = gain, (name, cut, low, high)
            if found is None:
                for i in members:
                    s[i] += value
                return (round(value, 6),)
            return (round(value, 6), found[0], found[1], grow(found[2], level + 1), grow(found[3], level + 1))

        trees.append(grow(list(range(len(rows))), 0))
    return trees, s


def shape(node):
    own = (round(node.value, 6),)
    return own if node.children is None else (*own, node.feature, node.cut, shape(node.children[0]), shape(node.children[1]))


@pytest.mark.parametrize(("loss", "gradient"), [("lambdaloss", plain_lambda), ("listwise", plain_likelihood)])
def test_trees_equal_plain(spark, loss, gradient):
    rows = lists()
    df = frame(spark, rows)
    model = boosting.fit(df, "label", NAMES, loss, rounds=3, depth=2, bins=8, rate=0.3, top=5)
    cuts = boosting.bin_cuts(df, NAMES, 8)
    assert cuts["w"] == [] and len(cuts["u"]) == 7
    trees, s = plain_trees(rows, cuts, gradient, 3, 2, 0.3, 5)
    assert [shape(t) for t in model.trees] == trees
    got = {(r.query_id, r.pos): r.model_score for r in model.score(df).collect()}
    assert all(got[r[0], r[1]] == pytest.approx(x, abs=1e-6) for r, x in zip(rows, s, strict=True))


def ndcg(scored):
    rows = scored.withColumnRenamed("label", "rel").withColumn("doc_id", F.col("pos"))
    order = F.row_number().over(metrics.W.Window.partitionBy("query_id").orderBy(F.desc("score"), "pos"))
    return metrics.evaluate(rows.withColumn("rank", order)).first().ndcg


def test_trees_rank_better_than_a_linear_scorer(spark):
    df = frame(spark, lists(16)).cache()
    weights = training.listwise_weights(df, "label", NAMES, "lambdaloss", steps=10)
    linear = ndcg(df.withColumn("score", sum(F.lit(w) * F.col(n) for n, w in weights.items())))
    boosted = ndcg(boosting.fit(df, "label", NAMES, rounds=8, rate=0.4).score(df).withColumn("score", F.col("model_score")))
    assert boosted > linear + 0.1


def test_edges(spark):
    df = frame(spark, lists(2, 3))
    empty = boosting.fit(df.limit(0), "label", NAMES, rounds=2)
    assert empty.score(df).filter("model_score <> 0").count() == 0
    equal = boosting.fit(df.withColumn("label", F.lit(1.0)), "label", NAMES, rounds=2)
    assert equal.score(df).filter("model_score <> 0").count() == 0
    odd = df.withColumn("u", F.lit(None).cast("double")).withColumn("model", F.lit("x"))
    assert boosting.fit(odd, "label", NAMES, "listwise", rounds=1).score(odd).count() == 6
    with pytest.raises(ValueError, match="unknown loss"):
        boosting.fit(df, "label", NAMES, "other")


def test_registered_query(spark, sf):
    rows = QUERIES["e07_boosted_lists"](spark, sf).collect()
    by = {}
    for r in rows:
        by.setdefault((r.loss, r.query_id), []).append((r["rank"], -r.score))
    assert {k for k, _ in by} == {"listwise", "lambdaloss"}
    for found in by.values():
        found.sort()
        assert [x for x, _ in found] == list(range(1, len(found) + 1)) and [s for _, s in found] == sorted(s for _, s in found)
