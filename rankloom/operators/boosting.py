"""Non-linear listwise ranking: boosted histogram trees on the gradients of whole lists.

Two losses. `lambdaloss` pulls the documents of a list apart by what their exchange changes in NDCG at `top`: an exchange
below the first `top` places changes nothing, so only pairs with one of the list's first `top` documents are formed,
linear in the list. `listwise` raises the likelihood of the list's order by label, from running sums over the list.

Each round stages gradients once, then grows a tree level by level: sums of gradients by node, feature and bin, one
aggregation with map-side sums a level, at most 2 ** depth * features * bins rows, of which the driver keeps the best
cut of each node. Bins are cut at quantiles of each feature. A tree is a nest of comparisons of features with cuts, an
expression inside code generation, and so is the model.

Defined cases: a null feature counts as 0; a list of one document, or of equal labels, pulls nothing (its order by
label is its order by pos under `listwise`); ties in labels or scores are ordered by pos, ties between cuts by feature
and bin; an empty table gives a model that scores 0. Lists are those that retrieval hands on, sorted by a window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..session import discard, stage

ROUNDS = 30
DEPTH = 3
BINS = 32
RATE = 0.1
TOP = 10
RIDGE = 1.0
LEAST_ROWS = 2


@dataclass
class Node:
    value: float
    feature: str | None = None
    cut: float = 0.0
    children: tuple[Node, Node] | None = None

    def score(self) -> Column:
        if self.children is None:
            return F.lit(self.value)
        low, high = self.children
        return F.when(F.col(self.feature) <= F.lit(self.cut), low.score()).otherwise(high.score())


@dataclass
class Trees:
    """A sum of trees over named features."""

    names: list[str]
    trees: list[Node] = field(default_factory=list)

    def score(self, rows: DataFrame) -> DataFrame:
        """rows with model_score."""
        plain = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in self.names]
        features = rows.select(F.struct(*rows.columns).alias("__row"), *plain)
        return features.withColumn("model_score", sum((t.score() for t in self.trees), F.lit(0.0))).select("__row.*", "model_score")


def bin_cuts(rows: DataFrame, names: list[str], bins: int) -> dict[str, list[float]]:
    """Ascending distinct quantiles of each feature, at most bins - 1; a value up to a cut lies below it."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(n, shares, 100_000).alias(n) for n in names], *[F.max(n).alias(f"{n}_max") for n in names]).first()
    return {n: sorted({float(x) for x in found[n] or [] if x < found[f"{n}_max"]}) for n in names}


def _bin(name: str, cuts: list[float]) -> Column:
    """How many cuts lie below the value, by halving."""

    def part(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(name) <= F.lit(cuts[middle]), part(low, middle)).otherwise(part(middle + 1, high))

    return part(0, len(cuts)).cast("int")


def lambda_gradients(scored: DataFrame, top: int) -> DataFrame:
    """scored(query_id, pos, y, s, ...) with g and h: the pull on each document by exchanges in its list, and its slope."""
    by = W.Window.partitionBy("query_id")
    place = lambda c: F.row_number().over(by.orderBy(F.desc(F.round(c, 9)), "pos"))
    discount = lambda r: F.when(r <= top, 1.0 / F.log2(r + 1.0)).otherwise(0.0)
    rows = scored.withColumns({"r": place("s"), "b": place("y"), "v": F.pow(F.lit(2.0), "y") - 1})
    rows = rows.withColumns({"d": discount(F.col("r")), "ideal": F.sum(F.col("v") * discount(F.col("b"))).over(by)})
    own = rows.filter("ideal > 0").select("query_id", "pos", "y", "s", "r", "v", "d", "ideal")
    head = own.filter(F.col("r") <= top).select("query_id", *[F.col(c).alias(f"{c}_t") for c in ("pos", "y", "s", "r", "v", "d")])
    pairs = own.join(head, "query_id").filter("y <> y_t AND r > r_t")
    sign = F.when(F.col("y") > F.col("y_t"), 1.0).otherwise(-1.0)
    change = F.abs(F.col("v") - F.col("v_t")) * F.abs(F.col("d") - F.col("d_t")) / F.col("ideal")
    wrong = 1.0 / (1.0 + F.exp(sign * (F.col("s") - F.col("s_t"))))
    pairs = pairs.select("query_id", "pos", "pos_t", (sign * change * wrong).alias("g"), (change * wrong * (1.0 - wrong)).alias("h"))
    ends = pairs.select("query_id", "pos", "g", "h").unionByName(pairs.select("query_id", F.col("pos_t").alias("pos"), (-F.col("g")).alias("g"), "h"))
    sums = ends.groupBy("query_id", "pos").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    return scored.join(sums, ["query_id", "pos"], "left").fillna(0.0, ["g", "h"])


def likelihood_gradients(scored: DataFrame, top: int) -> DataFrame:
    """The same by the likelihood of each list's order by label; top is not used."""
    by = W.Window.partitionBy("query_id")
    order = by.orderBy(F.desc("y"), "pos")
    rows = scored.withColumn("e", F.exp(F.col("s") - F.max("s").over(by)))
    rows = rows.withColumn("z", F.sum("e").over(order.rowsBetween(0, W.Window.unboundedFollowing)))
    passed = order.rowsBetween(W.Window.unboundedPreceding, 0)
    rows = rows.withColumns({"p1": F.col("e") * F.sum(1.0 / F.col("z")).over(passed), "p2": F.col("e") * F.col("e") * F.sum(1.0 / (F.col("z") * F.col("z"))).over(passed)})
    return rows.withColumns({"g": 1.0 - F.col("p1"), "h": F.greatest(F.col("p1") - F.col("p2"), F.lit(0.0))}).drop("e", "z", "p1", "p2")


GRADIENTS: dict[str, Callable[[DataFrame, int], DataFrame]] = {"lambdaloss": lambda_gradients, "listwise": likelihood_gradients}


def _gain(g: float, h: float, ridge: float) -> float:
    return g * g / (h + ridge)


def best_cut(cells: dict[tuple[int, int], tuple[float, float, int]], n_features: int, ridge: float = RIDGE, least: int = LEAST_ROWS) -> tuple[int, int, list[float], list[float]] | None:
    """(feature, bin, sums below, sums above) of the cut above a bin that gains most, from sums of g, h and rows by
    feature and bin; None if no cut gains. Sums are rounded, so that their order decides nothing."""
    best, found = 1e-9, None
    for f in range(n_features):
        bins = sorted(b for k, b in cells if k == f)
        total = [sum(cells[f, b][i] for b in bins) for i in range(3)]
        low = [0.0, 0.0, 0]
        for b in bins[:-1]:
            low = [x + y for x, y in zip(low, cells[f, b], strict=True)]
            high = [x - y for x, y in zip(total, low, strict=True)]
            if min(low[2], high[2]) < least:
                continue
            gain = round(_gain(low[0], low[1], ridge) + _gain(high[0], high[1], ridge) - _gain(total[0], total[1], ridge), 9)
            if gain > best:
                best, found = gain, (f, b, low, high)
    return found


def _literals(values: dict[int, float], size: int, empty: float) -> Column:
    """values by number as one array. Trees stand in arrays, not in expressions, so all rounds share their generated code."""
    return F.array(*[F.lit(values.get(i, empty)) for i in range(size)])


def _node(splits: dict[int, tuple[int, int]], depth: int) -> Column:
    """The number of a row's node after up to depth cuts: the children of n are 2n and 2n + 1."""
    size = 2 ** (depth + 1)
    feature, cut = _literals({n: f for n, (f, _) in splits.items()}, size, -1), _literals({n: b for n, (_, b) in splits.items()}, size, 0)
    node = F.lit(1)
    for _ in range(depth):
        at = F.get(feature, node)
        node = F.when(at < 0, node).otherwise(2 * node + (F.get("bins", at) > F.get(cut, node)).cast("int"))
    return node


def _grow(rows: DataFrame, names: list[str], cuts: dict[str, list[float]], depth: int, rate: float) -> tuple[Node, Column]:
    """A tree for rows(g, h, bins), and its value of a row's bins; each level is one aggregation."""
    root = Node(0.0)
    open_nodes: dict[int, Node] = {1: root}
    splits: dict[int, tuple[int, int]] = {}
    values: dict[int, float] = {}
    for level in range(max(depth, 1)):
        is_open = F.get(_literals(dict.fromkeys(open_nodes, True), 2 ** (level + 1), False), F.col("node"))
        placed = rows.select(_node(splits, level).alias("node"), "bins", "g", "h").filter(is_open)
        each = placed.select("node", "g", "h", F.posexplode("bins").alias("feature", "bin"))
        sums = each.groupBy("node", "feature", "bin").agg(F.round(F.sum("g"), 9), F.round(F.sum("h"), 9), F.count("*")).collect()
        found: dict[int, dict[tuple[int, int], tuple[float, float, int]]] = {}
        for node, f, b, g, h, n in sums:
            found.setdefault(node, {})[f, b] = (g, h, n)
        if level == 0:
            g, h = (sum(v[i] for (f, _), v in found.get(1, {}).items() if f == 0) for i in (0, 1))
            root.value = values[1] = rate * g / (h + RIDGE)
        after: dict[int, Node] = {}
        for number, node in open_nodes.items():
            cut = best_cut(found.get(number, {}), len(names)) if depth else None
            if cut is not None:
                f, b, low, high = cut
                splits[number] = f, b
                node.feature, node.cut = names[f], cuts[names[f]][b]
                node.children = (Node(rate * low[0] / (low[1] + RIDGE)), Node(rate * high[0] / (high[1] + RIDGE)))
                for child, of in zip((2 * number, 2 * number + 1), node.children, strict=True):
                    after[child], values[child] = of, of.value
        open_nodes = after
        if not open_nodes:
            break
    return root, F.get(_literals(values, 2 ** (depth + 1), 0.0), _node(splits, depth))


def fit(rows: DataFrame, label: str, names: list[str], loss: str = "lambdaloss", rounds: int = ROUNDS, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, top: int = TOP) -> Trees:
    """Trees from rows(query_id, pos, label, features), one row for each query_id and pos."""
    if loss not in GRADIENTS:
        raise ValueError(f"unknown loss: {loss}")
    plain = rows.select("query_id", "pos", F.col(label).cast("double").alias("y"), *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names])
    plain = stage(plain, "lists", "query_id")
    cuts = bin_cuts(plain, names, bins)
    model = Trees(names)
    data = stage(plain.select("query_id", "pos", "y", F.array(*[_bin(n, cuts[n]) for n in names]).alias("bins"), F.lit(0.0).alias("s")), "binned", "query_id")
    discard(plain)
    for _ in range(rounds):
        pulled = stage(GRADIENTS[loss](data, top).select("query_id", "pos", "y", "bins", "s", "g", "h"), "pulled")
        discard(data)
        tree, value = _grow(pulled, names, cuts, depth, rate)
        model.trees.append(tree)
        data = pulled.withColumn("s", F.col("s") + value).drop("g", "h")
        data.staged_path = pulled.staged_path
        if tree.children is None and abs(tree.value) < 1e-12:
            break
    discard(data)
    return model
