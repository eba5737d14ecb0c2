"""Closed frequent itemsets of baskets, and their rules, by counting inference over key sets.

A key set has a smaller support than each of its proper subsets. Only candidates whose subsets of one item less are all
frequent keys are counted; a counted candidate whose support is its subsets' minimum is no key and is not extended. The
support of any other set is the minimum of the supports of the keys that it contains, so a closed set of n items that
always occur together costs n keys and their pairs, not 2^n sets. Closures follow from supports alone:

- a counted candidate with the support of its subset Y adds its last item to the closure of Y;
- a closure contains the closures of all subsets;
- keys of equal support of which one lies in the other's closure have one closure.

Together these give whole closures: if i is in the closure of a key X, but of none of its subsets, then either X and i
were a counted candidate, or a key K of X's support contains i, lies in X and i, has at most as many items as X, and
its closure, as far as the first two rules give it, contains X.

Baskets: the distinct items of each basket. A set's items are ordered by support, rarest first, so sets share prefixes of
rare items and hot items never lead. The few largest baskets - fewer than half of the least support, MOST_LARGE at most,
so every frequent set occurs in others, often enough - never emit pairs: a candidate found in other baskets is looked up
in the lists of the large baskets that hold its items. All other steps are groupings with partial sums by basket, item
or set. What is broadcast: frequent items and sets, up to a counted FEW rows. A frequent item is in one of `share` baskets,
so there are at most 2 * share times the items of a mean basket of them, whatever the size of the input; above FEW the
join shuffles by salted keys.

Defined cases: rows whose basket or item is null are skipped; repeated rows count once; a basket of one item counts as
a basket; other columns are not looked at; an empty table gives no itemsets. Ids are 64-bit integers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, temporary

LEAST = 5
SHARE = 20_000
CONFIDENCE = 60
#: Baskets that may be looked up instead of emitting pairs, and the smallest size of such a basket.
MOST_LARGE = 1000
LARGE = 64
#: Rows of a counted table of items or sets up to which it is broadcast.
FEW = 60_000
SALTS = 16


@dataclass
class Bounds:
    """Scalars that the driver holds: the number of baskets, the least support, and the size above which a basket is large."""

    baskets: int
    least: int
    large: int
    n_large: int


def bounds(lines: DataFrame, least: int, share: int) -> Bounds:
    """From rows a basket, repeated rows included: an upper bound of its items."""
    steps = [LARGE << j for j in range(40)]
    sizes = lines.groupBy("basket").agg(F.count("*").alias("n"))
    row = sizes.agg(F.count("*"), *[F.count(F.when(F.col("n") > s, 1)) for s in steps]).first()
    least = max(least, -(-row[0] // share))
    above = dict(zip(steps, row[1:], strict=True))
    large = next(s for s in steps if above[s] <= min((least - 1) // 2, MOST_LARGE))
    return Bounds(row[0], least, large, above[large])


def _join_few(left: DataFrame, right: DataFrame, keys: list[str], salt: Column, how: str = "inner") -> DataFrame:
    """left with right, a staged table of one row for each key: broadcast up to FEW counted rows, else shuffled by salted keys."""
    if right.count() <= FEW:
        return left.join(F.broadcast(right), keys, how)
    salted = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), [*keys, "salt"], how).drop("salt")


def _split_large(lines: DataFrame, b: Bounds) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary baskets, and distinct rows of the large ones, whose ids, MOST_LARGE at most, are literals."""
    if not b.n_large:
        return lines, None
    sizes = lines.groupBy("basket").agg(F.count("*").alias("n"))
    large = F.col("basket").isin([r.basket for r in sizes.filter(F.col("n") > b.large).collect()])
    return lines.filter(~large), lines.filter(large).distinct()


def _frequent_items(ordinary: DataFrame, large: DataFrame | None, b: Bounds) -> DataFrame:
    """item, s (its support), big (the large baskets that hold it); staged."""
    counts = ordinary.distinct().groupBy("item").agg(F.count("*").alias("n"))
    if large is None:
        found = counts.select("item", F.col("n").alias("s"), F.array().cast("array<bigint>").alias("big"))
    else:
        held = large.groupBy("item").agg(F.sort_array(F.collect_list("basket")).alias("big"))
        found = counts.join(held.hint("merge"), "item", "left").select("item", (F.col("n") + F.coalesce(F.size("big"), F.lit(0))).alias("s"), F.coalesce("big", F.array().cast("array<bigint>")).alias("big"))
    return materialize(found.filter(F.col("s") >= b.least), "itemset-items")


def _baskets(ordinary: DataFrame, items: DataFrame) -> DataFrame:
    """basket, items: the frequent items of each ordinary basket of two or more of them, rarest first; staged."""
    known = _join_few(ordinary, items.select("item", "s"), ["item"], F.col("basket"))
    sets = known.groupBy("basket").agg(F.sort_array(F.collect_set(F.struct("s", F.col("item").alias("i")))).alias("items"))
    return materialize(sets.filter(F.size("items") > 1), "itemset-baskets")


def _pairs(baskets: DataFrame) -> DataFrame:
    left = baskets.select("basket", "items", F.posexplode("items").alias("k", "a")).filter(F.col("k") + 1 < F.size("items"))
    return left.select("basket", "a", F.explode(F.slice("items", F.col("k") + 2, F.size("items"))).alias("b"))


def _without(items: Column, at: Column) -> Column:
    return F.filter(items, lambda _, k: k != at)


def _subsets(sets: DataFrame, k: int, *columns: str) -> DataFrame:
    """A row for each subset of k - 1 items of the sets of k items; last is the item left out."""
    at = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("at")
    return sets.select("set", *columns, at).select("set", *columns, _without(F.col("set"), F.col("at")).alias("subset"), F.col("set")[F.col("at")].alias("last"))


def _counted(candidates: DataFrame, below: DataFrame, k: int, b: Bounds) -> DataFrame:
    """set, support, big, upper (the least support of its subsets) of the frequent candidates; staged.

    candidates: set, n of the ordinary baskets. A frequent set occurs in at least least - n_large of them."""
    near = materialize(candidates.filter(F.col("n") >= max(1, b.least - b.n_large)), "itemset-near")
    parts = _subsets(near, k, "n").join(below.select(F.col("set").alias("subset"), "support", "big").hint("merge"), "subset")
    both = F.aggregate(F.slice(F.collect_list("big"), 2, k), F.element_at(F.collect_list("big"), 1), F.array_intersect)
    whole = parts.groupBy("set").agg(F.first("n").alias("n"), F.min("support").alias("upper"), both.alias("big"))
    return materialize(whole.withColumn("support", F.col("n") + F.size("big")).filter(F.col("support") >= b.least).select("set", "support", "big", "upper"), "itemset-counted")


def _first_candidates(baskets: DataFrame) -> DataFrame:
    return _pairs(baskets).groupBy("a", "b").agg(F.count("*").alias("n")).select(F.array("a", "b").alias("set"), "n")


def _candidates(sets: Column, k: int) -> Column:
    """Sets of k + 1 items whose subsets of k items are all among a basket's sets."""
    head = lambda x: F.slice(x, 1, k - 1)
    grown = F.flatten(F.transform(sets, lambda x: F.transform(F.filter(sets, lambda y: (head(x) == head(y)) & (y[k - 1] > x[k - 1])), lambda y: F.concat(x, F.array(y[k - 1])))))
    return F.filter(grown, lambda z: F.forall(F.sequence(F.lit(0), F.lit(k - 2)), lambda at: F.array_contains(sets, _without(z, at))))


def _held(rows: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """basket, sets: a basket's key sets of k items, if they can make a candidate; staged."""
    found = _join_few(rows, keys.select("set"), ["set"], F.col("basket"), "left_semi")
    return materialize(found.groupBy("basket").agg(F.collect_set("set").alias("sets")).filter(F.size("sets") > k), "itemset-held")


def key_sets(lines: DataFrame, b: Bounds) -> tuple[list[DataFrame], list[DataFrame]]:
    """Staged tables by the number of items, from 1: frequent key sets (set, support, big), and counted candidates that
    are no keys (set, support), of one item more."""
    ordinary, large = _split_large(lines, b)
    items = _frequent_items(ordinary, large, b)
    keys = [items.select(F.array(F.struct("s", F.col("item").alias("i"))).alias("set"), F.col("s").alias("support"), "big")]
    others: list[DataFrame] = []
    baskets = _baskets(ordinary, items)
    rows, candidates = _pairs(baskets).select("basket", F.array("a", "b").alias("set")), _first_candidates(baskets)
    while True:
        k = len(keys) + 1
        counted = _counted(candidates, keys[-1], k, b)
        others.append(counted.filter("support = upper").select("set", "support"))
        found = counted.filter("support < upper").select("set", "support", "big")
        if found.isEmpty():
            return keys, others
        keys.append(found)
        held = _held(rows, found, k)
        rows = held.select("basket", F.explode(_candidates(F.col("sets"), k)).alias("set"))
        candidates = rows.groupBy("set").agg(F.count("*").alias("n"))


def _union(closures: Column) -> Column:
    return F.sort_array(F.array_distinct(F.flatten(closures)))


def _pairs_of(closures: DataFrame, *columns: str) -> DataFrame:
    """x, y: the pairs of each closure, rarer item first."""
    left = closures.select(*columns, "closure", F.posexplode("closure").alias("k", "x")).filter(F.col("k") + 1 < F.size("closure"))
    return left.select(*columns, "x", F.explode(F.slice("closure", F.col("k") + 2, F.size("closure"))).alias("y"))


def closures(keys: list[DataFrame], others: list[DataFrame]) -> DataFrame:
    """set, support, closure of each frequent key set."""
    done: list[DataFrame] = []
    wider: DataFrame | None = None  # closures with more items than their key, of all sizes so far
    for k, (level, other) in enumerate(zip(keys, others, strict=True), 1):
        direct = _subsets(other.withColumn("total", F.col("support")), k + 1, "total").groupBy("subset", "total").agg(F.collect_list("last").alias("more"))
        direct = direct.select(F.col("subset").alias("set"), F.col("total").alias("support"), "more")
        own = level.select("set", "support").join(direct.hint("merge"), ["set", "support"], "left").withColumn("closure", F.array_union("set", F.coalesce("more", F.array().cast(direct.schema["more"].dataType)))).drop("more")
        if k > 1:
            below = _subsets(own, k, "support", "closure").join(done[-1].select(F.col("set").alias("subset"), F.col("closure").alias("part")).hint("merge"), "subset")
            own = below.groupBy("set", "support").agg(_union(F.concat(F.collect_list("part"), F.array(F.first("closure")))).alias("closure"))
        own = materialize(own.withColumn("closure", F.sort_array("closure")), "itemset-closures")
        more = own.filter(F.size("closure") > F.size("set")).select("support", "set", "closure")
        wider = more if wider is None else wider.unionByName(more)
        if k > 1 and not wider.isEmpty():
            named = wider.select("support", F.col("set").alias("by"), "closure")
            two = own.select("set", "support", F.col("set")[0].alias("x"), F.col("set")[1].alias("y"))
            near = _pairs_of(named, "support", "by").join(two.hint("merge"), ["support", "x", "y"]).select("set", "support", "by").filter(F.col("by") != F.col("set"))
            same = near.join(named.hint("merge"), ["support", "by"]).filter(F.size(F.array_except("set", "closure")) == 0)
            joined = same.groupBy("set", "support").agg(_union(F.collect_list("closure")).alias("same"))
            empty = F.array().cast(own.schema["closure"].dataType)
            own = own.join(joined.hint("merge"), ["set", "support"], "left").withColumn("closure", F.sort_array(F.array_union("closure", F.coalesce("same", empty)))).drop("same")
            own = materialize(own, "itemset-closures")
        done.append(own)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _rests(closed: DataFrame, keys: list[DataFrame]) -> DataFrame:
    """id, best: for each closed set of three or more items a map from an item's id to the least support among the key
    sets of two or more items that the set without that item contains. Key sets are found by their two rarest items."""
    wide = closed.filter(F.size("closure") > 2)
    indexed = None
    for level in keys[1:]:
        two = level.select("set", "support", F.col("set")[0].alias("x"), F.col("set")[1].alias("y"))
        indexed = two if indexed is None else indexed.unionByName(two)
    if indexed is None:
        return closed.select("id", F.lit(None).cast("map<bigint,bigint>").alias("best")).limit(0)
    near = _pairs_of(wide, "id").join(indexed.hint("merge"), ["x", "y"]).join(wide.select("id", "closure").hint("merge"), "id")
    held = near.filter(F.size(F.array_except("set", "closure")) == 0)
    each = held.select("id", "support", F.explode(F.array_except("closure", "set")).alias("c")).groupBy("id", F.col("c.i").alias("c")).agg(F.min("support").alias("a"))
    return each.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("c", "a"))).alias("best"))


def with_rules(closed: DataFrame, keys: list[DataFrame], n_baskets: int, confidence: int = CONFIDENCE) -> DataFrame:
    """closed (closure, support) with rules: structs of an item c, the support a of the rest, and c's support s, by c."""
    closed = materialize(closed.withColumn("id", F.md5(F.concat_ws(",", F.transform("closure", lambda x: x["i"].cast("string"))))), "itemset-closed")
    joined = closed.join(_rests(closed, keys).hint("merge"), "id", "left")
    # the rest of a set has at most the support of its rarest item
    single = lambda k: F.when(k == 0, F.col("closure")[1]["s"]).otherwise(F.col("closure")[0]["s"])
    each = F.transform("closure", lambda x, k: F.struct(x["i"].alias("c"), F.least(single(k), F.try_element_at("best", x["i"])).alias("a"), x["s"].alias("s")))
    holds = lambda r: (100 * F.col("support") >= confidence * r["a"]) & (F.col("support") * F.lit(n_baskets) > r["a"] * r["s"])
    empty = F.array().cast("array<struct<c:bigint,a:bigint,s:bigint>>")
    return joined.select("closure", "support", F.when(F.size("closure") > 1, F.sort_array(F.filter(each, holds))).otherwise(empty).alias("rules"))


def mine(lines: DataFrame, basket: str = "sale_id", item: str = "item_id", least: int = LEAST, share: int = SHARE, confidence: int = CONFIDENCE) -> DataFrame:
    """items (ascending ids), support and rules (structs c, a, s) of every closed itemset whose support is at least
    `least` and at least one in `share` of all baskets."""
    lines = lines.select(F.col(basket).cast("bigint").alias("basket"), F.col(item).cast("bigint").alias("item")).filter("basket IS NOT NULL AND item IS NOT NULL")
    b = bounds(lines, least, share)
    with temporary(lines.sparkSession) as keep:
        keys, others = key_sets(lines, b)
        closed = closures(keys, others).groupBy("closure").agg(F.max("support").alias("support"))
        found = keep(materialize(with_rules(closed, keys, b.baskets, confidence), "itemsets"))
    return found.select(F.sort_array(F.transform("closure", lambda x: x["i"])).alias("items"), "support", "rules")


def digest(found: DataFrame) -> DataFrame:
    """items, n_items, support, n_rules, best_item, rules_sha256 of mined itemsets."""
    best = F.array_min(F.transform("rules", lambda r: F.struct(r["a"].alias("a"), r["c"].alias("c"))))["c"]
    text = F.concat_ws(";", F.transform("rules", lambda r: F.concat_ws(":", r["c"].cast("string"), r["a"].cast("string"), r["s"].cast("string"))))
    return found.select(
        F.concat_ws(",", F.transform("items", lambda i: i.cast("string"))).alias("items"),
        F.size("items").cast("bigint").alias("n_items"),
        "support",
        F.size("rules").cast("bigint").alias("n_rules"),
        best.alias("best_item"),
        F.sha2(text, 256).alias("rules_sha256"),
    )


#: Cliques of frequent pairs, basket by basket, give every frequent set with its support; supersets and rests by lookup.
ORACLE_SQL = f"""
WITH RECURSIVE b AS (
  SELECT DISTINCT sale_id AS basket, item_id AS i FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL),
n AS (SELECT count(DISTINCT basket) AS b FROM b),
f AS (
  SELECT i, count(*) AS s FROM b GROUP BY i HAVING count(*) >= {LEAST} AND count(*) * {SHARE} >= (SELECT b FROM n)),
fb AS (SELECT basket, i FROM b JOIN f USING (i)),
p AS (
  SELECT x.i AS x, y.i AS y FROM fb x JOIN fb y ON x.basket = y.basket AND x.i < y.i
  GROUP BY x.i, y.i HAVING count(*) >= {LEAST} AND count(*) * {SHARE} >= (SELECT b FROM n)),
follow AS (
  SELECT u.basket, p.x, list(p.y) AS ys FROM fb u JOIN p ON p.x = u.i JOIN fb v ON v.basket = u.basket AND v.i = p.y GROUP BY u.basket, p.x),
cliques(basket, items, more) AS (
  SELECT fb.basket, [fb.i], coalesce(e.ys, []) FROM fb LEFT JOIN follow e ON e.basket = fb.basket AND e.x = fb.i
  UNION ALL
  SELECT c.basket, list_append(c.items, c.y), list_intersect(c.more, coalesce(e.ys, []))
  FROM (SELECT basket, items, more, unnest(more) AS y FROM cliques) c LEFT JOIN follow e ON e.basket = c.basket AND e.x = c.y),
sets AS (
  SELECT items, count(*) AS support FROM cliques GROUP BY items
  HAVING count(*) >= {LEAST} AND count(*) * {SHARE} >= (SELECT b FROM n)),
wider AS (
  SELECT list_filter(items, lambda z: z <> c) AS rest, c, items, support FROM (SELECT items, support, unnest(items) AS c FROM sets WHERE len(items) > 1)),
closed AS (
  SELECT s.items, s.support FROM sets s LEFT JOIN (SELECT rest, max(support) AS top FROM wider GROUP BY rest) w ON w.rest = s.items
  WHERE w.top IS NULL OR w.top < s.support),
rules AS (
  SELECT w.items, w.c, r.support AS a, f.s FROM wider w JOIN closed USING (items) JOIN sets r ON r.items = w.rest JOIN f ON f.i = w.c
  WHERE 100 * w.support >= {CONFIDENCE} * r.support AND w.support * (SELECT b FROM n) > r.support * f.s),
told AS (
  SELECT items, count(*) AS n_rules, arg_min(c, (a, c)) AS best_item, string_agg(c || ':' || a || ':' || s, ';' ORDER BY c) AS text FROM rules GROUP BY items)
SELECT array_to_string(c.items, ',') AS items, CAST(len(c.items) AS BIGINT) AS n_items, c.support, coalesce(t.n_rules, 0) AS n_rules,
  t.best_item, sha256(coalesce(t.text, '')) AS rules_sha256
FROM closed c LEFT JOIN told t ON t.items = c.items
"""
