"""Closed itemsets and rules against a plain enumeration of all itemsets."""

import hashlib
import random
from itertools import combinations

import pytest

from rankloom.llm import itemsets
from rankloom.llm import queries as Q

LINES = "sale_id long, item_id long, basket string, s long, items string"


def plain(lines, least, share):
    baskets = {}
    for b, i in lines:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    n = len(baskets)
    enough = lambda s: s >= least and s * share >= n
    support, level = {}, {(i,) for x in baskets.values() for i in x}
    while level:
        counts = {z: sum(set(z) <= x for x in baskets.values()) for z in level}
        found = {z: s for z, s in counts.items() if enough(s)}
        support |= found
        items = sorted({i for z in found for i in z})
        level = {z + (i,) for z in found for i in items if i > z[-1] and all(w in found for w in combinations(z + (i,), len(z)))}
    out = {}
    for z, s in support.items():
        if any(support.get(tuple(sorted((*z, i)))) == s for i in {j for w in support for j in w} - set(z)):
            continue
        rules = []
        for c in z if len(z) > 1 else ():
            a = support[tuple(i for i in z if i != c)]
            if 100 * s >= 60 * a and s * n > a * support[(c,)]:
                rules.append((c, a, support[(c,)]))
        best = min(rules, key=lambda r: (r[1], r[0]))[0] if rules else None
        text = ";".join(":".join(map(str, r)) for r in rules)
        out[",".join(map(str, z))] = (len(z), s, len(rules), best, hashlib.sha256(text.encode()).hexdigest())
    return out


def found(spark, lines, least=5, share=20_000):
    df = spark.createDataFrame([(b, i, "x", 1, "y") for b, i in lines], LINES)
    rows = itemsets.digest(itemsets.mine(df, least=least, share=share)).collect()
    out = {r["items"]: (r.n_items, r.support, r.n_rules, r.best_item, r.rules_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def dense(seed, n=60):
    """Items that imply others, that always occur together, and that every basket has; nulls and repeated rows."""
    r = random.Random(seed)
    lines = []
    for b in range(n):
        have = {i for i in range(9) if r.random() < 0.45}
        if 3 in have:
            have |= {0, 1}
        if have >= {4, 5}:
            have.add(6)
        if 7 in have:
            have |= {20, 21, 22}
        if seed % 2:
            have.add(99)
        lines += [(b, i) for i in have] + [(b, i) for i in have if r.random() < 0.2]
    return [*lines, (None, 1), (3, None), (None, None), (1000, 77)]


@pytest.mark.parametrize("seed", range(2))
def test_dense_baskets_equal_plain(spark, seed):
    lines = dense(seed)
    assert found(spark, lines) == plain(lines, 5, 20_000)


def test_large_baskets_and_shares_equal_plain(spark, monkeypatch):
    """Baskets that are looked up, in the sizes that come up, and both ways to join."""
    monkeypatch.setattr(itemsets, "LARGE", 8)
    monkeypatch.setattr(itemsets, "FEW", 3)
    lines = dense(8) + [(b, i) for b in (500, 501) for i in [*range(9), 20, 21, 22, *range(100, 140)]]
    assert found(spark, lines) == plain(lines, 5, 20_000)
    assert found(spark, lines, 5, 6) == plain(lines, 5, 6)


def test_long_copies_cost_pairs_not_subsets(spark):
    """Thirty items that always occur together, though in baskets of other items too: one closed set, not 2^30."""
    lines = [(b, i) for b in range(6) for i in range(30)] + [(b, 100 + b % 2) for b in range(14)]
    got = found(spark, lines)
    whole = ",".join(map(str, range(30)))
    assert set(got) == {whole, "100", "101"} and got[whole][:3] == (30, 6, 30)


def test_itemsets_of_awkward_tables(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, None), (None, 2)]) == {}
    same = [(b, i) for b in range(5) for i in (-3, 2)]
    assert found(spark, same) == plain(same, 5, 20_000) and list(found(spark, same)) == ["-3,2"]


def test_registered_itemsets_equal_plain(spark, sf):
    rows = Q.op12_basket_itemsets(spark, sf).collect()
    lines = [tuple(r) for r in spark.read.parquet(f"{sf}/sale_lines.parquet").select("sale_id", "item_id").collect()]
    assert {r["items"]: (r.n_items, r.support, r.n_rules, r.best_item, r.rules_sha256) for r in rows} == plain(lines, 5, 20_000)
