"""Contradictions by classes against all pairs."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rankloom.operators import claims as C
from rankloom.operators import conflicts

CLAIMS = "claim_id long, doc_id long, entity string, attribute string, value string"
VALUES = ["1", "1.0", "1.01", "1.02", "1.009999", "10 ms", "10", "10.005 ms", "10.02ms", "yes", "Yes", "active", "on", "off", "nan", "inf", "-inf", "1e300", "1e17", "100000000000000016", "7 %", "7", "", "0", "-0.0", "-0.01", "0.02", "text", "other text", None]


def claims(n=260, seed=1, values=VALUES):
    r = random.Random(seed)
    rows = [(i, r.choice([*range(40), None] if i % 17 == 0 else range(40)), r.choice([" Fox", "fox ", "whale", None]), r.choice(["price", "size", "raw_text"]), r.choice(values)) for i in range(n)]
    return rows


def links(pairs):
    out = Counter()
    for r in pairs:
        out[r.claim_id_a] += 1
        out[r.claim_id_b] += 1
    return out


def expected(rows, found, key):
    out = defaultdict(lambda: [None, 0, 0])
    for i, doc, entity, attribute, value in rows:
        k = key(entity, attribute)
        if None in (doc, value) or k is None:
            continue
        c = out[(*k, value)]
        c[0] = i if c[0] is None else min(c[0], i)
        c[1] += 1
        c[2] += found[i]
    return {k: tuple(v) for k, v in out.items()}


def near_numbers():
    r = random.Random(9)
    return [f"{r.randrange(300) / 100:.2f}" for _ in range(60)] + [repr(0.3 + k * 0.001) for k in range(40)] + [repr(1e15 + k) for k in range(3)] + [repr(2.0**40 + k * 2.0**-12) for k in range(50)]


@pytest.mark.parametrize("values", [VALUES, near_numbers()])
def test_classes_equal_pairs(spark, values):
    rows = claims(values=values)
    df = spark.createDataFrame(rows, CLAIMS).repartition(3)
    pairs = C.contradictions(df).collect()
    named = lambda e, a: None if e is None or a == "raw_text" else (e.strip().lower(), a)
    got = {(r.entity_key, r.attribute, r.value): (r.class_id, r.n_claims, r.n_links) for r in conflicts.contradiction_classes(df).collect()}
    assert got == expected(rows, links(pairs), named) and sum(x[2] for x in got.values()) == 2 * len(pairs) > 0
    penalty = {r.doc_id: r.penalty for r in conflicts.penalties(df).collect()}
    assert penalty == {r.doc_id: r.penalty for r in C.penalties(C.contradictions(df)).collect()}


def test_small_numeric_groups_are_compared_where_they_lie(spark, monkeypatch):
    """Only large groups and those with other values than finite numbers are sorted; links are those of all pairs."""
    r = random.Random(3)
    entities = [f"part {i}" for i in range(40)] + ["large"] * 20
    rows = [(i, r.randrange(25), r.choice(entities), r.choice(["price", "size"]), r.choice(near_numbers())) for i in range(900)]
    rows += [(900 + i, i, "part 3", "price", v) for i, v in enumerate(["7 %", "nan", "yes"])]
    seen, plain = [], conflicts._sorted

    def watched(part, group, tolerance):
        seen.extend(part.select("entity_key", "attribute").distinct().collect())
        return plain(part, group, tolerance)

    monkeypatch.setattr(conflicts, "_sorted", watched)
    df = spark.createDataFrame(rows, CLAIMS).repartition(3)
    pairs = C.contradictions(df).collect()
    got = {(x.entity_key, x.attribute, x.value): (x.class_id, x.n_claims, x.n_links) for x in conflicts.contradiction_classes(df).collect()}
    assert got == expected(rows, links(pairs), lambda e, a: (e, a)) and sum(x[2] for x in got.values()) == 2 * len(pairs) > 0
    assert {tuple(x) for x in seen} == {("large", "price"), ("large", "size"), ("part 3", "price")}


def test_fuzzy_and_raw_classes_equal_pairs(spark):
    r = random.Random(6)
    names = ["ship latency", "latency ship", "latency-ship", "price"]
    rows = [(i, r.randrange(30), r.choice(["fox", "whale"]), r.choice(names), r.choice(VALUES[:14] + VALUES[-4:-1])) for i in range(150)]
    df = spark.createDataFrame(rows, CLAIMS)
    pairs = C.fuzzy_contradictions(df).collect()
    got = {(x.entity_key, x.attribute, x.value): (x.class_id, x.n_claims, x.n_links) for x in conflicts.fuzzy_classes(df).collect()}
    assert got == expected(rows, links(pairs), lambda e, a: None if a in ("price", "latency-ship") else (e, a)) and pairs
    rows = [(i, r.randrange(30), r.choice(["red fox", "fox red", "blue whale"]), "raw_text", r.choice(VALUES[:14] + VALUES[-4:-1])) for i in range(120)]
    df = spark.createDataFrame(rows, CLAIMS)
    pairs = C.raw_contradictions(df).collect()
    got = {(x.label, x.value): (x.class_id, x.n_claims, x.n_links) for x in conflicts.raw_classes(df).collect()}
    assert got == expected(rows, links(pairs), lambda e, a: (f"{e} {a}",)) and pairs


def test_labels_with_one_vector_meet_once(spark):
    """Labels of the same tokens in any order are one vector, so far fewer vectors than labels are compared."""
    r = random.Random(8)
    names = ["".join(r.sample("123", 3)) + " fox" * (i % 2) for i in range(60)] + ["77777", "77771"]
    rows = [(i, r.randrange(50), names[i % len(names)], "raw_text", r.choice(VALUES[:14])) for i in range(124)]
    df = spark.createDataFrame(rows, CLAIMS)
    labelled = df.selectExpr("concat(entity, ' raw_text') AS label")
    named, vectors = C.label_vectors(labelled)
    assert named.count() == len(set(names)) == 14 and vectors.select("vector").distinct().count() == 4
    assert C.aligned_vectors(vectors).count() == 6
    pairs = C.raw_contradictions(df).collect()
    assert {(x.label, x.other) for x in pairs} >= {("77777 raw_text", "77771 raw_text"), ("123 raw_text", "321 raw_text")}
    got = {(x.label, x.value): (x.class_id, x.n_claims, x.n_links) for x in conflicts.raw_classes(df).collect()}
    assert got == expected(rows, links(pairs), lambda e, a: (f"{e} {a}",)) and pairs


def test_raw_pairs_by_blocks_are_all_pairs(spark, monkeypatch):
    """However a vector's claims are cut into blocks, chunks and tasks, each pair is given once; repeated claims count each."""
    r = random.Random(11)
    names = ["red fox", "fox red", "blue whale", "77777", "77771"]
    rows = [(r.randrange(90), r.choice([*range(40), None]), r.choice(names), r.choice(["raw_text"] * 9 + ["price"]), r.choice(VALUES)) for _ in range(230)]
    facts = spark.createDataFrame(list(enumerate(v for *_, v in rows)), "i long, value string")
    other = facts.withColumnsRenamed({"i": "j", "value": "v"})
    apart = {(x.i, x.j) for x in facts.crossJoin(other).filter(C.values_conflict(F.col("value"), F.col("v"))).collect()}
    near = [set(names[:2]), {"blue whale"}, set(names[3:])]
    whole = [i for i, x in enumerate(rows) if None not in x and x[3] == "raw_text"]
    side = lambda x: (f"{x[2]} raw_text", x[0], x[1], x[4])
    meets = lambda a, b: a[0] < b[0] and a[1] != b[1] and any({a[2], b[2]} <= g for g in near)
    pairs = Counter(side(rows[i]) + side(rows[j]) for i in whole for j in whole if meets(rows[i], rows[j]) and (i, j) in apart)
    for block, chunk, tried in ((C.BLOCK, C.CHUNK, C.TASK_PAIRS), (3, 9, 400), (1, 1, 50)):
        monkeypatch.setattr(C, "BLOCK", block)
        monkeypatch.setattr(C, "CHUNK", chunk)
        monkeypatch.setattr(C, "TASK_PAIRS", tried)
        found = C.raw_contradictions(spark.createDataFrame(rows, CLAIMS).repartition(3))
        assert found.columns == ["label", "claim_id_a", "doc_id_a", "value_a", "other", "claim_id_b", "doc_id_b", "value_b"]
        assert Counter(map(tuple, found.collect())) == pairs and pairs
    assert C.raw_contradictions(spark.createDataFrame([], CLAIMS)).count() == 0


def test_raw_pairs_take_few_bytes(spark, tmp_path):
    """All pairs are most of what is written, so their order lets a file keep a pair in a fraction of a byte."""
    r = random.Random(12)
    rows = [(i, i, "fox", "raw_text", str(int(r.expovariate(1 / 50)))) for i in range(2_000)]
    C.raw_contradictions(spark.createDataFrame(rows, CLAIMS)).select("claim_id_a", "claim_id_b").write.parquet(str(tmp_path / "pairs"))
    n = spark.read.parquet(str(tmp_path / "pairs")).count()
    assert n == sum(a[4] != b[4] for i, a in enumerate(rows) for b in rows[:i])
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < n / 2


def test_edges(spark):
    empty = spark.createDataFrame([], CLAIMS)
    assert conflicts.contradiction_classes(empty).count() == conflicts.fuzzy_classes(empty).count() == conflicts.raw_classes(empty).count() == 0
    # a group with most of all claims, over many cells of values: as many links as pairs, in work linear in the claims
    rows = [(i, i, "fox", "price", str(i % 5000)) for i in range(20_000)]
    got = conflicts.contradiction_classes(spark.createDataFrame(rows, CLAIMS)).agg({"n_links": "sum", "n_claims": "sum"}).first()
    assert tuple(sorted(got)) == (20_000, 20_000 * (20_000 - 4))


def test_unit_prices_round_as_sql(spark, tmp_path):
    """1.005 * 100 is below 100.5, so the first price is 1.00 and conflicts with 1.01; a line without flag states nothing."""
    from rankloom.plans import queries_claims as Q

    lines = [(1, 1, 7, 2.0, 2.01, "A"), (2, 1, 7, 2.0, 2.02, "A"), (3, 1, 7, 1.0, 9.0, None), (4, 1, 7, 1.0, 8.0, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert [tuple(r) for r in Q.f05_contradictions(spark, str(tmp_path)).collect()] == [(11, 21, "part 7", "unit price_a")]
