"""Known values of claims, contradictions, splits, mining, generators, sources and settings."""

import json

import pytest
from pyspark.sql import functions as F

from rankloom import config
from rankloom.operators import claims as C
from rankloom.operators import mining, synth
from rankloom.sources import readers, store


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, doc string")


def found(spark, text):
    return {(r.entity, r.attribute, r.value) for r in C.extract_claims(docs(spark, text)).collect()}


def test_extraction(spark):
    got = found(spark, "Project Atlas's release year is 2025. Northwind Clinic: screening_status = approved.")
    assert ("Project Atlas", "release_year", "2025") in got and ("Northwind Clinic", "screening_status", "approved") in got
    got = found(spark, "For Project Atlas, release-year remains 2026; latency_ms for Model2Vec Potion-8M is 7.")
    assert ("Project Atlas", "release_year", "2026") in got and ("Model2Vec Potion-8M", "latency", "7") in got
    assert ("Project Atlas", "release_year", "2025") in found(spark, "Project Atlas is set to release in 2025.")
    assert ("Fusion Ranker", "best_metric", "NDCG@10") in found(spark, "The best metric for the Fusion Ranker is NDCG@10.")
    assert found(spark, "nothing stated here") == {("0", "raw_text", "nothing stated here")}
    assert found(spark, None) == {("0", "raw_text", "")}


def conflicts(spark, a, b):
    return spark.createDataFrame([(a, b)], "a string, b string").select(C.values_conflict(F.col("a"), F.col("b"))).first()[0]


@pytest.mark.parametrize(("a", "b", "want"), [("2025", "2026", True), ("2025", "2025", False), ("approved", "pending", True), ("5 ms", "5", False), ("5ms", "5", True), ("yes", "on", False), ("7%", "7", True), ("1.005", "1.0", False)])
def test_conflict(spark, a, b, want):
    assert conflicts(spark, a, b) is want
    assert conflicts(spark, b, a) is want


def checked(spark, *texts):
    claims = C.extract_claims(docs(spark, *texts)).withColumn("claim_id", F.col("doc_id") * 100 + F.col("n"))
    return C.check(claims)


def test_contradictions(spark):
    assert checked(spark, "Project Atlas reports release_year as 2025.", "Project Atlas reports release_year as 2026.").count() >= 1
    assert checked(spark, "Project Atlas reports release_year as 2025.", "Project Atlas reports release_year as 2025.").count() == 0
    assert checked(spark, "Potion-8M reveals a latency of only 2 milliseconds.", "Potion-8M has a latency of 7 milliseconds.").count() >= 1


def test_consistency_rank_puts_unrelated_first(spark):
    texts = ["Project Atlas reports release_year as 2025.", "Project Atlas reports release_year as 2026.", "The sea is calm today"]
    claims = C.extract_claims(docs(spark, *texts)).withColumn("claim_id", F.col("doc_id") * 100 + F.col("n"))
    rows = docs(spark, *texts).select(F.lit(0).alias("query_id"), "doc_id", F.col("doc_id").alias("pos"))
    ranked = C.consistency_rank(rows, C.penalties(C.contradictions(claims))).orderBy("rank").collect()
    assert ranked[0].doc_id == 2 and ranked[0].score == 0


def test_diagnose(spark):
    rows = spark.createDataFrame([("a", "Atlas reports size as 1.", "nothing here", True), ("b", "x", "y", True), ("c", "Atlas reports size as 1.", "Atlas reports size as 2.", True), ("d", "Atlas reports size as 1.", "Atlas reports size as 2.", False), ("e", "Atlas reports size as 1.", "Atlas reports size as 1.", True)], "id string, doc_a string, doc_b string, is_contradiction boolean")
    got = {r.id: r.miss_reason for r in C.diagnose(rows).collect()}
    assert got == {"a": "no_claims_from_doc_b", "b": "no_structured_claims_extracted", "d": "false_positive_detected", "e": "values_did_not_conflict(1 vs 1)"}


def test_split(spark):
    rows = spark.createDataFrame([(i, f"k{i % 7}") for i in range(70)], "i int, k string")
    a = {(r.i, r.split) for r in mining.split(rows, F.col("k"), 5).collect()}
    assert a == {(r.i, r.split) for r in mining.split(rows, F.col("k"), 5).collect()}
    by_key = {}
    for i, s in a:
        by_key.setdefault(i % 7, set()).add(s)
    assert all(len(s) == 1 for s in by_key.values()) and {s for _, s in a} == {"train", "validation", "test"}
    assert mining.split_cuts(4) == (3, 1) and mining.split_cuts(1) == (1, 0)
    assert mining.split(rows.limit(0), F.col("k")).count() == 0
    with pytest.raises(ValueError):
        mining.split_cuts(3, (0, 0, 0))


def test_hard_negatives(spark):
    q = spark.createDataFrame([(0, "red apple")], "query_id int, query string")
    d = spark.createDataFrame([(i, t) for i, t in enumerate(["red apple pie", "red car", "apple tree", "blue sea", "green hill", "grey sky"])], "doc_id int, doc string")
    rel = spark.createDataFrame([(0, 0, 2)], "query_id int, doc_id int, rel int")
    got = mining.hard_negatives(q, d, rel, per_query=4, ratio=0.5).orderBy("place").collect()
    assert [r.doc_id for r in got][:1] == [0] and {r.doc_id for r in got[1:3]} == {1, 2} and len(got) == 4 and got[0].score == 2
    for ratio in (1.5, -0.1):
        with pytest.raises(ValueError):
            mining.hard_negatives(q, d, rel, ratio=ratio)


def test_active_loop_never_labels_twice(spark):
    c = spark.createDataFrame([(0, i) for i in range(6)], "query_id int, doc_id int")
    labelled, counts = mining.active_loop(c, lambda rows, i: rows.filter(F.col("doc_id") <= i + 1), lambda rows: rows.withColumn("label", F.lit(1)))
    assert counts == [2, 1, 1] and labelled.count() == labelled.select("doc_id").distinct().count() == 4


def test_generators(spark):
    seeds = spark.createDataFrame([(i, f"q{i}", f"p{i}", f"n{i}") for i in range(5)], "seed_id int, query string, positive string, negative string")
    rows = synth.pairs(seeds, 24).collect()
    assert len(rows) == 24 and sum(r.score == 3 for r in rows) >= 5
    assert [(r.score) for r in sorted(rows, key=lambda r: r.idx)[10:14]] == [2, 3, 0, 1]
    assert synth.validate(synth.pairs(seeds, 24), "pairs").filter("valid").count() == 24
    one = synth.contradictions(spark, 16, 2)
    assert one.filter("is_contradiction").count() == 16 and one.filter("NOT is_contradiction AND value_a = value_b").count() == 2
    report = synth.distribution(spark.createDataFrame([("a",)] * 7 + [("b",)] * 2, "l string"), "l").orderBy("label").collect()
    assert [(r.label, r["count"], r.proportion, r.imbalance_ratio, r.is_balanced_enough) for r in report] == [("a", 7, 0.7778, 3.5, False), ("b", 2, 0.2222, 3.5, False)]
    assert synth.cost_summary(spark.createDataFrame([], "dataset string, cost_usd double"), 10).first().source == "configured_estimate"


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "x.jsonl")
    assert readers.read_jsonl(spark, path, "a int").count() == 0
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in readers.read_jsonl(spark, path, "a int").collect()) == [1, 2]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{broken\n')
    with pytest.raises(Exception):  # noqa: B017
        readers.read_jsonl(spark, path, "a int").collect()
    readers.write_json(tmp_path / "m.json", {"b": 1, "a": 2})
    assert readers.read_json(tmp_path / "m.json") == {"a": 2, "b": 1}


def test_retrieval_datasets(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id": "d1", "title": "T", "text": "one"}\n{"_id": "d2", "text": "two"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q1", "text": "ask"}\n')
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t2\nq1\td2\t0\nq1\t0\td3\t1\n")
    simple = readers.beir_simple(spark, str(tmp_path))
    assert {(r.doc_id, r.doc) for r in simple["corpus"].collect()} == {("d1", "one"), ("d2", "two")}
    assert {(r.doc_id, r.rel) for r in simple["qrels"].collect()} == {("d1", 2), ("d2", 0), ("d3", 1)}
    whole = readers.beir_comprehensive(spark, str(tmp_path))
    assert {r.doc for r in whole["corpus"].collect()} == {"T one", "two"}
    assert {(r.doc_id, r.rel) for r in whole["qrels"].collect()} == {("d1", 2), ("d3", 1)}
    rows = readers.judged_rows(simple["qrels"], simple["queries"], simple["corpus"]).collect()
    assert {r.doc for r in rows} == {"one", "two", ""}


def test_custom_dataset(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"queries": {"a": "x", "b": "y"}, "corpus": {"1": "plain", "2": {"text": "t"}, "3": {"title": "h", "text": "u"}}, "qrels": {"a": {"1": 2}}}))
    data = readers.custom_beir(spark, str(path))
    assert {(r.doc_id, r.title, r.doc) for r in data["corpus"].collect()} == {("1", "", "plain"), ("2", "", "t"), ("3", "h", "u")}
    assert [tuple(r) for r in data["qrels"].collect()] == [("a", "1", 2)] and data["queries"].count() == 2
    path.write_text(json.dumps({"queries": {"a": "x"}}))
    with pytest.raises(ValueError, match="corpus, qrels"):
        readers.custom_beir(spark, str(path))


def test_store(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    cache = store.TableStore(spark, str(tmp_path / "c"))
    for force in (False, False, True):
        assert cache.get_or_build("k", build, force).count() == 3
    assert len(built) == 2
    texts = spark.createDataFrame([("a",), ("b",)], "t string")
    key = store.content_of(texts, "t")
    assert len(key) == 16 and key == store.content_of(texts.orderBy(F.desc("t")), "t") != store.content_of(texts.limit(1), "t")
    assert store.label_key("d", ["y", "x"]) == store.label_key("d", ["x", "y"])
    path = str(tmp_path / "m")
    with pytest.raises(FileNotFoundError):
        store.load_model(spark, path, "k")
    store.save_model(spark, path, "k", {"n": "2"}, {"t": spark.range(2)})
    settings, tables = store.load_model(spark, path, "k")
    assert settings == {"n": "2"} and tables["t"].count() == 2
    with pytest.raises(ValueError, match="not a other"):
        store.load_model(spark, path, "other")


def test_settings():
    s = config.from_environment(environment={"RANKLOOM_LATE_INTERACTION__USE_SALIENCE": "off", "RANKLOOM_BINARY__BILINEAR_TOP_K": "7", "HOME": "x"})
    assert s.late_interaction.use_salience is False and s.binary.bilinear_top_k == 7 and s.hybrid.trees == 120
    assert config.sweep(s, {"a": {"lsh": {"ngram": 4}}})["a"].lsh.ngram == 4
    with pytest.raises(ValueError):
        config.with_overrides(s, {"nothing": {}})
    assert config.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_searches_equal_finditer():
    """Searches that begin where the rest of a pattern matches find what finditer finds, in time linear in long segments."""
    import random
    import re
    import time

    from rankloom.operators import claim_patterns as P

    r = random.Random(4)
    words = "Fox fox 3 -x .y a the of has is was for within with , ' 's : - = reports as at confirms remains release released in will be now The K9 a/b _u shows reported to have actually screening status best metric characterized by features makes demonstrates recorded known its low according set that\n \u00a0 é".split(" ")
    compiled, found = C._compiled(), set()
    generic = (0, re.compile(P.GENERIC), (1, 2, 3), tuple(map(re.compile, P.GENERIC_REST)))
    texts = ["".join(r.choice(words) + r.choice(["", " ", " ", " ", " ", "\n", "."]) for _ in range(r.randrange(2, 24))) for _ in range(3000)]
    texts += [t.replace("{E}", "Red Fox").replace("{A}", "top speed").replace("{V}", "9 ms.") for t in ("so {E} reports {A} as {V}", "The {A} of {E} is {V}", "{E} has a {A} of {V}", "x, {E}: {A} = {V}", "with a {A} of {V}, {E}", "a {A} of {V} makes {E}", "according to {E}, {A} is {V}")]
    for text in texts:
        for i, pattern, groups, rest in [*compiled, generic]:
            want = [(i, m[0], *(m[g] if g else "" for g in groups)) for m in pattern.finditer(text)]
            assert C._search(text, [(i, pattern, groups, rest)]) == want
            assert not want or pattern is generic[1] or i not in P.NEVER
            found |= {pattern for _ in want}
    assert len(found) >= 10
    began = time.time()
    C._search("The old fox has seen reports - and shows for all of us is " * 1500, [c for c in compiled if c[0] not in P.NEVER])
    C._search("The old fox shows " * 5000, [generic])
    assert time.time() - began < 60
