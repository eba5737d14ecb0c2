"""Exact percentiles, measured stages, teacher logs and verified stores."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankloom.operators import bm25, combine, metrics, rankers, teacher
from rankloom.plans import queries_rank
from rankloom.sources import store


def test_nearest_samples_equal_sorted(spark):
    r = random.Random(3)
    groups = {"a": [r.gauss(0, 1) for _ in range(300)], "b": [5.0], "c": [1.0, 1.0, 1e300, -1e300, 5e-324], None: [float(x) for x in range(10)], "d": [2.5] * 40 + [2.5000000001], "e": [None, float("nan"), float("inf"), 3.0, 4.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = {(x.g, x.share): x.x for x in metrics.nearest_samples(df, "v", shares, ["g"]).collect()}
    for g, vs in groups.items():
        order = sorted(v for v in vs if v is not None and abs(v) < float("inf"))
        assert [got[g, p] for p in shares] == [order[round(p * (len(order) - 1))] for p in shares]
    assert metrics.nearest_samples(df.limit(0), "v", shares).count() == 0
    whole = sorted(v for vs in groups.values() for v in vs if v is not None and abs(v) < float("inf"))
    assert metrics.nearest_samples(df, "v", [0.5]).first().x == whole[round((len(whole) - 1) / 2)]


def test_measured_stages_equal_staged(spark):
    rows = [(q, "red fox", i, "red " * (i % 3) + "fox runs", i) for q in range(3) for i in range(1, 6 + q)]
    candidates = spark.createDataFrame(rows, "query_id int, query string, doc_id int, doc string, pos int")
    stages = [combine.Stage("bm25", bm25.rerank, 5), combine.Stage("late", rankers.late_interaction, 2)]
    ranked, report = combine.staged_measured(candidates, stages)
    key = lambda df: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect())
    assert key(ranked) == key(combine.staged(candidates, stages))
    found = report.orderBy("stage").collect()
    counts = combine.stage_counts(candidates, stages).groupBy("stage").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out")).orderBy("stage").collect()
    assert [(r.n_in, r.n_out) for r in found] == [(r.n_in, r.n_out) for r in counts] and all(r.seconds > 0 and r.queries == 3 for r in found)
    _, report = combine.staged_measured(candidates.limit(0), stages)
    assert [(r.n_in, r.n_out) for r in report.collect()] == [(0, 0)] * 2


def test_teacher_log(spark):
    def graded(batch: pd.DataFrame, n: int) -> teacher.Answer:
        if (batch["n"] % 5 == 0).any() and n == 1:
            raise teacher.Retry("again")
        if len(batch) > 3:
            raise ValueError("too many")
        return teacher.Answer([int(x) * 2 for x in batch["n"]], "m", int(batch["n"].sum()), len(batch), 0.5)

    rows = spark.range(40).select(F.col("id").alias("n"), F.when(F.col("id") % 4 > 0, "x").alias("s"), F.lit(1).alias("label"))
    labelled, log = teacher.label_with_log(rows, "n", graded, "bigint", size=10, name="grade", wait=(0.0, 0.0))
    assert sorted((r.n, r.s, r.label, r.grade) for r in labelled.collect()) == [(n, "x" if n % 4 else None, 1, 2 * n) for n in range(40)]
    calls = log.collect()
    answered = [c for c in calls if c.outcome == "answered"]
    assert sum(c.input_tokens for c in answered) == sum(range(40)) and sum(c.n_rows for c in answered) == 40
    assert len({(c.batch, c["try"], c.depth, c.n_rows, c.seconds) for c in calls}) == len(calls) > len(answered)
    assert all(c["try"] == 1 for c in calls if c.outcome == "again") and {c.outcome for c in calls} == {"answered", "again", "failed"}
    total = teacher.cost_totals(log).first()
    assert total.total_tokens == sum(range(40)) + 40 and total.cost_usd == pytest.approx(0.5 * len(answered))
    labelled, log = teacher.label_with_log(rows.limit(0), "n", graded, "bigint")
    assert labelled.count() == log.count() == 0

    def never(batch: pd.DataFrame, n: int) -> teacher.Answer:
        raise teacher.Retry("never")

    with pytest.raises(Exception, match="never"):
        teacher.label_with_log(rows, "n", never, "bigint", wait=(0.0, 0.0))


def test_store_tells_damage(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(20).select("id", F.when(F.col("id") > 3, "x").alias("s")).repartition(3)

    cache = store.TableStore(spark, str(tmp_path))
    get = lambda: sorted((r.id, r.s) for r in cache.get_or_build("k", build).collect())
    want = get()
    assert get() == want and len(built) == 1
    parts = lambda: sorted(p for p in (tmp_path / "k").glob("part-*"))
    for n, damage in enumerate((lambda p: p.write_bytes(b"PAR1 broken"), lambda p: p.unlink(), lambda p: p.write_bytes(b""), lambda p: p.write_bytes(parts()[1].read_bytes())), 2):
        damage(parts()[0])
        for crc in (tmp_path / "k").glob(".*.crc"):
            crc.unlink()
        assert get() == want and len(built) == n
    (tmp_path / "_manifest-k" / "_SUCCESS").unlink()
    assert get() == want and len(built) == 6
    assert store.TableStore(spark, str(tmp_path), verify=False).get_or_build("k", build).count() == 20 and len(built) == 6
    empty = store.TableStore(spark, str(tmp_path))
    for _ in range(2):
        assert empty.get_or_build("none", lambda: spark.range(0)).count() == 0


def test_checksums_tell_where_nulls_stand_and_read_maps(spark, tmp_path, monkeypatch):
    def of(sql):
        path = str(tmp_path / str(len(list(tmp_path.iterdir()))))
        spark.sql(sql).coalesce(1).write.parquet(path)
        return list(store.checksums(spark.read.parquet(path)).values())

    assert of("SELECT map('a', 1) AS m, 2 AS n") == of("SELECT map('a', 1) AS m, 2 AS n") != of("SELECT map('a', 2) AS m, 2 AS n")
    monkeypatch.delattr(store.F, "to_json")  # only maps need it
    assert of("SELECT CAST(NULL AS INT) AS a, 1 AS b") != of("SELECT 1 AS a, CAST(NULL AS INT) AS b")
    [(n, h)] = of("SELECT id, -id AS m FROM range(1000)")
    rows = spark.sql("SELECT xxhash64(id, -id, false, false) AS h FROM range(1000)").collect()
    assert n == 1000 and h == sum(r.h for r in rows)


def test_teacher_log_of_single_rows_is_quick(spark):
    rows = spark.range(4000).withColumnRenamed("id", "n")
    one = lambda batch, n: teacher.Answer([0], cost_usd=0.5)
    teacher.label_with_log(rows.limit(8), "n", one, "bigint", size=1)
    began = time.monotonic()
    labelled, log = teacher.label_with_log(rows, "n", one, "bigint", size=1)
    assert time.monotonic() - began < 5  # 7 ms a call and core before
    assert labelled.count() == log.count() == 4000 and log.select("batch").distinct().count() == 4000


def test_uplift_retrieves_once(spark, sf, monkeypatch):
    found, of = [], queries_rank.R.candidates
    monkeypatch.setattr(queries_rank.R, "candidates", lambda *a: found.append(a) or of(*a))
    assert queries_rank.l08_uplift(spark, sf).count() == 1 and len(found) == 1
