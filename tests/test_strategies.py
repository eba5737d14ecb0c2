"""Fitted strategies, grids of them, outside teachers, and settings and archives from files."""

import zipfile
from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom import config
from rankloom.operators import bm25, strategies, teacher, training
from rankloom.sources import readers

NAMES = ["u", "v", "w"]


def _lists(spark):
    rng = np.random.default_rng(5)
    rows = []
    for q in range(6):
        for pos in range(1, 8):
            x = rng.normal(size=2)
            rows.append((q, pos, float(rng.integers(0, 4)), float(x[0]), float(x[1]), 1.0))
    return rows, spark.createDataFrame(rows, "query_id int, pos int, label double, u double, v double, w double")


def _likelihood(x, y, w):
    order = sorted(range(len(y)), key=lambda i: (-y[i], i))
    s = x @ w
    pull = np.zeros(len(y))
    for k, i in enumerate(order):
        rest = order[k:]
        e = np.exp(s[rest])
        pull[i] += 1
        pull[rest] -= e / e.sum()
    return (pull / len(y)) @ x


def _exchange(x, y, w):
    s, gain = x @ w, 2.0**y - 1
    by = lambda c: {i: k for k, i in enumerate(sorted(range(len(y)), key=lambda i: (-round(c[i], 9), i)), 1)}
    rank, best = by(s), by(y)
    ideal = sum(gain[i] / np.log2(best[i] + 1) for i in best)
    out = np.zeros(x.shape[1])
    for i in range(len(y)):
        for j in range(len(y)):
            if y[i] > y[j]:
                change = (gain[i] - gain[j]) * abs(1 / np.log2(rank[i] + 1) - 1 / np.log2(rank[j] + 1)) / ideal
                out += change / (1 + np.exp(s[i] - s[j])) * (x[i] - x[j])
    return out


@pytest.mark.parametrize(("loss", "gradient"), [("listwise", _likelihood), ("lambdaloss", _exchange)])
def test_listwise_weights_match_brute_force(spark, loss, gradient):
    rows, df = _lists(spark)
    data = np.array(rows)
    x = data[:, 3:]
    deviation = x.std(axis=0)
    scale = np.where(deviation > 1e-12, 1 / np.where(deviation > 1e-12, deviation, 1), 0)
    w = np.zeros(3)
    for _ in range(4):
        w = w + 0.5 * sum(gradient(x[data[:, 0] == q] * scale, data[data[:, 0] == q, 2], w) for q in range(6)) / 6
    got = training.listwise_weights(df, "label", NAMES, loss, steps=4)
    assert np.allclose([got[n] for n in NAMES], w * scale, atol=1e-8) and got["w"] == 0


def test_listwise_edges(spark):
    _, df = _lists(spark)
    assert training.listwise_weights(df.limit(0), "label", NAMES, steps=1) == dict.fromkeys(NAMES, 0.0)
    equal = df.withColumn("label", F.lit(1.0))
    assert training.listwise_weights(equal, "label", NAMES, "lambdaloss", steps=1) == dict.fromkeys(NAMES, 0.0)
    with pytest.raises(ValueError, match="unknown loss"):
        training.listwise_weights(df, "label", NAMES, "other")


def _judged(spark):
    docs = ["red fox runs", "a red fox", "blue whale swims", "nothing at all"]
    rows = [(q, "red fox" if q % 2 else "blue whale", 10 * q + i, d, i + 1, int(("fox" in d) == bool(q % 2) and i < 3) * 2) for q in range(4) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "query_id int, query string, doc_id int, doc string, pos int, rel int")


def test_strategies_by_name(spark):
    judged = _judged(spark)
    built = strategies.build(judged, {"bm25": {}, "listwise": {"steps": 3}, "distilled": {"steps": 10}, "binary": {"steps": 5}, "hybrid": {"maxIter": 2, "mode": "learned"}})
    for ranker in built.values():
        assert ranker(judged.drop("rel")).groupBy("query_id").agg(F.max("rank").alias("n")).filter("n = 4").count() == 4
    best = built["listwise"](judged.drop("rel")).filter("rank = 1").join(judged.select("query_id", "doc_id", "rel"), ["query_id", "doc_id"])
    assert best.filter("rel > 0").count() == 4
    with pytest.raises(ValueError, match="unknown strategies: other"):
        strategies.build(judged, {"other": {}})
    with pytest.raises(ValueError, match="no strategies"):
        strategies.build(judged, {})


def test_grids(spark):
    judged = _judged(spark)
    assert strategies.ablation(judged).count() == 1 + len(strategies.STATIC_WEIGHTS)
    sizes = {r.variant: r for r in strategies.scaling(judged, bm25.rerank, (1, 4)).collect()}
    assert sizes[1].queries == sizes[4].queries == 4 and sizes[4].ndcg >= sizes[1].ndcg


def test_teacher_batches(spark):
    def few(batch):
        if len(batch) > 3:
            raise ValueError("too many")
        return (batch["n"] * 2).tolist()

    rows = spark.range(50).withColumnRenamed("id", "n").repartition(3)
    assert sorted((r.n, r.label) for r in teacher.label_batches(rows, few, "bigint").collect()) == [(n, 2 * n) for n in range(50)]
    assert teacher.label_batches(rows.limit(0), few, "bigint").count() == 0
    short = lambda batch: [1] * (len(batch) - (len(batch) > 1))
    assert teacher.label_batches(rows, short, "int").filter("label = 1").count() == 50
    with pytest.raises(Exception, match="never"):
        teacher.label_batches(rows, lambda batch: 1 / 0 if len(batch) > 1 else (_ for _ in ()).throw(ValueError("never")), "int").collect()


def test_settings_file(tmp_path):
    path = tmp_path / "s.yaml"
    path.write_text("lsh:\n  ngram: 4\nhybrid:\n  mode: learned\n")
    s = config.from_yaml(str(path))
    assert s.lsh.ngram == 4 and s.lsh.permutations == 128 and s.hybrid.mode == "learned"
    path.write_text("")
    assert config.from_yaml(str(path), s) == s
    path.write_text("other: {}\n")
    with pytest.raises(ValueError, match="unknown settings"):
        config.from_yaml(str(path))


def test_plain():
    @dataclass
    class Inner:
        n: int

    @dataclass
    class Outer:
        many: tuple

    class Model:
        def model_dump(self):
            return {"m": 1}

    assert readers.plain({"a": [Outer((Inner(1), 2)), Model()], "b": None}) == {"a": [{"many": [{"n": 1}, 2]}, {"m": 1}], "b": None}


def test_unpack(tmp_path):
    good, bad = tmp_path / "good.zip", tmp_path / "bad.zip"
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("d/x.txt", "x")
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("ok.txt", "x")
        z.writestr("../out.txt", "x")
    out = readers.unpack(good, tmp_path / "to", readers.checksum(good).upper())
    assert (out / "d" / "x.txt").read_text() == "x"
    with pytest.raises(ValueError, match="outside"):
        readers.unpack(bad, tmp_path / "other")
    assert not (tmp_path / "other").exists() and not (tmp_path / "out.txt").exists()
    with pytest.raises(ValueError, match="checksum"):
        readers.unpack(good, tmp_path / "third", "0" * 64)


def test_named_datasets(spark, tmp_path):
    both = tmp_path / "collectionandqueries"
    both.mkdir()
    (tmp_path / "qrels").mkdir()
    (both / "collection.tsv").write_text("1\tone\n2\ttwo\nbroken\n")
    (both / "queries.tsv").write_text("q\task\n")
    (tmp_path / "qrels" / "test.tsv").write_text("q\t0\t1\t2\nq\t0\t2\t0\nq\t1\t1\n")
    data = readers.trec_covid(spark, str(tmp_path))
    assert sorted(map(tuple, data["corpus"].collect())) == [("1", "one"), ("2", "two")]
    assert list(map(tuple, data["queries"].collect())) == [("q", "ask")] and list(map(tuple, data["qrels"].collect())) == [("q", "1", 2)]
    (tmp_path / "qrels" / "collectionandqueries").mkdir()
    (tmp_path / "qrels" / "collectionandqueries" / "docs.tsv").write_text("1\tT\tone\n")
    assert list(map(tuple, readers.trec_covid(spark, str(tmp_path))["corpus"].collect())) == [("1", "T one")]
    root = tmp_path / "n" / "nfcorpus"
    (root / "qrels").mkdir(parents=True)
    (root / "corpus.jsonl").write_text('{"_id": "d", "title": "T", "text": "x"}\n')
    (root / "test.queries.jsonl").write_text('{"_id": "q", "text": "a"}\n')
    (root / "train.queries.jsonl").write_text('{"_id": "q", "text": "b"}\n{"_id": "r", "text": "c"}\n')
    (root / "qrels" / "test.tsv").write_text("q\t0\td\t1\n")
    data = readers.nfcorpus(spark, str(tmp_path / "n"))
    assert sorted(map(tuple, data["queries"].collect())) == [("q", "b"), ("r", "c")] and data["qrels"].count() == data["corpus"].count() == 1
    assert all(d.count() == 0 for d in readers.trec_covid(spark, str(tmp_path / "absent")).values())
