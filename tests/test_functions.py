"""Known values of the text, hash, vector and quantization functions."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from rankloom.functions import quantize as Z
from rankloom.functions import text as T
from rankloom.functions import vectors as V
from rankloom.operators import features as X


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("über 2025", ["ü", "ber", "2", "0", "2", "5"]), ("你好世界", ["你好", "好世", "世界"]), ("k8s_v2 C++", ["k8s", "_", "v2", "c", "+", "+"]), ("", []), ("  \n", [])],
)
def test_unicode_tokens(spark, text, want):
    assert one(spark, text, T.unicode_tokens) == want


def test_whitespace_tokens(spark):
    assert one(spark, " A b C\t d ", T.whitespace_tokens) == ["a", "b", "c", "d"]
    assert one(spark, "", T.whitespace_tokens) == []


def test_char_ngrams(spark):
    grams = lambda t: sorted(one(spark, t, T.char_ngrams))
    assert grams("hello") == ["ell", "hel", "llo"]
    assert grams("ab") == ["ab"]
    assert grams("") == []
    assert grams(" Aaaa ") == ["aaa"]


def test_sentences(spark):
    assert one(spark, "One. Two!  Three; four ;five", T.sentences) == ["One.", "Two!", "Three", "four", "five"]


def test_json_object(spark):
    get = lambda t: one(spark, t, lambda c: T.json_object(c, "a int"))
    assert get('{"a": 1}').a == 1
    assert get('```json\n{"a": 2}\n```').a == 2
    assert get('so {"a": 3} it is').a == 3
    assert get("nothing") is None


@pytest.mark.parametrize(("token", "bucket", "sign"), [("python", 17, -1), ("bm25", 99, -1), ("data", 58, -1), ("ü", 96, -1), ("2", 212, 1)])
def test_token_hash(spark, token, bucket, sign):
    row = spark.createDataFrame([(token,)], "t string").select(V.token_bucket(F.col("t")), V.token_sign(F.col("t"))).first()
    assert tuple(row) == (bucket, sign)
    digest = hashlib.sha256(token.encode()).digest()
    assert int.from_bytes(digest[:4], "little") % 256 == bucket


def test_minhash(spark):
    texts = spark.createDataFrame([(1, "author"), (2, "auther"), (3, "a"), (4, "b"), (5, "")], "id int, t string")
    s = V.minhash_signatures(texts, "id", T.char_ngrams(F.col("t")))
    pairs = spark.createDataFrame([(1, 2), (3, 4), (1, 5), (1, 1)], "a int, b int")
    got = V.signature_jaccard(pairs, s.withColumnRenamed("id", "a"), "a", s.withColumnRenamed("id", "b"), "b")
    assert {(r.a, r.b): r.lsh_score for r in got.collect()} == {(1, 2): 0.3203125, (3, 4): 0.21875, (1, 5): 0.0, (1, 1): 1.0}
    exact = texts.alias("x").filter("id = 1").crossJoin(texts.filter("id = 2").withColumnRenamed("t", "u")).select(V.jaccard(T.char_ngrams(F.col("t")), T.char_ngrams(F.col("u")))).first()[0]
    assert exact == pytest.approx(2 / 6)


def test_minhash_without_rows_of_grams(spark):
    """Signatures as by brute force, made without a shuffle of grams by permutations; texts of one key are merged."""
    texts = {1: ["one longer text" * 3000], 2: ["你好世界, naïve"], 3: ["ab", "abc cba", "ab"], 4: ["", "  "], None: ["xyz", "xyw"]}
    rows = spark.createDataFrame([(k, t) for k, ts in texts.items() for t in ts] + [(5, None)], "id int, t string")
    grams = lambda t: {t} if 0 < len(t) < 3 else {t[i : i + 3] for i in range(len(t) - 2)}
    want = {}
    for k, ts in texts.items():
        of_key = set().union(*(grams(t.strip()) for t in ts))
        for p in range(4):
            want |= {(k, p): min([hashlib.sha256(f"{g}|{p}".encode()).hexdigest()[:16] for g in of_key] + [V.SENTINEL])} if of_key else {}
    assert {(r.id, r.perm): r.h for r in V.minhash_signatures(rows, "id", T.char_ngrams(F.col("t")), 4).collect()} == want
    alone = V.minhash_signatures(rows.filter("id < 3").repartition(4), "id", T.char_ngrams(F.col("t")), 4)
    assert "hashpartitioning(gram" not in alone._jdf.queryExecution().toString()
    pairs = rows.select("id", F.col("id").alias("other"), "t", F.lit("abc").alias("u"))
    got = {(r.id, r.t): r.lsh_score for r in V.minhash_jaccard(pairs, "id", T.char_ngrams(F.col("t")), "other", T.char_ngrams(F.col("u")), 4).collect()}
    same = sum(want[3, p] == min(hashlib.sha256(f"abc|{p}".encode()).hexdigest()[:16], V.SENTINEL) for p in range(4)) / 4
    assert got[3, "ab"] == got[3, "abc cba"] == same and got[4, ""] == got[5, None] == got[None, "xyz"] == 0.0


def test_keyword_hit_rate(spark):
    rate = lambda q, d: spark.createDataFrame([(q, d)], "q string, d string").select(X.keyword_hit_rate(F.col("q"), F.col("d"))).first()[0]
    assert rate("hello world", "hello world, how are you?") == 1.0
    assert rate("hello world", "hello everyone!") == 0.5
    assert rate("", "x") == 0.0


def test_bits(spark):
    rows = spark.createDataFrame([([1.0, -0.5, 0.3, -0.1], [-1.0, 0.5, -0.3, 0.1])], "a array<double>, b array<double>")
    row = rows.select(V.dense_bits(F.col("a")), V.dense_hamming(V.dense_bits(F.col("a")), V.dense_bits(F.col("b")))).first()
    assert row[0] == [1, 0, 1, 0] and row[1] == 4


def matrix(spark, rows):
    return spark.createDataFrame([(0, i, j, float(x)) for i, r in enumerate(rows) for j, x in enumerate(r)], "grp int, id int, dim int, x float")


def test_quantize_4bit_rounds_in_single_precision(spark):
    codes = Z.quantize_4bit(matrix(spark, [[-1], [0], [1]]), ["grp"])
    assert [r.code for r in codes.orderBy("id").collect()] == [0, 7, 15]
    back = Z.dequantize_4bit(codes).orderBy("id").collect()
    assert back[0].x == -1.0 and back[2].x == pytest.approx(1.0)


def test_pack_4bit(spark):
    codes = Z.quantize_4bit(matrix(spark, [[0, 5, 10], [15, 0, 20]]), ["grp"])
    packed = Z.pack_4bit(codes, ["id"]).orderBy("id", "byte").collect()
    assert [(r.id, r.byte, r.packed) for r in packed] == [(0, 0, 240), (0, 1, 0), (1, 0, 15), (1, 1, 15)]


def test_ternary(spark):
    codes = Z.quantize_ternary(matrix(spark, [[1, -2, 0], [0.1, 1, 0]]), ["grp"])
    assert [r.code for r in codes.orderBy("id", "dim").collect()] == [1, -1, 0, 0, 0, 0]
    assert Z.dequantize_ternary(codes).orderBy("id", "dim").first().x == pytest.approx(0.7)


def test_embedding_is_unit_or_empty(spark):
    rows = V.embed(spark.createDataFrame([(1, "a b c a"), (2, "")], "id int, t string"), "id", "t").collect()
    assert {r.id for r in rows} == {1}
    assert math.isclose(sum(r.w * r.w for r in rows), 1.0)
