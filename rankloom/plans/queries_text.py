"""Text functions, hashing and vector functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quantize as Z
from ..functions import text as T
from ..functions import vectors as V
from ..functions.vocabulary import vocabulary_ids
from ..operators import phrases
from . import relations as R
from .registry import query

_DOC = "SELECT doc_id, {} FROM documents"


def _docs(spark, sf):
    return R.table(spark, sf, "documents")


@query(_DOC.format(f"{R.sql_words('text')} AS tokens"))
def b01_whitespace_tokens(spark, sf):
    return _docs(spark, sf).select("doc_id", T.whitespace_tokens(F.col("text")).alias("tokens"))


@query(_DOC.format(f"{R.sql_tokens('text')} AS tokens"))
def b02_unicode_tokens(spark, sf):
    return _docs(spark, sf).select("doc_id", T.unicode_tokens(F.col("text")).alias("tokens"))


@query()
def b03_vocabulary_tokens(spark, sf):
    """Ids of every document's words in a given vocabulary, by greedy longest match."""
    import public_tokenizers

    return vocabulary_ids(_docs(spark, sf), "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"))


@query(f"SELECT conv_id, turn, list_sort({R.sql_grams('text')}) AS grams FROM conversations")
def b04_char_ngrams(spark, sf):
    return R.table(spark, sf, "conversations").select("conv_id", "turn", F.sort_array(T.char_ngrams(F.col("text"))).alias("grams"))


@query("SELECT item_id, doc_id, CAST(contains(lower(d.text), lower(b.text)) AS DOUBLE) AS exact_phrase_match FROM benchmark b, documents d WHERE contains(lower(d.text), lower(b.text))")
def b05_phrase_containment(spark, sf):
    """Benchmark passages in whole documents, whatever the case, by an anchor index."""
    items = R.questions(spark, sf).select("query_id", F.lower("query").alias("query"))
    docs = R.corpus(spark, sf).select("doc_id", F.lower("doc").alias("doc"))
    return phrases.containing(docs, items).select(F.col("query_id").alias("item_id"), "doc_id", F.lit(1.0).alias("exact_phrase_match"))


_MARK = "chr(9246)"


@query(
    f"SELECT doc_id, [s FOR s IN [{R.sql_stripped('x')} FOR x IN string_split(regexp_replace(regexp_replace(text, '([.!?]){R.SPACE}+', '\\1' || {_MARK}, 'g'), '{R.SPACE}*;{R.SPACE}*', {_MARK}, 'g'), {_MARK})] IF s <> ''] AS segments FROM documents"
)
def b06_sentences(spark, sf):
    return _docs(spark, sf).select("doc_id", T.sentences(F.col("text")).alias("segments"))


@query(_DOC.format(f"trim(regexp_replace(text, '{R.SPACE}+', ' ', 'g')) AS text"))
def b07_normalize_space(spark, sf):
    return _docs(spark, sf).select("doc_id", T.normalize_space(F.col("text")).alias("text"))


@query(_DOC.format("substring(text, 1, 500) AS t500, substring(text, 1, 800) AS t800, substring(text, 1, 120) AS t120"))
def b12_truncate(spark, sf):
    """The operator shortens texts to 500, 800 and 120 characters; that is its feature."""
    t = F.col("text")
    return _docs(spark, sf).select("doc_id", T.truncate(t, 500).alias("t500"), T.truncate(t, 800).alias("t800"), T.truncate(t, 120).alias("t120"))


@query(
    r"SELECT item_id, CAST(regexp_matches(text, '\p{Nd}') AS DOUBLE) AS has_numbers, CAST(regexp_matches(text, '[^\p{L}\p{N}\t-\r\x1c-\x20\x85\xa0]') AS DOUBLE) AS has_special, CAST(length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS DOUBLE) / greatest(length(text), 1) AS capital_ratio FROM benchmark"
)
def b13_query_shape(spark, sf):
    rows = R.table(spark, sf, "benchmark")
    return rows.select("item_id", *[c.alias(n) for n, c in T.query_shape(F.col("text")).items()])


_ROUND = "round({}, 6)"
_VOCAB = f"v AS (SELECT DISTINCT unnest({R.sql_tokens('text')}) AS token FROM documents)"


@query(f"WITH {_VOCAB} SELECT token, {R.sql_bucket('token')} AS bucket, {R.sql_sign('token')} AS sign FROM v")
def c01_hashed_vocabulary(spark, sf):
    rows = _docs(spark, sf).select(F.explode(T.unicode_tokens(F.col("text"))).alias("token"))
    return V.hashed_vocabulary(rows)


_TURN = "t AS (SELECT conv_id * 10000 + turn AS id, text FROM conversations)"


def _turns(spark, sf):
    return R.table(spark, sf, "conversations").select((F.col("conv_id") * 10_000 + F.col("turn")).alias("id"), "text")


@query(f"WITH {_TURN}, {R.sql_embedding('t', 'id', 'text', 'e')} SELECT id, bucket, round(w, 6) AS w FROM e")
def c03_embed(spark, sf):
    """Counts of signed buckets, normalised to length 1."""
    return V.embed(_turns(spark, sf), "id", "text").withColumn("w", F.round("w", 6))


_EX_VECTORS = f"WITH {R.SQL_EXCHANGES}, {R.sql_embedding('ex', 'query_id', 'query', 'eq')}, {R.sql_embedding('ex', 'doc_id', 'doc', 'ed')}"
_EX_DOT = f"{_EX_VECTORS}, dots AS (SELECT ex.query_id, coalesce(sum(eq.w * ed.w), 0) AS dot FROM ex LEFT JOIN eq USING (query_id) LEFT JOIN ed ON ed.doc_id = ex.doc_id AND ed.bucket = eq.bucket GROUP BY ex.query_id)"


def _exchange_dots(spark, sf):
    ex = R.exchanges(spark, sf)
    return V.dot(ex, V.embed(ex, "query_id", "query"), "query_id", V.embed(ex, "doc_id", "doc"), "doc_id")


@query(f"{_EX_DOT}, nq AS (SELECT query_id, sum(w * w) AS q2 FROM eq GROUP BY ALL), nd AS (SELECT doc_id AS query_id, sum(w * w) AS d2 FROM ed GROUP BY ALL) SELECT query_id, round(dot, 6) AS dot, round(greatest(0, least(1, dot)), 6) AS similarity, round(sqrt(greatest(0, coalesce(q2, 0) + coalesce(d2, 0) - 2 * dot)), 5) AS l2 FROM dots LEFT JOIN nq USING (query_id) LEFT JOIN nd USING (query_id)")
def c04_similarity(spark, sf):
    """Product, clipped cosine and distance of each exchange."""
    ex = R.exchanges(spark, sf)
    q2 = V.embed(ex, "query_id", "query").groupBy("query_id").agg(F.sum(F.col("w") * F.col("w")).alias("q2"))
    d2 = V.embed(ex, "doc_id", "doc").groupBy("doc_id").agg(F.sum(F.col("w") * F.col("w")).alias("d2"))
    rows = _exchange_dots(spark, sf).join(q2, "query_id", "left").join(d2, "doc_id", "left").fillna(0.0, ["q2", "d2"])
    return rows.select("query_id", F.round("dot", 6).alias("dot"), F.round(V.clipped(F.col("dot")), 6).alias("similarity"), F.round(V.l2_distance(F.col("q2"), F.col("d2"), F.col("dot")), 5).alias("l2"))


@query(f"{_EX_VECTORS}, bq AS (SELECT query_id, list_sort(list(bucket)) AS bits FROM eq WHERE w > 0 GROUP BY ALL), bd AS (SELECT doc_id, list(bucket) AS bits FROM ed WHERE w > 0 GROUP BY ALL) SELECT query_id, bq.bits AS query_bits, CAST(len(bq.bits) + len(bd.bits) - 2 * len(list_intersect(bq.bits, bd.bits)) AS INTEGER) AS hamming FROM bq JOIN bd ON bd.doc_id = bq.query_id")
def c09_hamming(spark, sf):
    """Sign bits and their distance for each exchange."""
    ex = R.exchanges(spark, sf)
    q = V.positive_bits(V.embed(ex, "query_id", "query"), "query_id")
    d = V.positive_bits(V.embed(ex, "doc_id", "doc"), "doc_id").withColumnsRenamed({"doc_id": "query_id", "bits": "doc_bits"})
    return q.join(d, "query_id").select("query_id", F.col("bits").alias("query_bits"), V.hamming(F.col("bits"), F.col("doc_bits")).alias("hamming"))


_LABEL_MEANS = "m AS (SELECT label, i AS dim, avg(CAST(embedding[i + 1] AS DOUBLE)) AS c FROM embeddings, range(0, 64) AS r(i) GROUP BY ALL)"


@query(f"WITH {_LABEL_MEANS}, n AS (SELECT label, sqrt(sum(c * c)) AS norm FROM m GROUP BY ALL) SELECT a.label AS a, b.label AS b, round(1 - sum(a.c * b.c) / any_value(na.norm * nb.norm), 6) AS distance FROM m a JOIN m b ON a.dim = b.dim AND a.label < b.label JOIN n na ON na.label = a.label JOIN n nb ON nb.label = b.label GROUP BY ALL")
def c07_cosine_distances(spark, sf):
    """Cosine distances of all pairs of label centroids; a zero vector has no distance."""
    rows = R.table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("bucket", "x"))
    means = rows.groupBy("label", "bucket").agg(F.avg(F.col("x").cast("double")).alias("w"))
    unit = V.unit(means, "label").withColumnsRenamed({"label": "a"})
    other = unit.withColumnsRenamed({"a": "b", "w": "v"})
    pairs = unit.join(other, "bucket").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    return pairs.select("a", "b", F.round(1 - F.col("dot"), 6).alias("distance"))


@query("SELECT query_id, id, round(list_sum([CAST(q[i] AS DOUBLE) * CAST(v[i] AS DOUBLE) FOR i IN range(1, 65)]), 6) AS dot, CAST(list_sum([CASE WHEN (q[i] > 0) <> (v[i] > 0) THEN 1 ELSE 0 END FOR i IN range(1, 65)]) AS INTEGER) AS hamming FROM (SELECT vec_id AS query_id, label, embedding AS q FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1) JOIN (SELECT vec_id AS id, label, embedding AS v FROM embeddings) USING (label)")
def c10_dense_products(spark, sf):
    """C04, C08 and C09 on dense vectors: each label's first vector against all vectors of its label."""
    rows = R.table(spark, sf, "embeddings")
    first = rows.groupBy("label").agg(F.min("vec_id").alias("query_id"), F.min_by("embedding", "vec_id").alias("q"))
    both = rows.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v")).join(first, "label")
    bits = V.dense_hamming(V.dense_bits(F.col("q")), V.dense_bits(F.col("v")))
    return both.select("query_id", "id", F.round(V.dense_dot(F.col("q"), F.col("v")), 6).alias("dot"), bits.alias("hamming"))


_LONG = "x AS (SELECT vec_id AS id, i AS dim, embedding[i + 1] AS x FROM embeddings, range(0, 64) AS r(i))"
_CODES4 = f"{_LONG}, lo AS (SELECT dim, min(x) AS low, CAST(CAST(max(x) - min(x) AS FLOAT) / CAST(15 AS FLOAT) AS FLOAT) AS s FROM x GROUP BY dim), codes AS (SELECT id, dim, low, CASE WHEN s = 0 THEN CAST(1 AS FLOAT) ELSE s END AS scale, CAST(least(greatest(round_even(CAST(CAST(CAST(x - low AS FLOAT) / CASE WHEN s = 0 THEN CAST(1 AS FLOAT) ELSE s END AS FLOAT) AS DOUBLE), 0), 0), 15) AS INTEGER) AS code FROM x JOIN lo USING (dim))"


@query(f"WITH {_CODES4} SELECT id, CAST(dim // 2 AS INTEGER) AS byte, CAST(sum(CASE WHEN dim % 2 = 0 THEN code ELSE code * 16 END) AS INTEGER) AS packed FROM codes GROUP BY ALL")
def c11_quantize_4bit(spark, sf):
    return Z.pack_4bit(Z.quantize_4bit(R.dense(spark, sf), ["grp"]), ["id"])


@query(f"WITH {_CODES4} SELECT id, CAST(dim AS INTEGER) AS dim, code, round(CAST(CAST(CAST(CAST(code AS FLOAT) * scale AS FLOAT) + low AS FLOAT) AS DOUBLE), 5) AS x FROM codes")
def c11_dequantize_4bit(spark, sf):
    codes = Z.quantize(R.dense(spark, sf), ["grp"], "4bit")
    packed = Z.pack_4bit(codes, ["id"])
    grid = codes.select("dim", "low", "scale").distinct().withColumn("byte", (F.col("dim") / 2).cast("int"))
    back = packed.join(F.broadcast(grid), "byte").withColumn("code", Z.unpack_4bit(F.col("packed"), F.col("dim")))
    return Z.dequantize(back, "4bit").select("id", "dim", "code", F.round(F.col("x").cast("double"), 5).alias("x"))


@query(f"WITH {_LONG}, t AS (SELECT dim, CASE WHEN max(abs(x)) = 0 THEN CAST(1 AS FLOAT) ELSE max(abs(x)) END AS scale FROM x GROUP BY dim), codes AS (SELECT id, dim, scale, CASE WHEN x > CAST(scale * CAST(0.7 AS FLOAT) AS FLOAT) THEN 1 WHEN x < -CAST(scale * CAST(0.7 AS FLOAT) AS FLOAT) THEN -1 ELSE 0 END AS code FROM x JOIN t USING (dim)) SELECT id, CAST(dim AS INTEGER) AS dim, code, round(CAST(CAST(CAST(code * scale AS FLOAT) * CAST(0.7 AS FLOAT) AS FLOAT) AS DOUBLE), 5) AS x FROM codes")
def c12_quantize_ternary(spark, sf):
    codes = Z.quantize(R.dense(spark, sf), ["grp"], "ternary")
    return Z.dequantize(codes, "ternary").select("id", "dim", "code", F.round(F.col("x").cast("double"), 5).alias("x"))


@query("SELECT m AS mode, CASE m WHEN '4bit' THEN n * 32 WHEN 'ternary' THEN n * 64 ELSE n * 256 END AS bytes, CASE m WHEN '4bit' THEN 8e0 WHEN 'ternary' THEN 4e0 ELSE 1e0 END AS ratio FROM (SELECT count(*) AS n FROM embeddings), (VALUES ('4bit'), ('ternary'), ('none')) AS v(m)")
def c14_compression(spark, sf):
    size = R.table(spark, sf, "embeddings").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d"))
    modes = [F.struct(F.lit(m).alias("mode"), Z.memory_bytes(F.col("n"), F.col("d"), m).cast("bigint").alias("bytes"), Z.compression_ratio(F.col("n"), F.col("d"), m).alias("ratio")) for m in ("4bit", "ternary", "none")]
    return size.select(F.explode(F.array(*modes)).alias("m")).select("m.*")


_PERM = 128
_GRAMS = f"g AS (SELECT DISTINCT id, unnest({R.sql_grams('text')}) AS gram FROM t), h AS (SELECT gram, p AS perm, substr(sha256(gram || '|' || p), 1, 16) AS h FROM (SELECT DISTINCT gram FROM g), range(0, {_PERM}) AS r(p)), s AS (SELECT id, perm, least(min(h), '{V.SENTINEL}') AS h FROM g JOIN h USING (gram) GROUP BY ALL)"


@query(f"WITH {_TURN}, {_GRAMS} SELECT id, CAST(perm AS INTEGER) AS perm, h FROM s")
def c15_minhash_signatures(spark, sf):
    return V.minhash_signatures(_turns(spark, sf), "id", T.char_ngrams(F.col("text")), _PERM)


@query(f"WITH {R.SQL_EXCHANGES}, t AS (SELECT query_id * 2 AS id, query AS text FROM ex UNION ALL SELECT doc_id * 2 + 1, doc FROM ex), {_GRAMS}, e AS (SELECT a.id // 2 AS query_id, sum(CASE WHEN a.h = b.h THEN 1 ELSE 0 END) / {_PERM}e0 AS lsh_score FROM s a JOIN s b ON b.id = a.id + 1 AND a.id % 2 = 0 AND a.perm = b.perm GROUP BY ALL), j AS (SELECT query_id, {R.sql_grams('query')} AS a, {R.sql_grams('doc')} AS b FROM ex) SELECT query_id, coalesce(lsh_score, 0) AS lsh_score, round(CAST(len(list_intersect(a, b)) AS DOUBLE) / greatest(len(list_distinct(list_concat(a, b))), 1), 6) AS lsh_jaccard FROM j LEFT JOIN e USING (query_id)")
def d11_lsh_features(spark, sf):
    """Signature and exact Jaccard of each exchange's character trigrams."""
    ex = R.exchanges(spark, sf)
    rows = V.minhash_jaccard(ex, "query_id", T.char_ngrams(F.col("query")), "doc_id", T.char_ngrams(F.col("doc")), _PERM)
    return rows.select("query_id", "lsh_score", F.round(V.jaccard(T.char_ngrams(F.col("query")), T.char_ngrams(F.col("doc"))), 6).alias("lsh_jaccard"))


@query("SELECT source, substr(sha256(CAST(sum(CAST('0x' || substr(sha256(text), 1, 15) AS BIGINT)) AS VARCHAR) || chr(10) || count(*)), 1, 16) AS key FROM documents GROUP BY source")
def c18_content_keys(spark, sf):
    """A 16-digit key of each source's documents, whatever their order: hashes are summed, no group is gathered."""
    return _docs(spark, sf).groupBy("source").agg(V.multiset_key(F.col("text")).alias("key"))
