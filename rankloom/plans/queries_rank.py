"""BM25, features, ranking strategies, combinators and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bm25, combine, metrics, rankers
from ..operators import features as X
from ..operators.late_index import LateIndex
from ..session import few, scratch, stage
from . import relations as R
from . import sql_rank as S
from .registry import query

_KEYS = ["query_id", "doc_id"]


def _scores(ranked, *more):
    return ranked.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank", *more)


def _sql_scores(ctes: str, relation: str, more: str = "") -> str:
    return f"WITH {ctes} SELECT query_id, doc_id, round(score, 6) AS score, rank{more} FROM {relation}"


@query(f"WITH {R.SQL_RETRIEVED} SELECT token, df, round(ln((n - df + 0.5e0) / (df + 0.5e0) + 1), 6) AS idf FROM df CROSS JOIN st")
def d01_bm25_index(spark, sf):
    """Document frequencies over the whole corpus, with the inverse frequency that its size gives."""
    docs = R.corpus(spark, sf)
    counts = bm25.term_counts(docs, ["doc_id"], "doc")
    stats = bm25.statistics(bm25.document_lengths(docs, ["doc_id"], "doc"), [])
    rows = bm25.document_frequencies(counts, []).crossJoin(F.broadcast(stats))
    return rows.select("token", "df", F.round(bm25.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(f"WITH {R.SQL_RETRIEVED} SELECT query_id, doc_id, round(bm25, 6) AS bm25, round(bm25 / max(bm25) OVER (PARTITION BY query_id), 6) AS bm25_norm FROM bm")
def d02_bm25_scores(spark, sf):
    """Every query against every document that shares a term with it, and normalised per query."""
    scores = stage(bm25.search(R.questions(spark, sf), R.corpus(spark, sf)), "scores")
    most = few(stage(scores.groupBy("query_id").agg(F.max("bm25").alias("most")), "greatest-scores"))
    rows = scores.join(most, "query_id").withColumn("bm25_norm", F.col("bm25") / F.col("most"))
    return rows.select(*_KEYS, F.round("bm25", 6).alias("bm25"), F.round("bm25_norm", 6).alias("bm25_norm"))


@query(f"WITH {R.SQL_RETRIEVED} SELECT query_id, doc_id, round(bm25, 6) AS score, pos AS rank FROM ret WHERE pos <= 10")
def d04_bm25_top_documents(spark, sf):
    """The first ten documents of each query over the whole corpus."""
    return R.retrieved(spark, sf, 10).select(*_KEYS, F.round("bm25", 6).alias("score"), F.col("pos").alias("rank"))


_LOCAL = f"{R.SQL_CANDIDATES}, {S.bm25_local('cand', 'b', R.sql_words)}, bs AS (SELECT *, bm25_norm AS score FROM b), {S.ranked('bs', 'r')}"


@query(_sql_scores(_LOCAL, "r", ", round(bm25, 6) AS bm25"))
def e01_bm25_rank(spark, sf):
    """Candidates ranked by BM25 whose frequencies are counted over each query's own candidates."""
    return _scores(bm25.rerank(R.candidates(spark, sf)), F.round("bm25", 6).alias("bm25"))


_FEATURES = f"{R.SQL_CANDIDATES}, {S.features('cand', 'f')}"
_NAMES = [*X.BASE_FEATURES, "keyword_hit_rate"]


@query(f"WITH {_FEATURES} SELECT query_id, doc_id, {', '.join(f'round({n}, {5 if n == "vec_norm_diff" else 6}) AS {n}' for n in _NAMES)} FROM f")
def d12_features(spark, sf):
    """The feature matrix of the candidates."""
    rows = X.features(R.candidates(spark, sf))
    return rows.select(*_KEYS, *[F.round(n, 5 if n == "vec_norm_diff" else 6).alias(n) for n in _NAMES])


_HYBRID = f"{_FEATURES}, fs AS (SELECT *, {S.blend()} AS score FROM f), {S.ranked('fs', 'r')}"


@query(_sql_scores(_HYBRID, "r"))
def e02_hybrid(spark, sf):
    """Static fusion of the features."""
    return _scores(rankers.hybrid(R.candidates(spark, sf)))


_WEIGHTS, _CONSTANT = [2.0, -2.0, 1.5, 0.1, 0.001, -0.001, 0.0005], 0.05
_PAIRS = f"""{R.SQL_CANDIDATES}, {S.semantic("cand", "m")},
sd AS (SELECT m.query_id, m.doc_id, m.pos, m.sem_score, len({R.sql_tokens("doc")}) AS len, CASE WHEN doc_id IN (SELECT doc_id FROM m_ed) THEN 1 ELSE 0 END AS n2 FROM m),
dp AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM sd a JOIN sd b ON a.query_id = b.query_id AND a.pos < b.pos),
dd AS (SELECT a, b, sum(x.w * y.w) AS ab FROM dp JOIN m_ed x ON x.doc_id = a JOIN m_ed y ON y.doc_id = b AND y.bucket = x.bucket GROUP BY ALL),
pr AS (SELECT a.query_id, a.doc_id AS a, b.doc_id AS b, a.sem_score AS f1, b.sem_score AS f2, a.sem_score - b.sem_score AS f3, sqrt(greatest(0, a.n2 + b.n2 - 2 * coalesce(ab, 0))) AS f4, CAST(a.len AS DOUBLE) AS f5, CAST(b.len AS DOUBLE) AS f6, CAST(a.len - b.len AS DOUBLE) AS f7
  FROM sd a JOIN sd b ON a.query_id = b.query_id AND a.pos < b.pos LEFT JOIN dd ON dd.a = a.doc_id AND dd.b = b.doc_id)"""


@query(f"WITH {_PAIRS} SELECT query_id, a, b, round(f1, 6) AS f1, round(f2, 6) AS f2, round(f3, 6) + 0 AS f3, round(f4, 5) AS f4, f5, f6, f7, CASE WHEN round(f1, 6) >= round(f2, 6) THEN 1 ELSE 0 END AS semantic FROM pr")
def d15_pairwise_features(spark, sf):
    """Features of all pairs of a query's candidates, and the semantic-only choice."""
    pairs = rankers.document_pairs(R.candidates(spark, sf))
    return pairs.select("query_id", "a", "b", *[(F.round(f"f{i}", 6) + 0).alias(f"f{i}") for i in (1, 2, 3)], F.round("f4", 5).alias("f4"), "f5", "f6", "f7", rankers.semantic_choice(pairs).alias("semantic"))


_LOGIT = " + ".join(f"{w}e0 * f{i}" for i, w in enumerate(_WEIGHTS, 1)) + f" + {_CONSTANT}e0"


@query(_sql_scores(f"{_PAIRS}, pp AS (SELECT *, 1 / (1 + exp(-({_LOGIT}))) AS p FROM pr), cr AS (SELECT query_id, a AS doc_id, p AS c FROM pp UNION ALL SELECT query_id, b, 1 - p FROM pp), sc AS (SELECT query_id, doc_id, sum(c) AS score FROM cr GROUP BY ALL), sr AS (SELECT cand.query_id, cand.doc_id, pos, coalesce(score, 0) AS score FROM cand LEFT JOIN sc USING (query_id, doc_id)), {S.ranked('sr', 'r')}", "r"))
def e04_pairwise_tournament(spark, sf):
    """Full tournament with a fixed logistic comparison."""
    candidates = R.candidates(spark, sf)
    return _scores(rankers.tournament(rankers.document_pairs(candidates), candidates, rankers.logistic(_WEIGHTS, _CONSTANT)))


@query(_sql_scores(f"RECURSIVE {_PAIRS}, pp AS (SELECT query_id, a, b, 1 / (1 + exp(-({_LOGIT}))) AS p FROM pr), {S.merge_sort('pp', 'cand', 'mt')}, {S.ranked('mt', 'r')}", "r"))
def e05_merge_tournament(spark, sf):
    """Merge-sort tournament, as for candidate lists too long for the full one."""
    candidates = R.candidates(spark, sf)
    return _scores(rankers.merge_tournament(rankers.document_pairs(candidates), candidates, rankers.logistic(_WEIGHTS, _CONSTANT)))


@query(_sql_scores(f"{R.SQL_CANDIDATES}, {S.binary('cand', 'bi', 10)}, {S.ranked('bi', 'r')}", "r", ", CAST(hamming AS INTEGER) AS hamming"))
def e08_binary(spark, sf):
    """Sign bits, then inner products for the nearest ten."""
    return _scores(rankers.binary_quantized(R.candidates(spark, sf), bilinear_top_k=10), "hamming")


_INDEX = f"{R.SQL_CANDIDATES}, {S.token_index('cand', 'i')}"


@query(f"WITH {_INDEX} SELECT doc_id, place, token, bucket, sign, round(salience, 6) AS salience FROM i")
def d17_token_index(spark, sf):
    """The kept tokens of each candidate document with their salience."""
    index = rankers.token_index(R.candidates(spark, sf).select("doc_id", "doc").distinct())
    return index.select("doc_id", "place", "token", "bucket", "sign", F.round("salience", 6).alias("salience"))


_LATE = f"{R.SQL_CANDIDATES}, {S.late('cand', 'la')}, {S.ranked('la', 'r')}"


@query(_sql_scores(_LATE, "r"))
def e09_late_interaction(spark, sf):
    """Token matching against the pruned index."""
    return _scores(rankers.late_interaction(R.candidates(spark, sf)))


@query(_sql_scores(_LATE, "r"))
def h05_appended_index(spark, sf):
    """Documents added to a stored index in two batches, some of them twice, rank as in an index built at once."""
    candidates = R.candidates(spark, sf)
    docs = candidates.select("doc_id", "doc")
    index = LateIndex(spark, scratch(spark, "late-index"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    index.add(docs.filter(half == 0).unionByName(docs.filter(half == 1).select("doc_id", F.substring("doc", 1, 40).alias("doc"))), "batch-1")
    index.add(docs.filter(half == 1), "batch-2")
    return _scores(index.rank(candidates))


def _sql_late_quantized(mode: str) -> str:
    one = "CAST(1 AS FLOAT)"
    if mode == "4bit":
        grid = f"min(x) AS low, CASE WHEN max(x) = min(x) THEN {one} ELSE CAST(CAST(max(x) - min(x) AS FLOAT) / CAST(15 AS FLOAT) AS FLOAT) END AS scale"
        back = "CAST(CAST(CAST(least(greatest(round_even(CAST(CAST(CAST(x - low AS FLOAT) / scale AS FLOAT) AS DOUBLE), 0), 0), 15) AS FLOAT) * scale AS FLOAT) + low AS FLOAT)"
    else:
        grid = f"CASE WHEN max(abs(x)) = 0 THEN {one} ELSE max(abs(x)) END AS scale"
        edge = "CAST(scale * CAST(0.7 AS FLOAT) AS FLOAT)"
        back = f"CAST(CAST(CASE WHEN x > {edge} THEN 1 WHEN x < -{edge} THEN -1 ELSE 0 END * scale AS FLOAT) * CAST(0.7 AS FLOAT) AS FLOAT)"
    ctes = f"""{_INDEX}, dm AS (SELECT DISTINCT doc_id, bucket AS dim FROM i),
dn AS (SELECT i.doc_id, place, dim, CAST(CASE WHEN dim = bucket THEN sign ELSE 0 END AS FLOAT) AS x FROM i JOIN dm USING (doc_id)),
gr AS (SELECT doc_id, dim, {grid} FROM dn GROUP BY ALL),
re AS (SELECT doc_id, place, dim, CAST({back} AS DOUBLE) AS x FROM dn JOIN gr USING (doc_id, dim)),
un AS (SELECT doc_id, dim, x / CASE WHEN sqrt(sum(x * x) OVER (PARTITION BY doc_id, place)) = 0 THEN 1 ELSE sqrt(sum(x * x) OVER (PARTITION BY doc_id, place)) END AS x FROM re),
ex AS (SELECT doc_id, dim, max(x) AS hi, min(x) AS lo FROM un GROUP BY ALL),
{S.query_tokens("cand", "qk")},
sc AS (SELECT c.query_id, c.doc_id, sum(qf * coalesce(CASE WHEN sign > 0 THEN hi ELSE -lo END, 0)) AS score FROM cand c JOIN qk USING (query_id) LEFT JOIN ex ON ex.doc_id = c.doc_id AND ex.dim = qk.bucket GROUP BY ALL),
sr AS (SELECT c.query_id, c.doc_id, pos, coalesce(score, 0) AS score FROM cand c LEFT JOIN sc USING (query_id, doc_id)), {S.ranked("sr", "r")}"""
    return _sql_scores(ctes, "r")


@query(_sql_late_quantized("4bit"))
def e10_late_interaction_4bit(spark, sf):
    return _scores(rankers.late_interaction_quantized(R.candidates(spark, sf), "4bit"))


@query(_sql_late_quantized("ternary"))
def e10_late_interaction_ternary(spark, sf):
    return _scores(rankers.late_interaction_quantized(R.candidates(spark, sf), "ternary"))


@query(_sql_scores(f"{R.SQL_CANDIDATES}, {S.sparse('cand', 'sp')}, {S.ranked('sp', 'r')}", "r"))
def e11_sparse(spark, sf):
    """Least common weight over shared terms, with term-frequency weights for the encoder's."""
    return _scores(rankers.sparse(R.candidates(spark, sf)))


_TEACHERS = f"{_FEATURES}, fs AS (SELECT *, {S.blend()} AS score FROM f), {S.bm25_local('cand', 'b', R.sql_words)}, tt AS (SELECT query_id, doc_id, score FROM fs UNION ALL SELECT query_id, doc_id, bm25_norm FROM b), av AS (SELECT query_id, doc_id, avg(score) AS score FROM tt GROUP BY ALL), ar AS (SELECT cand.*, score FROM cand JOIN av USING (query_id, doc_id)), {S.ranked('ar', 'r')}"


@query(_sql_scores(_TEACHERS, "r"))
def e13_teacher_ensemble(spark, sf):
    """The mean of two teachers, here BM25 and the hybrid in place of outside models."""
    return _scores(rankers.ensemble(R.candidates(spark, sf), [bm25.rerank, rankers.hybrid]))


_RS = "{0} AS (SELECT query_id, doc_id, rank FROM {1})"
_BIN = f"{S.binary('cand', 'bi')}, {S.ranked('bi', 'rb')}"
_RRF_LISTS = f"{R.SQL_CANDIDATES}, {S.bm25_local('cand', 'b', R.sql_words)}, bs AS (SELECT *, bm25_norm AS score FROM b), {S.ranked('bs', 'r1')}, {_BIN}, {S.late('cand', 'la')}, {S.ranked('la', 'r3')}, u AS (SELECT query_id, doc_id, rank FROM r1 UNION ALL SELECT query_id, doc_id, rank FROM rb UNION ALL SELECT query_id, doc_id, rank FROM r3), fu AS (SELECT query_id, doc_id, sum(1e0 / (60 + rank)) AS score FROM u GROUP BY ALL), fr AS (SELECT cand.*, score FROM cand JOIN fu USING (query_id, doc_id)), {S.ranked('fr', 'r')}"


@query(_sql_scores(_RRF_LISTS, "r"))
def g03_rank_fusion(spark, sf):
    """BM25, binary and late interaction fused by reciprocal ranks."""
    return _scores(combine.fused(R.candidates(spark, sf), [bm25.rerank, rankers.binary_quantized, rankers.late_interaction]))


@query(f"WITH {_RRF_LISTS}, top AS (SELECT * FROM r1 WHERE rank <= 10 UNION ALL BY NAME SELECT * FROM rb WHERE rank <= 10), f2 AS (SELECT query_id, doc_id, sum(1e0 / (60 + rank)) AS rrf FROM top GROUP BY ALL) SELECT query_id, doc_id, round(rrf, 9) AS rrf FROM f2")
def g02_partial_lists(spark, sf):
    """Fusion of two top-ten lists, in which a document may be in only one."""
    c = R.candidates(spark, sf)
    lists = [r(c).filter("rank <= 10") for r in (bm25.rerank, rankers.binary_quantized)]
    return combine.reciprocal_rank_fusion(lists).withColumn("rrf", F.round("rrf", 9))


_STAGES = [combine.Stage("bm25", bm25.rerank, 20), combine.Stage("binary", rankers.binary_quantized, 10), combine.Stage("late", rankers.late_interaction, 5)]
_STAGED = f"""{R.SQL_CANDIDATES}, {S.bm25_local("cand", "b", R.sql_words)}, bs AS (SELECT *, bm25_norm AS score FROM b), {S.ranked("bs", "r1")},
s2 AS (SELECT query_id, query, doc_id, doc, rank AS pos FROM r1 WHERE rank <= 20), {S.binary("s2", "bi")}, {S.ranked("bi", "r2")},
s3 AS (SELECT query_id, query, doc_id, doc, rank AS pos FROM r2 WHERE rank <= 10), {S.late("s3", "la")}, {S.ranked("la", "r")}"""


@query(_sql_scores(_STAGED, "r WHERE rank <= 5", ", pos"))
def g01_staged_pipeline(spark, sf):
    """BM25, then binary, then late interaction, each on what the one before has left."""
    return _scores(combine.staged(R.candidates(spark, sf), _STAGES), "pos")


@query(f"WITH {R.SQL_RETRIEVED}, n AS (SELECT query_id, CAST(count(*) AS INTEGER) AS n FROM ret GROUP BY ALL) SELECT query_id, CAST(s AS INTEGER) AS stage, name, CAST(least(n, before) AS INTEGER) AS n_in, CAST(least(n, k) AS INTEGER) AS n_out FROM n, (VALUES (0, 'bm25', 20, 1000), (1, 'binary', 10, 20), (2, 'late', 5, 10)) AS v(s, name, k, before)")
def g01_stage_counts(spark, sf):
    return combine.stage_counts(R.retrieved(spark, sf), _STAGES)


@query(f"WITH {R.SQL_RETRIEVED}, n AS (SELECT query_id, count(*) AS n FROM ret GROUP BY ALL) SELECT CAST(s AS INTEGER) AS stage, name, count(*) AS queries, CAST(sum(least(n, before)) AS BIGINT) AS n_in, CAST(sum(least(n, k)) AS BIGINT) AS n_out, true AS timed FROM n, (VALUES (0, 'bm25', 20, 1000), (1, 'binary', 10, 20), (2, 'late', 5, 10)) AS v(s, name, k, before) GROUP BY ALL")
def g01_measured_stages(spark, sf):
    """Counts and latency of each stage, observed while it is written."""
    _, report = combine.staged_measured(R.candidates(spark, sf), _STAGES)
    return report.withColumn("timed", F.col("seconds") > 0).drop("seconds")


_CONF = "SELECT query_id, max(score) AS mx, min(score) AS mn, max(CASE WHEN k = 2 THEN score END) AS sec, var_samp(score) AS v FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) AS k FROM r) GROUP BY query_id"


@query(f"WITH {_HYBRID} SELECT query_id, round(mx, 6) AS max_score, round(coalesce(mx - sec, mx), 6) AS top_margin, round(coalesce(v, 0), 6) AS score_variance, round(CASE WHEN mx = mn THEN 1 ELSE mx / (mx - mn) END, 5) AS normalized_max FROM ({_CONF})")
def g06_confidence(spark, sf):
    """The four confidence measures of the hybrid ranking."""
    ranked = stage(rankers.hybrid(R.candidates(spark, sf)).select("query_id", "score"), "ranked")
    out = None
    for m in ("max_score", "top_margin", "score_variance", "normalized_max"):
        one = combine.confidence(ranked, m).select("query_id", F.round("confidence", 5 if m == "normalized_max" else 6).alias(m))
        out = one if out is None else out.join(one, "query_id")
    return out


_CASCADE = f"{_HYBRID}, cf AS (SELECT query_id, round(coalesce(mx - sec, mx), 9) AS confidence FROM ({_CONF})), low AS (SELECT query_id, confidence < 0.02e0 AS used, confidence FROM cf), {S.late('cand', 'la')}, {S.ranked('la', 'r2')}, ca AS (SELECT query_id, doc_id, score, rank FROM r JOIN low USING (query_id) WHERE NOT used UNION ALL SELECT query_id, doc_id, score, rank FROM r2 JOIN low USING (query_id) WHERE used)"


@query(f"WITH {_CASCADE} SELECT query_id, doc_id, round(score, 6) AS score, rank, used AS fallback_used, round(confidence, 6) AS confidence FROM ca JOIN low USING (query_id)")
def g07_cascade(spark, sf):
    """The hybrid ranking, and late interaction for the queries whose top margin is low."""
    rows = combine.cascade(R.candidates(spark, sf), rankers.hybrid, rankers.late_interaction, 0.02)
    return _scores(rows, "fallback_used", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {_CASCADE} SELECT count(*) AS total_queries, CAST(sum(used::INTEGER) AS BIGINT) AS fallback_count, round(avg(used::INTEGER), 6) AS fallback_rate, round(avg(confidence), 6) AS avg_confidence FROM low")
def g08_cascade_statistics(spark, sf):
    rows = combine.cascade_statistics(combine.cascade(R.candidates(spark, sf), rankers.hybrid, rankers.late_interaction, 0.02))
    return rows.withColumns({"fallback_rate": F.round("fallback_rate", 6), "avg_confidence": F.round("avg_confidence", 6)})


_VEC = f"q AS (SELECT item_id AS query_id, text AS query FROM benchmark), {R.sql_embedding('q', 'query_id', 'query', 'e')}, ss AS (SELECT query_id, sum(w) AS s, sum(w * w) AS s2 FROM e GROUP BY ALL)"


@query(rf"WITH {_VEC} SELECT query_id, CAST(len({R.sql_tokens('query')}) AS DOUBLE) AS n_tokens, round(CAST(coalesce(list_sum([length(x) FOR x IN {R.sql_tokens('query')}]), 0) AS DOUBLE) / greatest(len({R.sql_tokens('query')}), 1), 6) AS avg_token_len, round(coalesce(s, 0) / 256, 6) AS vec_mean, round(sqrt(greatest(0, coalesce(s2, 0) / 256 - (coalesce(s, 0) / 256) * (coalesce(s, 0) / 256))), 6) AS vec_std, CAST(regexp_matches(query, '\p{{Nd}}') AS DOUBLE) AS has_numbers, CAST(regexp_matches(query, '[^\p{{L}}\p{{N}}\t-\r\x1c-\x20\x85\xa0]') AS DOUBLE) AS has_special, round(CAST(length(regexp_replace(query, '[^\p{{Lu}}]', '', 'g')) AS DOUBLE) / greatest(length(query), 1), 6) AS capital_ratio FROM q LEFT JOIN ss USING (query_id)")
def d16_router_features(spark, sf):
    rows = X.router_features(R.questions(spark, sf)).drop("query")
    return rows.select(*[F.round(c, 6).alias(c) if c in ("avg_token_len", "vec_mean", "vec_std", "capital_ratio") else F.col(c) for c in rows.columns])


_LABELS = f"{R.SQL_JUDGED}, {S.features('cand', 'f')}, al AS (SELECT query_id, max(bm25_score) AS best, arg_max(least(greatest(sem_score, 0), 1), rel * 1000 - f.pos) AS sem, count(*) AS n FROM f JOIN judged USING (query_id, doc_id) GROUP BY ALL), lb AS (SELECT query_id, best, sem, CASE WHEN n < 2 THEN 0 WHEN abs(best - sem) <= 0.1e0 * greatest(abs(best), abs(sem), 1) THEN 2 WHEN best > sem THEN 0 ELSE 1 END AS category FROM al)"


@query(f"WITH {_LABELS} SELECT query_id, round(best, 6) AS bm25_best, round(sem, 6) AS sem, category FROM lb")
def g05_auto_labels(spark, sf):
    return combine.auto_labels(R.judged(spark, sf)).withColumns({"bm25_best": F.round("bm25_best", 6), "sem": F.round("sem", 6)})


@query(_sql_scores(f"{_LABELS}, fs AS (SELECT f.*, {S.profile_blend('category')} AS score FROM f JOIN lb USING (query_id)), {S.ranked('fs', 'r')}", "r"))
def e03_routed_hybrid(spark, sf):
    """Each query's features weighted by the profile of its category."""
    candidates = R.candidates(spark, sf)
    return _scores(combine.routed_hybrid(candidates, combine.auto_labels(R.judge(candidates))))


def _judged_ranking(candidates, ranker):
    return ranker(candidates).select("query_id", "doc_id", "rank").join(R.judge(candidates).select("query_id", "doc_id", "rel"), _KEYS)


_JUDGED_RANK = f"{R.SQL_JUDGED}, {S.bm25_local('cand', 'b', R.sql_words)}, bs AS (SELECT *, bm25_norm AS score FROM b), {S.ranked('bs', 'r1')}, jr AS (SELECT query_id, doc_id, rank, rel FROM r1 JOIN judged USING (query_id, doc_id))"
_GAIN = "(pow(2e0, rel) - 1) / log2({} + 1e0)"
_PER = f"""{_JUDGED_RANK},
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS best, sum((rel > 0)::INTEGER) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM jr),
per AS (SELECT query_id, coalesce(sum(CASE WHEN rank <= 10 THEN {_GAIN.format("rank")} END), 0) AS dcg, coalesce(sum(CASE WHEN best <= 10 THEN {_GAIN.format("best")} END), 0) AS ideal,
  coalesce(1e0 / min(CASE WHEN rel > 0 THEN rank END), 0) AS rr, coalesce(avg(CASE WHEN rel > 0 THEN so_far / CAST(rank AS DOUBLE) END), 0) AS ap,
  avg(CASE WHEN rank <= 1 THEN (rel > 0)::INTEGER END) AS p1, avg(CASE WHEN rank <= 5 THEN (rel > 0)::INTEGER END) AS p5, max((rel > 0)::INTEGER) AS any_rel FROM o GROUP BY ALL),
pn AS (SELECT *, CASE WHEN ideal = 0 THEN 0 ELSE dcg / ideal END AS ndcg FROM per)"""


@query(f"WITH {_PER} SELECT query_id, round(dcg, 6) AS dcg, round(ndcg, 6) AS ndcg, round(rr, 6) AS rr, round(ap, 6) AS ap, round(p5, 6) AS p5 FROM pn")
def l02_metrics_per_query(spark, sf):
    """L01 to L05 for each query of the BM25 ranking."""
    r = _judged_ranking(R.candidates(spark, sf), bm25.rerank)
    rows = metrics.ndcg(r).join(metrics.reciprocal_rank(r), "query_id").join(metrics.average_precision(r), "query_id").join(metrics.precision_at(r, 5).withColumnRenamed("precision", "p5"), "query_id")
    return rows.select("query_id", *[F.round(c, 6).alias(c) for c in ("dcg", "ndcg", "rr", "ap", "p5")])


@query(f"WITH {_PER} SELECT count(*) AS queries, round(coalesce(avg(CASE WHEN any_rel = 1 THEN ndcg END), 0), 6) AS ndcg, round(coalesce(avg(CASE WHEN any_rel = 1 THEN rr END), 0), 6) AS mrr, round(coalesce(avg(CASE WHEN any_rel = 1 THEN ap END), 0), 6) AS map, round(coalesce(avg(CASE WHEN any_rel = 1 THEN p1 END), 0), 6) AS p_at_1 FROM pn")
def l10_evaluate(spark, sf):
    """Means over the queries that have a relevant document."""
    rows = metrics.evaluate(_judged_ranking(R.candidates(spark, sf), bm25.rerank), only_with_relevant=True)
    return rows.select("queries", *[F.round(c, 6).alias(c) for c in ("ndcg", "mrr", "map", "p_at_1")])


@query(f"WITH {_PER}, {S.late('cand', 'la')}, {S.ranked('la', 'r2')}, j2 AS (SELECT query_id, rank, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS best FROM r2 JOIN judged USING (query_id, doc_id)), p2 AS (SELECT query_id, coalesce(sum(CASE WHEN rank <= 10 THEN {_GAIN.format('rank')} END), 0) AS d, coalesce(sum(CASE WHEN best <= 10 THEN {_GAIN.format('best')} END), 0) AS i FROM j2 GROUP BY ALL) SELECT round(avg(CASE WHEN i = 0 THEN 0 ELSE d / i END), 6) AS ndcg, round(avg(pn.ndcg), 6) AS baseline, round(avg(CASE WHEN i = 0 THEN 0 ELSE d / i END) - avg(pn.ndcg), 6) AS uplift FROM p2 JOIN pn USING (query_id)")
def l08_uplift(spark, sf):
    """Late interaction against the BM25 baseline on the same candidates."""
    candidates = R.candidates(spark, sf)
    a = metrics.ndcg(_judged_ranking(candidates, rankers.late_interaction)).select("query_id", "ndcg")
    b = metrics.ndcg(_judged_ranking(candidates, bm25.rerank)).select("query_id", F.col("ndcg").alias("baseline"))
    means = a.join(b, "query_id").agg(F.avg("ndcg").alias("ndcg"), F.avg("baseline").alias("baseline"))
    return means.select(F.round("ndcg", 6).alias("ndcg"), F.round("baseline", 6).alias("baseline"), F.round(F.col("ndcg") - F.col("baseline"), 6).alias("uplift"))


@query("SELECT round(avg((quality = 1 - toxic)::INTEGER), 6) AS accuracy FROM labels")
def l06_accuracy(spark, sf):
    rows = R.table(spark, sf, "labels").withColumn("guess", 1 - F.col("toxic"))
    return metrics.accuracy(rows, "quality", "guess").select(F.round("accuracy", 6).alias("accuracy"))


@query("WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS n, count(*) OVER (PARTITION BY event_type) AS c FROM events) SELECT event_type, max(CASE WHEN n = round_even((c - 1) * 0.5e0, 0) THEN value END) AS p50, max(CASE WHEN n = round_even((c - 1) * 0.99e0, 0) THEN value END) AS p99, round(avg(value), 6) AS mean FROM o GROUP BY ALL")
def l07_latency(spark, sf):
    """Nearest percentiles and mean of measured values, here the events' values by type."""
    return metrics.latency(R.table(spark, sf, "events"), "value", ["event_type"]).withColumn("mean", F.round("mean", 6))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY ALL")
def l13_summary(spark, sf):
    rows = metrics.summary(R.table(spark, sf, "events"), "value", ["event_type"])
    return rows.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p50", "p99")])


@query(f"WITH {R.SQL_JUDGED} SELECT query_id, query, doc_id, doc, pos, rel FROM judged")
def a11_judged_rows(spark, sf):
    """Judgements joined with the texts of queries and documents."""
    return R.judged(spark, sf)


@query("SELECT 'custom_' || doc_id AS id, text AS doc FROM documents UNION ALL SELECT 'page_' || page_id, html FROM pages")
def a10_prefixed_union(spark, sf):
    """A10: corpora united under prefixed ids."""
    a = R.table(spark, sf, "documents").select(F.concat(F.lit("custom_"), "doc_id").alias("id"), F.col("text").alias("doc"))
    b = R.table(spark, sf, "pages").select(F.concat(F.lit("page_"), "page_id").alias("id"), F.col("html").alias("doc"))
    return a.unionByName(b)
