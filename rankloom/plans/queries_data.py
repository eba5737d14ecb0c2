"""Mining, splitting, synthetic records, training and sources."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import json_object
from ..operators import bm25, boosting, combine, metrics, mining, phrases, rankers, strategies, synth, teacher, training
from ..operators import features as X
from ..session import scratch, stage
from ..sources import readers, store
from . import relations as R
from . import sql_rank as S
from .registry import query

_KEYS = ["query_id", "doc_id"]

_TAUGHT = f"{S.features('cand', 'f')}, fs AS (SELECT query_id, doc_id, pos, round({S.blend()}, 6) AS label FROM f)"
_CONTESTED = f"{R.SQL_CANDIDATES}, {S.bm25_local('cand', 'b')}, {S.semantic('b', 'm')}, rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25_norm, 6) DESC, pos) AS br, row_number() OVER (PARTITION BY query_id ORDER BY round(sem_score, 6) DESC, pos) AS sr, count(*) OVER (PARTITION BY query_id) AS n FROM m)"


@query(f"WITH {_CONTESTED} SELECT query_id, doc_id, CAST(br AS INTEGER) AS bm25_rank, CAST(sr AS INTEGER) AS semantic_rank FROM rk WHERE n >= 2 AND abs(br - sr) > 50 * least(n, 100) // 100")
def i01_contested(spark, sf):
    return mining.contested(R.candidates(spark, sf)).select(*_KEYS, "bm25_rank", "semantic_rank")


@query(f"WITH {R.SQL_CANDIDATES}, {S.semantic('cand', 'm')}, p AS (SELECT query_id, doc_id, 1 / (1 + exp(-(4e0 * sem_score - 2e0))) AS p FROM m) SELECT query_id, doc_id, round(p, 6) AS p FROM p WHERE round(p, 9) BETWEEN 0.4e0 AND 0.6e0")
def i02_uncertain(spark, sf):
    rows = X.semantic(R.candidates(spark, sf)).withColumn("p", 1 / (1 + F.exp(-(4.0 * F.col("sem_score") - 2.0))))
    return mining.uncertain(rows, "p").select(*_KEYS, F.round("p", 6).alias("p"))


@query()
def i03_diverse(spark, sf):
    return mining.diverse(R.candidates(spark, sf)).select("cluster", *_KEYS)


@query(f"WITH {_CONTESTED}, {_TAUGHT}, nt AS (SELECT query_id, doc_id, min(round_no) AS found FROM rk, range(0, 3) AS g(round_no) WHERE n >= 2 AND abs(br - sr) > (50 - 20 * round_no) * least(n, 100) // 100 GROUP BY ALL), rn AS (SELECT found, count(*) AS c FROM nt GROUP BY ALL) SELECT query_id, doc_id, label FROM nt JOIN fs USING (query_id, doc_id) WHERE found <= (SELECT min(g.r) FROM range(0, 4) AS g(r) WHERE g.r NOT IN (SELECT found FROM rn))")
def i05_active_loop(spark, sf):
    """Contested pairs, then uncertain ones, labelled by the stand-in teacher, no pair twice."""
    candidates = R.candidates(spark, sf)
    taught = stage(rankers.hybrid(candidates).select(*_KEYS, F.round("score", 6).alias("label")), "teacher")
    teacher = lambda pairs: pairs.select(*_KEYS).join(taught, _KEYS)
    mine = lambda c, i: mining.contested(c, 50 - 20 * i)
    labelled, _ = mining.active_loop(candidates, mine, teacher)
    return labelled if labelled is not None else taught.limit(0)


_FOLD = "CAST('0x' || substr(sha256('42:q:' || query_id), 1, 12) AS BIGINT)"
_HARD = f"""
q AS (SELECT item_id AS query_id, text AS query FROM benchmark), d AS (SELECT doc_id, substring(text, 1, 500) AS doc FROM documents),
dt AS (SELECT doc_id, unnest({R.sql_words("doc")}) AS token FROM d), tf AS (SELECT doc_id, token, count(*) AS f FROM dt GROUP BY ALL), dl AS (SELECT doc_id, len({R.sql_words("doc")}) AS dl FROM d),
st AS (SELECT count(*) AS n, greatest(avg(dl), 1e0) AS avgdl FROM dl), df AS (SELECT token, count(*) AS df FROM tf GROUP BY ALL),
qt AS (SELECT query_id, unnest({R.sql_words("query")}) AS token FROM q), qf AS (SELECT query_id, token, count(*) AS qf FROM qt GROUP BY ALL),
bm AS (SELECT query_id, doc_id, sum({R.BM25_TERM}) AS bm25 FROM qf JOIN tf USING (token) JOIN df USING (token) JOIN dl USING (doc_id) CROSS JOIN st GROUP BY ALL),
tp AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id) AS rank FROM bm QUALIFY rank <= 60),
rl AS (SELECT b.item_id AS query_id, d.doc_id, 3 AS rel FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
rw AS (SELECT tp.*, rel, row_number() OVER (PARTITION BY query_id, rel IS NULL ORDER BY rank) AS n FROM tp LEFT JOIN rl USING (query_id, doc_id)),
ch AS (SELECT query_id, doc_id, CASE WHEN rel IS NULL THEN 1 ELSE 0 END AS kind, rank FROM rw WHERE rel IS NOT NULL OR n <= 21),
need AS (SELECT query_id, 30 - coalesce(n, 0) AS need FROM q LEFT JOIN (SELECT query_id, count(*) AS n FROM ch GROUP BY ALL) USING (query_id) WHERE 30 - coalesce(n, 0) > 0),
num AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('42:' || doc_id), doc_id) - 1 AS i FROM documents), tot AS (SELECT count(*) AS c FROM documents),
lk AS (SELECT query_id, need, step, ({_FOLD} % c + step) % c AS i FROM need CROSS JOIN tot, range(0, 90) AS r(step) WHERE step < least(90, c)),
fl AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY step) AS rank, need FROM lk JOIN num USING (i) ANTI JOIN ch USING (query_id, doc_id)),
al AS (SELECT * FROM ch UNION ALL SELECT query_id, doc_id, 2, rank FROM fl WHERE rank <= need),
pl AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY kind, rank) AS place FROM al QUALIFY place <= 30)"""


@query(f"WITH {_HARD} SELECT query_id, b.text AS query, doc_id, substring(documents.text, 1, 800) AS doc, CAST(coalesce(rel, 0) AS INTEGER) AS score, CAST(place AS INTEGER) AS place FROM pl JOIN documents USING (doc_id) JOIN benchmark b ON b.item_id = query_id LEFT JOIN rl USING (query_id, doc_id)")
def i06_hard_negatives(spark, sf):
    """Relevant documents found, hard negatives and hash-ordered others, 30 a query."""
    docs, asked = R.corpus(spark, sf), R.questions(spark, sf)
    qrels = phrases.containing(docs, asked).select("query_id", "doc_id", F.lit(3).alias("rel"))
    return mining.hard_negatives(asked, docs, stage(qrels, "qrels"), per_query=30)


def _sql_split(rows: str, key: str) -> str:
    """CTEs ending in e(key, split): the split of each key, keys in hash order."""
    share = lambda r: f"round_even(n * {r}e0, 0)"
    return f"""k AS (SELECT DISTINCT {key} AS key FROM {rows}),
o AS (SELECT key, row_number() OVER (ORDER BY sha256('42:' || key), key) - 1 AS i, count(*) OVER () AS n FROM k),
c AS (SELECT *, least(greatest({share(0.7)}, 1), greatest(n - 1, 1)) AS tr FROM o),
v AS (SELECT *, least({share(0.15)}, greatest(n - tr - 1, 1)) AS va FROM c),
e AS (SELECT key, CASE WHEN i = n - 1 AND tr + va >= n THEN 'test' WHEN i < tr THEN 'train' WHEN i < tr + va THEN 'validation' ELSE 'test' END AS split FROM v)"""


@query(f"WITH {_sql_split('documents', "source || '/' || lang")} SELECT doc_id, split FROM documents JOIN e ON e.key = source || '/' || lang")
def i07_group_split(spark, sf):
    """Documents split by source and language, groups whole."""
    return mining.split(R.table(spark, sf, "documents"), F.concat_ws("/", "source", "lang")).select("doc_id", "split")


@query(f"WITH r AS (SELECT labels.*, source FROM labels JOIN documents USING (doc_id)), {_sql_split('r', 'source')}, t AS (SELECT r.* FROM r JOIN e ON e.key = source WHERE split = 'train'), m AS (SELECT count(*) > 1 AS mixed FROM (SELECT DISTINCT quality FROM t)) SELECT t.* FROM t, m WHERE mixed UNION ALL SELECT r.* FROM r, m WHERE NOT mixed")
def i08_train_rows(spark, sf):
    """Labels of the training groups, or all labels if those are of one class."""
    rows = R.table(spark, sf, "labels").join(R.table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    train = mining.split(rows, F.col("source")).filter("split = 'train'").drop("split")
    return mining.train_rows_or_all(train, rows, "quality")


_TOPICS = "tp AS (SELECT item_id AS topic_id, 'domain ' || (item_id % 5) AS domain, 'topic ' || item_id AS query, coalesce(lead(text) OVER (ORDER BY item_id), 'No topic follows.') AS d0, substring(text, 1, CAST(length(text) // 3 AS BIGINT)) AS d1, substring(text, 1, CAST(2 * length(text) // 3 AS BIGINT)) AS d2, text AS d3 FROM benchmark)"


def _topics(spark, sf):
    """Topics with documents graded 0 to 3: another topic's text, and a third, two thirds and all of their own."""
    t, n = R.table(spark, sf, "benchmark"), F.length("text")
    after = F.lead("text").over(W.Window.orderBy("item_id"))
    third = lambda k: F.substring(F.col("text"), F.lit(1), F.floor(k * n / 3).cast("int"))
    return t.select(F.col("item_id").alias("topic_id"), F.concat(F.lit("domain "), F.col("item_id") % 5).alias("domain"), F.concat(F.lit("topic "), F.col("item_id")).alias("query"), F.coalesce(after, F.lit("No topic follows.")).alias("d0"), third(1).alias("d1"), third(2).alias("d2"), F.col("text").alias("d3"))


_CROSS = "fo AS (SELECT topic_id AS other_id, domain AS other_domain FROM tp QUALIFY row_number() OVER (PARTITION BY domain ORDER BY sha256('42:' || topic_id)) <= 4), cx AS (SELECT topic_id, domain, other_id, other_domain, row_number() OVER (PARTITION BY topic_id ORDER BY sha256('42:' || topic_id || ':' || other_id)) AS place FROM tp JOIN fo ON domain <> other_domain QUALIFY place <= 4)"


@query(f"WITH {_TOPICS}, {_CROSS} SELECT topic_id, domain, other_id, other_domain, CAST(place AS INTEGER) AS place FROM cx")
def i09_cross_domain(spark, sf):
    return mining.cross_domain(_topics(spark, sf))


_TEACHER = f"{R.SQL_CANDIDATES}, {_TAUGHT}"


@query(f"WITH {_TEACHER}, pp AS (SELECT a.query_id, a.doc_id AS a, b.doc_id AS b, CASE WHEN a.label > b.label THEN 'A' ELSE 'B' END AS preferred, row_number() OVER (PARTITION BY a.query_id ORDER BY a.pos, b.pos) AS n FROM fs a JOIN fs b ON a.query_id = b.query_id AND a.pos < b.pos WHERE abs(a.label - b.label) >= 1e-9 QUALIFY n <= 1000) SELECT query_id, a, b, preferred, CAST(n AS INTEGER) AS n FROM pp")
def h06_preference_pairs(spark, sf):
    """Pairs from the stand-in teacher's scores, at most 1000 a query."""
    scored = rankers.hybrid(R.candidates(spark, sf)).select(*_KEYS, "pos", F.round("score", 6).alias("label"))
    return mining.preference_pairs(stage(scored, "teacher")).select("query_id", "a", "b", "preferred", "n")


def _examples(spark, sf):
    return R.judged(spark, sf).select("query_id", "query", "doc", F.col("rel").alias("score"), "pos")


_OFF = "42 AS generation_seed, 'offline' AS generation_mode, CAST(NULL AS VARCHAR) AS teacher_model"
_DRAWN = "CAST('0x' || substr(sha256('42:{}:' || idx), 1, 12) AS BIGINT) % {}"
_SUFFIX = "[" + ", ".join(f"'{x}'" for x in synth.SUFFIXES) + "]"


@query(f"""WITH {R.SQL_EXCHANGES}, sd AS (SELECT query_id, query, doc AS positive, coalesce(lead(doc) OVER (ORDER BY query_id), '') AS negative FROM ex),
od AS (SELECT *, row_number() OVER (ORDER BY sha256('42:' || query_id)) - 1 AS i FROM sd), sz AS (SELECT count(*) AS n FROM sd),
pl AS (SELECT 2 * i + side AS idx, query, CASE side WHEN 0 THEN positive ELSE negative END AS doc, CASE side WHEN 0 THEN 3 ELSE 0 END AS score, CASE side WHEN 0 THEN 'Directly addresses the query with the relevant concept.' ELSE 'Discusses a different topic from the query.' END AS rationale FROM od, range(0, 2) AS s(side)),
mo AS (SELECT idx, idx % 4 AS score, {_DRAWN.format("seed", "n")} AS i, {_SUFFIX}[{_DRAWN.format("suffix", len(synth.SUFFIXES))} + 1] AS suffix FROM sz, range(0, 1000) AS g(idx) WHERE idx >= 2 * n AND n > 0),
al AS (SELECT * FROM pl WHERE idx < 1000 UNION ALL SELECT idx, query, CASE WHEN score >= 2 THEN positive ELSE negative END || ' ' || suffix, score, 'Offline synthetic label generated from seeded examples.' FROM mo JOIN od USING (i))
SELECT CAST(idx AS INTEGER) AS idx, query, doc, CAST(score AS INTEGER) AS score, rationale, {_OFF} FROM al""")
def j01_pairs(spark, sf):
    """Graded pairs from the exchanges, each with the next exchange's answer as its negative."""
    ex = R.exchanges(spark, sf)
    seeds = ex.select(F.col("query_id").alias("seed_id"), "query", F.col("doc").alias("positive"), F.coalesce(F.lead("doc").over(W.Window.orderBy("query_id")), F.lit("")).alias("negative"))
    return synth.pairs(stage(seeds, "seeds"), 1000)


_BEST = f"{R.SQL_JUDGED}, bw AS (SELECT query_id, query, arg_max(doc, rel * 1000 + pos) AS doc_a, arg_min(doc, rel * 1000 + pos) AS doc_b FROM judged GROUP BY ALL HAVING count(*) >= 2)"


@query(f"WITH {_BEST} SELECT query_id, query, doc_a, doc_b, 'A' AS preferred, 0.95e0 AS confidence, {_OFF} FROM bw")
def j02_best_and_worst(spark, sf):
    return synth.best_and_worst(_examples(spark, sf))


@query(f"""WITH {R.SQL_JUDGED}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CAST('0x' || substr(sha256('42:' || query_id || ':' || pos), 1, 12) AS BIGINT)) AS k FROM judged)
SELECT a.query_id, CAST((a.k + 1) // 2 AS INTEGER) AS pair, a.query, a.doc AS doc_a, b.doc AS doc_b, CASE WHEN a.rel >= b.rel THEN 'A' ELSE 'B' END AS preferred, round(least(1e0, 0.55e0 + abs(a.rel - b.rel) * 0.15e0), 2) AS confidence, {_OFF} FROM k a JOIN k b ON a.query_id = b.query_id AND b.k = a.k + 1 WHERE a.k % 2 = 1 AND a.k <= 6""")
def j02_random_preferences(spark, sf):
    return synth.random_preferences(_examples(spark, sf), per_query=3)


@query(f"WITH {_BEST} SELECT query_id, CASE WHEN query_id % 2 = 1 THEN doc_b ELSE doc_a END AS doc_a, CASE WHEN query_id % 2 = 1 THEN doc_a ELSE doc_b END AS doc_b, CASE WHEN query_id % 2 = 1 THEN 'B' ELSE 'A' END AS preferred FROM bw")
def j03_swapped_preferences(spark, sf):
    rows = synth.swap(synth.best_and_worst(_examples(spark, sf)), F.col("query_id") % 2 == 1)
    return rows.select("query_id", "doc_a", "doc_b", "preferred")


_SUBJECTS = ", ".join(f"({i}, '{s}', '{f}', '{a}', '{b}')" for i, (s, f, a, b) in enumerate(synth.SUBJECTS))
def _sql_contradictions(count: str, controls: str) -> str:
    return f"su AS (SELECT * FROM (VALUES {_SUBJECTS}) AS v(i, subject, field, a, b)), rg AS (SELECT r.idx, r.idx < {count} AS bad, CASE WHEN r.idx < {count} THEN r.idx ELSE r.idx - {count} END % {len(synth.SUBJECTS)} AS i FROM range(0, {count} + {controls}) AS r(idx)), ct AS (SELECT idx, subject, CASE WHEN bad THEN subject || ' reports ' || field || ' as ' || a || '. The rest of the setup is unchanged.' ELSE subject || ' lists ' || field || ' as ' || a || '. Supporting context is similar.' END AS doc_a, CASE WHEN bad THEN subject || ' reports ' || field || ' as ' || b || '. The rest of the setup is unchanged.' ELSE subject || ' again lists ' || field || ' as ' || a || '. Supporting context is similar.' END AS doc_b, field AS contradicted_field, a AS value_a, CASE WHEN bad THEN b ELSE a END AS value_b, bad AS is_contradiction FROM rg JOIN su USING (i))"


#: As many records as there are documents, and a control for each second one.
_CONTRA = _sql_contradictions("(SELECT count(*) FROM documents)", "(SELECT count(*) // 2 FROM documents)")


def _contradictions(spark, sf):
    n = R.table(spark, sf, "documents").count()
    return synth.contradictions(spark, n, n // 2)


@query(f"WITH {_CONTRA} SELECT *, {_OFF} FROM ct")
def j04_contradictions(spark, sf):
    """Contradicting and agreeing records, as many as the corpus asks for."""
    return _contradictions(spark, sf)


@query(f"WITH {_CONTRA}, br AS (SELECT idx, subject, contradicted_field AS field_name, value_a, value_b, is_contradiction, CASE WHEN idx % 3 = 0 THEN 'Nothing is said.' ELSE doc_a END AS doc_a, doc_b, CASE WHEN idx % 4 = 0 THEN 'other' ELSE value_b END AS said_b FROM ct), fx AS (SELECT *, CASE WHEN is_contradiction THEN lower(trim(value_a)) = lower(trim(value_b)) OR NOT contains(lower(doc_a), lower(trim(value_a))) OR NOT contains(lower(doc_b), lower(trim(value_b))) ELSE lower(trim(value_a)) <> lower(trim(said_b)) OR NOT contains(lower(doc_a), lower(trim(value_a))) OR NOT contains(lower(doc_b), lower(trim(value_a))) END AS wrong FROM br) SELECT idx, CASE WHEN wrong THEN subject || ' reports ' || replace(field_name, '_', ' ') || ' as ' || value_a || '. Supporting context remains stable.' ELSE doc_a END AS doc_a, CASE WHEN wrong THEN subject || CASE WHEN is_contradiction THEN ' reports ' ELSE ' again reports ' END || replace(field_name, '_', ' ') || ' as ' || CASE WHEN is_contradiction THEN value_b ELSE value_a END || '. Supporting context remains stable.' ELSE doc_b END AS doc_b FROM fx")
def j05_stabilize(spark, sf):
    rows = _contradictions(spark, sf).withColumnRenamed("contradicted_field", "field_name")
    rows = rows.withColumns({"doc_a": F.when(F.col("idx") % 3 == 0, "Nothing is said.").otherwise(F.col("doc_a")), "said_b": F.when(F.col("idx") % 4 == 0, "other").otherwise(F.col("value_b"))})
    return synth.stabilize(rows).select("idx", "doc_a", "doc_b")


_EASY = ["The history of the calendar begins with the moon.", "A recipe for bread needs flour, water and time.", "Tides follow the moon and the sun."]


@query(f"WITH {_TOPICS}, po AS (SELECT domain, row_number() OVER (PARTITION BY domain ORDER BY topic_id) - 1 AS place, d2 AS text FROM tp WHERE domain <> 'domain 4'), sz AS (SELECT domain, count(*) AS size FROM po GROUP BY ALL), ex AS (SELECT topic_id AS idx, query, d3 AS positive, CASE WHEN domain IN (SELECT domain FROM po) THEN domain ELSE 'domain 0' END AS domain FROM tp) SELECT idx, query, positive, po.text AS hard_negative, ['{_EASY[0]}', '{_EASY[1]}', '{_EASY[2]}'][CAST(idx % 3 + 1 AS BIGINT)] AS easy_negative, {_OFF} FROM ex JOIN sz USING (domain) JOIN po ON po.domain = ex.domain AND po.place = idx % size")
def j06_hard_negatives(spark, sf):
    topics = _topics(spark, sf)
    place = F.row_number().over(W.Window.partitionBy("domain").orderBy("topic_id")) - 1
    pools = topics.filter("domain <> 'domain 4'").select("domain", place.alias("place"), F.col("d2").alias("text"))
    return synth.hard_negatives(topics.select(F.col("topic_id").alias("idx"), "query", F.col("d3").alias("positive"), "domain"), pools, _EASY, "domain 0")


@query(f"WITH {R.SQL_JUDGED}, k AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, pos) AS k FROM judged) SELECT query_id, query, list(doc ORDER BY k) AS docs, [0.4e0, 0.3e0, 0.2e0, 0.1e0][1:count(*)] AS scores, {_OFF} FROM k WHERE n >= 3 AND k <= 4 GROUP BY query_id, query")
def j07_listwise(spark, sf):
    return synth.listwise(_examples(spark, sf))


@query(f"SELECT text AS original_query, ['how to ' || text, text || ' best practices', text || ' example'] AS expanded_queries, {_OFF} FROM (SELECT DISTINCT text FROM benchmark)")
def j08_query_expansions(spark, sf):
    return synth.expansions(R.questions(spark, sf))


@query(f"WITH {_TOPICS}, {_CROSS}, ow AS (SELECT topic_id, domain, query, unnest([d0, d1, d2, d3]) AS doc, CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS score FROM tp), nr AS (SELECT a.topic_id, a.domain, a.query, unnest([b.d1, b.d0, b.d2, a.d3]) AS doc, CAST(unnest([1, 0, 2, 3]) AS INTEGER) AS score FROM tp a JOIN tp b ON a.domain = b.domain AND a.topic_id <> b.topic_id) SELECT * FROM ow UNION ALL SELECT * FROM nr UNION ALL SELECT cx.topic_id, cx.domain, a.query, b.d0, 0 FROM cx JOIN tp a ON a.topic_id = cx.topic_id JOIN tp b ON b.topic_id = cx.other_id")
def j09_expanded_pairs(spark, sf):
    topics = _topics(spark, sf)
    return synth.expanded_pairs(topics, mining.cross_domain(topics).select("topic_id", "other_id"))


_SIDE = "CAST('0x' || substr(sha256('42:' || topic_id || ':' || low || ':' || high), 1, 12) AS BIGINT) % 2 = 1"


@query(f"WITH {_TOPICS}, g AS (SELECT topic_id, domain, query, unnest([d0, d1, d2, d3]) AS doc, CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS score FROM tp), p AS (SELECT a.topic_id, a.domain, a.query, a.score AS high, a.doc AS dh, b.score AS low, b.doc AS dl FROM g a JOIN g b ON a.topic_id = b.topic_id AND b.score < a.score) SELECT topic_id, domain, query, high, low, CASE WHEN {_SIDE} THEN dl ELSE dh END AS doc_a, CASE WHEN {_SIDE} THEN dh ELSE dl END AS doc_b, CASE WHEN {_SIDE} THEN 'B' ELSE 'A' END AS preferred, round((high - low) / 3e0, 2) AS confidence FROM p")
def j09_expanded_preferences(spark, sf):
    return synth.expanded_preferences(_topics(spark, sf))


@query("WITH c AS (SELECT CAST(quality AS VARCHAR) AS label, count(*) AS count FROM labels GROUP BY ALL), t AS (SELECT sum(count) AS total, round(max(count) / greatest(min(count), 1), 4) AS imbalance_ratio FROM c), r AS (SELECT label, count, round(count / greatest(total, 1), 4) AS proportion, imbalance_ratio, imbalance_ratio <= 3.0 AS is_balanced_enough FROM c, t) SELECT *, repeat('#', CAST(round(proportion * 40, 0) AS BIGINT)) AS bar FROM r")
def j10_distribution(spark, sf):
    """Label shares, imbalance and bars."""
    report = synth.distribution(R.table(spark, sf, "labels"), "quality")
    return report.join(synth.bars(report).select("label", "bar"), "label")


@query("SELECT doc_id, n_chars % 5 AS score, n_chars % 5 BETWEEN 0 AND 3 AS valid FROM documents")
def j12_validate(spark, sf):
    """Records with scores in and out of range, checked."""
    rows = R.table(spark, sf, "documents").select("doc_id", F.col("text").alias("query"), F.col("text").alias("doc"), (F.col("n_chars") % 5).alias("score"), F.lit("").alias("rationale"), F.lit("offline").alias("generation_mode"))
    return synth.validate(rows, "pairs").select("doc_id", "score", "valid")


@query("WITH c AS (SELECT count(*) AS n, sum(value) / 1e3 AS logged FROM events WHERE event_type = 'purchase'), x AS (SELECT CASE WHEN n > 0 THEN 'logged_api_costs' ELSE 'configured_estimate' END AS source, CASE WHEN n > 0 THEN logged ELSE 1000 * 0.002e0 END AS cost FROM c) SELECT source, round(cost, 6) AS cost_usd, round(cost / 1000, 6) AS cost_per_judgment_usd, round(cost / 1000 * 100000, 4) AS monthly_cost_usd FROM x")
def j15_cost_summary(spark, sf):
    """The events' values as logged costs of one dataset."""
    costs = R.table(spark, sf, "events").select(F.when(F.col("event_type") == "purchase", "preferences").otherwise("pairs").alias("dataset"), (F.col("value") / 1000).alias("cost_usd"))
    rows = synth.cost_summary(costs, 1000)
    return rows.select("source", F.round("cost_usd", 6).alias("cost_usd"), F.round("cost_per_judgment_usd", 6).alias("cost_per_judgment_usd"), F.round("monthly_cost_usd", 4).alias("monthly_cost_usd"))


def _trained(spark, sf):
    judged = R.judge(R.candidates(spark, sf))
    return judged, stage(X.features(judged).withColumn("label", F.col("rel").cast("double")), "features")


@query()
def h02_pointwise_scores(spark, sf):
    """Boosted trees fitted on judged candidates; the mean of their score and the blend ranks."""
    _, rows = _trained(spark, sf)
    scorer = training.pointwise_hybrid(rows, "label", maxIter=20)
    scored = scorer(rows).withColumn("score", (F.col("model_score") + X.blend(X.STATIC_WEIGHTS)) / 2)
    return bm25.rank(scored, "score").select(*_KEYS, F.round("score", 4).alias("score"), "rank")


@query()
def h01_pairwise_scores(spark, sf):
    """Boosted trees on feature differences of neighbouring candidates."""
    _, rows = _trained(spark, sf)
    names = training.HYBRID_FEATURES
    a = rows.select("query_id", F.col("pos").alias("pos"), F.col("label").alias("la"), *[F.col(n).alias(f"{n}_a") for n in names])
    b = rows.select("query_id", (F.col("pos") - 1).alias("pos"), F.col("label").alias("lb"), *[F.col(n).alias(f"{n}_b") for n in names])
    pairs = a.join(b, ["query_id", "pos"]).filter("la <> lb").withColumn("label", (F.col("la") > F.col("lb")).cast("double"))
    scorer = training.pairwise_hybrid(stage(pairs, "difference"), maxIter=20)
    return scorer(rows).select(*_KEYS, F.round("model_score", 4).alias("score"))


@query()
def h03_learned_tournament(spark, sf):
    """A logistic comparison fitted on teacher preferences, then the full tournament."""
    judged = R.judge(R.candidates(spark, sf))
    pairs = rankers.document_pairs(judged)
    rel = judged.select("query_id", "doc_id", "rel")
    known = pairs.join(rel.toDF("query_id", "a", "ra"), ["query_id", "a"]).join(rel.toDF("query_id", "b", "rb"), ["query_id", "b"]).filter("ra <> rb").withColumn("label", (F.col("ra") > F.col("rb")).cast("double"))
    fitted = training.logistic_pairs(stage(known, "known-pairs"))
    probability = rankers.logistic(*fitted) if isinstance(fitted, tuple) else F.lit(fitted)
    return rankers.tournament(pairs, judged, probability).select(*_KEYS, F.round("score", 4).alias("score"), "rank")


@query()
def h04_bilinear(spark, sf):
    """Weights fitted on products of vectors, then the binary ranking with them."""
    judged = R.judge(R.candidates(spark, sf)).withColumn("label", (F.col("rel") >= 2).cast("int"))
    weights = training.bilinear_weights(judged, "label")
    return rankers.binary_quantized(judged, bilinear_top_k=10, weights=weights).select(*_KEYS, F.round("score", 4).alias("score"), "rank")


@query()
def g04_router(spark, sf):
    """A router fitted on the automatic labels, and the category of each query."""
    asked = X.router_features(R.questions(spark, sf))
    known = asked.join(combine.auto_labels(R.judge(R.candidates(spark, sf))).select("query_id", "category"), "query_id")
    return training.Router().fit(stage(known, "router")).predict(asked)


def _sql_sweep(rankers: dict[str, str]) -> str:
    """Metrics of ranked relations, by strategy, over the judged candidates."""
    lists = " UNION ALL ".join(f"SELECT '{name}' AS strategy, query_id, doc_id, rank FROM {relation}" for name, relation in rankers.items())
    gain = "(pow(2e0, rel) - 1) / log2({} + 1e0)"
    return f"""al AS ({lists}), ju AS (SELECT strategy, query_id, rank, rel FROM al JOIN judged USING (query_id, doc_id)),
od AS (SELECT *, row_number() OVER (PARTITION BY strategy, query_id ORDER BY rel DESC, rank) AS best, sum((rel > 0)::INTEGER) OVER (PARTITION BY strategy, query_id ORDER BY rank) AS so_far FROM ju),
pq AS (SELECT strategy, query_id, coalesce(sum(CASE WHEN rank <= 10 THEN {gain.format("rank")} END), 0) AS dcg, coalesce(sum(CASE WHEN best <= 10 THEN {gain.format("best")} END), 0) AS ideal, coalesce(1e0 / min(CASE WHEN rel > 0 THEN rank END), 0) AS rr, coalesce(avg(CASE WHEN rel > 0 THEN so_far / CAST(rank AS DOUBLE) END), 0) AS ap, avg(CASE WHEN rank <= 1 THEN (rel > 0)::INTEGER END) AS p1 FROM od GROUP BY ALL)
SELECT strategy, count(*) AS queries, round(avg(CASE WHEN ideal = 0 THEN 0 ELSE dcg / ideal END), 6) AS ndcg, round(avg(rr), 6) AS mrr, round(avg(ap), 6) AS map, round(avg(p1), 6) AS p_at_1 FROM pq GROUP BY ALL"""


_SWEPT = f"""{R.SQL_JUDGED}, {S.bm25_local('cand', 'b', R.sql_words)}, bs AS (SELECT *, bm25_norm AS score FROM b), {S.ranked('bs', 'r1')},
{S.features('cand', 'f')}, fs AS (SELECT *, {S.blend()} AS score FROM f), {S.ranked('fs', 'r2')}, {S.binary('cand', 'bi')}, {S.ranked('bi', 'r3')}, {S.late('cand', 'la')}, {S.ranked('la', 'r4')}, {S.sparse('cand', 'sp')}, {S.ranked('sp', 'r5')}"""


@query(f"WITH {_SWEPT}, {_sql_sweep({'bm25': 'r1', 'hybrid': 'r2', 'binary': 'r3', 'late_interaction': 'r4', 'sparse': 'r5'})}")
def l12_sweep(spark, sf):
    """Several strategies evaluated on the same judged candidates."""
    judged = R.judge(R.candidates(spark, sf))
    rel = judged.select("query_id", "doc_id", "rel")
    strategies = {"bm25": bm25.rerank, "hybrid": rankers.hybrid, "binary": rankers.binary_quantized, "late_interaction": rankers.late_interaction, "sparse": rankers.sparse}
    out = None
    for name, ranker in strategies.items():
        ranked = stage(ranker(judged.drop("rel")).select("query_id", "doc_id", "rank"), f"ranked-{name}").join(rel, _KEYS)
        one = metrics.evaluate(ranked).select(F.lit(name).alias("strategy"), "queries", *[F.round(c, 6).alias(c) for c in ("ndcg", "mrr", "map", "p_at_1")])
        out = one if out is None else out.unionByName(one)
    return out


_ABLATED = {"all": X.STATIC_WEIGHTS} | {n: X.STATIC_WEIGHTS | {n: 0.0} for n in X.STATIC_WEIGHTS}
_VARIANTS = ", ".join(f"v{i} AS (SELECT *, {S.blend(w)} AS score FROM f), {S.ranked(f'v{i}', f'w{i}')}" for i, w in enumerate(_ABLATED.values()))


@query(f"WITH {R.SQL_JUDGED}, {S.features('cand', 'f')}, {_VARIANTS}, {_sql_sweep({n: f'w{i}' for i, n in enumerate(_ABLATED)}).replace('SELECT strategy, count', 'SELECT strategy AS variant, count')}")
def l11_ablation(spark, sf):
    """The static fusion without each of its features in turn."""
    return _rounded(strategies.ablation(R.judged(spark, sf)))


_SIZES = (20, 50, 100, 200)
_SIZED = f"{R.SQL_JUDGED}, sz AS (SELECT CAST(s.size AS BIGINT) * 1000000000 + query_id AS query_id, query, doc_id, doc, pos FROM cand, (VALUES {', '.join(f'({n})' for n in _SIZES)}) AS s(size) WHERE pos <= s.size), {S.bm25_local('sz', 'b', R.sql_words)}, bs AS (SELECT *, bm25_norm AS score FROM b), {S.ranked('bs', 'r1')}, " + ", ".join(f"z{n} AS (SELECT query_id % 1000000000 AS query_id, doc_id, rank FROM r1 WHERE query_id // 1000000000 = {n})" for n in _SIZES)


@query(f"WITH {_SIZED}, {_sql_sweep({str(n): f'z{n}' for n in _SIZES}).replace('SELECT strategy, count', 'SELECT CAST(strategy AS INTEGER) AS variant, count')}".replace(f"pos <= {R.RETRIEVED})", f"pos <= {max(_SIZES)})"))
def l11_scaling(spark, sf):
    """BM25 over lists of 20 to 200 documents."""
    return _rounded(strategies.scaling(R.judge(R.candidates(spark, sf, max(_SIZES))), bm25.rerank, _SIZES))


_DIMENSIONS = (64, 128, 256, 512)


def _sql_folded(source: str, key: str, text: str, name: str) -> str:
    hashed = R.sql_bucket("token").replace(" % 256 AS INTEGER)", " AS BIGINT)")
    return f"""{name}t AS (SELECT {key}, unnest({R.sql_tokens(text)}) AS token FROM (SELECT DISTINCT {key}, {text} FROM {source})),
{name}h AS (SELECT token, {hashed} AS h, {R.sql_sign("token")} AS sign FROM (SELECT DISTINCT token FROM {name}t)),
{name}n AS (SELECT dim, {key}, h % dim AS bucket, CAST(sum(sign) AS DOUBLE) AS n FROM {name}t JOIN {name}h USING (token), (VALUES {", ".join(f"({x})" for x in _DIMENSIONS)}) AS g(dim) GROUP BY ALL HAVING sum(sign) <> 0),
{name} AS (SELECT dim, {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY dim, {key})) AS w FROM {name}n)"""


_FOLDED = f"{R.SQL_JUDGED}, {_sql_folded('cand', 'query_id', 'query', 'eq')}, {_sql_folded('cand', 'doc_id', 'doc', 'ed')}, dots AS (SELECT a.dim, a.query_id, b.doc_id, sum(a.w * b.w) AS s FROM cand c JOIN eq a ON a.query_id = c.query_id JOIN ed b ON b.doc_id = c.doc_id AND b.dim = a.dim AND b.bucket = a.bucket GROUP BY ALL), " + ", ".join(f"x{n} AS (SELECT c.query_id, c.doc_id, c.pos, coalesce(s, 0) AS score FROM cand c LEFT JOIN dots ON dots.query_id = c.query_id AND dots.doc_id = c.doc_id AND dim = {n}), {S.ranked(f'x{n}', f'y{n}')}" for n in _DIMENSIONS)


@query(f"WITH {_FOLDED}, {_sql_sweep({str(n): f'y{n}' for n in _DIMENSIONS}).replace('SELECT strategy, count', 'SELECT CAST(strategy AS INTEGER) AS variant, count')}")
def l11_dimensions(spark, sf):
    """Ranking by hashed embeddings of several dimensions."""
    return _rounded(strategies.dimensions(R.judge(R.candidates(spark, sf)), list(_DIMENSIONS)))


@query(f"WITH {_SWEPT}, {_sql_sweep({'bm25': 'r1', 'late_interaction': 'r4', 'sparse': 'r5'}).replace('SELECT strategy, count', 'SELECT strategy AS variant, true AS timed, count')}")
def l11_latency(spark, sf):
    """Metrics and latency of strategies by name."""
    report = strategies.measured(R.judge(R.candidates(spark, sf)), {"bm25": {}, "late_interaction": {}, "sparse": {}})
    return _rounded(report).join(report.select("variant", (F.col("seconds") > 0).alias("timed")), "variant")


def _rounded(report):
    return report.select("variant", "queries", *[F.round(c, 6).alias(c) for c in ("ndcg", "mrr", "map", "p_at_1")])


@query()
def e07_listwise_scores(spark, sf):
    """Linear scorers fitted by both losses over whole lists, and how they rank the judged candidates."""
    judged, rows = _trained(spark, sf)
    out = None
    for loss in ("listwise", "lambdaloss"):
        weights = training.listwise_weights(rows, "label", loss=loss)
        scored = rows.withColumn("score", sum((F.lit(w) * F.coalesce(n, F.lit(0.0)) for n, w in weights.items()), F.lit(0.0)))
        one = bm25.rank(scored, "score").select(F.lit(loss).alias("loss"), *_KEYS, F.round("score", 4).alias("score"), "rank")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def e07_boosted_lists(spark, sf):
    """Boosted trees fitted by both losses over whole lists, and how they rank the judged candidates."""
    _, rows = _trained(spark, sf)
    out = None
    for loss in ("listwise", "lambdaloss"):
        scored = boosting.fit(rows, "label", training.HYBRID_FEATURES, loss).score(rows)
        one = bm25.rank(scored.withColumn("score", F.round("model_score", 6)), "score").select(F.lit(loss).alias("loss"), *_KEYS, "score", "rank")
        out = one if out is None else out.unionByName(one)
    return out


_REGIONS = "tm AS (SELECT n_name AS subject, 'region' AS field, r_name AS value_a, coalesce(o.name, 'NOWHERE') AS value_b FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN (SELECT r_regionkey - 1 AS k, r_name AS name FROM region) o ON o.k = n_regionkey), cn AS (SELECT n_name AS subject, 'key' AS field, CAST(n_nationkey AS VARCHAR) AS value FROM nation)"


@query(f"""WITH {_REGIONS}, al AS (SELECT subject, subject || ' states ' || field || ' is ' || value_a || '.' AS doc_a, subject || ' specifies ' || field || ' as ' || value_b || '.' AS doc_b, field AS contradicted_field, value_a, value_b, true AS is_contradiction, copy FROM tm, range(1, 1 + greatest(1, 1000 // (SELECT count(*) FROM tm))) AS g(copy)
UNION ALL SELECT subject, subject || ' confirms ' || field || ' ' || value || '.', subject || ' states ' || field || ' ' || value || '.', field, value, value, false, copy FROM cn, range(1, 1 + greatest(1, 400 // (SELECT count(*) FROM cn))) AS g(copy))
SELECT * EXCLUDE (copy) FROM al ORDER BY sha256('42:' || subject || ':' || contradicted_field || ':' || is_contradiction || ':' || copy), value_a, value_b LIMIT 1400""")
def j09_expanded_contradictions(spark, sf):
    """Nations with two regions each as templates, with their keys as controls."""
    nation, region = R.table(spark, sf, "nation"), R.table(spark, sf, "region")
    after = region.select((F.col("r_regionkey") - 1).alias("n_regionkey"), F.col("r_name").alias("other"))
    rows = nation.join(region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey").join(after, "n_regionkey", "left")
    templates = rows.select(F.col("n_name").alias("subject"), F.lit("region").alias("field"), F.col("r_name").alias("value_a"), F.coalesce("other", F.lit("NOWHERE")).alias("value_b"))
    controls = nation.select(F.col("n_name").alias("subject"), F.lit("key").alias("field"), F.col("n_nationkey").cast("string").alias("value"))
    return synth.expanded_contradictions(templates, controls)


def _graded(batch):
    """A stand-in teacher that answers at most seven rows at a time."""
    if len(batch) > 7:
        raise ValueError("too many rows")
    return [int(n) % 4 for n in batch["n_chars"]]


@query("SELECT doc_id, CAST(n_chars % 4 AS INTEGER) AS score FROM documents")
def j13_teacher_batches(spark, sf):
    """All documents graded in batches that fail until they are halved."""
    return teacher.label_batches(R.table(spark, sf, "documents").select("doc_id", "n_chars"), _graded, "int", name="score").select("doc_id", "score")


@query("SELECT item_id, 3 AS score, text AS rationale FROM benchmark")
def b14_json_salvage(spark, sf):
    """Records read back from fenced, bare and talkative answers."""
    said = F.to_json(F.struct(F.lit(3).alias("score"), F.col("text").alias("rationale")))
    kinds = F.array(said, F.concat(F.lit("```json\n"), said, F.lit("\n```")), F.concat(F.lit("Here it is: "), said, F.lit(" - done.")))
    rows = R.table(spark, sf, "benchmark").select("item_id", F.element_at(kinds, (F.col("item_id") % 3 + 1).cast("int")).alias("answer"))
    return rows.select("item_id", json_object(F.col("answer"), "score int, rationale string").alias("r")).select("item_id", "r.*")


@query("SELECT doc_id AS query_id, text AS query, quality AS score FROM documents JOIN labels USING (doc_id)")
def a01_jsonl_round_trip(spark, sf):
    """Records written as JSON lines in two appends and read back under their schema."""
    rows = R.table(spark, sf, "documents").join(R.table(spark, sf, "labels"), "doc_id").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"), F.col("quality").alias("score"))
    path = scratch(spark, "records")
    readers.write_jsonl(rows.filter("query_id % 2 = 0"), path)
    readers.append_jsonl(rows.filter("query_id % 2 = 1"), path)
    return readers.read_jsonl(spark, path, rows.schema)


@query("SELECT b.item_id::VARCHAR AS query_id, b.text AS query, d.doc_id::VARCHAR AS doc_id, d.text AS doc, 3 AS rel FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def a05_retrieval_dataset(spark, sf):
    """A benchmark folder written in the common layout, read back, and joined into judged rows."""
    folder = scratch(spark, "dataset")
    docs, asked = R.corpus(spark, sf), R.questions(spark, sf)
    docs.select(F.col("doc_id").cast("string").alias("_id"), F.lit("").alias("title"), F.col("doc").alias("text")).write.json(f"{folder}/corpus.jsonl")
    asked.select(F.col("query_id").cast("string").alias("_id"), F.col("query").alias("text")).write.json(f"{folder}/queries.jsonl")
    phrases.containing(docs, asked).select(F.col("query_id").alias("query-id"), F.col("doc_id").alias("corpus-id"), F.lit(3).alias("score")).write.option("sep", "\t").option("header", True).csv(f"{folder}/qrels/test.tsv")
    data = readers.beir_simple(spark, folder)
    return readers.judged_rows(data["qrels"], data["queries"], data["corpus"]).select("query_id", "query", "doc_id", "doc", "rel")


@query(f"WITH {R.SQL_RETRIEVED} SELECT token, df FROM df")
def a12_cached_term_counts(spark, sf):
    """Term counts kept under the key of their texts, built once and read the second time."""
    docs = R.corpus(spark, sf)
    cache = store.TableStore(spark, scratch(spark, "cache"))
    key = store.content_of(docs, "doc")
    for _ in range(2):
        counts = cache.get_or_build(key, lambda: bm25.term_counts(docs, ["doc_id"], "doc"))
    return bm25.document_frequencies(counts, [])


@query(f"WITH {R.SQL_RETRIEVED} SELECT token, df FROM df")
def a13_rebuilt_store(spark, sf):
    """Term counts in a store, one of whose files is damaged; what is read then has been built anew."""
    docs, root = R.corpus(spark, sf), scratch(spark, "store")
    build = lambda: bm25.document_frequencies(bm25.term_counts(docs, ["doc_id"], "doc"), [])
    cache = store.TableStore(spark, root)
    cache.get_or_build("df", build)
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache.path("df"))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in files.listStatus(folder) if f.getPath().getName().startswith("part-"))
    damaged = files.create(part, True)
    damaged.writeBytes("PAR1 no longer a table")
    damaged.close()
    return store.TableStore(spark, root).get_or_build("df", build)


def _metered(batch, n):
    """A stand-in teacher of single documents that fails at first by a rule of their length."""
    chars = int(batch["n_chars"].iloc[0])
    if n <= chars % 3:
        raise teacher.Retry("too many requests")
    return teacher.Answer([chars % 4], "stand-in", chars, 1, (chars + 1) / 1e6)


@query("WITH c AS (SELECT doc_id, n_chars, unnest(range(1, n_chars % 3 + 2)) AS n FROM documents) SELECT CASE WHEN n <= n_chars % 3 THEN 'again' ELSE 'answered' END AS outcome, count(*) AS calls, count(*) AS n_rows, CAST(sum(CASE WHEN n > n_chars % 3 THEN n_chars ELSE 0 END) AS BIGINT) AS input_tokens, CAST(sum((n > n_chars % 3)::INTEGER) AS BIGINT) AS output_tokens, CAST(sum(CASE WHEN n > n_chars % 3 THEN n_chars + 1 ELSE 0 END) AS BIGINT) AS total_tokens, round(sum(CASE WHEN n > n_chars % 3 THEN n_chars + 1 ELSE 0 END) / 1e6, 6) AS cost_usd FROM c GROUP BY ALL")
def j14_cost_log(spark, sf):
    """All documents graded by a teacher whose calls fail and are made again, and what its log sums to."""
    docs = R.table(spark, sf, "documents").select("doc_id", "n_chars")
    _, log = teacher.label_with_log(docs, "doc_id", _metered, "int", size=1, name="score", wait=(0.0, 0.0))
    return teacher.cost_totals(log, "outcome").withColumn("cost_usd", F.round("cost_usd", 6))


@query("SELECT CAST(dim - 1 AS INTEGER) AS bucket, round(avg(x), 6) AS weight FROM (SELECT unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS dim FROM embeddings) GROUP BY ALL")
def a14_model_round_trip(spark, sf):
    """A model's tables and settings, here mean embeddings, saved, checked and loaded."""
    path = scratch(spark, "model")
    weights = R.dense(spark, sf).groupBy(F.col("dim").alias("bucket")).agg(F.round(F.avg("x"), 6).alias("weight"))
    store.save_model(spark, path, "bilinear", {"source": "embeddings"}, {"weights": weights})
    _, tables = store.load_model(spark, path, "bilinear")
    return tables["weights"]


@query(f"WITH {_BEST}, {_CONTRA} SELECT 'preferences' AS dataset, count(*) AS records, sum((query IS NOT NULL AND doc_a IS NOT NULL AND doc_b IS NOT NULL)::INTEGER)::BIGINT AS valid FROM bw UNION ALL SELECT 'contradictions', count(*), sum((subject IS NOT NULL AND value_b IS NOT NULL)::INTEGER)::BIGINT FROM ct UNION ALL SELECT 'query_expansions', count(DISTINCT text), count(DISTINCT text) FROM benchmark")
def a15_materialized_datasets(spark, sf):
    """Generated records written as files of bounded size, and the manifest of their counts."""
    root, out = scratch(spark, "generated"), None
    made = {"preferences": synth.best_and_worst(_examples(spark, sf)).drop("query_id"), "contradictions": _contradictions(spark, sf).drop("idx"), "query_expansions": synth.expansions(R.questions(spark, sf))}
    for name, rows in made.items():
        readers.write_jsonl(rows, f"{root}/{name}", 1000)
        back = synth.validate(readers.read_jsonl(spark, f"{root}/{name}", synth.SCHEMAS[name]), name)
        one = back.agg(F.count("*").alias("records"), F.sum(F.col("valid").cast("int")).alias("valid")).select(F.lit(name).alias("dataset"), "*")
        out = one if out is None else out.unionByName(one)
    return out
