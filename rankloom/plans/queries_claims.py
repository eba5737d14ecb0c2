"""Claim normalisation, contradiction joins, consistency ranking and confusion metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import claim_patterns as P
from ..operators import claims as C
from ..operators import conflicts, metrics
from . import relations as R
from .registry import query

_LEADS = ["However, the ", "In reality ", "the ", "", "Yet ", "On the other hand the ", "(", "recent tests show that the "]
_TAILS = [" is", " actually", "", " has now", " will again be", ".", ")", " was"]
_ATTRIBUTES = ["The Actual Latency", "low-latency ms", "release", "a High Score", "the best  metric", "Screening Status ", "(release)", "an actual low price"]
_VALUES = ["reported as {}", "only {}", "approximately {} ms", "an impressive {}", "now {} in tests", "{} percent", "measured at {} which is new", "{}"]
_RAW = ["Yes", " pending ", "5 ms", "5ms", "12 seconds", "7 %", "off", "3 gb free"]


def _pick(values: list[str], index):
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def _sql_pick(values: list[str], index: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST({index} % {len(values)} + 1 AS BIGINT)]"


def _decorated(spark, sf):
    """Customer names and balances written as people write them."""
    c = R.table(spark, sf, "customer").withColumn("i", F.col("c_custkey"))
    amount = F.col("c_acctbal").cast("decimal(18,2)").cast("string")
    return c.select("i", F.concat(_pick(_LEADS, F.col("i")), "c_name", _pick(_TAILS, F.col("i") + F.floor(F.col("i") / 8))).alias("entity"), _pick(_ATTRIBUTES, F.col("i")).alias("attribute"), F.replace(_pick(_VALUES, F.col("i")), F.lit("{}"), amount).alias("value"), _pick(_RAW, F.col("i")).alias("raw"), amount.alias("amount"))


_DECORATED = f"dec AS (SELECT c_custkey AS i, {_sql_pick(_LEADS, 'c_custkey')} || c_name || {_sql_pick(_TAILS, '(c_custkey + c_custkey // 8)')} AS entity, {_sql_pick(_ATTRIBUTES, 'c_custkey')} AS attribute, replace({_sql_pick(_VALUES, 'c_custkey')}, '{{}}', CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR)) AS value, {_sql_pick(_RAW, 'c_custkey')} AS raw, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS amount FROM customer)"


def _sql_clean(column: str) -> str:
    return f"trim(regexp_replace(trim({column}, ' .,:;()[]{{}}\"'''), '{R.SPACE}+', ' ', 'g'))"


def _sql_fold(column: str, *steps: tuple[str, str]) -> str:
    for pattern, by in steps:
        column = f"regexp_replace({column}, '{pattern}', '{by}', 'g')"
    return column


_ENTITY = _sql_fold(_sql_clean("entity"), (rf"(?i)^(?:(?:{'|'.join(P.NARRATIVE_PREFIXES)})\s+)+", ""), (r"(?i)\s+(?:is|has|was|will|again)\b.*$", ""), (r"(?i)\s+actually$", ""))
_ATTRIBUTE = _sql_fold(f"lower({_sql_clean('attribute')})", (r"[\s\-]+", "_"), ("^(?:a|an|the)_", ""), ("^(?:actual)_", ""), ("^(?:low|high)_", ""), ("^(?:recent_tests_show_that|latest_results_indicate_that|latest_tests_indicate_that)_", ""), ("^(?:the)_", ""))
_VALUE = _sql_fold(_sql_clean("value"), (r"(?i)^(?:reported|confirmed|measured|recorded)\s+(?:to\s+be|as|at)\s+", ""), (r"(?i)^(?:only|just|actual(?:ly)?|approximately|around)\s+", ""), (r"(?i)^(?:an?|the)\s+impressive\s+", ""), (r"(?i)^now\s+", ""), (r"(?i)\s+(?:in|during|which|making|ensuring|indicating)\b.*$", ""))


@query(f"WITH {_DECORATED} SELECT i, {_ENTITY} AS entity, CASE WHEN contains({_ATTRIBUTE}, 'latency') THEN 'latency' WHEN {_ATTRIBUTE} = 'release' THEN 'release_year' ELSE trim({_ATTRIBUTE}, '_') END AS attribute, {_VALUE} AS value FROM dec")
def b08_normalize_claims(spark, sf):
    """Normalised entities, attributes and values."""
    d = _decorated(spark, sf)
    return d.select("i", C.normalize_entity(F.col("entity")).alias("entity"), C.normalize_attribute(F.col("attribute")).alias("attribute"), C.normalize_value(F.col("value")).alias("value"))


def _sql_canonical(column: str) -> str:
    raw = f"lower(trim({column}))"
    units = _sql_fold(raw, *[(rf"\b{u}\b", "") for u in P.UNITS])
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in P.SYNONYMS.items())
    return f"CASE {raw} {cases} ELSE trim({units}) END"


@query(f"WITH {_DECORATED} SELECT i, {_sql_canonical('raw')} AS raw, {_sql_canonical('value')} AS value FROM dec")
def b11_canonical_values(spark, sf):
    d = _decorated(spark, sf)
    return d.select("i", C.canonical_value(F.col("raw")).alias("raw"), C.canonical_value(F.col("value")).alias("value"))


def _sql_conflict(a: str, b: str) -> str:
    ca, cb = _sql_canonical(a), _sql_canonical(b)
    return f"CASE WHEN try_cast({a} AS DOUBLE) IS NOT NULL AND try_cast({b} AS DOUBLE) IS NOT NULL THEN abs(try_cast({a} AS DOUBLE) - try_cast({b} AS DOUBLE)) > 0.01e0 WHEN {ca} = {cb} THEN false WHEN try_cast({ca} AS DOUBLE) IS NOT NULL AND try_cast({cb} AS DOUBLE) IS NOT NULL THEN abs(try_cast({ca} AS DOUBLE) - try_cast({cb} AS DOUBLE)) > 0.01e0 ELSE true END"


@query(f"WITH {_DECORATED} SELECT a.i, {_sql_conflict('a.raw', 'b.raw')} AS raw_conflict, {_sql_conflict('a.amount', 'b.amount')} AS amount_conflict FROM dec a JOIN dec b ON b.i = a.i + 1")
def f04_values_conflict(spark, sf):
    d = _decorated(spark, sf)
    b = d.select((F.col("i") - 1).alias("i"), F.col("raw").alias("raw_b"), F.col("amount").alias("amount_b"))
    return d.join(b, "i").select("i", C.values_conflict(F.col("raw"), F.col("raw_b")).alias("raw_conflict"), C.values_conflict(F.col("amount"), F.col("amount_b")).alias("amount_conflict"))


def _order_claims(spark, sf):
    """Each order line states the part's price per unit: parts are the entities, orders the documents."""
    lines = R.table(spark, sf, "lineitem")
    # SQL rounds the product's binary value: Spark's round to two places takes 1.005 for a tie, though 1.005 * 100 < 100.5
    price = (F.round(F.col("l_extendedprice") / F.col("l_quantity") * 100, 0) / 100).cast("decimal(18,2)").cast("string")
    return lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"), F.col("l_orderkey").alias("doc_id"), F.concat(F.lit(" Part "), F.col("l_partkey")).alias("entity"), F.concat(F.lit("unit price_"), F.lower("l_returnflag")).alias("attribute"), price.alias("value"))


_LINES = "cl AS (SELECT l_orderkey * 10 + l_linenumber AS claim_id, l_orderkey AS doc_id, 'part ' || l_partkey AS entity_key, 'unit price_' || lower(l_returnflag) AS attribute, CAST(CAST(round(l_extendedprice / l_quantity, 2) AS DECIMAL(18,2)) AS VARCHAR) AS value FROM lineitem)"


@query(f"WITH {_LINES} SELECT a.claim_id AS claim_id_a, b.claim_id AS claim_id_b, a.entity_key, a.attribute FROM cl a JOIN cl b ON a.entity_key = b.entity_key AND a.attribute = b.attribute AND a.claim_id < b.claim_id AND a.doc_id <> b.doc_id WHERE abs(CAST(a.value AS DOUBLE) - CAST(b.value AS DOUBLE)) > 0.01e0")
def f05_contradictions(spark, sf):
    return C.contradictions(_order_claims(spark, sf)).select("claim_id_a", "claim_id_b", "entity_key", "attribute")


_FUZZY = ["ship latency", "ship-latency", "latency ship", "price"]
_EVENTS = f"ev AS (SELECT event_id AS claim_id, event_id AS doc_id, 'user ' || user_id AS entity, {_sql_pick(_FUZZY, 'event_id')} AS attribute, CAST(CAST(round(value, 0) AS BIGINT) AS VARCHAR) AS value FROM events)"


def _event_claims(spark, sf):
    e = R.table(spark, sf, "events")
    return e.select(F.col("event_id").alias("claim_id"), F.col("event_id").alias("doc_id"), F.concat(F.lit("user "), F.col("user_id")).alias("entity"), _pick(_FUZZY, F.col("event_id")).alias("attribute"), F.round("value", 0).cast("bigint").cast("string").alias("value"))


@query(f"WITH {_EVENTS}, nm AS (SELECT DISTINCT attribute, attribute AS text FROM ev), {R.sql_embedding('nm', 'attribute', 'text', 'e')}, pr AS (SELECT a.attribute, b.attribute AS other FROM e a JOIN e b ON a.bucket = b.bucket AND a.attribute < b.attribute GROUP BY ALL HAVING round(sum(a.w * b.w), 9) >= 0.95e0) SELECT a.claim_id AS claim_id_a, b.claim_id AS claim_id_b, pr.attribute, pr.other FROM ev a JOIN pr USING (attribute) JOIN ev b ON b.attribute = pr.other AND a.entity = b.entity AND a.doc_id <> b.doc_id WHERE abs(CAST(a.value AS DOUBLE) - CAST(b.value AS DOUBLE)) > 0.01e0")
def f06_fuzzy_contradictions(spark, sf):
    """conflicting values under attributes whose embeddings align."""
    return C.fuzzy_contradictions(_event_claims(spark, sf)).select("claim_id_a", "claim_id_b", "attribute", "other")


_RAWS = "rw AS (SELECT event_id AS claim_id, event_id AS doc_id, 'user ' || user_id || ' raw_text' AS label, CAST(CAST(round(value, 0) AS BIGINT) AS VARCHAR) AS value FROM events)"


@query(f"WITH {_RAWS}, nm AS (SELECT DISTINCT label, label AS text FROM rw), {R.sql_embedding('nm', 'label', 'text', 'e')}, pr AS (SELECT a.label, b.label AS other FROM e a JOIN e b ON a.bucket = b.bucket GROUP BY ALL HAVING round(sum(a.w * b.w), 9) >= 0.95e0) SELECT a.claim_id AS claim_id_a, b.claim_id AS claim_id_b FROM rw a JOIN pr USING (label) JOIN rw b ON b.label = pr.other AND a.claim_id < b.claim_id WHERE abs(CAST(a.value AS DOUBLE) - CAST(b.value AS DOUBLE)) > 0.01e0")
def f07_raw_contradictions(spark, sf):
    """raw-text claims whose labels align."""
    return C.raw_contradictions(_raw_claims(spark, sf), carry=("claim_id",))


def _raw_claims(spark, sf):
    e = R.table(spark, sf, "events")
    return e.select(F.col("event_id").alias("claim_id"), F.col("event_id").alias("doc_id"), F.concat(F.lit("user "), F.col("user_id")).alias("entity"), F.lit("raw_text").alias("attribute"), F.round("value", 0).cast("bigint").cast("string").alias("value"))


_CLASSES = "pa AS (SELECT claim_id_a AS claim_id FROM co UNION ALL SELECT claim_id_b FROM co), li AS (SELECT claim_id, count(*) AS links FROM pa GROUP BY ALL)"


_PRICES = "cl AS (SELECT l_orderkey * 10 + l_linenumber AS claim_id, l_orderkey AS doc_id, 'part ' || l_partkey AS entity_key, 'price_' || lower(l_returnflag) AS attribute, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS value FROM lineitem), nr AS (SELECT *, row_number() OVER () AS nr FROM cl)"


@query(f"WITH {_PRICES}, co AS (SELECT a.nr AS claim_id_a, b.nr AS claim_id_b FROM nr a JOIN nr b ON a.entity_key = b.entity_key AND a.attribute = b.attribute AND a.claim_id < b.claim_id AND a.doc_id <> b.doc_id WHERE abs(CAST(a.value AS DOUBLE) - CAST(b.value AS DOUBLE)) > 0.01e0), {_CLASSES} SELECT entity_key, attribute, value, min(nr.claim_id) AS class_id, count(*) AS n_claims, CAST(coalesce(sum(links), 0) AS BIGINT) AS n_links FROM nr LEFT JOIN li ON li.claim_id = nr.nr GROUP BY ALL")
def f05_contradiction_classes(spark, sf):
    """classes of equal prices with their contradictions counted, in work linear in the claims."""
    lines = R.table(spark, sf, "lineitem")
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    claims = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"), F.col("l_orderkey").alias("doc_id"), F.concat(F.lit(" Part "), F.col("l_partkey")).alias("entity"), F.concat_ws("_", F.lit("price"), F.lower("l_returnflag")).alias("attribute"), price.alias("value"))
    return conflicts.contradiction_classes(claims)


@query(f"WITH {_EVENTS}, nm AS (SELECT DISTINCT attribute, attribute AS text FROM ev), {R.sql_embedding('nm', 'attribute', 'text', 'e')}, pr AS (SELECT a.attribute, b.attribute AS other FROM e a JOIN e b ON a.bucket = b.bucket AND a.attribute < b.attribute GROUP BY ALL HAVING round(sum(a.w * b.w), 9) >= 0.95e0), co AS (SELECT a.claim_id AS claim_id_a, b.claim_id AS claim_id_b FROM ev a JOIN pr USING (attribute) JOIN ev b ON b.attribute = pr.other AND a.entity = b.entity AND a.doc_id <> b.doc_id WHERE abs(CAST(a.value AS DOUBLE) - CAST(b.value AS DOUBLE)) > 0.01e0), {_CLASSES}, si AS (SELECT attribute FROM pr UNION SELECT other FROM pr) SELECT entity AS entity_key, attribute, value, min(claim_id) AS class_id, count(*) AS n_claims, CAST(coalesce(sum(links), 0) AS BIGINT) AS n_links FROM ev JOIN si USING (attribute) LEFT JOIN li USING (claim_id) GROUP BY ALL")
def f06_fuzzy_classes(spark, sf):
    """the same between an entity's attributes whose embeddings align."""
    return conflicts.fuzzy_classes(_event_claims(spark, sf))


@query(f"WITH {_RAWS}, nm AS (SELECT DISTINCT label, label AS text FROM rw), {R.sql_embedding('nm', 'label', 'text', 'e')}, pr AS (SELECT a.label, b.label AS other FROM e a JOIN e b ON a.bucket = b.bucket GROUP BY ALL HAVING round(sum(a.w * b.w), 9) >= 0.95e0), co AS (SELECT a.claim_id AS claim_id_a, b.claim_id AS claim_id_b FROM rw a JOIN pr USING (label) JOIN rw b ON b.label = pr.other AND a.claim_id < b.claim_id WHERE abs(CAST(a.value AS DOUBLE) - CAST(b.value AS DOUBLE)) > 0.01e0), {_CLASSES} SELECT label, value, min(claim_id) AS class_id, count(*) AS n_claims, CAST(coalesce(sum(links), 0) AS BIGINT) AS n_links FROM rw LEFT JOIN li USING (claim_id) GROUP BY ALL")
def f07_raw_classes(spark, sf):
    """the same between raw-text claims whose labels align."""
    return conflicts.raw_classes(_raw_claims(spark, sf))


_PENALTY = f"{_LINES}, co AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM cl a JOIN cl b ON a.entity_key = b.entity_key AND a.attribute = b.attribute AND a.claim_id < b.claim_id AND a.doc_id <> b.doc_id WHERE abs(CAST(a.value AS DOUBLE) - CAST(b.value AS DOUBLE)) > 0.01e0), pe AS (SELECT doc_id, CAST(count(*) AS DOUBLE) AS penalty FROM (SELECT doc_a AS doc_id FROM co UNION ALL SELECT doc_b FROM co) GROUP BY ALL)"


@query(f"WITH {_PENALTY} SELECT o_custkey AS query_id, o_orderkey AS doc_id, -coalesce(penalty, 0) AS score, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(penalty, 0), o_orderkey) AS INTEGER) AS rank FROM orders LEFT JOIN pe ON pe.doc_id = o_orderkey")
def e12_consistency_rank(spark, sf):
    """Each customer's orders, those with the fewest contradicted statements first."""
    orders = R.table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_orderkey").alias("pos"))
    penalty = conflicts.penalties(_order_claims(spark, sf))
    return C.consistency_rank(orders, penalty).select("query_id", "doc_id", (F.col("score") + 0.0).alias("score"), "rank")


@query()
def f02_extract_claims(spark, sf):
    """Claims of every document, by patterns, the generic pattern, or its text as one claim."""
    return C.extract_claims(R.corpus(spark, sf))


_STATED = [("{e} reports {a} as {v}.", 0), ("{e} has a {a} of {v}.", 1), ("For {e}, {a} remains {v}.", 2), ("{e}'s {a} is {v}.", 3)]


@query("WITH s AS (SELECT p_partkey AS doc_id, p_name AS n, p_size AS v FROM part) SELECT doc_id, 'Part ' || doc_id AS entity, 'size_class' AS attribute, CAST(v AS VARCHAR) AS value FROM s")
def f01_structured_claims(spark, sf):
    """claims read back from sentences that state each part's size in four ways."""
    part = R.table(spark, sf, "part")
    said = [F.format_string(t.replace("{e}", "Part %1$s").replace("{a}", "size class").replace("{v}", "%2$s"), F.col("p_partkey").cast("string"), F.col("p_size").cast("string")) for t, _ in _STATED]
    text = F.element_at(F.array(*said), (F.col("p_partkey") % len(said) + 1).cast("int"))
    return C.structured_claims(part.select(F.col("p_partkey").alias("doc_id"), text.alias("doc"))).drop("n")


#: Pairs of documents for each outcome: what a and b say of a part's size class (or of its weight), whether the pair is
#: given as a contradiction, and what the diagnosis should find.
_DIAGNOSED = [
    ("Nothing here.", "Nothing there.", True, 0, 0, "no_structured_claims_extracted"),
    ("Nothing here.", "{e} reports size class as {v}.", True, 0, 1, "no_claims_from_doc_a"),
    ("{e} reports size class as {v}.", "Nothing there.", True, 1, 0, "no_claims_from_doc_b"),
    ("{e} reports size class as {v}.", "{e} reports unit weight as {v}.", True, 1, 1, "no_matching_attributes_between_docs"),
    ("{e} reports size class as {v}.", "{e} reports size class as {v}.", True, 1, 1, "values_did_not_conflict({v} vs {v})"),
    ("{e} reports size class as {v}.", "{e} reports size class as {w}.", False, 1, 1, "false_positive_detected"),
    ("{e} reports size class as {v}.", "{e} reports size class as {w}.", True, 1, 1, None),
    ("{e} reports size class as {v}.", "{e} reports size class as {v}.", False, 1, 1, None),
]


def _sql_said(text: str) -> str:
    for k, v in (("{e}", "Part ' || id || '"), ("{v}", "' || v || '"), ("{w}", "' || (v + 7) || '")):
        text = text.replace(k, v)
    return f"'{text}'"


_CASES = " UNION ALL ".join(
    f"SELECT id, {_sql_said(a)} AS doc_a, {_sql_said(b)} AS doc_b, {bad} AS is_contradiction, {na} AS claims_a, {nb} AS claims_b, {reason == 'false_positive_detected'} AS was_detected, {_sql_said(reason)} AS miss_reason FROM pt WHERE k = {k}"
    for k, (a, b, bad, na, nb, reason) in enumerate(_DIAGNOSED)
    if reason
)


@query(f"WITH pt AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_size AS v, p_partkey % {len(_DIAGNOSED)} AS k FROM part) SELECT id, doc_a, doc_b, is_contradiction, CAST(claims_a AS BIGINT) AS claims_a, CAST(claims_b AS BIGINT) AS claims_b, was_detected, miss_reason FROM ({_CASES})")
def f08_diagnose(spark, sf):
    """why statements on each part's size were missed, or found where none should be; one case of each kind in turn."""
    part = R.table(spark, sf, "part")
    said = lambda t: F.format_string(t.replace("{e}", "Part %1$s").replace("{v}", "%2$s").replace("{w}", "%3$s"), F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), (F.col("p_size") + 7).cast("string"))
    of = lambda i, f: F.element_at(F.array(*[f(c[i]) for c in _DIAGNOSED]), (F.col("p_partkey") % len(_DIAGNOSED) + 1).cast("int"))
    rows = part.select(F.col("p_partkey").cast("string").alias("id"), of(0, said).alias("doc_a"), of(1, said).alias("doc_b"), of(2, F.lit).alias("is_contradiction"))
    return C.diagnose(rows)


@query("WITH s AS (SELECT sum((quality = 0 AND toxic = 1)::INTEGER) AS tp, sum((quality = 1 AND toxic = 1)::INTEGER) AS fp, sum((quality = 0 AND toxic = 0)::INTEGER) AS fn, sum((quality = 1 AND toxic = 0)::INTEGER) AS tn FROM labels) SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp), 6) AS precision, round(fp / (fp + tn), 6) AS fpr, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM s")
def f09_confusion(spark, sf):
    rows = R.table(spark, sf, "labels").select((F.col("quality") == 0).alias("truth"), (F.col("toxic") == 1).alias("guess"))
    out = metrics.confusion(rows, "truth", "guess")
    return out.withColumns({c: F.round(c, 6) for c in ("recall", "precision", "fpr", "accuracy", "f1")})
