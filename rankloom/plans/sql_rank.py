"""SQL of the ranking operators, as common table expressions over a named relation (query_id, query, doc_id, doc, pos)."""

from __future__ import annotations

from ..operators.features import PROFILES, STATIC_WEIGHTS
from .relations import BM25_TERM, sql_bucket, sql_embedding, sql_sign, sql_tokens, sql_words


def bm25_local(rel: str, out: str, tokens=sql_tokens) -> str:
    """<out>: rel with bm25 and bm25_norm, frequencies over each query's own documents."""
    p = f"{out}_"
    return f"""
{p}t AS (SELECT query_id, doc_id, unnest({tokens("doc")}) AS token FROM {rel}),
{p}tf AS (SELECT query_id, doc_id, token, count(*) AS f FROM {p}t GROUP BY ALL),
{p}dl AS (SELECT query_id, doc_id, len({tokens("doc")}) AS dl FROM {rel}),
{p}st AS (SELECT query_id, count(*) AS n, greatest(avg(dl), 1e0) AS avgdl FROM {p}dl GROUP BY ALL),
{p}df AS (SELECT query_id, token, count(*) AS df FROM {p}tf GROUP BY ALL),
{p}qt AS (SELECT query_id, unnest({tokens("query")}) AS token FROM (SELECT DISTINCT query_id, query FROM {rel})),
{p}qf AS (SELECT query_id, token, count(*) AS qf FROM {p}qt GROUP BY ALL),
{p}s AS (SELECT query_id, doc_id, sum({BM25_TERM}) AS bm25 FROM {p}qf JOIN {p}tf USING (query_id, token) JOIN {p}df USING (query_id, token) JOIN {p}dl USING (query_id, doc_id) JOIN {p}st USING (query_id) GROUP BY ALL),
{p}z AS (SELECT r.*, coalesce(s.bm25, 0) AS bm25 FROM {rel} r LEFT JOIN {p}s s USING (query_id, doc_id)),
{out} AS (SELECT *, CASE WHEN max(bm25) OVER (PARTITION BY query_id) > 0 THEN greatest(bm25, 0) / max(bm25) OVER (PARTITION BY query_id) ELSE 0 END AS bm25_norm FROM {p}z)"""


def ranked(src: str, out: str, score: str = "score", descending: bool = True) -> str:
    return f"""
{out} AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 6) {"DESC" if descending else "ASC"}, pos) AS INTEGER) AS rank FROM {src})"""


def semantic(rel: str, out: str) -> str:
    p = f"{out}_"
    return f"""{sql_embedding(rel, "query_id", "query", p + "eq")}, {sql_embedding(rel, "doc_id", "doc", p + "ed")},
{p}dot AS (SELECT r.query_id, r.doc_id, sum(a.w * b.w) AS s FROM {rel} r JOIN {p}eq a ON a.query_id = r.query_id JOIN {p}ed b ON b.doc_id = r.doc_id AND b.bucket = a.bucket GROUP BY ALL),
{out} AS (SELECT r.*, coalesce(s, 0) AS sem_score,
  sqrt(greatest(0, CASE WHEN r.query_id IN (SELECT query_id FROM {p}eq) THEN 1 ELSE 0 END + CASE WHEN r.doc_id IN (SELECT doc_id FROM {p}ed) THEN 1 ELSE 0 END - 2 * coalesce(s, 0))) AS vec_norm_diff
  FROM {rel} r LEFT JOIN {p}dot USING (query_id, doc_id))"""


def features(rel: str, out: str) -> str:
    p = f"{out}_"
    words = sql_words("query")
    return f"""{bm25_local(rel, p + "b")}, {semantic(p + "b", p + "m")},
{p}k AS (SELECT *, {sql_tokens("query")} AS qtok, {sql_tokens("doc")} AS dtok FROM {p}m),
{p}h AS (SELECT *, list_intersect(qtok, dtok) AS shared FROM {p}k),
{out} AS (SELECT query_id, query, doc_id, doc, pos, sem_score, vec_norm_diff, bm25_norm AS bm25_score,
  CAST(len(shared) AS DOUBLE) / greatest(len(list_distinct(list_concat(qtok, dtok))), 1) AS token_overlap_ratio,
  CAST(len(shared) AS DOUBLE) / greatest(len(list_distinct(qtok)), 1) AS query_coverage_ratio,
  CAST(coalesce(list_sum([length(x) FOR x IN shared]), 0) AS DOUBLE) AS shared_token_char_sum,
  CAST(contains(lower(doc), lower(query)) AS DOUBLE) AS exact_phrase_match,
  CAST(len(qtok) AS DOUBLE) AS query_len, CAST(len(dtok) AS DOUBLE) AS doc_len,
  CAST(len([x FOR x IN {words} IF contains(lower(doc), x)]) AS DOUBLE) / greatest(len({words}), 1) AS keyword_hit_rate
  FROM {p}h)"""


def blend(weights: dict[str, float | str] = STATIC_WEIGHTS) -> str:
    words = f"greatest(len({sql_words('replace(query, chr(95), chr(32))')}), 1)"
    term = lambda n: f"shared_token_char_sum / {words}" if n == "shared_token_char_sum" else n
    number = lambda w: w if isinstance(w, str) else f"{w}e0"
    return " + ".join(f"{number(weights[n])} * {term(n)}" for n in STATIC_WEIGHTS)


def profile_blend(category: str) -> str:
    a, b, c = (PROFILES[n] for n in PROFILES)
    return blend({f: f"(CASE {category} WHEN 0 THEN {a[f]}e0 WHEN 1 THEN {b[f]}e0 ELSE {c[f]}e0 END)" for f in STATIC_WEIGHTS})


def binary(rel: str, out: str, top: int = 50) -> str:
    p = f"{out}_"
    return f"""{semantic(rel, p + "s")},
{p}bq AS (SELECT query_id, list(bucket) AS bits FROM {p}s_eq WHERE w > 0 GROUP BY ALL),
{p}bd AS (SELECT doc_id, list(bucket) AS dbits FROM {p}s_ed WHERE w > 0 GROUP BY ALL),
{p}h AS (SELECT s.*, len(coalesce(bits, [])) + len(coalesce(dbits, [])) - 2 * len(list_intersect(coalesce(bits, []), coalesce(dbits, []))) AS hamming FROM {p}s s LEFT JOIN {p}bq USING (query_id) LEFT JOIN {p}bd USING (doc_id)),
{p}n AS (SELECT *, 1 - CAST(hamming AS DOUBLE) / greatest(max(hamming) OVER (PARTITION BY query_id), 1) AS near FROM {p}h),
{p}o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(near, 6) DESC, pos DESC) AS n FROM {p}n),
{out} AS (SELECT query_id, query, doc_id, doc, pos, hamming, CASE WHEN n <= {top} THEN sem_score ELSE near END AS score FROM {p}o)"""


def token_index(rel: str, out: str, top: int = 128, order: str = "round(salience, 6) DESC, place DESC") -> str:
    p = f"{out}_"
    return f"""
{p}l AS (SELECT doc_id, {sql_tokens("doc")} AS toks FROM (SELECT DISTINCT doc_id, doc FROM {rel})),
{p}t AS (SELECT doc_id, unnest(toks) AS token, CAST(unnest(range(len(toks))) AS INTEGER) AS place FROM {p}l),
{p}f AS (SELECT *, count(*) OVER (PARTITION BY doc_id, token) AS tf, count(*) OVER (PARTITION BY doc_id) AS n FROM {p}t),
{p}s AS (SELECT *, tf * ln(1 + n / (tf + 1e0)) AS salience FROM {p}f),
{p}k AS (SELECT doc_id, token, place, salience FROM {p}s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {order}) <= {top}),
{p}v AS (SELECT token, {sql_bucket("token")} AS bucket, {sql_sign("token")} AS sign FROM (SELECT DISTINCT token FROM {p}k)),
{out} AS (SELECT * FROM {p}k JOIN {p}v USING (token))"""


def query_tokens(rel: str, out: str) -> str:
    return f"""
{out}_t AS (SELECT query_id, unnest({sql_tokens("query")}) AS token FROM (SELECT DISTINCT query_id, query FROM {rel})),
{out} AS (SELECT query_id, {sql_bucket("token")} AS bucket, {sql_sign("token")} AS sign, count(*) AS qf FROM {out}_t GROUP BY ALL)"""


def late(rel: str, out: str) -> str:
    """MaxSim by the general definition on signed one-hot vectors: the greatest product over all kept tokens."""
    p = f"{out}_"
    return f"""{token_index(rel, p + "i")}, {query_tokens(rel, p + "q")},
{p}d AS (SELECT doc_id, bucket, sign, count(*) AS c FROM {p}i GROUP BY ALL),
{p}x AS (SELECT r.query_id, r.doc_id, q.bucket, q.sign, q.qf, max(CASE WHEN d.bucket = q.bucket THEN q.sign * d.sign ELSE 0 END) AS best FROM {rel} r JOIN {p}q q USING (query_id) JOIN {p}d d ON d.doc_id = r.doc_id GROUP BY ALL),
{p}y AS (SELECT query_id, doc_id, CAST(sum(qf * best) AS DOUBLE) AS score FROM {p}x GROUP BY ALL),
{out} AS (SELECT r.*, coalesce(score, 0) AS score FROM {rel} r LEFT JOIN {p}y USING (query_id, doc_id))"""


def _terms(rel: str, key: str, text: str, out: str) -> str:
    return f"""{out}_t AS (SELECT {key}, unnest({sql_tokens(text)}) AS term FROM (SELECT DISTINCT {key}, {text} FROM {rel})),
{out}_w AS (SELECT {key}, term, ln(1 + count(*)) AS w FROM {out}_t GROUP BY ALL),
{out} AS (SELECT * FROM {out}_w QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY round(w, 6) DESC, term) <= 128)"""


def sparse(rel: str, out: str) -> str:
    p = f"{out}_"
    return f"""{_terms(rel, "query_id", "query", p + "q")}, {_terms(rel, "doc_id", "doc", p + "d")},
{p}s AS (SELECT r.query_id, r.doc_id, sum(least(a.w, b.w)) AS score FROM {rel} r JOIN {p}q a ON a.query_id = r.query_id JOIN {p}d b ON b.doc_id = r.doc_id AND b.term = a.term GROUP BY ALL),
{out} AS (SELECT r.*, coalesce(score, 0) AS score FROM {rel} r LEFT JOIN {p}s USING (query_id, doc_id))"""


def merge_sort(pairs: str, rel: str, out: str, levels: int = 6) -> str:
    """<out>: query_id, doc_id, pos and score of a merge-sort tournament over pairs(query_id, a, b, p) of up to
    2 ** levels documents. Each level is a recursive merge of two runs; every step is one comparison."""
    p = f"{out}_"
    parts = [
        f"{p}c AS (SELECT query_id, a, b, p FROM {pairs} UNION ALL SELECT query_id, b, a, 1 - p FROM {pairs})",
        f"{p}l AS (SELECT query_id, list(doc_id ORDER BY pos) AS docs, count(*) AS n FROM {rel} GROUP BY ALL)",
        f"{p}g0 AS (SELECT query_id, CAST(0 AS BIGINT) AS lo, CAST(n AS BIGINT) AS hi FROM {p}l)",
    ]
    for k in range(levels):
        parts.append(f"{p}g{k + 1} AS (SELECT query_id, lo, (lo + hi) // 2 AS hi FROM {p}g{k} WHERE hi - lo > 1 UNION ALL SELECT query_id, (lo + hi) // 2, hi FROM {p}g{k} WHERE hi - lo > 1)")
    parts.append(f"{p}m{levels} AS (SELECT g.query_id, lo, hi, [docs[lo + 1]] AS run FROM {p}g{levels} g JOIN {p}l USING (query_id))")
    for k in range(levels - 1, -1, -1):
        step = f"SELECT s.query_id, lo, hi, CASE WHEN c.p >= 0.5e0 THEN x[2:] ELSE x END, CASE WHEN c.p >= 0.5e0 THEN y ELSE y[2:] END, list_append(run, CASE WHEN c.p >= 0.5e0 THEN x[1] ELSE y[1] END), x[1], y[1], c.p FROM {p}w{k} s JOIN {p}c c ON c.query_id = s.query_id AND c.a = x[1] AND c.b = y[1] WHERE len(x) > 0 AND len(y) > 0"
        start = f"SELECT g.query_id, g.lo, g.hi, a.run AS x, b.run AS y, CAST([] AS BIGINT[]) AS run, CAST(NULL AS BIGINT) AS first, CAST(NULL AS BIGINT) AS second, CAST(NULL AS DOUBLE) AS p FROM {p}g{k} g JOIN {p}m{k + 1} a ON a.query_id = g.query_id AND a.lo = g.lo JOIN {p}m{k + 1} b ON b.query_id = g.query_id AND b.hi = g.hi AND b.lo = a.hi WHERE g.hi - g.lo > 1"
        parts.append(f"{p}w{k} AS ({start} UNION ALL {step})")
        parts.append(f"{p}m{k} AS (SELECT query_id, lo, hi, run || x || y AS run FROM {p}w{k} WHERE len(x) = 0 OR len(y) = 0 UNION ALL SELECT g.query_id, lo, hi, [docs[lo + 1]] FROM {p}g{k} g JOIN {p}l USING (query_id) WHERE hi - lo = 1)")
    won = " UNION ALL ".join(f"SELECT query_id, first AS doc_id, p AS credit FROM {p}w{k} WHERE p IS NOT NULL UNION ALL SELECT query_id, second, 1 - p FROM {p}w{k} WHERE p IS NOT NULL" for k in range(levels))
    parts.append(f"{p}t AS (SELECT query_id, doc_id, sum(credit) AS credit FROM ({won}) GROUP BY ALL)")
    parts.append(f"{p}o AS (SELECT query_id, unnest(run) AS doc_id, len(run) - unnest(range(len(run))) AS bonus FROM {p}m0)")
    parts.append(f"{out} AS (SELECT r.query_id, r.doc_id, r.pos, bonus + coalesce(credit, 0) AS score FROM {rel} r JOIN {p}o USING (query_id, doc_id) LEFT JOIN {p}t USING (query_id, doc_id))")
    return ", ".join(parts)
