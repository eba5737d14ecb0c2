"""Quality rules whose cutoffs are chosen with a bound on false rejections.

Every rule rejects a document whose measure reaches a cutoff; the rules act together. A stratum (language) has one path
of STEPS steps, from lenient to strict: at a step each rule's cutoff is the lowest from which on it is estimated to turn
away at most that step's share of good documents; the estimate is the share of documents without a label that it turns
away, less that of documents labelled bad at their rate among labels. Unlabelled copies of a labelled good text are left
out of it, so the path depends on the labelled good documents by their number alone. On all labelled good documents of the stratum that pass the base rules, the steps are tested in order: a step is certified while the exact
binomial test rejects "the rules together turn away more than a share ALPHA of good documents" at the stratum's level.
The strictest certified step holds. Testing in this fixed order needs no correction among steps, and testing the rules
together none among rules; DELTA is divided by the number of strata. So with probability 1 - DELTA at most ALPHA of the
good documents of any stratum are turned away.

Each distinct text of a stratum is one trial, good if every label of every document with that text says so, so copies and
repeated labels don't count as independent. Strata with fewer good texts than could certify a single step at the level
that they would have are pooled into one stratum, by their numbers alone; the bound then holds for the pool. Where even
that is too small nothing is turned away beyond the base rules.

Counts are aggregated to (stratum, rule, bin) and (stratum, step) before anything is gathered; a stratum's choice gets a
fixed number of rows.

Defined cases: a null or empty text has no words and fails the base rules; a null lang is a stratum of its own;
labels that are null or for unknown documents are not used; repeated rows are judged alike; without labels only the base
rules act; an empty table gives no rows. Columns of the input named like an output are replaced by it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, join_hot, join_small, materialize, temporary, text_key

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
ALPHA = 0.02
DELTA = 0.05
BINS = 200
#: Shares of good documents that each rule is estimated to turn away at the steps of a path, at most.
STEPS = [0.0, 0.0005, 0.001, 0.002, 0.003, 0.004, 0.006, 0.008, 0.01, 0.015, 0.02, 0.03, 0.04, 0.06]
POOL = "pool"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters", "n_marks"]
SCHEMA = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))

#: Each rule's measure, from 0 (harmless) up to 1.
RULES = {
    "symbols": "n_symbols / greatest(n_words, 1)",
    "marks": "n_marks / greatest(n_words, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(n_letters, 1)",
}


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    hit = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(hit)] |= hit
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    capitals = len(raw) - len(raw.translate(None, UPPER))
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        capitals,
        capitals + len(raw) - len(raw.translate(None, LOWER)),
        text.count("!"),
    )


def measures(text: Column) -> Column:
    """A struct of MEASURES of the whole texts."""

    @F.pandas_udf(SCHEMA)
    def quality_measures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([measure(t) for t in texts], columns=MEASURES, dtype="int64")
        give_back()

    return quality_measures.asNondeterministic()(text)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def bins() -> list[Column]:
    return [F.least(F.floor(F.expr(m) * BINS), F.lit(BINS)).cast("int").alias(f"bin_{r}") for r, m in RULES.items()]


def log_binomial_cdf(k: int, n: int, p: float) -> float:
    """log P(Bin(n, p) <= k), exactly summed."""
    i = np.arange(k + 1)
    lf = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n + 1)))))
    terms = lf[n] - lf[i] - lf[n - i] + i * math.log(p) + (n - i) * math.log1p(-p)
    top = terms.max()
    return float(top + math.log(np.exp(terms - top).sum()))


def fewest(level: float, alpha: float = ALPHA) -> int:
    """The fewest trials that can certify anything: none of them rejected."""
    return math.ceil(math.log(level) / math.log1p(-alpha))


def strata_of(good: dict[str, int], alpha: float = ALPHA, delta: float = DELTA) -> dict[str, str]:
    """The stratum of each of these by their numbers of good texts: itself, or the pool."""
    alone = {s: n for s, n in good.items() if n >= fewest(delta / max(len(good), 1), alpha)}
    return {s: s if s in alone else POOL for s in good}


def path(free: dict[str, np.ndarray], bad: dict[str, np.ndarray], bad_share: float) -> dict[str, list[int]]:
    """Each rule's cutoff at each step, from counts by bin of unlabelled and of bad documents. BINS + 1: turns nothing away."""
    out = {}
    for rule in free:
        beyond, caught = (np.append(np.cumsum(n[::-1])[::-1], 0) / max(n.sum(), 1) for n in (free[rule], bad[rule]))
        loss = np.maximum.accumulate((beyond - bad_share * caught)[::-1])[::-1]  # of this cutoff or any higher one
        out[rule] = [max(int(np.argmax(loss <= share + 1e-12)), 1) for share in STEPS] if free[rule].any() else [BINS + 1] * len(STEPS)
    return out


def certified_steps(rejected: np.ndarray, n: int, level: float, alpha: float = ALPHA) -> int:
    """How many first steps are certified; rejected[i]: good texts that step i turns away, of n."""
    for i, k in enumerate(rejected.tolist()):
        if n == 0 or k >= n or log_binomial_cdf(int(k), n, alpha) > math.log(level):
            return i
    return len(rejected)


def _above(column: str) -> Callable[[Column], Column]:
    return lambda x: x > F.col(column)


def thresholds(judged: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, cut_<rule>: certified cutoffs, from judged(doc_id, stratum, text_hash, base_failed, bin_*) and
    labels(doc_id, quality)."""
    spark = judged.sparkSession
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min((F.col("quality") == 1).cast("int")).alias("good"))
    passed = judged.filter("NOT base_failed")
    each_bin = [F.min(f"bin_{r}").alias(f"bin_{r}") for r in RULES]
    said = join_hot(passed, known, "doc_id").groupBy("stratum", "text_hash").agg(F.min("good").alias("good"), F.count("*").alias("labelled"), F.sum(1 - F.col("good")).alias("bad"), *each_bin)
    said = materialize(said, "rule-labelled")
    trials = said.filter("good = 1").drop("good", "labelled", "bad")
    names = [f"cut_{r}" for r in RULES]
    schema = ", ".join(["stratum string", *(f"{n} int" for n in names)])
    good = {r[0]: r[1] for r in trials.groupBy("stratum").count().collect()}  # one row for each stratum
    merged = strata_of(good, alpha, delta)
    if not merged:
        return spark.createDataFrame([], schema)
    level = delta / len(set(merged.values()))
    groups = spark.createDataFrame(pa.table({"stratum": list(merged), "grp": list(merged.values())}))
    group = join_small(groups, judged.select("stratum").distinct(), "stratum", "inner")
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"bin_{r}").alias("bin")) for r in RULES])).alias("p")
    # copies of a text are counted before they are shuffled; a text that is a trial counts for nothing here
    texts = passed.groupBy("stratum", "text_hash").agg(F.count("*").alias("rows"), *each_bin)
    texts = texts.join(said.select("stratum", "text_hash", "good", "labelled", "bad").hint("merge"), ["stratum", "text_hash"], "left").filter("good IS NULL OR good = 0")
    free = texts.select("stratum", pairs, F.lit(None).cast("int").alias("good"), (F.col("rows") - F.coalesce("labelled", F.lit(0))).alias("n"))
    bad = texts.select("stratum", pairs, F.lit(0).alias("good"), F.coalesce("bad", F.lit(0)).alias("n"))
    others = free.unionByName(bad).filter("n > 0")
    counts = join_small(others.groupBy("stratum", "good", "p.rule", "p.bin").agg(F.sum("n").alias("n")), group, "stratum", "inner")
    counts = materialize(counts, "rule-counts")
    n_good = {s: sum(n for t, n in good.items() if merged[t] == s) for s in set(merged.values())}

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        free, bad = ({r: np.zeros(BINS + 1, np.int64) for r in RULES} for _ in range(2))
        for (rule, labelled), mine in rows.assign(labelled=rows["good"].notna()).groupby(["rule", "labelled"]):
            np.add.at((bad if labelled else free)[rule], mine["bin"].to_numpy(), mine["n"].to_numpy())
        n_bad = int(bad[next(iter(RULES))].sum())
        cuts = path(free, bad, n_bad / max(n_bad + n_good[key[0]], 1))
        return pd.DataFrame([[key[0], *(cuts[r] for r in RULES)]], columns=["grp", *names])

    paths = materialize(counts.groupBy("grp").applyInPandas(walk, ", ".join(["grp string", *(f"{n} array<int>" for n in names)])), "rule-paths")
    held = join_small(join_small(trials, group, "stratum", "inner"), paths, "grp", "inner")
    # the first step, from 0, whose cutoffs turn the text away: cutoffs fall along a path
    step = F.least(*[F.size(F.filter(f"cut_{r}", _above(f"bin_{r}"))) for r in RULES])
    steps = held.groupBy("grp", step.alias("step")).agg(F.count("*").alias("n"))

    def certify(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        first = np.zeros(len(STEPS) + 1, np.int64)
        np.add.at(first, rows["step"].to_numpy(), rows["n"].to_numpy())
        return pd.DataFrame({"grp": [key[0]], "certified": [certified_steps(np.cumsum(first)[:-1], int(first.sum()), level, alpha)]})

    chosen = steps.groupBy("grp").applyInPandas(certify, "grp string, certified int").join(paths, "grp")
    cuts = [F.when(F.col("certified") > 0, F.element_at(n, F.greatest("certified", F.lit(1)))).otherwise(F.lit(BINS + 1)).alias(n) for n in names]
    return chosen.join(group, "grp").select("stratum", *cuts)


def verdict(judged: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds kept: neither failed the base rules nor reached a certified cutoff of its stratum."""
    joined = join_small(judged, cuts, "stratum")
    hit = F.lit(False)
    for r in RULES:
        hit = hit | (F.col(f"bin_{r}") >= F.coalesce(F.col(f"cut_{r}"), F.lit(BINS + 1)))
    return joined.withColumn("kept", ~(F.col("base_failed") | hit))


def _measured(docs: DataFrame, stratum: str, carry: list[str]) -> DataFrame:
    rows = docs.select(*carry, text_key(stratum).alias("stratum"), F.xxhash64("text").alias("text_hash"), measures(F.col("text")).alias("m"))
    rows = rows.select(*carry, "stratum", "text_hash", "m.*")
    return rows.withColumn("base_failed", base_failed()).select("*", *bins())


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, the measures, base_failed and kept of every document. The measures are taken once and written."""
    judged = materialize(_measured(docs, stratum, ["doc_id"]), "rule-measures")
    with temporary(docs.sparkSession) as keep:
        cuts = keep(materialize(thresholds(judged, labels), "rule-cuts"))
    return verdict(judged, cuts).select("doc_id", *MEASURES, "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The documents that are kept, with the columns of docs. Texts are measured once to find the cutoffs and once
    more to apply them, which is cheaper than shuffling whole texts to join a verdict."""
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("__row")
    with temporary(docs.sparkSession) as keep:
        narrow = materialize(_measured(docs, stratum, ["doc_id"]).drop(*MEASURES), "rule-measures")
        cuts = keep(materialize(thresholds(narrow, labels), "rule-cuts"))
    rows = _measured(docs.select(whole, "text", F.col(stratum).alias("__stratum")), "__stratum", ["__row"])
    return verdict(rows, cuts).filter("kept").select("__row.*")
