"""Mixing, sharding, rules, classifier, language model, vector search, licences and the pipeline against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import common, language_model, licenses, mixing, quality_classifier, quality_rules, sharding, vector_search
from rankloom.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(1, "a b c d", "en", "s1"), (1, "a b c d", "en", "s1"), (2, None, None, None), (None, "x y", "en", "s1"), (3, "", "de", None), (4, "word " * 30_000, None, "s2"), (5, "same", "en", "s2"), (6, "same", "en", "s2"), (7, "Ünïcode TEXT\nLicensed under CC BY-NC 4.0.\n", "fr", "s3")]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS)


# mixing


def draws(rate, key, seed=mixing.SEED):
    total, parts = 0, max(1, math.ceil(rate / mixing.MOST_RATE))
    for i in range(parts):
        u = int(hashlib.md5((f"count:{seed}:{key}" + (f":{i + 1}" if i else "")).encode()).hexdigest()[:13], 16) / 2**52
        n, p = 0, math.exp(-rate / parts)
        c = p
        while c <= u:
            n += 1
            p *= rate / parts / n
            c += p
        total += n
    return total


def one_key(doc_id, text):
    keys = ["n" if x is None else f"v:{x}" for x in (doc_id, text)]
    return keys[0] + ":" + hashlib.md5(keys[1].encode()).hexdigest()


def test_mixing_spreads_hot_ids(spark):
    """Rows of one doc_id are drawn each for itself, and lie all over the result."""
    rows = spark.range(8000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit("s").alias("source"))
    got = mixing.mix(rows).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in got) == pytest.approx(8000, rel=0.06)
    assert len(got) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in got) < 2 * 8000 / len(got)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_beyond_the_broadcast_bound(spark, monkeypatch, how):
    """A hot key, keys on one side only, and rows without a key."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    key = lambda i: None if i % 7 == 0 else 5 if i % 3 == 0 else i % 90
    left = spark.createDataFrame([(i, key(i)) for i in range(600)], "i long, k long")
    small = spark.createDataFrame([(k, f"v{k}") for k in range(60)], "k long, v string")
    got = Counter((r.i, r.k, r.v) for r in common.join_small(left, small, "k", how).collect())
    want = [(i, key(i), None if key(i) is None or key(i) >= 60 else f"v{key(i)}") for i in range(600)]
    assert got == Counter(w for w in want if how == "left" or w[2])


def test_mixing_equals_brute_force(spark, awkward):
    rows = awkward.collect()
    size = Counter()
    for r in rows:
        size[r.source] += len((r.text or "").encode()) + 1
    weight = {s: x**0.5 for s, x in size.items()}
    want = Counter()
    for r in rows:
        rate = sum(size.values()) * weight[r.source] / sum(weight.values()) / size[r.source]
        for k in range(draws(rate, one_key(r.doc_id, r.text))):
            want[r.doc_id, r.source, k + 1] += 1
    mixed = mixing.mix(awkward)
    got = mixed.collect()
    assert Counter((r.doc_id, r.source, r.mix_copy) for r in got) == want
    assert mixed.columns == [*awkward.columns, "mix_rate", "mix_copy", "mix_position"]
    positions = [r.mix_position for r in got]
    assert positions == sorted(positions)
    assert mixing.mix(awkward.limit(0)).count() == 0


def test_large_rates_equal_brute_force(spark):
    rows = spark.createDataFrame([(i, "xyz", "s") for i in range(5)], "doc_id long, text string, source string")
    got = Counter(r.doc_id for r in mixing.mix(rows, epochs=1000.0).select("doc_id").collect())
    assert got == {i: draws(1000.0, one_key(i, "xyz")) for i in range(5)}


def test_mixing_meets_its_targets(spark):
    rows = spark.range(20_000).select("id", F.col("id").alias("doc_id"), F.lit("x" * 9).alias("text"), F.when(F.col("id") < 15_000, "big").otherwise("small").alias("source"))
    got = Counter(r.source for r in mixing.mix(rows, weights={"big": 0.25, "small": 0.75}, epochs=2.0).select("source").collect())
    assert got["big"] == pytest.approx(10_000, rel=0.05) and got["small"] == pytest.approx(30_000, rel=0.05)
    assert mixing.mix(rows, weights={"small": 1.0}).filter("source = 'big'").count() == 0
    big = mixing.mix(rows.limit(20), weights={"big": 1.0}, epochs=1500.0)
    assert big.count() == pytest.approx(20 * 1500, rel=0.05)


# sharding


def minimax(sizes, shards):
    low, high = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)

    def fits(c):
        n, room = 1, c
        for s in sizes:
            if s > room:
                n, room = n + 1, c
            room -= s
        return n <= shards

    while low < high:
        m = (low + high) // 2
        low, high = (low, m) if fits(m) else (m + 1, high)
    return low


@pytest.mark.parametrize(("n", "hot"), [(3000, 0), (3000, 5_000_000), (9, 0), (1, 0), (300, 40_000)])
def test_minimax_cuts_equal_brute_force(spark, n, hot):
    rng = np.random.default_rng(n + hot)
    keys = sorted({int(k) for k in rng.integers(0, 1 << 60, n)})
    if n == 300:
        keys = sorted({k >> 40 for k in keys})  # crowded into few ranges
    sizes = [int(x) for x in rng.lognormal(5, 1.5, len(keys)) + 1]
    if hot:
        sizes[len(sizes) // 3] = hot
    groups = spark.createDataFrame(list(zip(keys, sizes)), "k long, size long")
    capacity, cuts = sharding.minimax_cuts(groups)
    assert capacity == minimax(sizes, 16)
    shards = Counter()
    for k, s in zip(keys, sizes):
        shards[sum(k >= c for c in cuts)] += s
    assert max(shards.values()) <= capacity
    if n > 16:
        assert len(shards) == 16


def test_shard_table(spark, sf, awkward):
    for docs in (table(spark, sf, "documents"), awkward):
        rows = sharding.shard_table(docs).collect()
        assert len(rows) == docs.count()
        texts = defaultdict(list)
        for r in docs.collect():
            raw = (r.text or "").encode()
            texts[r.doc_id].append((len(raw) + 1, zlib.crc32(raw)))
        slots, shard_of = defaultdict(list), defaultdict(set)
        for r in rows:
            assert (r["size"], r.text_crc32) in texts[r.doc_id] and r.law == "bytes" and r.grown_shard is None
            slots[r.shard].append(r.slot)
            shard_of[r.text_crc32].add(r.shard)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert all(len(s) == 1 for s in shard_of.values())
    assert sharding.shard_table(awkward.limit(0)).count() == 0


# quality rules


def brute_measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            inside |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_measures(spark, sf, awkward):
    for docs in (table(spark, sf, "documents"), awkward):
        for r in docs.select("text", quality_rules.measures(F.col("text")).alias("m")).collect():
            assert tuple(r.m)[:5] == brute_measures(r.text)
    assert brute_measures("a b c a b c x") == (7, 7, 0, 0, 6)


def test_binomial_is_exact():
    for k, n, p in ((0, 10, 0.1), (3, 50, 0.02), (7, 20, 0.5)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert math.exp(quality_rules.log_binomial_cdf(k, n, p)) == pytest.approx(want)


def test_certified_steps():
    level = 0.05 / 4
    least = quality_rules.fewest(level)
    assert 0.98**least <= level < 0.98 ** (least - 1)
    assert quality_rules.certified_steps(np.asarray([0, 0]), least - 1, level) == 0
    assert quality_rules.certified_steps(np.asarray([0, 1, 1]), least, level) == 1
    assert quality_rules.certified_steps(np.asarray([0, 5, 900]), 5000, level) == 2
    assert quality_rules.certified_steps(np.asarray([0]), 0, level) == 0
    assert quality_rules.strata_of({"a": 500, "b": 20, "c": 30}) == {"a": "a", "b": "pool", "c": "pool"}


def brute_kept(docs, labels):
    """kept of each row, by plain Python over all rows."""
    bins = [r.asDict() for r in docs.select("doc_id", "text", "lang", quality_rules.measures(F.col("text")).alias("m")).select("doc_id", "text", "lang", "m.*").withColumn("base_failed", quality_rules.base_failed()).select("*", *quality_rules.bins()).collect()]
    rules, said, good = list(quality_rules.RULES), defaultdict(list), {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality is not None:
            said[r.doc_id].append(r.quality == 1)
    for r in bins:
        if not r["base_failed"] and r["doc_id"] in said:
            held = good.setdefault((r["lang"], r["text"]), [True, r])
            held[0] &= all(said[r["doc_id"]])
    trials = defaultdict(list)
    for (lang, _), (fine, r) in good.items():
        if fine:
            trials[lang].append(r)
    small = {s for s in trials if 0.98 ** len(trials[s]) > 0.05 / len(trials)}
    groups = [{s} for s in trials if s not in small] + ([small] if small else [])
    kept = {}
    for group in groups:
        passed = [r for r in bins if r["lang"] in group and not r["base_failed"]]
        free = [r for r in passed if r["doc_id"] not in said and not good.get((r["lang"], r["text"]), [False])[0]]
        bad = [r for r in passed if r["doc_id"] in said and not all(said[r["doc_id"]])]
        tried = [r for s in group for r in trials[s]]
        rate = len(bad) / (len(bad) + len(tried))

        def loss(rule, c):
            above = lambda rows: sum(x[f"bin_{rule}"] >= c for x in rows) / max(len(rows), 1)
            return above(free) - rate * above(bad)

        losses = {r: [loss(r, c) for c in range(202)] for r in rules}
        best = None
        for share in quality_rules.STEPS:
            cuts = {r: next(c for c in range(1, 202) if max(losses[r][c:]) <= share + 1e-12) for r in rules}
            lost = sum(any(x[f"bin_{r}"] >= cuts[r] for r in rules) for x in tried)
            n = len(tried)
            if sum(math.comb(n, i) * 0.02**i * 0.98 ** (n - i) for i in range(lost + 1)) > 0.05 / len(groups):
                break
            best = cuts
        for s in group:
            kept[s] = best
    return [(r["doc_id"], not r["base_failed"] and not (kept.get(r["lang"]) and any(r[f"bin_{k}"] >= kept[r["lang"]][k] for k in rules))) for r in bins]


def test_kept_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    labels = labels.unionByName(labels.filter("doc_id % 11 = 0").withColumn("quality", F.lit(0).cast(labels.schema["quality"].dataType)))
    got = quality_rules.judge(docs, labels).collect()
    assert Counter((r.doc_id, r.kept) for r in got) == Counter(brute_kept(docs, labels))
    assert any(not r.kept and not r.base_failed for r in got)


def test_false_rejections_on_unseen_labels(spark):
    """Cutoffs from half of the labels turn away few good documents of the other half."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = quality_rules.judge(docs, labels.filter("doc_id % 2 = 0")).filter("NOT base_failed")
    rows = got.join(labels.filter("doc_id % 2 = 1"), "doc_id").select("quality", "kept").collect()
    assert np.mean([not r.kept for r in rows if r.quality == 1]) <= 0.02
    assert np.mean([not r.kept for r in rows if r.quality == 0]) > 0.05


def test_rules_keep_good_documents(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(4000):
        words = list(rng.choice(vocabulary, 60))
        if i % 10 == 0:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "en" if i % 2 else None))
        if i < 2000:
            labels.append((i, 0 if i % 10 == 0 else 1))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality_rules.judge(docs, known).collect()}
    assert np.mean([got[i] for i in range(4000) if i % 10]) > 0.98
    assert not any(got[i] for i in range(0, 4000, 10))
    kept = quality_rules.keep_good(docs, known)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}


def test_rules_awkward(spark, awkward):
    labels = spark.createDataFrame([(1, None), (99, 1), (3, 1)], "doc_id long, quality int")
    rows = quality_rules.judge(awkward, labels).collect()
    assert len(rows) == awkward.count() and not any(r.kept for r in rows)
    assert [r.base_failed for r in rows if r.doc_id == 4] == [True]
    assert quality_rules.keep_good(awkward.limit(0), labels.limit(0)).count() == 0


# quality classifier


def test_classifier_on_held_out_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = quality_classifier.fit(quality_classifier.stage_features(docs), labels.filter("doc_id % 3 <> 0"))
    held = labels.filter("doc_id % 3 = 0").select("doc_id", F.col("quality").alias("truth"))
    rows = quality_classifier.score(docs, model).join(held, "doc_id").select("truth", "quality.score", "kept").collect()
    good, bad = [r.score for r in rows if r.truth], [r.score for r in rows if not r.truth]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95
    assert np.mean([r.kept for r in rows if r.truth]) > 0.95
    assert np.mean([r.kept for r in rows if not r.truth]) < 0.5


def test_classifier_awkward(spark, sf, awkward):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {(r.score, r.kept) for r in quality_classifier.judge(awkward, none).collect()} == {(0.5, True)}
    sf = "/root/testdata/sf0.01"
    model = quality_classifier.fit(quality_classifier.stage_features(table(spark, sf, "documents")), table(spark, sf, "labels"))
    assert model is not None
    rows = quality_classifier.score(awkward, model)
    assert rows.count() == awkward.count() and rows.filter("quality.score IS NULL").count() == 0
    bare = awkward.select("doc_id", "text")
    assert quality_classifier.keep_good(bare, none).columns == bare.columns
    assert quality_classifier.keep_good(awkward.limit(0), none).count() == 0


def test_rounds_equal_brute_force(spark):
    """Every round by plain Python over all documents at once: folds, pseudo-labels, calibration, cutoff and verdicts."""
    Q4 = quality_classifier
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    said = {r.doc_id: int(r.quality == 1) for r in labels.collect()}
    rows = {r.doc_id: (r.text, r.lang, r.source) for r in docs.collect()}
    found = {key: Q4.features_of(*key) for key in set(rows.values())}
    view = lambda k, keys: Q4.View.of_text([found[x][0] for x in keys], [found[x][1] for x in keys]) if k == 0 else Q4.View.of_meta([found[x][2] for x in keys])
    fold = defaultdict(list)
    for i, y in sorted(said.items()):
        fold[zlib.crc32(str(i).encode()) % 8].append((rows[i], y))
    train = [x for f in (3, 4, 5, 6, 7) for x in fold[f]]
    pool = sorted(set(rows.values()) - {rows[i] for i in said})
    share = np.mean(list(said.values()))
    taught = [{}, {}]

    def fitted():
        both = [train + list(t.items()) for t in taught]
        return [view(k, [x for x, _ in b]).fit(np.arange(len(b)), np.asarray([y for _, y in b], float)) for k, b in enumerate(both)]

    def scaled(w):
        y = np.asarray([y for _, y in fold[0]], float)
        return [Q4.logistic(view(k, [x for x, _ in fold[0]]).logits(w[k])[:, None], y) for k in (0, 1)]

    w = fitted()
    for _ in range(Q4.ROUNDS):
        scale, new = scaled(w), [{}, {}]
        for k in (0, 1):
            p = 1 / (1 + np.exp(-(view(k, pool).logits(w[k]) * scale[k][0] + scale[k][1])))
            for label, sure in ((1, p), (0, 1 - p)):
                n = max(round(Q4.PER_ROUND * (share if label else 1 - share)), 1)
                ordered = [j for j in np.argsort(-sure, kind="stable") if sure[j] >= Q4.CONFIDENT and pool[j] not in taught[1 - k]]
                new[1 - k] |= {pool[j]: label for j in ordered[:n]}
        for k in (0, 1):
            taught[k] |= new[k]
        w = fitted()
    model = Q4.Model(*w, *scaled(w), np.zeros(3))
    z = lambda keys: model.calibrated(view(0, keys).logits(w[0]), view(1, keys).logits(w[1]))
    model.joint = Q4.logistic(z([x for x, _ in fold[1]])[:, :2], np.asarray([y for _, y in fold[1]], float))
    score = lambda keys: 1 / (1 + np.exp(-np.clip(z(keys)[:, 2], -30, 30)))
    held = sorted(score([x for x, y in fold[2] if y]))
    cutoff = min(0.5, held[max(math.ceil(0.01 * len(held)) - 1, 0)])
    assert len(taught[0]) > 50 and len(taught[1]) > 50
    want = dict(zip(rows, score(list(rows.values())), strict=True))
    for r in Q4.judge(docs, labels).collect():
        assert r.score == pytest.approx(want[r.doc_id], rel=1e-4, abs=1e-6)
        assert r.kept == (want[r.doc_id] >= cutoff) or abs(want[r.doc_id] - cutoff) < 1e-6


def test_classifier_takes_any_ids(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    labels = table(spark, "/root/testdata/sf0.01", "labels").withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    rows = quality_classifier.judge(docs.unionByName(docs.filter("doc_id LIKE '%7'")), labels.unionByName(labels.filter("doc_id LIKE '%3'"))).collect()
    assert len(rows) > docs.count() and len({r.score for r in rows}) > 100


# language model


def tokens_of(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def test_language_model_base(spark, sf):
    docs = table(spark, sf, "documents").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in docs}
    counts = Counter(t for r in docs if not held[r.doc_id] for t in tokens_of(r.text))
    n, v = sum(counts.values()), len(counts)
    rows = {r.doc_id: r for r in Q.op2_lm_scoring(spark, sf).collect()}
    assert len(rows) == len(docs)
    for r in docs:
        t, got = tokens_of(r.text), rows[r.doc_id]
        assert (got.held_out, got.n_tokens, got.n_known, got.train_tokens) == (held[r.doc_id], len(t), sum(x in counts for x in t), n)
        assert got.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t))
    unseen = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_forward_recursion_equals_all_paths():
    rng = np.random.default_rng(1)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = language_model.Hmm(norm(rng.random(2), 0), norm(rng.random((2, 2)), 1), norm(rng.random((5, 2)), 0))
    texts = [[0, 3, 2], [4], [1, 1, 1, 0, 2, 3]]

    def path_sum(text):
        total = 0.0
        for code in range(2 ** len(text)):
            s = [code >> i & 1 for i in range(len(text))]
            p = model.start[s[0]] * model.emit[text[0], s[0]]
            for i in range(1, len(text)):
                p *= model.move[s[i - 1], s[i]] * model.emit[text[i], s[i]]
            total += p
        return math.log(total)

    flat, sizes = np.concatenate(texts), np.asarray([len(t) for t in texts])
    got = language_model.log_likelihoods(model, flat, np.cumsum(sizes) - sizes, sizes)
    assert got == pytest.approx([path_sum(t) for t in texts])
    before = sum(got)
    sequences = [np.asarray(t, np.uint16) for t in texts]
    start, moves, emitted = language_model.expected_counts(model, sequences)
    assert start.sum() == pytest.approx(3, rel=1e-4) and moves.sum() == pytest.approx(7, rel=1e-4) and emitted.sum() == pytest.approx(10, rel=1e-4)
    better = language_model.Hmm(start / start.sum(), norm(moves, 1), norm(emitted, 0))
    assert sum(language_model.log_likelihoods(better, flat, np.cumsum(sizes) - sizes, sizes)) > before


def plain_counts(model, texts):
    """Forward-backward by its textbook recursions, unscaled, one text at a time."""
    k = len(model.start)
    start, moves, emitted = np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emit)
    for text in texts:
        alpha = [model.start * model.emit[text[0]]]
        for x in text[1:]:
            alpha.append((alpha[-1] @ model.move) * model.emit[x])
        beta = [np.ones(k)]
        for x in reversed(text[1:]):
            beta.append(model.move @ (model.emit[x] * beta[-1]))
        beta, p = beta[::-1], alpha[-1].sum()
        start += alpha[0] * beta[0] / p
        for t, x in enumerate(text):
            emitted[x] += alpha[t] * beta[t] / p
            if t:
                moves += alpha[t - 1][:, None] * model.move * (model.emit[x] * beta[t])[None] / p
    return start, moves, emitted


@pytest.mark.parametrize("stretch", [10**6, 7, 1])
def test_expected_counts_equal_brute_force(stretch):
    rng = np.random.default_rng(4)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    model = language_model.Hmm(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((6, 3)), 0))
    texts = [rng.integers(0, 6, n).astype(np.uint16) for n in (1, 40, 3, 3, 17)]
    for got, want in zip(language_model.expected_counts(model, texts, stretch), plain_counts(model, texts)):
        assert got == pytest.approx(want, rel=1e-3, abs=1e-4)


def test_score_end_to_end(spark):
    """score of every text by plain Python: counts, classes, all rounds of Baum-Welch and the forward recursion."""
    rng = np.random.default_rng(9)
    words = [f"{a}{b}" for a in ("run", "sit", "go", "think", "wander") for b in ("", "s", "ing", "ed")]
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 30))) or None) for i in range(40)] + [(40, "zebra Run RUNS"), (None, "go go")]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    tokens = {i: [*(t or "").lower().encode().split(), b""] for i, t in docs}
    counts = Counter(x for i, ts in tokens.items() if not held[i] for x in ts)
    n, v = sum(counts.values()), len(counts)
    of = language_model.class_of
    size, kinds = np.zeros(language_model.CLASSES), np.zeros(language_model.CLASSES)
    for w, c in counts.items():
        size[of(w)] += c
        kinds[of(w)] += 1
    once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
    d = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
    model = language_model.Hmm.first(size / n)
    train = [[of(w) for w in tokens[i]] for i in tokens if not held[i]]
    for _ in range(language_model.ROUNDS):
        model = language_model.Hmm.of_counts(*plain_counts(model, train), size / n)
    unknown = (model.emit * (d * kinds / np.maximum(size, 1))[:, None]).sum(0)
    rows = {r.doc_id: r for r in language_model.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, ts in tokens.items():
        a, p = model.start, 0.0
        for t, w in enumerate(ts):
            e = model.emit[of(w)] * (counts[w] - d) / size[of(w)] if w in counts else unknown
            a = (a if t == 0 else a @ model.move) * e
            p, a = p + math.log10(a.sum()), a / a.sum()
        assert rows[i].score == pytest.approx(p, rel=1e-4) and rows[i].n_known == sum(w in counts for w in ts)


def test_model_is_a_distribution(spark):
    docs = spark.createDataFrame([(i, "a b a c d e f g") for i in range(30)] + [(100 + i, w) for i, w in enumerate(["a", "b", "c", "d", "e", "f", "g", "zzz"])], "doc_id long, text string")
    rows = {r.doc_id: r for r in language_model.score(docs).collect()}
    first = [10 ** rows[100 + i].score for i in range(8)]
    assert sum(first) < 1


def test_language_model_awkward(spark, awkward):
    rows = language_model.score(awkward).collect()
    assert len(rows) == awkward.count() and all(r.n_tokens >= 1 and math.isfinite(r.score) for r in rows)
    assert language_model.score(awkward.limit(0)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    only = language_model.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (only.train_tokens, only.n_known) == (0, 0) and only.base_score == 0 and abs(only.score) < 1e-12


# vector search


def test_vector_search_awkward(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(300)]
    rows += [(1000, None), (1050, [1.0, None] + [0.0] * 6), (1100, [float("nan")] + [0.0] * 7), (1150, [float("inf")] + [0.0] * 7), (None, [0.0] * 8)]
    rows += [(2000 + i, [0.5, -0.5]) for i in range(3)] + [(2050, [1.0, 1.0])] + [(301, rows[7][1])] * 2 + [(302, [1e6] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0))
    rows += [(400, [1e18] + [0.0] * 7), (401, [-3e38] * 8), (402, [8e6] + [0.0] * 7), (450, [3e15, -2e15] + [0.0] * 6), (403, [5.0, 7.0] + [1e17] * 2 + [0.0] * 4), (404, [1e16] * 4 + [-1e16] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0))
    vectors = {}
    for i, e in rows:
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            vectors[i] = [math.floor(256 * float(np.float32(x))) for x in e]
    want = set()
    for q, a in vectors.items():
        if q % 50 == 0:
            held = lambda s: min(max(s, -(2**63)), 2**63 - 1)
            scored = sorted((-held(sum(x * y for x, y in zip(a, b))), i) for i, b in vectors.items() if i != q and len(a) == len(b))
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])}
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in vector_search.top_k(df, "id % 50 = 0").collect()}
    assert got == want
    assert vector_search.top_k(df.limit(0), "id % 50 = 0").count() == 0


# licences


def wrapped(text, mark="# ", width=60):
    import textwrap

    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def test_license_inheritance(spark):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]
    full = f"MIT License\n\nCopyright (c) 2020 Some One\n\n{wrapped(mit[4], '', 76)}\n"
    apache, code = licenses.TEMPLATES["Apache-2.0"][3], "\n\ndef f(x):\n    return x + 1\n" * 20
    files = [
        ("LICENSE", full), ("src/a.py", "code " * 50), ("src/b.py", f"# {gpl[0]}\n" + "code " * 50), ("lib/COPYING.txt", f"{gpl[0]}\n" + "more words here " * 40),
        ("lib/deep/er/c.py", "other"), ("lib/deep/notes", full), ("lib/deep/x/d.py", None), ("library/e.py", ""), (None, "text"), (None, mit[0]), ("src/a.py", "code " * 50),
        ("src/page", mit[0]), ("src/g.py", "x"), ("vendor/h.c", "/*\n" + wrapped(apache, " * ") + "\n */" + code), ("vendor/i.c", code),
        ("vendor/j.py", wrapped(gpl[1]) + code), ("vendor/k.py", "# SPDX-License-Identifier: ISC" + code), ("vendor/l/LICENSE.md", wrapped(licenses.TEMPLATES["BSD-3-Clause"][3], "", 70)), ("vendor/l/m.c", code),
    ]
    rows = licenses.scan(spark.createDataFrame(files, "path string, text string").withColumns({"found": F.lit(1), "declared": F.lit(2), "inherited": F.lit(3), "kind": F.lit(4)})).collect()
    got = sorted(((r.path or "", r.license, r.found) for r in rows), key=str)
    want = [
        ("LICENSE", "MIT", "declared"), ("src/a.py", "MIT", "inherited"), ("src/a.py", "MIT", "inherited"), ("src/b.py", "GPL-3.0", "declared"), ("lib/COPYING.txt", "GPL-3.0", "declared"),
        ("lib/deep/er/c.py", "MIT", "inherited"), ("lib/deep/notes", "MIT", "declared"), ("lib/deep/x/d.py", "MIT", "inherited"), ("library/e.py", "MIT", "inherited"), ("", None, None), ("", "MIT", "declared"),
        ("src/page", "MIT", "declared"), ("src/g.py", "MIT", "inherited"), ("vendor/h.c", "Apache-2.0", "declared"), ("vendor/i.c", "MIT", "inherited"),
        ("vendor/j.py", "GPL-3.0", "declared"), ("vendor/k.py", "ISC", "declared"), ("vendor/l/LICENSE.md", "BSD-3-Clause", "declared"), ("vendor/l/m.c", "BSD-3-Clause", "inherited"),
    ]
    assert got == sorted(want, key=str)
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).count() == 0
    assert licenses.scan(spark.createDataFrame(files, "path string, text string"), {}).filter("license IS NOT NULL").count() == 0


def test_a_notice_in_a_page_is_not_inherited(spark):
    """Only a file that says so by its name, or holds little but a licence, gives its directory one."""
    rows = [("d/page.txt", licenses.TEMPLATES["MIT"][0]), ("d/other.txt", "some words"), ("d/e/LICENSE", licenses.TEMPLATES["MIT"][0]), ("d/e/f/g.txt", "words")]
    got = {r.path: r.found for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"d/page.txt": "declared", "d/other.txt": None, "d/e/LICENSE": "declared", "d/e/f/g.txt": "inherited"}


# pipeline


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = table(spark, sf, "documents")
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, sf)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        docs.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= before
        if name != "packing":
            assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] > 0
    run = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, docs.select(run.columns).collect()))


def test_pipeline_equals_plain_steps(spark, sf):
    """The chain's survivors by plain Python, given the classifier's scores and the rules' verdicts."""
    import corpus_pipeline
    from test_similar import brute

    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    kept = {r.doc_id for r in quality_classifier.judge(docs, labels).filter("kept").collect()}
    rest = docs.filter(F.col("doc_id").isin(sorted(kept)))
    kept = {r.doc_id for r in quality_rules.judge(rest, labels).filter("kept").collect()}
    texts = {r.doc_id: r.text for r in rest.collect() if r.doc_id in kept}
    ids = sorted(texts)
    first = {ids[k] for k in brute([texts[i] for i in ids])}
    stages = dict(corpus_pipeline.STAGES)
    out = docs
    for name in ("quality_classifier", "quality_rules", "simhash_near_dedup"):
        out = stages[name](spark, out, sf)
    assert {r.doc_id for r in out.collect()} == first


def test_pipeline_awkward(spark, tmp_path):
    """Nulls, empty texts, repeated rows, clashing names and ids through all five stages; empty tables."""
    import corpus_pipeline

    long = [" ".join(f"w{(i * k) % 997}" for i in range(120)) for k in (1, 2, 3)]
    rows = [(1, long[0], "en", "s1"), (1, long[0], "en", "s1"), (1, long[1], "en", "s1"), (None, long[2], None, None), (None, long[2], None, None), (2, None, "en", "s1"), (3, "", None, "s1"), (4, "short text", "en", None)]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, lang string, source string, kept long, stratum long, label string")
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        columns = out.columns
        out = stage(spark, out, str(tmp_path))
        if name == "simhash_near_dedup":
            assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, long[0]), (1, long[1]), (None, long[2])], key=str)
        if name != "packing":
            assert out.columns == columns
    assert out.count() > 0
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_classifier_counts_every_word():
    ids, counts = quality_classifier.text_features([b"again"] * 70_000 + [b"once"])
    assert dict(zip(counts.tolist(), ids.tolist())).keys() == {70_000, 1}
    view = quality_classifier.View.of_text([ids.tobytes()] * 2, [counts.tobytes()] * 2)
    assert view.values.size == 2 * ids.size and view.values.max() == pytest.approx(math.log1p(70_000) / math.sqrt(sum(math.log1p(c) ** 2 for c in counts.tolist())))


def test_license_filters_lose_nothing(spark):
    """Whatever the filters let pass, cosines from the threshold on are those of plain Python over all parts."""
    rng = np.random.default_rng(3)
    pool = [t for variants in licenses.TEMPLATES.values() for t in variants if len(t) < 400]
    rows = []
    for i in range(120):
        text = pool[rng.integers(len(pool))].split()
        text = [w for w in text if rng.random() > 0.15] + ["mit", "wort", *(f"w{j}" for j in range(rng.integers(8)))]
        rng.shuffle(text)
        rows.append((f"d/{i}.txt", "mit\n\n" + " ".join(text) + "\n\nnur mit dir " * int(rng.integers(3))))
    df = spark.createDataFrame(rows, "path string, text string")
    n, df_of = licenses.document_frequencies(df, licenses.TEMPLATES)
    weights = licenses.Weights(n, df_of, licenses.TEMPLATES)
    want = {}
    for path, text in rows:
        best = (0.0, None)
        parts = [(p, 0.8) for p in text.split("\n")] + [(p, 0.8) for p in re.split(licenses.GAP, text) if "\n" in p] + [(text, 0.9)]
        for part, least in parts:
            w = {x: c * weights.idf.get(x, weights.other) for x, c in Counter(licenses.words(part)).items()}
            norm = math.sqrt(sum(v * v for v in w.values()))
            for (name, _), t in weights.templates.items():
                cosine = round(sum(v * t.get(x, 0.0) for x, v in w.items()) / norm, 9) if norm else 0.0
                if cosine >= least and (-cosine, name) < (-best[0], best[1] or "~"):
                    best = (cosine, name)
        want[path] = best[0]
    got = {r.path: r.cosine or 0.0 for r in licenses.scan(df).collect()}
    assert got == pytest.approx(want) and 10 < sum(c > 0 for c in want.values()) < 120


def test_classifier_drops_encoders_that_a_packing_left(spark, sf):
    def left(batches):
        import pyarrow as pa

        from rankloom.llm import encode

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(encode._ENCODERS)] * batch.num_rows})

    def fill(batches):
        from rankloom.llm import encode

        encode._ENCODERS["left over"] = None
        yield from batches

    docs = table(spark, sf, "documents").select("text", "lang", "source").coalesce(1)
    docs.mapInArrow(fill, docs.schema).count()
    docs.select(quality_classifier.features(*map(F.col, docs.columns)).alias("f")).agg(F.count("f.text_ids")).collect()
    assert docs.select("text").mapInArrow(left, "n long").agg(F.max("n")).first()[0] == 0
