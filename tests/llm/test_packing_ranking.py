"""Packing: shards by content, scores of the whole corpus, and the walk down the ranking."""

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from rankloom.llm import common, packing
from rankloom.llm.queries import tokenizer_file


def test_related_rests_beyond_the_first_32_come_before_others():
    other = [np.asarray([10_000 + i, 10_001 + i, 0], "<u4") for i in range(200)]
    related = [np.asarray([7, 100 + i, 0], "<u4") for i in range(150)]
    seed = np.asarray([7, *range(50_000, 50_400)], "<u4")
    documents = [*other, *related, seed]
    window = [d for d, _, _, s, _ in packing.fill_windows(documents) if s == 0]
    assert window[0] == len(documents) - 1 and set(window[1:]) >= set(range(200, 350))


def test_all_shared_terms_count():
    rare = [np.asarray([t, t], "<u4") for t in range(30)]
    seed, near = np.arange(60, dtype="<u4"), np.arange(30, 60, dtype="<u4")
    decoys = [np.arange(30, 60, dtype="<u4") + 1000] * 2
    documents = [*rare, *decoys, near, near, near, seed]
    index = packing.Bm25Index(documents, packing.Statistics.of(documents))
    scores = index.scores(35)
    assert scores[32] > 0 and scores[30] == 0


def test_scores_equal_brute_force():
    rng = np.random.default_rng(2)
    documents = [np.append(rng.zipf(1.3, rng.integers(1, 200)) % 3000 + 1, 0).astype("<u4") for _ in range(150)]
    corpus = packing.Statistics.of(documents)
    n, mean = len(documents), np.mean([len(d) for d in documents])
    df = Counter(t for d in documents for t in set(d.tolist()))
    index = packing.Bm25Index(documents, corpus)
    counts = [Counter(d.tolist()) for d in documents]
    for seed in (0, 7, 149):
        got = index.scores(seed)
        for i, c in enumerate(counts):
            if i != seed:
                want = sum(np.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(documents[i]) / mean)) for t in counts[seed] if t in c)
                assert abs(got[i] - want) < 2e-3 + 1e-4 * want


def test_neighbours_meet_across_shards(spark, monkeypatch):
    """Edited copies lie far apart in the table; far more of them share a window than of random fillings."""
    monkeypatch.setattr(packing, "SHARD_DOCS", 64)
    rng = np.random.default_rng(3)
    words = [f"{a}{b}" for a in ("ba", "ki", "lo", "mu", "ne", "po", "ra", "su") for b in ("tan", "vel", "dor", "mip", "gus", "fir", "hal", "zen", "wob", "cyx")]
    words = [x + y for x in words for y in words]
    groups = 300
    texts = {}
    for g in range(groups):
        base = rng.choice(words, 100)
        for copy in range(4):
            edited = base.copy()
            edited[rng.choice(100, 5, replace=False)] = rng.choice(words, 5)
            texts[copy * groups + g] = " ".join(edited)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    windows, of = defaultdict(set), {}
    for r in packing.pack(docs, tokenizer_file()).collect():
        windows[r.sequence_id].add(r.doc_id)
        of.setdefault(r.doc_id, set()).add(r.sequence_id)
    met = np.mean([any(d != e and d % groups == e % groups for s in of[d] for e in windows[s]) for d in texts])
    size = np.mean([len(w) for w in windows.values()])
    by_chance = 3 * size / len(texts)
    print(f"share of documents with a relative in a window: {met:.2f}, by chance {by_chance:.2f}")
    assert met > 0.5 and met > 20 * by_chance


def test_ranges_split_hot_keys(spark, monkeypatch):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(5)).when(F.col("id") < 1500, F.lit(None)).otherwise(F.col("id")).cast("long").alias("k"), "id")
    for most in (common.MOST_BOUNDS, 1):
        monkeypatch.setattr(common, "MOST_BOUNDS", most)
        dealt = common.by_range(rows, "k", F.xxhash64("id"), 12).select("k", F.xxhash64("id").alias("h"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at"))
        got = [(r.k, r.h, r.p) for r in sorted(dealt.collect(), key=lambda r: r["at"])]
        assert [g[:2] for g in got] == sorted((g[:2] for g in got), key=lambda g: (-1 if g[0] is None else g[0], g[1]))
        assert max(Counter(g[2] for g in got).values()) < 700 and len({g[2] for g in got if g[0] == 5}) >= 3
