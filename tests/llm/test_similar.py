"""The pipeline's near-duplicates against all pairs of shingle sets."""

from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from rankloom.llm import common, similar
from rankloom.llm.simhash import distances


def grams(text, n=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(texts):
    sets, parent = [grams(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def edited():
    rng = np.random.default_rng(5)
    texts = ["", None, " ", "a b", "A  b", "a b c"]
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 4, 5, 7, 9, 14):
            words = list(base)
            for at in rng.choice(200, edits, replace=False):
                words[at] = f"n{rng.integers(0, 5000)}"
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("tile", [similar.TILE, 4])
def test_components_equal_all_pairs(spark, edited, tile):
    docs = spark.createDataFrame(list(enumerate(edited)), "doc_id long, text string")
    groups = defaultdict(set)
    for r in similar.near_duplicates(docs, tile=tile).collect():
        groups[r.root].add(r.doc_id)
    want = defaultdict(set)
    for i, k in enumerate(brute(edited)):
        want[k].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_pipeline_stage_drops_pairs_at_least_0_8(spark, sf, edited):
    docs = spark.createDataFrame(list(enumerate(edited)), "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute(edited)))
    assert similar.drop_near_duplicates(docs.limit(0)).collect() == []


def test_no_text_is_lost_whatever_the_ids(spark, edited, monkeypatch):
    """Clashing, repeated and null ids; hot rows go through the broadcast."""
    one, other = edited[6], edited[15]
    rows = [(5, one), (5, one), (5, other), (9, other), (None, "null id " * 30), (None, "null id " * 30), (None, one), (7, "x y z " * 20), (7, "p q r " * 20)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, key long, root long")
    want = sorted([(5, one), (5, other), (None, "null id " * 30), (7, "x y z " * 20), (7, "p q r " * 20)], key=str)
    for hot in (common.HOT_ROWS, 1):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        kept = similar.drop_near_duplicates(docs)
        assert kept.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == want


def test_wide_fingerprints_find_pairs_and_little_else():
    rng = np.random.default_rng(1)
    near, far = [], []
    for _ in range(300):
        a = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
        b = np.concatenate([a[:80], rng.integers(0, 1 << 63, 10, dtype=np.uint64)])  # similarity 0.8
        c = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
        x, y, z = (np.frombuffer(similar.wide_fingerprint(h), "<u8")[None] for h in (a, b, c))
        near.append(int(distances(x, y)[0, 0]))
        far.append(int(distances(x, z)[0, 0]))
    assert max(near) <= similar.radius_for(0.8) < min(far)
