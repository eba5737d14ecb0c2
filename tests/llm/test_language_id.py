"""The byte network: gradients against differences, held-out accuracy, and defined cases."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from rankloom.llm import language_id
from rankloom.llm import queries as Q

DOCS = "doc_id long, text string, lang string, score double"
WORDS = {"en": "the of and that with from they this have".split(), "de": "der und nicht schon für über auch ich wenn".split(), "fr": "le est pour dans être avec plus français où".split()}


def corpus(n=240, seed=3):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        out.append((i, " ".join(r.choice(WORDS[lang], 30)), lang, 1.0))
    return out


def test_gradients_equal_differences():
    net = language_id.Network.new(3, hidden=4)
    for name in ("inputs", "states", "outputs", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    r = np.random.default_rng(1)
    x, y = r.integers(0, 12, (7, 5)), r.integers(0, 3, 5)
    x[:, 0] = 0
    found, _ = net.gradients(x, y)
    for w, g in zip(net.weights, found, strict=True):
        flat = w.reshape(-1)
        for k in r.integers(0, flat.size, 12):
            old, loss = flat[k], []
            for d in (1e-4, -1e-4):
                flat[k] = old + d
                loss.append(net.gradients(x, y)[1])
            flat[k] = old
            assert (loss[0] - loss[1]) / 2e-4 == pytest.approx(g.reshape(-1)[k], abs=2e-5)


def test_steps_equal_one_window_at_a_time():
    """Both directions of many windows side by side equal a plain recursion over one."""
    net = language_id.Network.new(2, hidden=3)
    x = np.random.default_rng(2).integers(0, 20, (9, 4))
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for k in range(4):
        states = []
        for direction, order in ((0, range(9)), (1, range(8, -1, -1))):
            h, seen = np.zeros(3), {}
            for t in order:
                g, u = net.inputs[direction][x[t, k]].astype(float), h @ net.states[direction]
                update, reset = sigmoid(g[:3] + u[:3]), sigmoid(g[3:6] + u[3:6])
                h = (1 - update) * np.tanh(g[6:] + reset * u[6:]) + update * h
                seen[t] = h @ net.outputs[direction]
            states.append(seen)
        for t in range(9):
            z = states[0][t] + states[1][t] + net.bias
            assert net.probabilities(x)[t, k] == pytest.approx(np.exp(z) / np.exp(z).sum(), abs=1e-5)


def test_held_out_accuracy_and_no_other_input(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    for i, _, lang, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1
    held = [i for i in got if got[i].held_out]
    assert np.mean([got[i].lang_pred == rows[i][2] for i in held]) >= 0.95
    # languages of held-out documents are not read, neither are ids when predicting
    blind = spark.createDataFrame([(i, t, "xx" if got[i].held_out else g, s) for i, t, g, s in rows], DOCS)
    assert {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(blind).collect()} == {i: (r.lang_pred, r.score) for i, r in got.items()}
    model = language_id.fit(docs)
    other = language_id.predict(spark.createDataFrame([(7, rows[5][1])], "doc_id long, text string"), model).first()
    assert (other.lang_pred, other.score) == (got[5].lang_pred, got[5].score)


def test_batches_do_not_matter():
    rows = corpus(60)
    windows = [t.encode()[:64] for _, t, _, _ in rows]
    model = language_id.Model(sorted(WORDS), language_id.fit_network(windows, np.arange(60) % 3, 3, epochs=2))
    texts = [*(t for _, t, _, _ in rows), "der " * 40_000, "a"]
    best, score = model.predict(pa.array(texts))
    for i in (0, 7, 59, 60, 61):
        b, s = model.predict(pa.array([texts[i]]))
        assert b[0] == best[i] and s[0] == pytest.approx(score[i], abs=1e-6)
    sliced = model.predict(pa.array(texts)[5:9])
    assert sliced[0].tolist() == best[5:9].tolist()


def test_awkward_rows(spark):
    odd = [(1000, None, "en", 1.0), (1001, "", "en", 1.0), (1002, "12 345 !!", "de", 1.0), (None, "the of and that", "en", 1.0), (1003, "der und nicht schon", None, 1.0), (1003, "der und nicht schon", None, 1.0), (1004, "日本", None, 1.0)]
    got = language_id.identify(spark.createDataFrame(corpus() + odd, DOCS)).filter("doc_id IS NULL OR doc_id >= 1000").collect()
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000].score == 0
    assert by[1003].lang_pred == "de" and by[None].lang_pred == "en" and not by[None].held_out
    assert len(got) == 7 and by[1004].lang_pred in WORDS
    assert language_id.identify(spark.createDataFrame([], DOCS)).collect() == []
    nothing = language_id.identify(spark.createDataFrame([(1, "some text", None, 1.0)], DOCS)).first()
    assert (nothing.lang_pred, nothing.score) == ("und", 0.0)
    single = language_id.identify(spark.createDataFrame([(i, "some text", "en", 1.0) for i in range(5)], DOCS)).collect()
    assert all(r.lang_pred == "en" and r.score == 1 for r in single)


def test_registered_query(spark, sf):
    known = {r.doc_id: (r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = Q.op11_language_id(spark, sf).collect()
    assert len(rows) == len(known)
    held = [r for r in rows if r.held_out and known[r.doc_id][1] is not None and any(c.isalpha() for c in known[r.doc_id][0] or "")]
    assert np.mean([r.lang_pred == known[r.doc_id][1] for r in held]) >= 0.95
    for r in rows:
        if not any(c.isalpha() for c in known[r.doc_id][0] or ""):
            assert r.lang_pred == "und"
