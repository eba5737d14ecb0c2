"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers, one reading on and one reading back, see the bytes of a window; a softmax over both states
labels every position, and a document's score for a language is the mean of its letters' probabilities. Letters of
A to Z are read in lower case; digits, marks and white space are one symbol; bytes beyond ASCII stand for themselves.

A document is cut into windows of WINDOW bytes from its start, in which states begin anew. So its result depends on its
text alone, all windows of a batch run side by side, a step of numpy over thousands of windows, and memory is bounded
for any length. Whole texts are read.

The network is fitted in numpy by backpropagation through time over whole windows, on a sample of about SAMPLE windows, the
same number for each language, chosen from all windows of all training documents by a hash of doc_id and place. At most
MOST_LANGUAGES languages, those with the most text, are learned. Only the sample and the weights, both of a fixed size, are held by the
driver.

Defined cases: a null text, or one without a letter, is `und` with score 0; so is every text if there is nothing to
learn from; texts without language, without doc_id or without a letter teach nothing; with one language every text with
a letter has it; repeated rows are predicted alike; a null doc_id is not held out; other columns are not looked at; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.session import spread

from .common import give_back
from .encode import batches_of

WINDOW = 64
SAMPLE = 8192
HIDDEN = 8
EPOCHS = 5
BATCH = 256
RATE = 0.02
MOST_LANGUAGES = 128
#: Windows that run side by side when predicting, and bytes of text in one step.
TOGETHER = 2048
BATCH_BYTES = 1_000_000
UNDETERMINED = "und"
LETTER = r"\p{L}"


def symbols() -> np.ndarray:
    """The symbol of each byte: 0 for all that is no letter."""
    out = np.zeros(256, np.uint8)
    out[97:123] = out[65:91] = np.arange(1, 27)
    out[128:] = np.arange(27, 155)
    return out


SYMBOLS = symbols()
N_SYMBOLS = 155


@dataclass
class Network:
    """Both directions' weights stand in the first axis: 0 reads on, 1 reads back. Gates in the last: update, reset, new."""

    inputs: np.ndarray  # 2, symbols, 3 * hidden
    states: np.ndarray  # 2, hidden, 3 * hidden
    outputs: np.ndarray  # 2, hidden, languages
    bias: np.ndarray

    @classmethod
    def new(cls, n_languages: int, hidden: int = HIDDEN, seed: int = 5) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda *shape: r.normal(0, 0.3, shape).astype(np.float32)
        return cls(draw(2, N_SYMBOLS, 3 * hidden), draw(2, hidden, 3 * hidden), draw(2, hidden, n_languages), np.zeros(n_languages, np.float32))

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.inputs, self.states, self.outputs, self.bias]

    def step(self, x: np.ndarray, back: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next states of both directions from symbols x and back: also gates, candidate and the candidate's part of
        the states."""
        n = self.states.shape[1]
        u = h @ self.states
        g = np.stack([self.inputs[0].take(x, 0), self.inputs[1].take(back, 0)])
        gates = u[..., : 2 * n] + g[..., : 2 * n]
        gates *= 0.5
        np.tanh(gates, gates)
        gates *= 0.5
        gates += 0.5
        new = np.tanh(g[..., 2 * n :] + gates[..., n:] * u[..., 2 * n :])
        return new + gates[..., :n] * (h - new), gates, new, u[..., 2 * n :]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """positions, windows, languages: of symbols x (positions, windows)."""
        size, n = x.shape
        logits = np.zeros((2, size, n, len(self.bias)), np.float32)
        h = np.zeros((2, n, self.states.shape[1]), np.float32)
        for t in range(size):
            h = self.step(x[t], x[size - 1 - t], h)[0]
            out = h @ self.outputs
            logits[0, t], logits[1, size - 1 - t] = out[0], out[1]
        return _softmax(logits[0] + logits[1] + self.bias)

    def gradients(self, x: np.ndarray, labels: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Of the mean loss over all letters of the windows x (positions, windows), by backpropagation through time."""
        size, n = x.shape
        width = self.states.shape[1]
        h, steps = np.zeros((2, n, width), np.float32), []
        for t in range(size):
            after, gates, new, u = self.step(x[t], x[size - 1 - t], h)
            steps.append((h, gates, new, u, after))
            h = after
        states = np.stack([s[4] for s in steps])  # positions in reading order
        both = np.stack([states[:, 0], states[::-1, 1]])
        p = _softmax(both[0] @ self.outputs[0] + both[1] @ self.outputs[1] + self.bias)
        letters = x > 0
        total = max(letters.sum(), 1)
        right = np.take_along_axis(p, np.broadcast_to(labels[None, :, None], (size, n, 1)), 2)[..., 0]
        loss = float(-(np.log(np.maximum(right, 1e-9)) * letters).sum() / total)
        d = p
        d[:, np.arange(n), labels] -= 1
        d *= (letters / np.float32(total))[..., None]
        flat = d.reshape(-1, d.shape[-1])
        outputs = np.stack([b.reshape(-1, width).T @ flat for b in both])
        d_reading = np.stack([d, d[::-1]], 1)  # positions in reading order of both directions
        from_outputs = d_reading @ self.outputs.transpose(0, 2, 1)
        dh, d_states = np.zeros((2, n, width), np.float32), np.zeros_like(self.states)
        d_inputs = np.zeros((size, 2, n, 3 * width), np.float32)
        for t in range(size - 1, -1, -1):
            before, gates, new, u, _ = steps[t]
            update, reset = gates[..., :width], gates[..., width:]
            dh = dh + from_outputs[t]
            d_new = dh * (1 - update) * (1 - new * new)
            d_in = d_inputs[t]
            d_in[..., :width] = dh * (before - new) * update * (1 - update)
            d_in[..., width : 2 * width] = d_new * u * reset * (1 - reset)
            d_in[..., 2 * width :] = d_new
            through = np.concatenate([d_in[..., : 2 * width], d_new * reset], -1)
            d_states += before.transpose(0, 2, 1) @ through
            dh = dh * update + through @ self.states.transpose(0, 2, 1)
        inputs = np.stack([_by_symbol(x if k == 0 else x[::-1], d_inputs[:, k]) for k in (0, 1)])
        return [inputs, d_states, outputs, flat.sum(0)], loss


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(-1, keepdims=True)
    np.exp(z, z)
    z /= z.sum(-1, keepdims=True)
    return z


def _by_symbol(x: np.ndarray, d: np.ndarray) -> np.ndarray:
    symbols, rows = x.ravel(), d.reshape(-1, d.shape[-1])
    order = np.argsort(symbols, kind="stable")
    seen, first = np.unique(symbols[order], return_index=True)
    out = np.zeros((N_SYMBOLS, d.shape[-1]), np.float32)
    out[seen] = np.add.reduceat(rows[order], first)
    return out


def fit_network(windows: list[bytes], labels: np.ndarray, n_languages: int, epochs: int = EPOCHS, hidden: int = HIDDEN) -> Network:
    """Adam on batches of windows, in an order fixed by a seed."""
    net = Network.new(n_languages, hidden)
    x = SYMBOLS[np.frombuffer(b"".join(w.ljust(WINDOW, b" ") for w in windows), np.uint8)].reshape(len(windows), WINDOW)
    r = np.random.default_rng(11)
    mean, square, k = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights], 0
    steps = epochs * -(-len(windows) // BATCH)
    for _ in range(epochs):
        order = r.permutation(len(windows))
        for i in range(0, len(windows), BATCH):
            some = order[i : i + BATCH]
            found, _ = net.gradients(np.ascontiguousarray(x[some].T), labels[some])
            k += 1
            rate = RATE * (1 - 0.9 * k / steps)
            for w, m, s, g in zip(net.weights, mean, square, found, strict=True):
                g = np.clip(g, -1, 1)
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-7)
    return net


@dataclass
class Model:
    languages: list[str]
    network: Network

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each text (none null) the number of its language and the score."""
        raw = texts.cast(pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
        size = np.diff(offsets)
        n = -(-size // WINDOW)
        first = np.concatenate(([0], np.cumsum(n)))
        starts = np.repeat(offsets[:-1], n) + WINDOW * (np.arange(first[-1]) - np.repeat(first[:-1], n))
        ends = np.repeat(offsets[1:], n)
        sums = np.zeros((first[-1], len(self.languages) + 1))
        for i in range(0, len(starts), TOGETHER):
            at = starts[i : i + TOGETHER] + np.arange(WINDOW)[:, None]
            inside = at < ends[i : i + TOGETHER]
            x = np.where(inside, SYMBOLS[data[np.where(inside, at, 0)]], 0)
            letters = x > 0
            sums[i : i + TOGETHER, :-1] = (self.network.probabilities(x) * letters[..., None]).sum(0)
            sums[i : i + TOGETHER, -1] = letters.sum(0)
        total = np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(sums, 0)])
        pooled = total[first[1:]] - total[first[:-1]]
        mean = pooled[:, :-1] / np.maximum(pooled[:, -1:], 1)
        best = mean.argmax(1)
        return best, np.clip(mean[np.arange(len(best)), best], 0, 1)


def _remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def sample(docs: DataFrame, windows: int = SAMPLE) -> tuple[list[str], list[bytes], np.ndarray]:
    """Languages, and about as many windows of training documents, with the numbers of their languages."""
    n = F.ceil(F.octet_length("text") / WINDOW).cast("int")
    known = docs.filter((_remainder(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    sizes = known.groupBy("lang").agg(F.sum(n.cast("bigint")).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not sizes:
        return [], [], np.zeros(0, np.int64)
    languages = sorted(r.lang for r in sizes)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, min(1.0, windows / len(sizes) / r.n))])[F.col("lang")]
    place = lambda i: F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), i), 12)
    chosen = F.filter(F.sequence(F.lit(0), n - 1), lambda i: place(i) < share * float(1 << 52))
    rows = known.select("lang", "doc_id", "text", F.explode(chosen).alias("i")).select("lang", place(F.col("i")).alias("place"), F.substring(F.col("text").cast("binary"), F.col("i") * WINDOW + 1, F.lit(WINDOW)).alias("window"))
    found = sorted((r.place, r.lang, bytes(r.window)) for r in rows.collect())
    return languages, [w for _, _, w in found], np.asarray([languages.index(x) for _, x, _ in found], np.int64)


def fit(docs: DataFrame, windows: int = SAMPLE, epochs: int = EPOCHS, hidden: int = HIDDEN) -> Model | None:
    """A model from docs(doc_id, text, lang) whose crc32(doc_id) mod 4 is not 2; None if none of them teaches anything."""
    languages, some, labels = sample(docs, windows)
    return Model(languages, fit_network(some, labels, len(languages), epochs, hidden)) if languages else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs(doc_id, text)."""
    slim = spread(docs.select("doc_id", F.when(F.col("text").rlike(LETTER), F.col("text")).alias("text")))
    none = slim.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    if model is None:
        return none
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for a, b in batches_of(texts.fill_null(""), BATCH_BYTES):
                some = texts.slice(a, b - a)
                there = some.is_valid().to_numpy(zero_copy_only=False)
                names, scores = np.full(b - a, UNDETERMINED, object), np.zeros(b - a)
                if there.any():
                    best, scores[there] = of.predict(some.drop_null())
                    names[there] = np.asarray(of.languages, object)[best]
                yield pa.RecordBatch.from_arrays([doc_ids.slice(a, b - a), pa.array(names, pa.string()), pa.array(scores.round(6))], ["doc_id", "lang_pred", "score"])
        give_back()

    return slim.mapInArrow(rows, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from those that aren't held out."""
    docs = docs.select("doc_id", "text", "lang")
    held = F.coalesce(_remainder(F.col("doc_id")) == 2, F.lit(False))
    return predict(docs, fit(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
