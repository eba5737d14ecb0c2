"""A hidden Markov language model, trained by Baum-Welch on the whole training part and scored exactly.

A token is a word of the lower-cased text (ASCII letters) or the end of the text. Hidden states emit classes of
words; a word's class is a hash of the word itself or, for longer words, of its ending. Within its class a word has
its discounted share of the class's training count, c - d over C, with d = n1 / (n1 + 2 n2) from the counts of words
seen once and twice; what is discounted is the probability of the one unknown word. So for every state the
probabilities of all known words and the unknown word sum to 1, and the model's parameters have a fixed size while
word counts stay distributed, whatever the vocabulary.

Steps: (1) each task cuts its documents into blocks of a bounded size, numbers a block's words, and writes the
documents as word numbers and classes, and the block's vocabulary with its training counts; (2) counts are summed by
word (in each task first) and joined back to the vocabularies, those of words in many blocks by a broadcast of bounded
size; (3) states are trained on all training documents by ROUNDS rounds of Baum-Welch over whole texts: each task sums
expected counts, which are added up by class across tasks; (4) documents meet their block's vocabulary and get the exact
likelihood of their whole text by the scaled forward recursion.

A task runs its documents in step. Memory is bounded whatever the length of a text: forward messages are kept at every
STRETCH_TOKENS tokens only, and computed again stretch by stretch while the backward messages are carried from the end.

Defined cases: a null or empty text is the end token alone; a null doc_id is in the training part; repeated rows
count and are scored each; other columns are not looked at; if nothing is in the training part every word is
unknown and both scores are those of the unknown word alone; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize

STATES = 8
CLASSES = 8192
ENDING = 4
LONGEST_OWN = 6
ROUNDS = 6
BATCH_TOKENS = 3_000_000
STRETCH_TOKENS = 3_000_000
BLOCK_BYTES = 10 << 20
PRIOR = 100.0
SCHEMA = "kind int, block bigint, doc_id bigint, held_out boolean, ids binary, classes binary, word binary, number int, class int, train_count bigint"
OUTPUT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def class_of(word: bytes) -> int:
    """0: the end of a text, which is the empty word here."""
    if not word:
        return 0
    return 1 + zlib.crc32(word if len(word) <= LONGEST_OWN else b" " + word[-ENDING:]) % (CLASSES - 1)


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 32
    schema = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.binary()), ("classes", pa.binary()), ("word", pa.binary()), ("number", pa.int32()), ("class", pa.int32()), ("train_count", pa.int64())])

    def rows(kind: int, n: int, **columns) -> pa.RecordBatch:
        columns |= {"kind": pa.array(np.full(n, kind, np.int32)), "block": pa.array(np.full(n, block))}
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def flush() -> Iterator[pa.RecordBatch]:
        words = list(numbers)
        classes = np.fromiter(map(class_of, words), np.uint16, len(words))
        counts = np.zeros(len(words), np.int64)
        for ids, held in zip(texts, helds, strict=True):
            if not held:
                counts += np.bincount(ids, minlength=len(words)) if len(ids) * 20 > len(words) else 0
                if len(ids) * 20 <= len(words):
                    np.add.at(counts, ids, 1)
        yield rows(0, len(texts), doc_id=doc_ids, held_out=helds, ids=[x.tobytes() for x in texts], classes=[classes[x].tobytes() for x in texts])
        for i in range(0, len(words), 50_000):
            part = slice(i, i + 50_000)
            n = len(words[part])
            yield rows(1, n, word=words[part], number=np.arange(i, i + n, dtype=np.int32), **{"class": classes[part].astype(np.int32)}, train_count=counts[part])

    numbers, texts, helds, doc_ids, size = _Numbers(), [], [], [], 0
    for batch in batches:
        for doc_id, held, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = (text or "").encode().lower().split()
            words.append(b"")
            texts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
            helds.append(held)
            doc_ids.append(doc_id)
            size += len(text or "") + 1
            if size >= BLOCK_BYTES:
                yield from flush()
                block += 1
                numbers, texts, helds, doc_ids, size = _Numbers(), [], [], [], 0
    if texts:
        yield from flush()


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # [class, state]

    @classmethod
    def first(cls, frequency: np.ndarray, states: int = STATES) -> Hmm:
        rng = np.random.default_rng(11)
        move = np.full((states, states), 0.1 / max(states - 1, 1))
        np.fill_diagonal(move, 0.9)
        emit = frequency[:, None] * rng.uniform(0.2, 1.8, (len(frequency), states))
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0))

    @classmethod
    def of_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, frequency: np.ndarray) -> Hmm:
        start, move, emit = start + 1, move + 1, emit + PRIOR * frequency[:, None]
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _stretches(alive: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs (first, last + 1) of steps with at most most tokens together (one step at least)."""
    ends, out, start = np.cumsum(alive), [], 0
    while start < len(alive):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        out.append((start, stop))
        start = stop
    return out


def expected_counts(model: Hmm, sequences: list[np.ndarray], stretch: int = STRETCH_TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts of starts, moves and emissions over whole sequences, all of them in step."""
    sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
    order = np.argsort(-sizes, kind="stable")
    sizes, flat = sizes[order], np.concatenate([sequences[i] for i in order.tolist()])
    starts = np.cumsum(sizes) - sizes
    move, emit = model.move.astype(np.float32), model.emit.astype(np.float32)
    states, longest = len(move), int(sizes[0])
    alive = np.searchsorted(-sizes, -np.arange(1, longest + 2), side="right")  # sequences longer than t
    steps = _stretches(alive[:-1], stretch)

    def forward(a: np.ndarray, first: int, stop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The symbols, states' probabilities and scale of each step, from the probabilities a of the step before."""
        for t in range(first, stop):
            n = alive[t]
            symbols = flat[starts[:n] + t]
            a = (a[:n] @ move if t else a) * emit[symbols]
            c = a.sum(1, keepdims=True)
            a = a / c
            yield symbols, a, c

    saved = [np.tile(model.start.astype(np.float32), (len(sizes), 1))]
    for first, stop in steps[:-1]:
        for _, a, _ in forward(saved[-1], first, stop):
            pass
        saved.append(a)
    moves, emitted = np.zeros((states, states)), np.zeros((len(emit), states))
    b, later = np.ones((0, states), np.float32), None
    for (first, stop), a in zip(reversed(steps), reversed(saved), strict=True):
        held = list(forward(a, first, stop))
        seen = []
        for t in range(stop - 1, first - 1, -1):
            symbols, a, c = held.pop()
            if later is not None and alive[t + 1]:
                x = emit[later[0]] * b / later[1]
                moves += a[: alive[t + 1]].T @ x
                b = x @ move.T
            b = np.concatenate([b, np.ones((alive[t] - len(b), states), np.float32)])
            later = (symbols, c)
            seen.append((symbols, a * b))
        begun = seen[-1][1].sum(0, dtype=np.float64)
        which = np.concatenate([s for s, _ in seen])
        for k in range(states):
            emitted[:, k] += np.bincount(which, np.concatenate([w[:, k] for _, w in seen]), len(emit))
    return begun, moves * move, emitted


def log_likelihoods(model: Hmm, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log of each whole sequence's probability; sequences are runs of symbols in flat."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    out, a = np.zeros(len(sizes)), np.tile(model.start, (len(sizes), 1))
    alive = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), side="right")
    for t in range(int(sizes[0])):
        n = alive[t]
        a = (a[:n] if t == 0 else a[:n] @ model.move) * model.emit[flat[starts[:n] + t]]
        if t % 8 == 7 or t + 1 == len(alive) or alive[t + 1] < n:
            c = a.sum(1)
            out[:n] += np.log(c)
            a /= c[:, None]
    back = np.empty_like(out)
    back[order] = out
    return back


def _sequences(batches: Iterator[pa.RecordBatch], most: int = BATCH_TOKENS) -> Iterator[list[np.ndarray]]:
    held, size = [], 0
    for batch in batches:
        for raw in batch.column(0):
            held.append(np.frombuffer(raw.as_py(), np.uint16))
            size += len(held[-1])
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def baum_welch(train: DataFrame, model: Hmm, frequency: np.ndarray) -> Hmm:
    """One round over train(classes): counts are summed in each task, then by row of the model across tasks."""
    states = len(model.move)
    shared = train.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for sequences in _sequences(batches):
            start, moves, emitted = expected_counts(shared.value, sequences)
            one = np.concatenate([start[None], moves, emitted])
            total = one if total is None else total + one
        if total is not None:
            some = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, k]) for k in range(states))], ["row", *(f"s{k}" for k in range(states))])

    names = [f"s{k}" for k in range(states)]
    sums = train.mapInArrow(count, "row long, " + ", ".join(f"{n} double" for n in names)).groupBy("row").agg(*[F.sum(n) for n in names]).collect()
    total = np.zeros((1 + states + len(frequency), states))
    for row in sums:
        total[row[0]] = row[1:]
    shared.unpersist()
    return Hmm.of_counts(total[0], total[1 : 1 + states], total[1 + states :], frequency)


def fit(documents: DataFrame, frequency: np.ndarray, rounds: int = ROUNDS) -> Hmm:
    """documents(doc_id, held_out, classes) of all blocks; frequency: the classes' shares of the training tokens."""
    train = documents.filter("NOT held_out").select("classes")
    model = Hmm.first(frequency)
    for _ in range(rounds):
        model = baum_welch(train, model, frequency)
    return model


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row of docs(doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    blocks = materialize(texts.mapInArrow(_blocks, SCHEMA), "lm-blocks", compression="zstd")
    documents = blocks.filter("kind = 0")
    listed = blocks.filter("kind = 1").select("word", "block", "number", "class", "train_count")
    counts = materialize(listed.groupBy("word", "class").agg(F.sum("train_count").alias("c"), F.count("*").alias("n")), "lm-counts")
    total, most = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    words = join_counted(listed.drop("class"), counts, "word", total, most).select("block", "number", "class", "c")
    seen = counts.filter("c > 0").groupBy("class").agg(F.sum("c"), F.count("*"), F.sum((F.col("c") == 1).cast("int")), F.sum((F.col("c") == 2).cast("int")))
    in_class, kinds, once, twice = np.zeros((4, CLASSES))
    for k, *figures in seen.collect():
        in_class[k], kinds[k], once[k], twice[k] = figures
    n, v = int(in_class.sum()), int(kinds.sum())
    d = float(np.clip(once.sum() / max(once.sum() + 2 * twice.sum(), 1), 0.1, 0.9))
    frequency = in_class / n if n else np.full(CLASSES, 1 / CLASSES)
    model = fit(documents, frequency, rounds if n else 0)
    unknown = (model.emit * (d * kinds / np.maximum(in_class, 1))[:, None]).sum(0) if n else np.ones(STATES)
    whole = Hmm(model.start, model.move, np.concatenate([model.emit, unknown[None]]))
    shared = docs.sparkSession.sparkContext.broadcast((whole, in_class))

    def score_block(texts: pa.Table, vocabulary: pa.Table) -> pa.Table:
        hmm, total = shared.value
        number = vocabulary.column("number").to_numpy()
        c, classes = np.zeros((2, len(number)), np.int64)
        c[number], classes[number] = vocabulary.column("c").to_numpy(), vocabulary.column("class").to_numpy()
        known = c > 0
        symbol = np.where(known, classes, CLASSES)
        share = np.log10(np.where(known, (c - d) / np.maximum(total[classes], 1), 1.0))
        base = np.log10((c + 1) / (n + v + 1))
        ids = [np.frombuffer(x.as_py(), np.int32) for x in texts.column("ids")]
        flat, sizes = np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))
        starts = np.cumsum(sizes) - sizes
        per_text = lambda x: np.add.reduceat(x[flat], starts)
        found = log_likelihoods(hmm, symbol[flat], starts, sizes) / np.log(10) + per_text(share)
        return pa.table([texts.column("doc_id"), texts.column("held_out"), pa.array(sizes), pa.array(per_text(known.astype(np.int64))), pa.array(np.full(len(ids), n, np.int64)), pa.array(per_text(base)), pa.array(found)], names=[x.split()[0] for x in OUTPUT.split(", ")])

    words = materialize(words, "lm-words")
    left = documents.select("block", "doc_id", "held_out", "ids").groupBy("block")
    right = words.select("block", "number", "class", "c").groupBy("block")
    return left.cogroup(right).applyInArrow(score_block, OUTPUT)
