"""A quality classifier by co-training of two views.

The text view sees hashed words and word endings; the metadata view sees language, source and the page's layout
(lengths, line shapes, shares of capitals, digits and symbols, repetition). Each is a sparse logistic regression.
In each round either view scores every document without a label and hands its PER_ROUND most confident pseudo-labels to
the other, in the proportion of the classes. Labels are split by a hash of doc_id into folds, of which no two serve one
purpose: one calibrates each view (Platt scaling), one weighs the two calibrated views against each other, one sets the
cutoff, and the rest train. The cutoff is one half, or less if that would turn away more than the share MOST_LOST of the
good documents of all labels in its fold. A good document is one labelled quality 1.

All documents are turned into features once, which are staged. A model is fitted on a bounded sample: about LABELLED
labelled documents, chosen by a hash of their doc_id, and the pseudo-labelled ones, 2 * ROUNDS * PER_ROUND at most; only
these reach the driver. Pseudo-labels come from all unlabelled documents and the cutoff from all labels of its fold, by
distributed scoring. Every document is scored, on its whole text.

Defined cases: a null or empty text has no words and is judged by its layout; null lang or source are values of
their own, and absent columns count as null; labels that are null or of unknown documents are not used; a document
labelled twice is good only if each label says so; rows that share a labelled doc_id stand for it by the one with the
smallest hash; rows of equal text, lang and source are one pseudo-label; doc_ids may be of any type; repeated rows score
alike; with labels of one class or none every score is 0.5 and all are kept; an empty table gives no rows. Input columns
named like an output are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import SALTS, give_back, join_hot, materialize, temporary
from .encode import forget

LABELLED = 4000
ROUNDS = 4
PER_ROUND = 400
CONFIDENT = 0.95
FOLDS = 8
SCALE_FOLD, JOINT_FOLD, CUTOFF_FOLD = 0, 1, 2
MOST_LOST = 0.01
TEXT_BITS = 16
META_SIZE = 1024
REMEMBERED = 200_000
SYMBOLS = "#*$%&|<>"
#: Documents that are scored in one step.
TOGETHER = 256
#: Little-endian 16-bit, 32-bit and 16-bit integers.
FEATURES = T.StructType([T.StructField(n, T.BinaryType()) for n in ("text_ids", "text_counts", "meta_ids")])
LOGITS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("text", "meta")])
SCORES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("text_score", "meta_score", "score")])


class _WordIds(dict):
    """A word's two feature numbers in one: the word's hash, and its ending's."""

    def __missing__(self, word: bytes) -> int:
        whole, end = zlib.crc32(word) >> (33 - TEXT_BITS), zlib.crc32(b"$" + word[-3:]) >> (33 - TEXT_BITS)
        both = whole | (end | 1 << (TEXT_BITS - 1)) << TEXT_BITS
        if len(self) < REMEMBERED:
            self[word] = both
        return both


_WORD_IDS = _WordIds()


def text_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers and their counts."""
    both = np.fromiter(map(_WORD_IDS.__getitem__, words), np.int64, len(words))
    ids, counts = np.unique(np.concatenate([both & ((1 << TEXT_BITS) - 1), both >> TEXT_BITS]), return_counts=True)
    return ids.astype("<u2"), counts.astype("<u4")


def meta_features(text: str, words: list[bytes], lang: str | None, source: str | None) -> np.ndarray:
    """One feature number for each measure: its name and interval, hashed; and language and source."""
    raw = text.encode()
    n, lines = max(len(words), 1), max(text.count("\n") + 1, 1)
    upper = len(raw) - len(raw.translate(None, bytes(range(65, 91))))
    lower = len(raw) - len(raw.translate(None, bytes(range(97, 123))))
    digits = len(raw) - len(raw.translate(None, bytes(range(48, 58))))
    size = max(len(raw), 1)
    measures = [
        np.log2(size),
        np.log2(n),
        np.log2(size / lines),
        20 * upper / max(upper + lower, 1),
        40 * digits / size,
        20 * min(1, sum(map(text.count, SYMBOLS)) / n),
        20 * min(1, text.count("!") / n),
        20 * len(set(words)) / n,
        sum(map(len, words)) / n / 2,
        20 * min(1, sum(map(text.count, ".,;:")) / n),
    ]
    names = [f"{i}:{int(m)}" for i, m in enumerate(measures)] + [f"lang:{lang}", f"source:{source}"]
    return np.asarray([zlib.crc32(x.encode()) % META_SIZE for x in names])


def features_of(text: str | None, lang: str | None, source: str | None) -> tuple[bytes, bytes, bytes]:
    words = (text or "").encode().lower().split()
    ids, counts = text_features(words)
    return ids.tobytes(), counts.tobytes(), meta_features(text or "", words, lang, source).astype("<u2").tobytes()


def features(text: Column, lang: Column, source: Column) -> Column:
    @F.pandas_udf(FEATURES)
    def view_features(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        forget()
        for texts, langs, sources in batches:
            yield pd.DataFrame(map(features_of, texts, langs, sources), columns=FEATURES.names, dtype=object)
        _WORD_IDS.clear()
        give_back()

    return view_features.asNondeterministic()(text, lang, source)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the runs of values between the bounds."""
    sums = np.concatenate(([0.0], np.cumsum(values)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


@dataclass
class View:
    """Sparse rows: row r has ids[bounds[r]:bounds[r + 1]] with values."""

    ids: np.ndarray
    values: np.ndarray
    bounds: np.ndarray
    size: int

    @classmethod
    def of_text(cls, ids: list[bytes], counts: list[bytes]) -> View:
        """Values are log counts, scaled to length 1."""
        bounds = np.concatenate(([0], np.cumsum([len(x) // 4 for x in counts], dtype=np.int64)))
        values = np.log1p(np.frombuffer(b"".join(counts), "<u4").astype(float))
        length = np.sqrt(np.maximum(_sums(values * values, bounds), 1e-18))
        return cls(np.frombuffer(b"".join(ids), "<u2").astype(np.int64), values / np.repeat(length, np.diff(bounds)), bounds, 1 << TEXT_BITS)

    @classmethod
    def of_meta(cls, ids: list[bytes]) -> View:
        bounds = np.concatenate(([0], np.cumsum([len(x) // 2 for x in ids], dtype=np.int64)))
        return cls(np.frombuffer(b"".join(ids), "<u2").astype(np.int64), np.ones(int(bounds[-1])), bounds, META_SIZE)

    def logits(self, weights: np.ndarray) -> np.ndarray:
        return _sums(weights[self.ids] * self.values, self.bounds) + weights[-1]

    def fit(self, rows: np.ndarray, labels: np.ndarray, steps: int = 80, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
        """Full-batch logistic regression with adaptive steps; both classes weigh the same."""
        take = np.concatenate([np.arange(self.bounds[r], self.bounds[r + 1]) for r in rows])
        ids, values = self.ids[take], self.values[take]
        owner = np.repeat(np.arange(len(rows), dtype=np.int32), self.bounds[rows + 1] - self.bounds[rows])
        share = labels.mean()
        weight = np.where(labels == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) / len(rows)
        w, seen = np.zeros(self.size + 1), np.full(self.size + 1, 1e-8)
        for _ in range(steps):
            z = np.bincount(owner, w[ids] * values, len(rows)) + w[-1]
            error = (1 / (1 + np.exp(-z)) - labels) * weight
            g = np.bincount(ids, error[owner] * values, self.size + 1)
            g[-1] = error.sum()
            g[:-1] += decay * w[:-1] / len(rows)
            seen += g * g
            w -= rate * g / np.sqrt(seen)
        return w


def logistic(columns: np.ndarray, labels: np.ndarray, steps: int = 50, ridge: float = 1.0) -> np.ndarray:
    """Newton's method for a few dense columns; the last weight is the constant."""
    x = np.column_stack([columns, np.ones(len(columns))])
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(x.shape[1])
    keep[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, x.T @ (p - labels) + keep @ w)
    return w


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    text_scale: np.ndarray
    meta_scale: np.ndarray
    joint: np.ndarray
    cutoff: float = 0.5

    def calibrated(self, text_logit: np.ndarray, meta_logit: np.ndarray) -> np.ndarray:
        a = text_logit * self.text_scale[0] + self.text_scale[1]
        b = meta_logit * self.meta_scale[0] + self.meta_scale[1]
        return np.column_stack([a, b, np.column_stack([a, b]) @ self.joint[:-1] + self.joint[-1]])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _column(docs: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in docs.columns else F.lit(None).cast("string")


def stage_features(docs: DataFrame) -> DataFrame:
    """doc_id, id (a hash of what a document is judged by) and the features of every row, staged."""
    lang, source, text = _column(docs, "lang"), _column(docs, "source"), F.coalesce("text", F.lit(""))
    one = F.xxhash64(text, F.coalesce(lang, F.lit("")), lang.isNull(), F.coalesce(source, F.lit("")), source.isNull())
    rows = docs.select("doc_id", one.alias("id"), features(F.col("text"), lang, source).alias("f"))
    return materialize(rows.select("doc_id", "id", "f.*"), "quality-features")


def _logits(text: np.ndarray, meta: np.ndarray, ids: list[bytes], counts: list[bytes], metas: list[bytes]) -> np.ndarray:
    """Both views' logits, a few documents at a time: their arrays are many times as large as the features."""
    out = np.zeros((len(ids), 2))
    for i in range(0, len(ids), TOGETHER):
        some = slice(i, i + TOGETHER)
        out[some, 0] = View.of_text(ids[some], counts[some]).logits(text)
        out[some, 1] = View.of_meta(metas[some]).logits(meta)
    return out


def logits(rows: DataFrame, text: np.ndarray, meta: np.ndarray) -> Column:
    """A struct of both views' logits of staged features."""
    shared = rows.sparkSession.sparkContext.broadcast((text, meta))

    @F.pandas_udf(LOGITS)
    def view_logits(ids: pd.Series, counts: pd.Series, metas: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_logits(*shared.value, list(ids), list(counts), list(metas)), columns=LOGITS.names)

    return view_logits.asNondeterministic()("text_ids", "text_counts", "meta_ids")


def fold_of(doc_id: object) -> int:
    return zlib.crc32(str(doc_id).encode()) % FOLDS


def _fold(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


@dataclass
class Trainer:
    """Fits both views on labelled rows and on what each was taught; rows are kept by id."""

    rows: dict[int, tuple[bytes, bytes, bytes]]
    labelled: list[tuple[int, int, int]]  # id, label, fold

    def views(self, ids: list[int]) -> tuple[View, View]:
        found = [self.rows[i] for i in ids]
        return View.of_text([x[0] for x in found], [x[1] for x in found]), View.of_meta([x[2] for x in found])

    def fold(self, *folds: int) -> tuple[list[int], np.ndarray]:
        some = [(i, y) for i, y, f in self.labelled if f in folds]
        return [i for i, _ in some], np.asarray([y for _, y in some], float)

    def fit(self, taught: tuple[dict[int, int], dict[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the text and the metadata view."""
        ids, labels = self.fold(*(set(range(FOLDS)) - {SCALE_FOLD, JOINT_FOLD, CUTOFF_FOLD}))
        out = []
        for k, given in enumerate(taught):
            view = self.views(ids + list(given))[k]
            out.append(view.fit(np.arange(len(ids) + len(given)), np.concatenate([labels, np.fromiter(given.values(), float, len(given))])))
        return out[0], out[1]

    def scales(self, weights: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        ids, labels = self.fold(SCALE_FOLD)
        return [logistic(v.logits(w)[:, None], labels) for v, w in zip(self.views(ids), weights, strict=True)]

    def model(self, weights: tuple[np.ndarray, np.ndarray]) -> Model:
        model = Model(*weights, *self.scales(weights), np.zeros(3))
        ids, labels = self.fold(JOINT_FOLD)
        text, meta = (v.logits(w) for v, w in zip(self.views(ids), weights, strict=True))
        model.joint = logistic(model.calibrated(text, meta)[:, :2], labels)
        return model

    @property
    def usable(self) -> bool:
        folds = [self.fold(*(set(range(FOLDS)) - {SCALE_FOLD, JOINT_FOLD, CUTOFF_FOLD})), self.fold(SCALE_FOLD), self.fold(JOINT_FOLD)]
        return all(len(np.unique(y)) == 2 for _, y in folds)


def _fetch(staged: DataFrame, ids: list[int]) -> dict[int, tuple[bytes, bytes, bytes]]:
    """Features of a bounded number of rows."""
    if not ids:
        return {}
    wanted = staged.sparkSession.createDataFrame(pa.table({"id": pa.array(ids, pa.int64())}))  # a list of rows would take Python workers of another kind
    found = staged.join(F.broadcast(wanted), "id").select("id", *FEATURES.names).dropDuplicates(["id"])
    return {r[0]: (bytes(r[1]), bytes(r[2]), bytes(r[3])) for r in found.collect()}


def pseudo_labels(staged: DataFrame, pool: DataFrame, weights: tuple[np.ndarray, np.ndarray], scales: list[np.ndarray], taught: tuple[dict[int, int], dict[int, int]], share: float, per_round: int) -> list[tuple[int, int, int]]:
    """(view that is taught, id, label): each view's most confident ones of the whole pool, by confidence, then id."""
    z = staged.select("id", logits(staged, *weights).alias("z")).dropDuplicates(["id"]).join(pool, "id", "left_semi")
    p = [1 / (1 + F.exp(-(F.col(f"z.{name}") * float(s[0]) + float(s[1])))) for name, s in zip(LOGITS.names, scales, strict=True)]
    wanted = {1: max(round(per_round * share), 1), 0: max(round(per_round * (1 - share)), 1)}
    kinds = [F.struct(F.lit(1 - k).alias("view"), F.lit(y).alias("label"), (p[k] if y else 1 - p[k]).alias("sure"), F.lit(wanted[y]).alias("n")) for k in (0, 1) for y in (1, 0)]
    rows = z.select("id", F.explode(F.array(*kinds)).alias("k")).select("id", "k.*").filter(F.col("sure") >= CONFIDENT)
    for k in (0, 1):
        if taught[k]:
            rows = rows.filter((F.col("view") != k) | ~F.col("id").isin(list(taught[k])))
    # the first of each of SALTS parts, then of all: no task meets more than SALTS times as many as are wanted
    rows, first = rows.withColumn("salt", F.pmod("id", F.lit(SALTS))), None
    for by in (["view", "label", "salt"], ["view", "label"]):
        order = W.Window.partitionBy(*by).orderBy(F.desc("sure"), "id")
        first = (rows if first is None else first).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max(wanted.values()))
    first = first.filter("place <= n")
    return [tuple(r) for r in first.orderBy("view", "label", "place").select("view", "id", "label").collect()]


def fit(staged: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> Model | None:
    """A model from staged features and labels(doc_id, quality)."""
    good = F.min((F.col("quality") == 1).cast("int"))
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(good.alias("label"))
    rows = materialize(join_hot(staged.select("doc_id", "id"), known, "doc_id"), "quality-labelled")
    here = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("id").alias("id"))
    part = labelled / max(here.count(), 1)
    if part < 1:
        here = here.filter(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("sample")), 12) < int(part * (1 << 52)))
    sample = sorted((r.id, r.label, fold_of(r.doc_id)) for r in here.collect())
    trainer = Trainer(_fetch(staged, sorted({i for i, _, _ in sample})), sample)
    if not trainer.usable:
        return None
    pool = materialize(staged.select("id").distinct().join(rows.select("id").distinct(), "id", "left_anti"), "quality-pool")
    taught: tuple[dict[int, int], dict[int, int]] = ({}, {})
    share = float(np.mean([y for _, y, _ in sample]))
    weights = trainer.fit(taught)
    for _ in range(rounds):
        chosen = pseudo_labels(staged, pool, weights, trainer.scales(weights), taught, share, per_round)
        trainer.rows |= _fetch(staged, sorted({i for _, i, _ in chosen} - trainer.rows.keys()))
        for view, i, label in chosen:
            taught[view][i] = label
        weights = trainer.fit(taught)
    model = trainer.model(weights)
    scored = materialize(score(staged, model).select("doc_id", F.col("quality.score").alias("score")), "quality-scores")
    held = join_hot(scored, known.filter((_fold("doc_id") == CUTOFF_FOLD) & (F.col("label") == 1)), "doc_id")
    lowest = held.agg(F.percentile_approx("score", F.lit(MOST_LOST), F.lit(100_000))).first()[0]
    model.cutoff = 0.5 if lowest is None else min(0.5, lowest)
    return model


def score(rows: DataFrame, model: Model | None) -> DataFrame:
    """rows of staged features, or documents, with quality: a struct of text_score, meta_score and score; and kept."""
    if model is None:
        none = [F.lit(0.5).alias(f.name) for f in SCORES.fields]
        return rows.withColumn("quality", F.struct(*none)).withColumn("kept", F.lit(True))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def scores(m: Model, ids: list[bytes], counts: list[bytes], metas: list[bytes]) -> pd.DataFrame:
        z = _logits(m.text, m.meta, ids, counts, metas)
        return pd.DataFrame(_sigmoid(m.calibrated(z[:, 0], z[:, 1])), columns=SCORES.names)

    @F.pandas_udf(SCORES)
    def of_features(ids: pd.Series, counts: pd.Series, metas: pd.Series) -> pd.DataFrame:
        return scores(shared.value, list(ids), list(counts), list(metas))

    @F.pandas_udf(SCORES)
    def of_documents(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        forget()
        for texts, langs, sources in batches:
            found = list(map(features_of, texts, langs, sources))
            yield scores(shared.value, *([x[k] for x in found] for k in range(3)))
        _WORD_IDS.clear()
        give_back()

    if set(FEATURES.names) <= set(rows.columns):
        quality = of_features.asNondeterministic()(*FEATURES.names)
    else:
        quality = of_documents.asNondeterministic()(F.col("text"), _column(rows, "lang"), _column(rows, "source"))
    return rows.withColumn("quality", quality).withColumn("kept", F.col("quality.score") >= F.lit(model.cutoff))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_score, meta_score, score and kept of every document."""
    staged = stage_features(docs)
    return score(staged, fit(staged, labels)).select("doc_id", "quality.*", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns of docs. They are turned into features once more, which is cheaper
    than shuffling whole texts to join a verdict."""
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("__row")
    slim = docs.select(whole, "text", _column(docs, "lang").alias("lang"), _column(docs, "source").alias("source"))
    with temporary(docs.sparkSession):
        model = fit(stage_features(docs), labels)
    return score(slim, model).filter("kept").select("__row.*")
