"""Packing by lexical retrieval: windows of related documents, with no padding inside a shard.

The BM25 index is sharded by content, so that a seed meets its likely neighbours. Texts are encoded once and staged as
ids. The numbers of documents that hold each id, a row for each id of the tokenizer's vocabulary, and the mean length are
counted over all documents. Each document then gets KEYS weighted min-hashes of its terms: the term with the least
exponential draw, hashed from the term alone, at a rate of its inverse document frequency. Two documents share a key
with the chance of their weighted overlap, and rare shared terms weigh most; a term of one document only weighs nothing.
Documents are put in the order of these keys (then of a hash, so that a hot group is cut anywhere), and each run of
SHARD_TOKENS ids or SHARD_DOCS documents of a partition of that order is a shard with an inverted index of its own,
scored with the frequencies of the whole corpus.

In a shard whole windows are cut from long documents first. Then the longest unused rest is a seed: all its terms query
the index, unused neighbours that fit are appended in order of score, as far down the ranking as the window has room, and
the best neighbour left is cut to fill the window exactly; what remains of it stays unused. Documents that share no term
with the seed come after all that do. Only a shard's last window can be short.

Defined cases: a null or empty text is a document of the end id alone; repeated rows and copies are documents of their
own, ordered by keys and a hash of row and place; equal scores go to the earlier document; a null doc_id is kept, and equal or
null doc_ids are spread like others; other columns are not looked at; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_range, give_back, materialize, partitions
from .encode import MEMORY, batches_of, encoder, forget

WINDOW = 1024
END_ID = 0
SHARD_TOKENS = 1 << 19
SHARD_DOCS = 1024
KEYS, KEY_BITS = 2, 24
#: Tokens whose keys are drawn in one step.
TOGETHER = 250_000
#: Neighbours that are sorted at first; the rest of the ranking is sorted when a window has room for more.
SORT_FIRST = 32
BATCH_BYTES = 4_000_000
K1, B = 1.2, 0.75
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class Statistics:
    """Of the whole corpus: documents, their mean length, and for each term its inverse document frequency."""

    def __init__(self, documents: int, tokens: int, df: np.ndarray) -> None:
        self.mean_length = max(tokens / max(documents, 1), 1)
        self.idf = np.log((documents - df + 0.5) / (df + 0.5) + 1)
        rate = np.where(df > 1, self.idf, 0)
        draws = np.random.default_rng(7).exponential(size=(KEYS, len(df)))
        with np.errstate(divide="ignore"):
            self.draws = np.where(rate > 0, draws / rate, np.inf).astype(np.float32)

    @classmethod
    def of(cls, documents: list[np.ndarray]) -> Statistics:
        terms = np.concatenate([np.unique(d) for d in documents])
        return cls(len(documents), sum(map(len, documents)), np.bincount(terms))

    def keys(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """One number for each document, ids[bounds[i]:bounds[i + 1]]: its keys, most significant first."""
        out = np.zeros(len(bounds) - 1, np.int64)
        first = 0
        while first < len(out):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + TOGETHER, side="right")) - 1)
            some, starts = ids[bounds[first] : bounds[last]], bounds[first:last] - bounds[first]
            size = np.diff(bounds[first : last + 1])
            for draws in self.draws:
                drawn = draws[some]
                least = np.minimum.reduceat(drawn, starts)
                at = np.flatnonzero(drawn == np.repeat(least, size))
                term = np.zeros(last - first, np.int64)
                term[np.searchsorted(starts, at, side="right") - 1] = some[at]  # terms with one draw are the same term
                out[first:last] = out[first:last] << KEY_BITS | np.where(np.isinf(least), 0, term)
            first = last
        return out


class Bm25Index:
    """Postings of one shard, by term: document numbers and BM25 impacts."""

    def __init__(self, documents: list[np.ndarray], corpus: Statistics) -> None:
        length = np.fromiter(map(len, documents), np.int64, len(documents))
        width = len(corpus.idf)
        both, count = np.unique(np.repeat(np.arange(len(documents)), length) * width + np.concatenate(documents), return_counts=True)
        owner, term = np.divmod(both, width)
        self.bounds = np.searchsorted(owner, np.arange(len(documents) + 1))
        self.by_document = term
        order = np.argsort(term, kind="stable")
        tf, self.owner, term = count[order].astype(np.float64), owner[order], term[order]
        norm = K1 * (1 - B + B * length / corpus.mean_length)
        self.impact = corpus.idf[term] * tf * (K1 + 1) / (tf + norm[self.owner])
        self.first = np.searchsorted(term, np.arange(width + 1))
        # postings of words in many documents are kept as rows of a matrix, which one product sums
        size = np.diff(self.first)
        common = np.flatnonzero(size > max(len(documents) / 8, 1))
        self.row = np.full(width, -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), len(documents)), np.float32)
        held = self.row[term] >= 0
        self.dense[self.row[term[held]], self.owner[held]] = self.impact[held]
        self.listed = (size > 1) & (self.row < 0)

    def scores(self, document: int) -> np.ndarray:
        """BM25 of all documents against all terms of one document that another one has."""
        terms = self.by_document[self.bounds[document] : self.bounds[document + 1]]
        asked = np.zeros(len(self.dense), np.float32)
        rows = self.row[terms]
        asked[rows[rows >= 0]] = 1
        out = (asked @ self.dense).astype(np.float64)
        at = terms[self.listed[terms]]
        if len(at):
            first = self.first[at]
            size = self.first[at + 1] - first
            take = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            out += np.bincount(self.owner[take], self.impact[take], len(out))
        return np.round(out, 4)


def ranking(scores: np.ndarray) -> Iterator[int]:
    """Numbers by descending score, SORT_FIRST at first, then the rest sorted fully; negative scores are left out."""
    if len(scores) > 4 * SORT_FIRST:
        near = np.argpartition(-scores, SORT_FIRST)[:SORT_FIRST]
        yield from (d for d in near[np.argsort(-scores[near], kind="stable")].tolist() if scores[d] >= 0)
        scores[near] = -1
    rest = np.flatnonzero(scores >= 0)
    yield from rest[np.argsort(-scores[rest], kind="stable")].tolist()


def fill_windows(documents: list[np.ndarray], corpus: Statistics | None = None, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of pieces that cover each document once."""
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    rest = np.zeros(len(documents), np.int64)
    for d, ids in enumerate(documents):
        for start in range(0, len(ids) - window + 1, window):
            pieces.append((d, start, window, sequence, 0))
            sequence += 1
        rest[d] = len(ids) % window
    total = np.fromiter(map(len, documents), np.int64, len(documents))
    index = Bm25Index(documents, corpus or Statistics.of(documents))
    earlier = np.arange(len(documents)) * 1e-9  # of equal scores, the earlier document's counts as greater
    while (seed := int(rest.argmax())) >= 0 and rest[seed]:
        used = 0

        def take(d: int, n: int) -> None:
            nonlocal used
            pieces.append((d, int(total[d] - rest[d]), n, sequence, used))
            rest[d] -= n
            used += n

        take(seed, int(rest[seed]))
        if used < window and rest.any():
            scores = index.scores(seed)
            scores = np.where((rest > 0) & (scores > 0), np.maximum(scores - earlier, 0), -1)
            smallest, cut = int(rest[rest > 0].min()), None
            for d in ranking(scores):
                if rest[d] <= window - used:
                    take(d, int(rest[d]))
                elif cut is None:
                    cut = d
                if used == window or (cut is not None and window - used < smallest):
                    break
            while used < window and rest.any():
                d = cut if cut is not None else int((rest > 0).argmax())
                take(d, int(min(rest[d], window - used)))
        sequence += 1
    return pieces


def _lists(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and bounds of a column of binary ids, without a copy."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return flat.view(dtype), ((offsets - offsets[0]) // np.dtype(dtype).itemsize).astype(np.int64)


def _held_by(ids: np.ndarray, n: np.ndarray, width: int, docs: int = 64) -> np.ndarray:
    """For each term the number of documents that hold it; n: their lengths."""
    out, ends = np.zeros(width, np.int64), np.concatenate(([0], np.cumsum(n)))
    for i in range(0, len(n), docs):
        some = n[i : i + docs]
        held = np.zeros((len(some), width), np.uint8)
        held[np.repeat(np.arange(len(some)), some), ids[ends[i] : ends[i + len(some)]]] = 1
        out += held.sum(0, dtype=np.uint8)
    return out


def _encoded(docs: DataFrame, tokenizer_file: str, end_id: int, dtype: str, remembered: int) -> tuple[DataFrame, Statistics]:
    """(doc_id, h, n, ids) of each document, staged, and the corpus's statistics."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, end, df = encoder(tokenizer_file, remembered), np.asarray([end_id], "<u4"), np.zeros(0, np.int64)
        names = ["doc_id", "h", "n", "ids", "term", "df"]
        for batch in batches:
            doc_id, text, h = batch.columns
            for a, b in batches_of(text, BATCH_BYTES):
                ids = [np.concatenate([x, end]) for x in of.encode(text.slice(a, b - a))]
                flat = np.concatenate(ids)
                n, width = np.fromiter(map(len, ids), np.int64, len(ids)), int(flat.max()) + 1
                df = np.pad(df, (0, max(0, width - len(df))))
                df[:width] += _held_by(flat, n, width)
                flat = flat.astype(dtype)
                offsets = np.concatenate(([0], flat.itemsize * np.cumsum(n))).astype(np.int32)
                none = pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays([doc_id.slice(a, b - a), h.slice(a, b - a), pa.array(n), pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(flat)]), none, none], names)
        terms = np.flatnonzero(df)
        none = pa.nulls(len(terms), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(terms), pa.binary()), pa.array(terms), pa.array(df[terms])], names)
        give_back()

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("doc_id", "text", F.xxhash64("doc_id", "text", F.monotonically_increasing_id()).alias("h"))
    both = materialize(texts.mapInArrow(encode, "doc_id bigint, h bigint, n bigint, ids binary, term bigint, df bigint"), "packing-ids")
    staged = both.filter("n IS NOT NULL").select("doc_id", "h", "n", "ids")
    documents, tokens = staged.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(end_id + 1, np.int64)
    for term, count in both.filter("term IS NOT NULL").groupBy("term").agg(F.sum("df")).collect():  # one row for each id of the vocabulary
        df = np.pad(df, (0, max(0, term + 1 - len(df))))
        df[term] = count
    return staged, Statistics(documents, tokens, df)


def pack(docs: DataFrame, tokenizer_file: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False, remembered: int = MEMORY) -> DataFrame:
    """Pieces of sequences of at most window ids; with_ids adds each piece's ids (array<int>). remembered: parts of texts
    whose ids a worker keeps at hand, at about 220 bytes each; they take memory for time and change no result."""
    dtype = "<u2" if max(encoder(tokenizer_file, remembered).size - 1, end_id) < 1 << 16 else "<u4"
    staged, corpus = _encoded(docs, tokenizer_file, end_id, dtype, remembered)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(corpus)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # all texts are encoded
        for batch in batches:
            if batch.num_rows:
                k = shared.value.keys(*_lists(batch.column(3), dtype))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k)], [*batch.schema.names, "k"])
        give_back()

    keyed = staged.mapInArrow(key, "doc_id bigint, h bigint, n bigint, ids binary, k bigint")
    keys = materialize(keyed.select("k", "h", "n"), "packing-keys")
    shards = max(1, *(int(x) for x in keys.agg(F.ceil(F.count("*") / SHARD_DOCS), F.ceil(F.coalesce(F.sum("n"), F.lit(0)) / SHARD_TOKENS)).first()))
    ordered = by_range(keyed, "k", F.col("h"), min(shards, max(partitions(spark), shards // 32)), keys)

    def pack_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, sequence = [], TaskContext.get().partitionId() << 40
        room_docs, room_tokens = SHARD_DOCS, SHARD_TOKENS
        for batch in batches:
            n = batch.column(2).to_numpy()
            a = 0
            while a < len(n):
                ends = np.cumsum(n[a:])
                b = min(a + room_docs, a + int(np.searchsorted(ends, room_tokens, side="right")), len(n))
                b = max(b, a + 1) if not held else b
                if b > a:
                    held.append(batch.slice(a, b - a))
                    room_docs, room_tokens = room_docs - (b - a), room_tokens - int(ends[b - a - 1])
                if b < len(n):
                    packed, sequence = pack_shard(held, sequence)
                    yield packed
                    held, room_docs, room_tokens = [], SHARD_DOCS, SHARD_TOKENS
                a = b
        if held:
            yield pack_shard(held, sequence)[0]
        held = []
        give_back()

    def pack_shard(held: list[pa.RecordBatch], first: int) -> tuple[pa.RecordBatch, int]:
        doc_ids = pa.concat_arrays([b.column(0) for b in held])
        ids = [x.astype("<u4") for b in held for flat, bounds in [_lists(b.column(3), dtype)] for x in np.split(flat, bounds[1:-1])]
        d, start, length, sequence, offset = map(np.asarray, zip(*fill_windows(ids, shared.value, window), strict=True))
        slices = [ids[i][a : a + n] for i, a, n in zip(d.tolist(), start.tolist(), length.tolist(), strict=True)]
        columns = {
            "doc_id": doc_ids.take(pa.array(d)),
            "start": pa.array(start, pa.int64()),
            "length": pa.array(length, pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in slices], pa.int64()),
            "doc_tokens": pa.array(np.fromiter(map(len, ids), np.int64, len(ids))[d]),
            "sequence_id": pa.array(first + sequence, pa.int64()),
            "offset": pa.array(offset, pa.int64()),
        }
        if with_ids:
            columns["ids"] = pa.array([x.astype(np.int32) for x in slices], pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(columns), first + int(sequence.max()) + 1

    return ordered.select("doc_id", "h", "n", "ids").mapInArrow(pack_shards, SCHEMA + (", ids array<int>" if with_ids else ""))
