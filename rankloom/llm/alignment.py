"""Alignment of two tokenizers' tokens by shared byte cuts, and how often token ids of both end together.

Packed bitsets over the bytes of a text mark where tokens of either tokenizer end. Their conjunction has the shared cuts;
popcount ranks of a cut in either bitset are the numbers of tokens up to it, so successive cuts give token ranges: a
group. A link is a pair of token occurrences whose byte ranges end together: a group's last two tokens.

A text whose white space is single spaces and line feeds is cut before each (both tokenizers end a token there; for the
second this is read off its vocabulary), and each distinct part of a batch is encoded and aligned once and remembered.
Any other text is encoded as a whole.

Of two tokens that end together one's bytes end the other's, so the vocabularies alone bound the linked id pairs: at
most one for each suffix of each token and id with those bytes. These pairs are numbered in order. Each task sums its
links by number and writes the sums beside its documents' numbers, once; the summed counts, of that fixed size, go back
to all tasks. So texts are encoded once and nothing is shuffled but bounded sums.

Defined cases: a null or empty text, and one that either tokenizer does not give back byte for byte (with a space before
it), has no tokens: counts are zero and the hash is the empty string; strings of special tokens are plain text;
repeated rows are repeated; a null doc_id is kept; other columns are not looked at; an empty table gives no rows.
doc_id must be an integer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.session import spread

from .common import give_back, materialize, temporary
from .encode import Encoder, batches_of

BATCH_BYTES = 2_000_000
#: Aligned parts that a worker remembers, at about 300 bytes each; longer parts than LONGEST characters seldom return.
MEMORY = 150_000
LONGEST = 24
SPACE = "▁"
DELTA = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}
STAGED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links array<int>, counts array<bigint>"
DIGEST = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: printable ones for themselves, the others, in
    order, for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Bits:
    """A packed bitset with ranks."""

    def __init__(self, size: int, positions: np.ndarray) -> None:
        marks = np.zeros(-(-size // 64) * 64, np.uint8)
        marks[positions] = 1
        self.words = np.packbits(marks, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def shared(self, other: Bits) -> np.ndarray:
        """Positions that are set in both."""
        return np.flatnonzero(np.unpackbits((self.words & other.words).view(np.uint8), bitorder="little"))

    def rank(self, positions: np.ndarray) -> np.ndarray:
        """How many positions up to each of these are set."""
        at = positions >> 6
        up_to = np.uint64(0xFFFFFFFFFFFFFFFF) >> (63 - (positions & 63)).astype(np.uint64)
        return self.before[at] + np.bitwise_count(self.words[at] & up_to)


class Piece:
    """An aligned part or text: counts, its groups as text, and the numbers of its links. Without groups: not given back."""

    __slots__ = ("groups", "links", "n_a", "n_b", "n_groups")

    def __init__(self, n_a: int = 0, n_b: int = 0, n_groups: int = 0, groups: str | None = None, links: bytes = b"") -> None:
        self.n_a, self.n_b, self.n_groups, self.groups, self.links = n_a, n_b, n_groups, groups, links


class Aligner:
    def __init__(self, a_file: str, b_file: str) -> None:
        import sentencepiece

        self.a = Encoder(a_file)
        self.a.tokenizer.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        alphabet = byte_alphabet()
        self.a_bytes = [b""] * self.a.size
        for token, i in self.a.tokenizer.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        self.pairs = self._possible_pairs()
        self.space = self.b.piece_to_id(SPACE)
        whole_words = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces)
        self.cuts = self.a.cuts and whole_words and self.b.encode("x y\nz") == [*self.b.encode("x"), *self.b.encode("y"), *self.b.encode("\nz")[1:]] and self.b.encode("\nz")[0] == self.space
        self.memory: dict[str, Piece] = {}

    def _possible_pairs(self) -> np.ndarray:
        """All pairs (a << 32 | b) of which one token's bytes end the other's, ascending."""
        by: tuple[dict[bytes, list[int]], dict[bytes, list[int]]] = ({}, {})
        for known, entries in zip(by, (self.a_bytes, self.b_bytes), strict=True):
            for i, x in enumerate(entries):
                known.setdefault(x, []).append(i)
        found = {(i << 32) | j for i, x in enumerate(self.a_bytes) for k in range(len(x)) for j in by[1].get(x[k:], ())}
        found |= {(i << 32) | j for j, x in enumerate(self.b_bytes) for k in range(len(x)) for i in by[0].get(x[k:], ())}
        return np.asarray(sorted(found), np.int64)

    def _aligned(self, raw: list[bytes], a_ids: list[np.ndarray], b_ids: list[list[int]]) -> list[Piece]:
        """Pieces of texts (their bytes, a space first unless a line feed is) with the ids of both tokenizers."""
        out = [Piece() for _ in raw]
        good = [i for i, x in enumerate(raw) if b"".join(map(self.a_bytes.__getitem__, a_ids[i].tolist())) == x and b"".join(map(self.b_bytes.__getitem__, b_ids[i])) == x]
        if not good:
            return out
        a = np.concatenate([a_ids[i] for i in good]).astype(np.int64)
        b = np.concatenate([np.asarray(b_ids[i], np.int64) for i in good])
        ends = np.cumsum([len(raw[i]) for i in good])
        bits_a, bits_b = (Bits(int(ends[-1]), np.cumsum(size[ids]) - 1) for size, ids in ((self.a_size, a), (self.b_size, b)))
        cuts = bits_a.shared(bits_b)
        a_end, b_end = bits_a.rank(cuts), bits_b.rank(cuts)
        links = np.searchsorted(self.pairs, (a[a_end - 1] << 32) | b[b_end - 1]).astype(np.int32)
        a_text, b_text = list(map(str, a.tolist())), list(map(str, b.tolist()))
        a_at, b_at = [0, *a_end.tolist()], [0, *b_end.tolist()]
        groups = [",".join(a_text[a_at[k] : a_at[k + 1]]) + "|" + ",".join(b_text[b_at[k] : b_at[k + 1]]) for k in range(len(cuts))]
        first = 0
        for i, last in zip(good, (np.searchsorted(cuts, ends - 1) + 1).tolist(), strict=True):
            out[i] = Piece(a_at[last] - a_at[first], b_at[last] - b_at[first], last - first, ";".join(groups[first:last]), links[first:last].tobytes())
            first = last
        return out

    def _whole(self, texts: list[str]) -> list[Piece]:
        spaced = [f" {t}" for t in texts]
        return self._aligned([t.encode() for t in spaced], self.a._ids(spaced), self.b.encode(texts, num_threads=1))

    def _parts(self, parts: list[str]) -> list[Piece]:
        """Parts as they stand after a space, or with their line feed."""
        out = list(map(self.memory.get, parts))
        holes = [i for i, x in enumerate(out) if x is None]
        new = [parts[i] for i in holes]
        fed = [p[0] == "\n" for p in new]
        words = self.a._parts([p[1:] if f else f" {p}" for p, f in zip(new, fed, strict=True)])
        feed = self.a.feed.tobytes()
        a_ids = [np.frombuffer(feed + x if f else x, "<u4") for x, f in zip(words, fed, strict=True)]
        b_ids = [x[1:] if f else x for x, f in zip(self.b.encode(new, num_threads=1), fed, strict=True)]
        raw = [p.encode() if f else b" " + p.encode() for p, f in zip(new, fed, strict=True)]
        for i, piece in zip(holes, self._aligned(raw, a_ids, b_ids), strict=True):
            out[i] = piece
            if len(self.memory) < MEMORY and len(parts[i]) <= LONGEST:
                self.memory[parts[i]] = piece
        return out

    def align(self, texts: pa.Array) -> Aligned:
        """texts: strings, none of them null or empty."""
        odd = self.a._whole(texts) if self.cuts else np.ones(len(texts), bool)
        at = np.empty(len(texts), np.int64)  # the place of each text among those of both kinds, cut ones first
        at[~odd], at[odd] = np.arange((~odd).sum()), np.arange(odd.sum()) + (~odd).sum()
        cut = texts.filter(pa.array(~odd))
        lists = pc.split_pattern(pc.replace_substring(cut, "\n", " \n"), " ")
        numbered = lists.flatten().dictionary_encode()
        pieces = self._parts(numbered.dictionary.to_pylist()) if len(cut) else []
        whole = texts.filter(pa.array(odd)).to_pylist()
        found = self._whole(whole) if whole else []
        indices = np.concatenate([numbered.indices.to_numpy().astype(np.int64), np.arange(len(found)) + len(pieces)])
        bounds = np.concatenate([lists.offsets.to_numpy().astype(np.int64), len(numbered.indices) + np.arange(1, len(found) + 1)])
        return Aligned(pieces + found, indices, bounds, at)


class Aligned:
    """Documents as runs of pieces: document i has pieces[indices[bounds[at[i]]:bounds[at[i] + 1]]]."""

    def __init__(self, pieces: list[Piece], indices: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> None:
        self.pieces, self.indices, self.bounds, self.at = pieces, indices, bounds, at
        self.good = self._sums(np.fromiter((p.groups is None for p in pieces), np.int64, len(pieces))) == 0

    def _sums(self, of_piece: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(of_piece[self.indices])))
        return (sums[self.bounds[1:]] - sums[self.bounds[:-1]])[self.at]

    def counts(self, name: str) -> np.ndarray:
        return np.where(self.good, self._sums(np.fromiter((getattr(p, name) for p in self.pieces), np.int64, len(self.pieces))), 0)

    def groups(self) -> list[str]:
        texts = [p.groups or "" for p in self.pieces]
        indices, bounds = self.indices.tolist(), self.bounds.tolist()
        return [";".join([texts[k] for k in indices[bounds[i] : bounds[i + 1]]]) if ok else "" for i, ok in zip(self.at.tolist(), self.good.tolist(), strict=True)]

    def links(self) -> list[np.ndarray]:
        """Ascending numbers of each document's links."""
        size = np.fromiter((len(p.links) // 4 for p in self.pieces), np.int64, len(self.pieces))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(np.frombuffer(b"".join(p.links for p in self.pieces), "<i4")))
        taken = lists.take(pa.array(self.indices))
        flat, ends = taken.values.to_numpy(), taken.offsets.to_numpy()[self.bounds]
        return [np.sort(flat[ends[i] : ends[i + 1]]) if ok else flat[:0] for i, ok in zip(self.at.tolist(), self.good.tolist(), strict=True)]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_file: str, b_file: str) -> Aligner:
    """One for each worker process."""
    if (a_file, b_file) not in _ALIGNERS:
        _ALIGNERS[a_file, b_file] = Aligner(a_file, b_file)
    return _ALIGNERS[a_file, b_file]


def _batches(batches: Iterator[pa.RecordBatch], of: Aligner) -> Iterator[tuple[pa.Array, np.ndarray, Aligned | None]]:
    """doc_ids, which of them have a text, and the alignment of these texts."""
    for batch in batches:
        doc_ids, texts = batch.column(0), batch.column(1)
        for a, b in batches_of(texts, BATCH_BYTES):
            some = texts.slice(a, b - a)
            full = pc.greater(pc.binary_length(some), 0)
            there = full.to_numpy(zero_copy_only=False)
            yield doc_ids.slice(a, b - a), there, of.align(some.filter(full)) if there.any() else None


def _spread_out(there: np.ndarray, values: np.ndarray | list | None, empty: object) -> list:
    out = [empty] * len(there)
    for i, v in zip(np.flatnonzero(there).tolist(), values if values is not None else (), strict=True):
        out[i] = v
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")))


def align(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """doc_id and groups of every document: in order, the ids of both tokenizers between two shared cuts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, there, aligned in _batches(batches, aligner(a_file, b_file)):
            texts = _spread_out(there, aligned and aligned.groups(), "")
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(texts, pa.string())], ["doc_id", "text"])

    ids = lambda x: F.split(x, ",").cast("array<int>")
    group = lambda g: F.struct(ids(F.split_part(g, F.lit("|"), F.lit(1))).alias("a"), ids(F.split_part(g, F.lit("|"), F.lit(2))).alias("b"))
    groups = F.transform(F.filter(F.split("text", ";"), lambda g: g != ""), group)
    return _texts(docs).mapInArrow(rows, "doc_id bigint, text string").select("doc_id", groups.alias("groups"))


def _stage(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """A row for each document, with the numbers of its links, and one for each task, with its links' sums in counts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = aligner(a_file, b_file)
        sums = np.zeros(len(of.pairs), np.int64)
        names = [x.split()[0] for x in STAGED.split(", ")]
        for doc_ids, there, aligned in _batches(batches, of):
            n = [pa.array(_spread_out(there, aligned and aligned.counts(c).tolist(), 0), pa.int64()) for c in ("n_a", "n_b", "n_groups")]
            hashes = _spread_out(there, aligned and [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in aligned.groups()], "")
            links = _spread_out(there, aligned and aligned.links(), np.zeros(0, np.int32))
            flat = np.concatenate(links)
            sums += np.bincount(flat, minlength=len(sums))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in links]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([doc_ids, *n, pa.array(hashes, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())), pa.nulls(len(doc_ids), pa.list_(pa.int64()))], names)
        seen = np.flatnonzero(sums)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, x) for x in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())] + [pa.array([seen.astype(np.int32)], pa.list_(pa.int32())), pa.array([sums[seen]], pa.list_(pa.int64()))], names)
        give_back()

    return materialize(_texts(docs).mapInArrow(rows, STAGED), "aligned", **DELTA)


def link_counts(staged: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of linked pairs, ascending, and how many links of the corpus hold each: at most one row for each possible pair."""
    each = staged.filter("counts IS NOT NULL").select(F.explode(F.arrays_zip("links", "counts")).alias("c"))
    rows = each.groupBy("c.links").agg(F.sum("c.counts").alias("n")).toPandas().sort_values("links")
    return rows["links"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def link_statistics(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """The counts of DIGEST for every document. A link is best if its pair's count is the highest of its second id."""
    spark = docs.sparkSession
    with temporary(spark) as keep:
        staged = keep(_stage(docs, a_file, b_file))
        numbers, found = link_counts(staged)
    pairs = aligner(a_file, b_file).pairs
    counts = np.zeros(len(pairs), np.int64)
    counts[numbers] = found
    second = pairs & 0xFFFFFFFF
    highest = np.zeros(int(second.max(initial=0)) + 1, np.int64)
    np.maximum.at(highest, second, counts)
    shared = spark.sparkContext.broadcast((counts, counts == highest[second]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, best = shared.value
        for batch in batches:
            lists = batch.column(5)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            sums = [np.concatenate(([0], np.cumsum(x[flat], dtype=np.int64))) for x in (best, n)]
            out = [pa.array((s[ends[1:]] - s[ends[:-1]])) for s in sums]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.diff(ends).astype(np.int64)), *out, batch.column(4)], [x.split()[0] for x in DIGEST.split(", ")])

    documents = staged.filter("counts IS NULL").select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", F.coalesce("links", F.array().cast("array<int>")).alias("links"))
    return documents.mapInArrow(rows, DIGEST)
