"""Tokens of a given vocabulary by greedy longest match, each distinct word of a batch once.

The vocabulary is a tokenizers file whose entries are byte-level, with a suffix on those that end a word; its merges are not
used: from each place of a word the longest entry is taken, one with the suffix if it reaches the end, else one without.
A byte that no entry begins with is UNKNOWN. Words are runs of letters, single digits, runs of other marks, and
contractions, of the lower-cased text; white space is dropped.

Words are found by the JVM; a task numbers the distinct words of a batch, matches each once, and takes the arrays of ids
for all occurrences. So nothing is shuffled, and no word is hot.

Defined cases: a null text has no ids and gives an empty array, as an empty one does; repeated rows give equal arrays.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from . import text as T

WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
UNKNOWN = -1
#: Words that a worker remembers.
MEMORY = 200_000


def _alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level entry: printable ones stand for themselves, the others, in order, are
    the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@dataclass
class Vocabulary:
    """Ids of byte strings inside a word, and of those that end one."""

    inner: dict[bytes, int]
    final: dict[bytes, int]
    known: dict[str, list[int]] = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        suffix, alphabet = model.get("end_of_word_suffix") or "", _alphabet()
        inner: dict[bytes, int] = {}
        final: dict[bytes, int] = {}
        for entry, i in model["vocab"].items():
            ends = bool(suffix) and entry.endswith(suffix) and entry != suffix
            part = entry[: -len(suffix)] if ends else entry
            if all(c in alphabet for c in part):
                (final if ends or not suffix else inner)[bytes(alphabet[c] for c in part)] = i
        return cls(inner if suffix else final, final)

    def __post_init__(self) -> None:
        self.longest = max(map(len, [*self.inner, *self.final]), default=0)

    def match(self, word: str) -> list[int]:
        if word in self.known:
            return self.known[word]
        raw, at, out = word.encode(), 0, []
        while at < len(raw):
            for end in range(min(len(raw), at + self.longest), at, -1):
                found = (self.final if end == len(raw) else self.inner).get(raw[at:end])
                if found is not None:
                    out.append(found)
                    at = end
                    break
            else:
                out.append(UNKNOWN)
                at += 1
        if len(self.known) < MEMORY:
            self.known[word] = out
        return out


_READ: dict[str, Vocabulary] = {}


def _vocabulary(path: str) -> Vocabulary:
    """One for each worker process."""
    if path not in _READ:
        _READ[path] = Vocabulary.read(path)
    return _READ[path]


def vocabulary_ids(texts: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, ids) of each text; path is that of the vocabulary file on the executors."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path)
        for batch in batches:
            lists = batch.column(1)
            numbered = lists.flatten().dictionary_encode()
            ids = [vocabulary.match(w) for w in numbered.dictionary.to_pylist()]
            starts = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            by_word = pa.ListArray.from_arrays(pa.array(starts), pa.array([i for x in ids for i in x], pa.int32()))
            taken = by_word.take(numbered.indices)
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            whole = pa.ListArray.from_arrays(pa.array(taken.offsets.to_numpy()[offsets] - taken.offsets[0].as_py()), taken.flatten())
            yield pa.RecordBatch.from_arrays([batch.column(0), whole], [key, "ids"])

    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))
    return spread(texts.select(key, words.alias("words"))).mapInArrow(rows, f"{key} {texts.schema[key].dataType.simpleString()}, ids array<int>")


def tokens_of(texts: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, tokens): by a vocabulary file if there is one, else Unicode words."""
    if path is None:
        return texts.select(key, F.coalesce(T.unicode_tokens(F.col(text)), F.array().cast("array<string>")).alias("tokens"))
    return vocabulary_ids(texts, key, text, path).select(key, F.col("ids").cast("array<string>").alias("tokens"))
