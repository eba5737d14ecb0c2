"""Whole texts to token ids with a given tokenizer file, quickly and exactly.

A byte-level BPE splits a text before every single space and around every line feed, and merges only inside
those parts. So a text whose only white space is single spaces and single line feeds is cut there, and each
distinct part is encoded once by the tokenizers library and remembered (a bounded memory; when it is full, it
keeps what it has and further parts are encoded each time).
Any other text - runs of white space, other spaces, the spelling of a special token, characters beyond Latin -
goes to the library as a whole. Both ways give the library's ids; tests compare them.
"""

from __future__ import annotations

import os
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts remembered by a worker, at about 220 bytes each; parts longer than this many characters seldom return.
MEMORY = 700_000
LONGEST = 24
#: Unknown parts that the library encodes in one call.
TOGETHER = 100
#: What sends a text to the library as a whole: white space in runs, at the ends or of other kinds, and characters
#: beyond Latin letters and common punctuation.
_ODD = r"[ \n][ \n]|^[ \n]|[ \n]$|[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}]|[^\x00-\x{24f}\x{2010}-\x{2027}]"


class Encoder:
    """encode(texts) gives each text's ids as an array of little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer_file: str, most: int = MEMORY) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        splitter = str(self.tokenizer.pre_tokenizer)
        self.cuts = "ByteLevel" in splitter and "add_prefix_space=False" in splitter and self.tokenizer.normalizer is None
        self.most, self.memory = most, dict[str, bytes]()
        self.feed = self._ids(["\n"])[0]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts must be encoded as a whole."""
        if not self.cuts:
            return np.ones(len(texts), bool)
        odd = pc.match_substring_regex(texts, _ODD)
        for name in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, name))
        return odd.to_numpy(zero_copy_only=False)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """texts: strings without nulls."""
        whole = self._whole(texts)
        out = [self.feed] * len(texts)
        if whole.any():
            for i, ids in zip(np.flatnonzero(whole).tolist(), self._ids(texts.filter(pa.array(whole)).to_pylist()), strict=True):
                out[i] = ids
        for i, ids in zip(np.flatnonzero(~whole).tolist(), self._cut(texts.filter(pa.array(~whole)) if whole.any() else texts), strict=True):
            out[i] = ids
        pa.default_memory_pool().release_unused()
        return out

    def _cut(self, texts: pa.Array) -> list[np.ndarray]:
        """Arrow cuts and numbers the parts: a word after a space, or a line feed and the word after it. Python sees
        each distinct part once. The line feed put before each text, one token, is dropped again."""
        if not len(texts):
            return []
        marked = pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), "")
        lists = pc.split_pattern(marked, " ")
        numbered = lists.flatten().dictionary_encode()
        ids = self._known(numbered.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        starts = np.concatenate(([0], np.cumsum(size, dtype=np.int32)))
        by_part = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(ids), "<u4")))
        taken = by_part.take(numbered.indices)
        flat = taken.values.to_numpy()
        bounds = taken.offsets.to_numpy()[lists.offsets.to_numpy()].tolist()
        return [flat[a + 1 : b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _known(self, parts: list[str]) -> list[bytes]:
        ids = list(map(self.memory.get, parts))
        holes = [i for i, x in enumerate(ids) if x is None]
        feed = self.feed.tobytes()
        for fed in (False, True):
            at = [i for i in holes if (parts[i][0] == "\n") == fed]
            found = self._parts([parts[i][1:] if fed else f" {parts[i]}" for i in at])
            for i, x in zip(at, found, strict=True):
                ids[i] = feed + x if fed else x
        short = ((parts[i], ids[i]) for i in holes if len(parts[i]) <= LONGEST)
        self.memory.update(islice(short, max(0, self.most - len(self.memory))))
        return ids

    def _parts(self, words: list[str]) -> list[bytes]:
        """Ids of each word: many a call, with line feeds between, which are tokens of their own."""
        out: list[bytes] = []
        for i in range(0, len(words), TOGETHER):
            ids = self._ids(["\n".join(words[i : i + TOGETHER])])[0]
            raw, start = ids.tobytes(), 0
            for end in [*np.flatnonzero(ids == self.feed[0]).tolist(), len(ids)]:
                out.append(raw[4 * start : 4 * end])
                start = end + 1
        return out


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(tokenizer_file: str, most: int = MEMORY) -> Encoder:
    """One encoder for each worker process; most: the parts that it remembers."""
    if (tokenizer_file, most) not in _ENCODERS:
        forget()
        _ENCODERS[tokenizer_file, most] = Encoder(tokenizer_file, most)
    return _ENCODERS[tokenizer_file, most]


def forget() -> None:
    """Drop this worker's encoders, with all parts that they remember: Spark reuses workers, and what runs after a packing
    needs the memory."""
    _ENCODERS.clear()


def batches_of(texts: pa.Array, most_bytes: int = 8_000_000):
    """Runs (first, last + 1) of texts with at most most_bytes bytes (one text at least)."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start, base = 0, 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield start, stop
        start, base = stop, int(ends[stop - 1])
