"""Token files, packing and SimHash against plain restatements on a small table with every awkward case."""

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from rankloom.llm import packing, simhash, tiles, token_files
from rankloom.llm.encode import Encoder
from rankloom.llm.queries import op3_token_files, op5_packing, op7_simhash_near_dedup, tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AWKWARD = ["", None, "a  b", " x", "x ", "\n", "a\n\nb", "a\tb c", "<|endoftext|> a", "it's we'll 'q' 12,345", "naïve – déjà “vu”", "日本 語 x", "a b", "x\n y", "same text", "same text", "word " * 5000, "a\x1cb", "a\x85b", "Ünïcode ǅ ɏ ɐ text", "soft\u00adhyphen « quoted »"]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "extra", 1) for i, t in enumerate(AWKWARD)] + [(None, "no id", "extra", 1), (5, "\n", "extra", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, shard int")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_equals_library(library):
    texts = [t or "" for t in AWKWARD]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    encoder = Encoder(tokenizer_file())
    for _ in range(2):
        assert [x.tobytes() for x in encoder.encode(pa.array(texts))] == want


def expected_tokens(rows, library, end):
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.asarray([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_op3_round_trip(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = sorted(tuple(r) for r in op3_token_files(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == expected_tokens([(r.doc_id, r.text) for r in docs], library, 2)


def test_token_files_awkward(spark, awkward, library, tmp_path):
    path = str(tmp_path / "t")
    token_files.write_tokens(awkward, path, tokenizer_file(), 2)
    got = token_files.digest(token_files.read_tokens(spark, path)).collect()
    assert len(got) == awkward.count()
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == sorted([r.doc_id for r in got], key=lambda x: -1 if x is None else x)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(by_start, by_start[1:]))
    index = token_files.read_index(spark, path)
    assert sorted((r.start, r.n_tokens) for r in index.collect()) == sorted((r.start, r.n_tokens) for r in got)
    assert "ids" not in index._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def check_pieces(rows, docs, library, end=0, window=1024):
    ids = defaultdict(list)
    for doc_id, text in docs:
        ids[doc_id].append(np.asarray([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for doc_id, pieces in by_doc.items():
        assert sum(p.length for p in pieces) == sum(map(len, ids[doc_id]))
        for p in pieces:
            assert any(len(x) == p.doc_tokens and zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for x in ids[doc_id])
        if len(ids[doc_id]) == 1:
            pieces = sorted(pieces, key=lambda p: p.start)
            assert pieces[0].start == 0 and all(a.start + a.length == b.start for a, b in zip(pieces, pieces[1:]))
    fills = []
    for pieces in by_sequence.values():
        pieces = sorted(pieces, key=lambda p: p.offset)
        assert pieces[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(pieces, pieces[1:]))
        fills.append(pieces[-1].offset + pieces[-1].length)
    assert max(fills) <= window
    return fills


def test_op5_covers_every_id_once(spark, sf, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    fills = check_pieces(op5_packing(spark, sf).collect(), docs, library)
    assert sum(1024 - f for f in fills) / sum(fills) < 0.01


def test_packing_awkward(spark, awkward, library):
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    check_pieces(packing.pack(awkward, tokenizer_file()).collect(), docs, library)
    assert packing.pack(awkward.limit(0), tokenizer_file()).collect() == []


def test_packing_puts_related_documents_together():
    rng = np.random.default_rng(0)
    topics = [np.arange(100 * t, 100 * t + 50) for t in range(8)]
    documents = [rng.choice(topics[d % 8], 256).astype("<u4") for d in range(64)]
    groups = defaultdict(list)
    for d, _, _, s, _ in packing.fill_windows(documents):
        groups[s].append(d % 8)
    assert sum(len(set(g)) == 1 for g in groups.values()) >= 14


def brute_fingerprint(text, n=4):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=4):
    prints = list(prints)
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_op7_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    prints = [brute_fingerprint(r.text) for r in docs]
    roots = brute_components(prints)
    want = {r.doc_id: (f"{p:016x}", docs[k].doc_id) for r, p, k in zip(docs, prints, roots)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in op7_simhash_near_dedup(spark, sf).collect()} == want


def test_simhash_awkward(spark, awkward):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    got = {r.doc_id: r for r in rows}
    assert got[0].fingerprint == "0" * 16 and got[1].component_id == 0
    assert got[14].component_id == got[15].component_id == 14
    for i, t in enumerate(AWKWARD):
        assert got[i].fingerprint == f"{brute_fingerprint(t):016x}"
    kept = simhash.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    texts = {" ".join(WORD.findall((t or "").lower())) for t in [*AWKWARD, "no id"]}
    assert len(kept.collect()) == len(texts)
    assert simhash.near_duplicates(awkward.limit(0)).collect() == []


def test_links_on_planted_fingerprints(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values = set()
    for v in base.tolist():
        for _ in range(30):
            x = v
            for bit in rng.choice(64, rng.integers(0, 6), replace=False).tolist():
                x ^= 1 << bit
            values.add(x)
    values = sorted(values)
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in values]
    df = spark.createDataFrame(signed, "fp long")
    roots = brute_components(values)
    for tile in (4096, 16):
        found = {r.node % 2**64: r.root % 2**64 for r in tiles.components(simhash.links(df, tile=tile)).collect()}
        groups, want = defaultdict(set), defaultdict(set)
        for v, k in zip(values, roots):
            groups[found.get(v, v)].add(v)
            want[k].add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
