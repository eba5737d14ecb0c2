"""Token alignment against a plain version: sets of byte offsets, one text at a time."""

import hashlib
from collections import Counter

import pyarrow as pa
import pytest

from rankloom.llm import alignment
from rankloom.llm import queries as Q

DOCS = "doc_id long, text string, links long, counts string"
FILES = Q.tokenizer_file("byte_bpe_50k.json"), Q.tokenizer_file("piece_bpe_32k.model")
TEXTS = [
    "a plain sentence of words, and again a plain sentence",
    "lines\nof words\nand\n\nempty ones",
    "two  spaces and   three",
    " leads and trails ",
    "tabs\tand\x0bothers\r\n",
    "the literal ▁ mark",
    "<|endoftext|> is plain <s> text </s> <unk> <0x41>",
    "Größe, élève, ñandú; naïve café",
    "日本語のテキスト and 中文 🙂🙃 mixed",
    "é combining, ﬁ ligature, Å sign",
    "x" * 5000,
    "word " * 3000 + "end",
    "1234567890 3.14159 $%&* ((()))",
    "\n",
    "\nstarts with a feed",
    "a\n",
    "nul \x00 inside",
]


@pytest.fixture(scope="module")
def of():
    return alignment.Aligner(*FILES)


def plain(of, texts):
    """Rows as the query gives them, of (doc_id, text)."""
    split, count = [], Counter()
    for _, text in texts:
        groups, links = [], []
        if text:
            whole = b" " + text.encode()
            a = of.a.tokenizer.encode(f" {text}", add_special_tokens=False).ids
            b = of.b.encode(text)
            if b"".join(of.a_bytes[i] for i in a) == whole == b"".join(of.b_bytes[i] for i in b):
                ends = []
                for ids, entries in ((a, of.a_bytes), (b, of.b_bytes)):
                    at, found = 0, {}
                    for k, i in enumerate(ids):
                        at += len(entries[i])
                        found[at] = k
                    ends.append(found)
                la = lb = 0
                for cut in sorted(ends[0].keys() & ends[1].keys()):
                    na, nb = ends[0][cut] + 1, ends[1][cut] + 1
                    groups.append((a[la:na], b[lb:nb]))
                    links.append((a[na - 1], b[nb - 1]))
                    la, lb = na, nb
        split.append((groups, links))
        count.update(links)
    highest = Counter()
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    rows = []
    for (doc_id, _), (groups, links) in zip(texts, split, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best = sum(count[x] == highest[x[1]] for x in links)
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        rows.append((doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), best, sum(count[x] for x in links), digest))
    return rows


def key(row):
    return tuple(map(str, row))


def test_texts_of_all_kinds_equal_plain(spark, of):
    texts = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, TEXTS[0]), (50, None), (51, "")]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in texts], DOCS).repartition(3)
    got = [tuple(r) for r in alignment.link_statistics(docs, *FILES).collect()]
    assert sorted(got, key=key) == sorted(plain(of, texts), key=key)


def test_groups_rebuild_both_token_lists(spark, of):
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(TEXTS)] + [(98, None, 1, "x")], DOCS)
    for r in alignment.align(docs, *FILES).collect():
        if r.groups:
            text = TEXTS[r.doc_id]
            assert [i for g in r.groups for i in g.a] == of.a.tokenizer.encode(f" {text}", add_special_tokens=False).ids
            assert [i for g in r.groups for i in g.b] == of.b.encode(text)
        assert bool(r.groups) == (plain(of, [(1, TEXTS[r.doc_id] if r.doc_id < 98 else None)])[0][1] > 0)


def test_remembered_parts_are_bounded(of, monkeypatch):
    monkeypatch.setattr(alignment, "MEMORY", 3)
    one = alignment.Aligner(*FILES)
    text = pa.array(["some words that come again some words"])
    assert one.align(text).groups() == of.align(text).groups() == one.align(text).groups()
    assert len(one.memory) <= 3 and one.cuts


def test_ranks_of_bits():
    bits = alignment.Bits(200, alignment.np.array([0, 3, 63, 64, 127, 199]))
    assert bits.rank(alignment.np.array([0, 2, 3, 63, 64, 126, 127, 198, 199])).tolist() == [1, 1, 2, 3, 4, 4, 5, 5, 6]
    assert bits.shared(alignment.Bits(200, alignment.np.array([3, 5, 199]))).tolist() == [3, 199]


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert alignment.link_statistics(docs, *FILES).collect() == [] and alignment.align(docs, *FILES).collect() == []


def test_registered_query_equals_plain(spark, sf, of):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in Q.op13_token_alignment(spark, sf).collect()]
    assert sorted(got, key=key) == sorted(plain(of, texts), key=key)
