"""Alignment of two tokenizers: whole texts against the libraries, groups and counts against a plain version."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lineara.llm import arrays as A, registry, token_align as T
from lineara.session import table


@pytest.fixture(scope="module")
def files():
    return T.Files.read(*registry.TOKENIZERS)


@pytest.fixture(scope="module")
def enc(files):
    return T.Encoders(files.a_json, files.b_model)


def plain_tokens(enc, text):
    a, b = (x.tolist() for x in enc.alone(text or ""))
    raw = lambda v, i: v.data[v.offsets[i] : v.offsets[i + 1]].tobytes()
    want = (" " + (text or "")).encode()
    if not text or any(b"".join(raw(v, i) for i in ids) != want for v, ids in ((enc.a_vocab, a), (enc.b_vocab, b))):
        return [], [], []
    ends = [np.cumsum([len(raw(v, i)) for i in ids]).tolist() for v, ids in ((enc.a_vocab, a), (enc.b_vocab, b))]
    out, x, y = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        p, q = ends[0].index(end) + 1, ends[1].index(end) + 1
        out.append((a[x:p], b[y:q], end))
        x, y = p, q
    return a, b, out


def plain(enc, docs):
    met = [(doc, *plain_tokens(enc, text)) for doc, text in docs]
    links = [Counter((i, j) for a, b, _ in g for i in a for j in b) for *_, g in met]
    count = Counter(p for c in links for p in c)
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (doc, a, b, g), c in zip(met, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y, _ in g)
        out.append((doc, len(a), len(b), len(g), sum(c.values()), sum(n for p, n in c.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in c.items()), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=str)


ODD = [
    "a\n  b \t c\x1c d▁e  f\xa0 g ", "  lead", " ", "\n", "tail  ", "tail\n", " next", "<|endoftext|> <s> x<unk>", "é \U0001f600\U0001f468‍\U0001f469 　 z", "it's we'll I'd  'tis",
    "!!!!!     !!!", "\x1c\x1d a \x85 b", " " * 3000 + "x", "日本 語", "“q” z", "  a  b", "x" * 5000, "=" * 997 + " -" * 400, "<0x41> ▁", "a\x00b \x00 c",
]


def check(enc, texts):
    u = T.Aligned(enc, A.Texts.of(pa.array(range(len(texts))), pa.array(texts)))
    spans = u.group_span()
    na, nb = u.sizes()
    for i, text in enumerate(texts):
        a, b, groups = plain_tokens(enc, text)
        assert u.a[u.first_a[i] : u.first_a[i + 1]].tolist() == a and u.b[u.first_b[i] : u.first_b[i + 1]].tolist() == b, text
        at = range(spans[i], spans[i + 1])
        assert [(int(na[k]), int(nb[k])) for k in at] == [(len(x), len(y)) for x, y, _ in groups], text


def test_units_of_odd_texts(enc):
    check(enc, ODD)
    draw = random.Random(5)
    parts = ["a", "b ", "  ", "the", " ", "\n", "é", "\xa0", "!", "▁", "日", "'s", "9", "\t", "ing", " ", "\U0001f600"]
    for _ in range(15):
        check(enc, ["".join(draw.choice(parts) for _ in range(draw.randint(1, 30))) for _ in range(40)])


def test_colliding_segments_are_encoded_again(enc, monkeypatch):
    enc._clear()
    monkeypatch.setattr(T.A, "spans_hash", lambda data, starts, ends, base: (ends - starts).astype(np.uint64))
    check(enc, ["one two six ten", "red cat dog", None, ""])
    enc._clear()


def test_kept_segments_are_bounded(enc, monkeypatch):
    enc._clear()
    monkeypatch.setattr(T, "KEPT", 4)
    check(enc, ["one two three four five six"])
    check(enc, ["seven two eight", "nine"])
    assert len(enc.hashes) <= 6
    enc._clear()


def test_against_plain(spark, files, enc):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (101, ""), (None, "the cat"), (102, "the cat sat"), (102, "the cat sat"), (103, "the cat " * 3000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_a int").repartition(3)
    found = T.align(docs, files)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(enc, rows)


def test_whole_table(spark, enc):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in registry.op12_token_align(spark, "/root/testdata/sf0.001").collect()), key=str) == plain(enc, rows)


def test_groups(spark, files, enc):
    rows = [(1, "the cats' naïveté"), (2, None), (3, "▁"), (None, "日本 語")]
    found = T.groups(spark.createDataFrame(rows, "doc_id long, text string"), files).collect()
    for r in found:
        a, b, groups = plain_tokens(enc, dict(rows)[r["doc_id"]])
        assert r["a"] == a and r["b"] == b and [g["byte_end"] for g in r["groups"]] == [end for *_, end in groups]
        assert [g["a_end"] for g in r["groups"]] == np.cumsum([len(x) for x, *_ in groups]).tolist()


def test_wide_groups_count_equal_ids_first(enc, monkeypatch):
    tx = A.Texts.of(pa.array([1, 2]), pa.array([" " * 3000 + "x y", "the cat"]))
    u = T.Aligned(enc, tx)
    narrow = u.links(len(enc.b_vocab))
    monkeypatch.setattr(T, "WIDE", 0)
    wide = u.links(len(enc.b_vocab))
    assert (narrow[0] == wide[0]).all() and (narrow[1] == wide[1]).all()


def test_empty(spark, files):
    assert T.align(spark.createDataFrame([], "doc_id long, text string"), files).collect() == []
