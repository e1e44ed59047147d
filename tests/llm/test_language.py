"""Language profiles: a plain version, held-out accuracy, edges."""

import unicodedata
import zlib
from collections import Counter

import pytest

from lineara.llm import lang_id, registry
from lineara.session import table


def plain_grams(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if unicodedata.category(c).startswith("L"):
            word += c.lower() if len(c.lower()) == 1 else c
        elif word:
            words.append(word)
            word = ""
    out = Counter()
    for w in words:
        out.update(w)
        p = f"_{w}_"
        out.update(p[i : i + 2] for i in range(len(p) - 1))
        out.update(p[i : i + 3] for i in range(len(p) - 2))
    return out


def plain_places(grams, most):
    rows = sorted(grams.items(), key=lambda x: (-x[1], plain_key(x[0])))[:most]
    same = {}
    for i, (_, n) in enumerate(rows):
        same.setdefault(n, []).append(i + 1)
    return {g: sum(same[n]) / len(same[n]) for g, n in rows}


def plain_key(gram):
    out = 0
    for c in gram:
        out = (out << 21) | ((1 << 21) - 1 if c == "_" else ord(c))
    return out


def plain(rows, most=lang_id.PLACES):
    held = lambda d: None if d is None else zlib.crc32(str(d).encode()) % 5 == 0
    learned = {}
    for doc, text, lang in rows:
        if lang is not None and held(doc) is False:
            learned.setdefault(lang, Counter()).update(plain_grams(text))
    profiles = {lang: plain_places(g, most) for lang, g in learned.items() if g}
    out = []
    for doc, text, _ in rows:
        mine = plain_places(plain_grams(text), most)
        far = {lang: sum(min(most, abs(p[g] - x)) if g in p else most for g, x in mine.items()) for lang, p in profiles.items()}
        best = min(far, key=lambda x: (far[x], x)) if far and mine else None
        out.append((doc, held(doc), best or "und", 1 - far[best] / (most * len(mine)) if best else 0.0))
    return out


def same(found, want):
    order = lambda rows: sorted(rows, key=str)
    for f, w in zip(order(found), order(want), strict=True):
        assert f[:3] == w[:3] and f[3] == pytest.approx(w[3], abs=1e-9)


def test_plain_version(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    same([tuple(r) for r in registry.op13_lang_id(spark, "/root/testdata/sf0.001").collect()], plain(rows))


def test_edges(spark, monkeypatch):
    long = "Straße überall " * 20000
    rows = [
        (1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "", None),
        (5, "12 34 !!", "en"), (None, "the dog", "en"), (6, long, "de"), (7, "cat", None), (8, "ß", None), (9, "日本", "ja"), (10, "x日", None), (11, "İstanbul", "tr"),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    want = plain(rows)
    same([tuple(r) for r in lang_id.identify(docs).collect()], want)
    for piece in (1, 7, 4096):  # pieces never cut a word
        monkeypatch.setattr(lang_id, "PIECE", piece)
        for text in ("the cat", long[:9000], "", " a ", "x" * 5000):
            keys, times = lang_id.counted(text)
            assert dict(zip(keys.tolist(), times.tolist(), strict=True)) == {plain_key(g): n for g, n in plain_grams(text).items()}


def test_empty_and_unlearned(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert lang_id.identify(none).collect() == []
    rows = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in lang_id.identify(rows).collect()] == [(1, False, "und", 0.0)]


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(lang_id, "LANGUAGES", 1)
    rows = spark.createDataFrame([(1, "abc", "a"), (2, "xyz", "b"), (3, "uvw", "c")], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        lang_id.learn(rows)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    said = registry.op13_lang_id(spark, sf).where("held_out").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(said) > 150 and sum(r["lang_pred"] == r["lang"] for r in said) >= 0.98 * len(said)
    assert all(0 <= r["score"] <= 1 for r in said)
