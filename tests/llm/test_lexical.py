"""Ranked search against a plain version: ties, edges, exact sums, blocks of items."""

import math
from collections import Counter

import numpy as np
import pytest

from lineara.llm import lexical

DOCS, ITEMS = "doc_id long, text string, extra string", "item_id long, text string, extra string"


def plain(docs, items, k=20):
    found = [(d, Counter(lexical.terms_of(t)), len(lexical.terms_of(t))) for d, t, *_ in docs]
    n, total = sum(1 for *_, size in found if size), sum(size for *_, size in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text, *_ in items:
        rows = []
        for doc, c, size in found:
            if size:
                m = 100 - 25 + (25 * size * n) // total
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in lexical.terms_of(text) if c[t])
                if score > 0:
                    rows.append((score, doc))
        rows.sort(key=lambda r: (-r[0], r[1] is not None, r[1] or 0))
        out += [(item, i + 1, doc, score) for i, (score, doc) in enumerate(rows[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, **kw):
    rows = lexical.search(spark.createDataFrame([(*d, "x") for d in docs], DOCS), spark.createDataFrame([(*i, "y") for i in items], ITEMS), **kw)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in rows.collect()), key=str)


def test_terms():
    assert lexical.terms_of("Don't STOP\tÉté_x 日本-9") == ["don", "t", "stop", "Été", "x", "日本", "9"]
    assert lexical.terms_of(None) == lexical.terms_of("...") == []


DOCS_ROWS = [
    (1, "red fish blue fish"), (2, "RED FISH"), (3, None), (4, ""), (5, "..."), (6, "fish " * 4000), (7, "one two three"), (7, "one two three"),
    (None, "red fish"), (8, "Ünit ünit"), (9, "ünit"), *[(100 + i, "tie breaker text") for i in range(60)],
]
ITEMS_ROWS = [(1, "red fish"), (2, "Fish fish FISH"), (3, None), (4, ""), (5, "nothing here"), (6, "ünit"), (7, "tie"), (7, "three tie"), (None, "two")]


def test_edges(spark):
    found = run(spark, DOCS_ROWS, ITEMS_ROWS)
    assert found == plain(DOCS_ROWS, ITEMS_ROWS)
    assert [r[2] for r in sorted(r for r in found if r[0] == 7 and r[1] <= 20)][:1] in ([7], [100])


@pytest.mark.parametrize("k", [1, 3, 100])
def test_blocks_and_tiles_change_nothing(spark, monkeypatch, k):
    monkeypatch.setattr(lexical, "TILE_ITEMS", 2)
    monkeypatch.setattr(lexical, "TILE_TERMS", 3)
    assert run(spark, DOCS_ROWS, ITEMS_ROWS, k=k, item_terms=3) == plain(DOCS_ROWS, ITEMS_ROWS, k)


def test_empty_tables(spark):
    assert run(spark, [], ITEMS_ROWS) == [] and run(spark, DOCS_ROWS, []) == [] and run(spark, [(1, "...")], [(1, "a")]) == []


def test_partial_sums_stay_below_the_exact_bound():
    text = " ".join(f"w{i} " * (1 + i % 7) for i in range(3000)) + " big" * 400_000
    block = lexical.Block.of([(1, text), (2, "w1 big")])
    weight = np.full(len(block.hashes), 40_000, np.int64)
    parts = lexical.products(block, weight)[0][1]
    whole = np.zeros((2, len(block.hashes)), np.int64)
    for vocab, dense in parts:
        assert len(vocab) <= lexical.TILE_TERMS and (dense.sum(axis=1) * lexical.IMPACT < lexical.EXACT).all()
        whole[:, vocab] += dense.astype(np.int64)
    want = np.zeros_like(whole)
    want[block.item, block.term] = block.repeats * 40_000
    assert (whole == want).all() and len(parts) > 2


def test_first_k_keeps_ties_by_id():
    scores, ids = np.array([5, 9, 5, 0, 5, 9]), np.array([7, 3, 1, 0, 4, 2])
    assert [int(ids[i]) for i in lexical.first_k(scores, ids, 4)] == [2, 3, 1, 4]
