"""Rows that share an id."""

import brute
from lineara.llm import substring

DOCS = "doc_id long, text string"


def test_substring_rows_that_share_an_id(spark):
    """Repeated rows of one id and rows without an id: a window goes only if it starts at a strictly smaller (id, word)."""
    w = [f"w{i}" for i in range(200)]
    text = lambda *spans: " ".join(x for a, b in spans for x in w[a:b])
    made = [(None, text((0, 30))), (None, text((60, 100))), (None, text((150, 160), (0, 30))), (2, text((100, 130))), (2, text((100, 130)))]
    made += [(3, "q " + text((100, 130))), (4, text((130, 155))), (4, "z " + text((130, 155))), (5, text((60, 100))), (5, text((60, 100)))]
    low = -(1 << 63)
    plain = brute.word_repeats([(low if i is None else i, t) for i, t in made])
    for n in (1, 5):
        out = substring.remove_repeats(spark.createDataFrame(made, DOCS).repartition(n))
        assert sorted((low if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()) == plain
