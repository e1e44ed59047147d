"""Cases in which an operator once did less than the whole job."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lineara.llm import quality
from lineara.session import table

DOCS = "doc_id long, text string"


def test_quality_score_without_own_counts(spark):
    """Scores from plain counts: a text of a trusted document is scored without its own counts, and so is its copy."""
    made = [(1, "a b c a"), (2, "b c d a"), (3, "a b c a"), (4, "x y a b"), (5, None), (6, "b c q")]
    good = {1, 2}
    frame = spark.createDataFrame(made, DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 1, 0), (4, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    grams = {r[0]: Counter(r[1]) for r in frame.select("doc_id", quality.ngrams(quality.words(frame.text))).collect()}
    raw = sum(grams.values(), Counter())
    own = sum((grams[d] for d in good), Counter())
    texts = {t for d, t in made if d in good}
    found = {r.doc_id: r.score for r in quality.judge(frame, labels).collect()}
    assert found[5] is None
    for doc, text in made:
        if doc != 5:
            g = grams[doc]
            t = own - g if text in texts else own
            share = t.total() / raw.total()
            want = sum(c * math.log((t[b] + quality.PRIOR) / (share * raw[b] + quality.PRIOR)) for b, c in g.items()) / g.total()
            assert abs(found[doc] - want) < 1e-5, doc
    assert found[1] == found[3]


@pytest.mark.parametrize(("sf", "part"), [("sf0.001", 0.8), ("sf0.01", 0.1), ("sf0.01", 0.8)])
def test_quality_keeps_held_out_good_documents(spark, sf, part):
    """Good documents whose label is held out are kept in every language, whatever part of the labels there is; bad ones still go."""
    sf = f"/root/testdata/{sf}"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    given = F.pmod(F.xxhash64("doc_id"), F.lit(100)) < int(100 * part)
    judged = quality.judge(docs, labels.where(given)).where("not base_failed")
    seen = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = judged.join(seen, "doc_id").select("lang", "quality", "toxic", given.alias("given"), "kept").collect()
    held = [r for r in rows if r.quality == 1 and r.toxic == 0 and not r.given]
    assert held
    for lang in {r.lang for r in held}:
        some = [r.kept for r in held if r.lang == lang]
        assert sum(some) >= 0.95 * len(some), lang
    trusted = [r.kept for r in rows if r.quality == 1 and r.toxic == 0 and r.given]
    assert sum(trusted) >= 0.95 * len(trusted)
    if part == 0.8:
        bad = [r.kept for r in judged.join(seen, "doc_id").where("quality = 0").select("kept").collect()]
        assert sum(bad) <= 0.5 * len(bad)
