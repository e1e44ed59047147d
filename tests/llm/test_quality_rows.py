"""op3's hashing: words become rows before they are counted, and windows are hashed by their pairs."""

from collections import Counter

from lineara.llm import quality

TEXTS = [None, "", " \t\n", "one", "one two", "  a b a b a b a b  ", "x " * 40, "p q r s t u p q r s t v", "ab c a bc ab c", "1 2 3 4 5 6 7 8 9"]


def _covered(words, n):
    windows = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    many = Counter(windows)
    return len({i + k for i, x in enumerate(windows) if many[x] > 1 for k in range(n)})


def test_counting_hashes_no_words_in_lambdas(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    ids = spark.createDataFrame([(5,), (6,), (6,)], "_id long").distinct()
    counted = quality.bucket_counts(docs, ids, 97)
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert not any("lambdafunction" in line and "xxhash64(lambda" in line for line in plan.splitlines())
    grams = {r[0]: r[1] for r in docs.select("doc_id", quality.ngrams(quality.words(docs.text), 97)).collect()}
    n, t = Counter(b for g in grams.values() for b in g), Counter(grams[5] + grams[6])
    assert sum(n.values()) == sum(max(0, 2 * len((x or "").split()) - 1) for x in TEXTS)
    assert {tuple(r) for r in counted.collect()} == {(b, c, t[b]) for b, c in n.items()}


def test_windows_of_every_length_by_their_pairs(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    w = quality.words(docs.text)
    for r in docs.select("doc_id", *[quality.repeated_words(w, n).alias(f"n{n}") for n in (2, 3, 4, 5, 6)]).collect():
        for n in (2, 3, 4, 5, 6):
            assert r[f"n{n}"] == _covered((TEXTS[r.doc_id] or "").split(), n), (r.doc_id, n)
