"""Masks against all substitutions that the comparison accepts."""

from itertools import combinations

from lineara.llm import decontaminate

DOCS = "doc_id long, text string"


def test_decontamination_masks_cover_all_substitutions(spark):
    """Every placing of the words that may differ is hit by a mask, and such copies are found."""
    for n in range(decontaminate.LEAST, decontaminate.VERIFY + 1):
        d = n - decontaminate.least_agreeing(n)
        for places in combinations(range(n), d):
            assert any(all(m[p] == "0" for p in places) for m in decontaminate.covering(n)), (n, places)
        assert min(m.count("1") for m in decontaminate.covering(n)) >= 3
    item = [f"k{i}" for i in range(13)]
    swapped = [(k, " ".join("zz" if i in p else x for i, x in enumerate(item))) for k, p in enumerate(combinations(range(13), 2))]
    long = [f"m{i}" for i in range(60)]
    fifth = (1000, " ".join("zz" if i % 5 == 0 else x for i, x in enumerate(long)))
    short = [(2000 + k, " ".join("zz" if i == k else f"s{i}" for i in range(6))) for k in range(6)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(long)), (3, " ".join(f"s{i}" for i in range(6)))], "item_id long, text string")
    made = [*swapped, fifth, *short, (3000, "k0 k1 k2 m1 m2 s0 s1")]
    found = sorted(tuple(r) for r in decontaminate.overlaps(spark.createDataFrame(made, DOCS), bench).select("doc_id", "item_id").collect())
    assert found == [*((k, 1) for k, _ in swapped), (1000, 2), *((2000 + k, 3) for k in range(6))]
