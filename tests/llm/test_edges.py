"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, by value."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import brute
from lineara.llm import chat, decontaminate, mixing, neardup, quality, sharding, substring, suffix, warc

LOW = -(1 << 63)
DOCS = "doc_id long, text string, size int, shard string, slot string, component_id int, kept string, n_words int"
LONG = " ".join(f"w{i % 9973}" for i in range(40_000)) + "\n" + "\n".join(f"line {i % 50}" for i in range(3000))
ROWS = [(None, "alone without an id"), (None, "alone without an id"), (1, None), (2, ""), (3, " \t\n"), (4, "a b c"), (5, "a b c"), (5, "a b c"), (6, "Zürich – «naïve» ✓ " * 30), (7, "x" * 50_000), (8, LONG), (9, LONG + " end")]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(*r, 1, "s", "t", 0, "k", 3) for r in ROWS], DOCS)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def keyed(rows):
    return sorted(((LOW if r[0] is None else r[0], *r[1:]) for r in rows), key=str)


def test_substring(frame):
    plain = brute.word_repeats([(LOW if i is None else i, t) for i, t in ROWS])
    out = substring.remove_repeats(frame).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert keyed(map(tuple, out)) == sorted(plain, key=str)


def test_suffix(frame):
    plain = brute.byte_repeats([(LOW if i is None else i, t) for i, t in ROWS])
    out = suffix.remove_repeats(frame).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert keyed(map(tuple, out)) == sorted(plain, key=str)


def test_quality(spark, frame):
    labels = spark.createDataFrame([(8, 1, 0), (8, 1, 0), (None, None, None), (6, 0, None)], "doc_id long, quality int, toxic int")
    judged = quality.judge(frame.drop("kept", "n_words"), labels).collect()
    assert len(judged) == len(ROWS)
    texts = {i: t for i, t in ROWS}
    for r in judged:
        text = "alone without an id" if r.doc_id is None else texts[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base_counts(text), r.doc_id
        assert (r.score is None) == (r.n_words == 0) and not (r.base_failed and r.kept)
    assert quality.judge(frame.drop("kept", "n_words").limit(0), labels).count() == 0
    none = {r.doc_id: r.score for r in quality.judge(frame.drop("kept", "n_words"), labels.limit(0)).collect() if r.score is not None}
    assert set(none.values()) == {0.0}


def test_near(frame):
    out = neardup.groups(frame).select("doc_id", "n_shingles", "component_id", "kept").collect()
    with_id = [(i, t) for i, t in ROWS if i is not None]
    plain = brute.near_groups([*dict(with_id).items()])
    got = sorted({tuple(r) for r in out if r[0] is not None})
    assert got == plain and sum(r[0] == 5 for r in out) == 2
    assert [tuple(r) for r in out if r[0] is None] == [(None, 1, None, True)] * 2


def test_shards(frame):
    out = [r.asDict() for r in sharding.shard_digest(frame.select("doc_id", "text"), 4).collect()]
    assert sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in out) == sorted((i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS)
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    where = {}
    for r in out:
        where.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert len(where[zlib.crc32(b"a b c")]) == 1  # a light group stays together
    whole = sharding.assign_shards(frame, 4)
    assert set(whole.columns) == set(frame.columns) and whole.select(F.max(F.length("component_id"))).count() == 1
    assert sharding.assign_shards(frame.limit(0), 4).count() == 0


def test_shards_by_a_plain_version(spark):
    """The law stated plainly: bytes in key order, light groups of equal texts as one unit, heavy ones cut; whatever the ranges are."""
    import random

    draw = random.Random(3)
    rows = [(i, draw.choice(["same", "same " * 40, "text %d" % draw.randrange(50), "x" * draw.randrange(300)])) for i in range(600)]
    key = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    order = sorted(rows, key=lambda r: (key(r[1]), key(str(r[0]))))
    size, total = {i: len(t) + 1 for i, t in rows}, sum(len(t) + 1 for _, t in rows)
    group = {}
    for i, t in rows:
        group.setdefault(t, []).append(i)
    at, want, first, slots = 0, {}, {}, {}
    for i, t in order:
        light = len(group[t]) == 1 or sum(size[j] for j in group[t]) <= total // (4 * 64)
        shard = min(3, (first.setdefault(t, at) if light else at) * 4 // total)
        want[i] = (shard, slots.get(shard, 0))
        slots[shard] = slots.get(shard, 0) + 1
        at += size[i]
    for ranges in (4, 7, 64):
        out = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 4, ranges=ranges).collect()
        assert {r.doc_id: (r.shard, r.slot) for r in out} == want


CONV = "conv_id long, turn int, role string, text string, kind string, ends int"


def test_chat(spark):
    made = [(1, 0, "user", "q"), (1, 1, "assistant", "a\\<|b"), (1, 1, "assistant", "a\\<|b"), (1, None, "system", None), (None, 0, "assistant", "x"), (2, 0, None, "only"), (3, 0, "assistant", ""), (3, 0, "Assistant\nrole", "t" * 100_000)]
    frame = spark.createDataFrame([(*r, "k", 1) for r in made], CONV)
    out = {r.conv_id: r for r in chat.digest(chat.expand(frame)).collect()}
    conv = {}
    for c, t, role, text in made:
        conv.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(out) == set(conv)
    for c, turns in conv.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        got = out[c]
        assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()), len(loss), sha(loss.encode()))
        assert got.n_examples == sum(r == "assistant" for _, r, _ in turns)
    assert chat.digest(chat.expand(frame.limit(0))).count() == 0


PAGES = "page_id long, url string, html string, record_type string, payload_bytes int"


def test_warc(spark):
    big, small = "é" * 600, "s"
    made = [(1, "u", big), (1, "u", big), (2, "v w", big), (3, None, big), (3, "z", small), (None, "n", big), (None, "n", big), (4, "u", small), (5, None, None), (6, "u", "x" * 999), (7, "u", "x" * 999), (8, "u", "CRLF\r\n\r\nWARC/1.1\r\n" * 100), (9, "u", "CRLF\r\n\r\nWARC/1.1\r\n" * 100)]
    frame = spark.createDataFrame([(*r, "x", 0) for r in made], PAGES)
    out = sorted((tuple(r) for r in warc.round_trip(frame).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    last = {}
    for i, _, h in made:
        if i is not None:
            last[h] = max(last.get(h, i), i)
    want = []
    for i, _, h in made:
        raw = (h or "").encode()
        again = len(raw) >= 1000 and i != last.get(h) and last.get(h) is not None
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last[h] if again else None))
    assert out == sorted(want, key=str)
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_warc_records_can_be_read_alone(spark, tmp_path):
    import gzip
    import io

    path = "file://" + str(tmp_path / "w")
    made = [(i, f"http://h/{i}", "p" * (1500 if i % 2 else 20)) for i in range(6)]
    warc.write_archives(warc.resolve(spark.createDataFrame(made, "page_id long, url string, html string").coalesce(1)), path)
    files = [f.read_bytes() for f in (tmp_path / "w").iterdir() if f.name.startswith("part-")]
    seen = 0
    for data in files:
        assert sum(1 for _ in warc.parse(gzip.open(io.BytesIO(data)))) == data.count(b"\x1f\x8b\x08") - data.count(warc.EMPTY)
        at = 0
        while (at := data.find(b"\x1f\x8b\x08", at)) >= 0:  # each member by itself
            d = zlib.decompressobj(31)
            record = d.decompress(data[at:])
            seen += record.startswith(b"WARC/1.1")
            at += 1
    assert seen == 6
    assert warc.rows_a_file(spark.createDataFrame(made, "page_id long, url string, html string")) == warc.FILE_ROWS


def test_decontamination(spark):
    item = " ".join(f"k{i}" for i in range(20))
    made = [(None, item), (1, None), (2, ""), (3, item.upper()), (3, item.upper()), (4, "w " * 3000), (5, "none of it " * 50)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in made], "doc_id long, text string, item_id string, n_agree int")
    bench = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "w " * 40), (None, item)], "item_id long, text string")
    got = sorted(((r.doc_id or 0, r.item_id or 0) for r in decontaminate.overlaps(frame, bench).collect()))
    assert got == sorted([(0, 7), (3, 7), (3, 7), (4, 9), (0, 0), (3, 0), (3, 0)])
    clean = decontaminate.clean(frame, bench)
    assert clean.columns == frame.columns and sorted(r.doc_id for r in clean.collect()) == [1, 2, 5]
    assert decontaminate.overlaps(frame.limit(0), bench).count() == 0 and decontaminate.clean(frame, bench.limit(0)).count() == len(made)


def test_decontamination_recall_against_all_alignments(spark):
    """Random substitutions, against a look at every alignment of every item: all overlaps that the rule accepts are found."""
    import random

    draw = random.Random(5)
    items = [(k, [f"i{k}w{j % 9}" for j in range(draw.choice((6, 9, 13, 15, 30)))]) for k in range(12)]
    docs = []
    for d in range(150):
        _, w = draw.choice(items)
        copy = [x if draw.random() > draw.choice((0, 0.1, 0.2, 0.35)) else f"z{draw.randrange(99)}" for x in w]
        docs.append((d, [f"p{draw.randrange(50)}" for _ in range(draw.randrange(6))] + copy + ["q"] * draw.randrange(4)))
    want = set()
    for d, text in docs:
        for k, w in items:
            n = min(decontaminate.VERIFY, len(w))
            need = decontaminate.least_agreeing(n)
            for a in range(len(text) - n + 1):
                for b in range(len(w) - n + 1):
                    if sum(x == y for x, y in zip(text[a : a + n], w[b : b + n])) >= need:
                        want.add((d, k))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string"), bench).collect()}
    assert got == want and want


def test_mixing(spark, frame):
    labels = spark.createDataFrame([(8, 1, 0), (6, 0, 0), (4, 1, 1), (4, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = mixing.rates(frame, labels, {"clean": 0.5, "junk": 0.3, "toxic": 0.2}).collect()
    assert len(out) == len(ROWS) and all(r.rate >= 0 and r.copies >= 0 for r in out)
    assert {r.doc_id: r.n_tokens for r in out if r.doc_id} == {i: len(brute.words(t)) for i, t in ROWS if i}
    same = {r.rate for r in out if r.doc_id == 5}
    assert len(same) == 1
    assert mixing.rates(frame.limit(0), labels, {"clean": 1.0}).count() == 0
    kept = mixing.mix(frame, labels.limit(0), {"clean": 1.0}, anchor="clean")
    assert kept.columns == frame.columns and kept.count() == len(ROWS)  # all clean, all wanted
    assert mixing.mix(frame.limit(0), labels, {"clean": 1.0}).count() == 0


def test_rates_against_plain_least_squares(spark):
    """The distributed steps reach the targets that a plain solver of the same problem reaches."""
    import numpy as np

    rng = np.random.default_rng(2)
    p = rng.dirichlet([2, 1, 1], 300)
    t = rng.integers(10, 500, 300)
    rows = [(i, int(t[i]), *map(float, np.round(p[i], 6)), 0.5) for i in range(300)]
    post = spark.createDataFrame(rows, "doc_id long, n_tokens long, p_clean double, p_junk double, p_toxic double, u double")
    weights = {"clean": 0.45, "junk": 0.3, "toxic": 0.25}
    steps, said = mixing.fit_rates(post, weights, 4.0)
    target = np.array([0.45, 0.3, 0.25]) * t.sum()
    assert np.allclose(said["target"], target) and np.abs(np.array(said["reached"]) - target).max() < 0.01 * t.sum()
    got = np.array([r.rate for r in post.withColumn("rate", mixing.rate(steps, 4.0)).orderBy("doc_id").collect()])
    assert ((got >= 0) & (got <= 4)).all() and np.allclose((got * t) @ p, said["reached"], rtol=1e-3)


def test_rates_for_a_target_that_cannot_be_met(spark):
    """As near to the target as a plain solver comes that sets one rate after the other; with and without a bound."""
    import numpy as np

    rng = np.random.default_rng(3)
    p = np.round(rng.dirichlet([8, 1, 0.3], 250), 3)
    t = rng.integers(10, 500, 250).astype(float)
    post = spark.createDataFrame([(i, int(t[i]), *map(float, p[i]), 0.5) for i in range(250)], "doc_id long, n_tokens long, p_clean double, p_junk double, p_toxic double, u double")
    a = (t[:, None] * p).T
    for most, weights, anchor in ((1.0, {"clean": 0.99, "junk": 0.01, "toxic": 0.0}, "clean"), (None, {"clean": 0.1, "junk": 0.1, "toxic": 0.8}, None)):
        steps, said = mixing.fit_rates(post, weights, most, anchor)
        target, r = np.array(said["target"]), np.ones(250)
        for _ in range(3000):
            was = r.copy()
            for d in rng.permutation(250):
                r[d] = np.clip(r[d] - a[:, d] @ (a @ r - target) / (a[:, d] @ a[:, d]), 0, most)
            if np.abs(r - was).max() < 1e-10:
                break
        plain, found = np.linalg.norm(a @ r - target), np.linalg.norm(np.array(said["reached"]) - target)
        assert plain > 100 and abs(found - plain) < 1e-3 * plain
        got = np.array([x.rate for x in post.withColumn("rate", mixing.rate(steps, most)).orderBy("doc_id").collect()])
        assert np.allclose(got, mixing.rates_of(p, steps, most)) and np.allclose(a @ got, said["reached"])


def test_known_labels_need_no_prediction(spark):
    docs = spark.createDataFrame([(i, f"plain words number {i} here") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 8 == 3)) for i in range(20)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in mixing.rates(docs, labels, {"clean": 1.0, "toxic": 0.0}, max_rate=1.0, anchor="clean").collect()}
    assert all((out[i].p_toxic, out[i].p_clean) == ((1.0, 0.0) if i % 8 == 3 else (0.0, 1.0)) for i in range(20))
    assert all(out[i].rate < 1e-6 for i in (3, 11, 19)) and all(abs(r.p_clean + r.p_junk + r.p_toxic - 1) < 1e-9 for r in out.values())


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Every stage on nulls, repeated rows, long texts and no rows: defined results, and the columns of documents."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    good = [(100 + i, " ".join(f"g{(i * 37 + k) % 500}" for k in range(60))) for i in range(6)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in [*ROWS, *good, good[0]]], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.quality_rules(spark, docs, sf)
    assert kept.columns == docs.columns and not {r.doc_id for r in kept.collect()} & {1, 2, 3, 4, 5}
    near = corpus_pipeline.near_duplicates(spark, docs, sf)
    ids = sorted((r.doc_id for r in near.where("doc_id is not null").collect()))
    assert near.columns == docs.columns and 9 not in ids and {8, 1, 2, 3, 4, *(i for i, _ in good)} <= set(ids) and near.where("doc_id is null").count() == 2
    for name, stage in corpus_pipeline.STAGES[2:]:
        out = stage(spark, docs, sf)
        assert set(docs.columns) <= set(out.columns), name
        assert name == "mixing" or out.count() == docs.count(), name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
