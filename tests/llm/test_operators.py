"""The ten operators against plain versions, round trips and edge cases."""

import json
import zlib

import pytest

import brute
from lineara.llm import chat, decontaminate, html_text, mixing, neardup, quality, registry, sharding, substring, suffix, warc
from lineara.session import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
EDGES = [(None, "alone without an id"), (1, None), (2, ""), (3, " \t\n"), (4, "a b c"), (5, "a b c"), (5, "a b c"), (6, "Zürich – «naïve» ✓ " * 30), (7, "x" * 300_000)]
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def got(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def edge_frame(spark):
    return spark.createDataFrame([(*r, 1, "y", 0) for r in EDGES], DOCS + ", size int, key string, component int")


def test_substring_matches_brute_force(spark, docs, rows):
    names = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert got(registry.op2_substring(spark, SF), *names) == brute.word_repeats(rows)
    made = [(1, f"{BASE} x {BASE}"), (2, f"y {BASE} z"), (3, BASE[:-7]), (4, None), (9, f"{BASE} {BASE} {BASE}")]
    assert got(substring.remove_repeats(spark.createDataFrame(made, DOCS)), *names) == brute.word_repeats(made)


def test_suffix_matches_brute_force(spark, rows):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got(registry.op10_suffix(spark, SF), *names) == brute.byte_repeats(rows)
    made = [(1, BASE), (2, "é" + BASE[3:60] + "q" + BASE[50:]), (3, "ab" * 200), (4, "ba" * 100), (5, None), (6, BASE[:49])]
    assert got(suffix.remove_repeats(spark.createDataFrame(made, DOCS)), *names) == brute.byte_repeats(made)


def test_near_groups_match_brute_force(spark, rows):
    names = ("doc_id", "n_shingles", "component_id", "kept")
    assert got(registry.op9_neardup(spark, SF), *names) == brute.near_groups(rows)


def test_near_groups_of_many_near_copies(spark):
    """A chain of texts in which each is linked only with its neighbours, and a star around one text."""
    w = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(w[8 * i : 8 * i + 200])) for i in range(25)]
    star = [(100 + i, " ".join([f"s{k}" if k not in (7 * i, 7 * i + 1) else f"t{i}" for k in range(300)])) for i in range(40)]
    made = chain + star
    assert got(neardup.groups(spark.createDataFrame(made, DOCS)), "doc_id", "n_shingles", "component_id", "kept") == brute.near_groups(made)


def test_quality_base_counts(spark, rows):
    q = {r.doc_id: r for r in registry.op3_quality(spark, SF).collect()}
    for doc, text in rows:
        r = q[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base_counts(text), doc
        assert not (r.base_failed and r.kept)


def test_repeated_words_few_and_many(spark):
    """Texts below, at and above FEW repeated windows, with runs that overlap, give the same counts as a plain look at all windows."""
    import random

    draw, texts = random.Random(7), ["", "a", "a b c d e", "a a a a a a", "x " * 500]
    for k in (1, quality.FEW - 1, quality.FEW, quality.FEW + 1, 60):
        run = [f"r{i}" for i in range(k + 4)]
        texts.append(" ".join([*run, "gap", *run, "end", *run[: len(run) // 2]]))
    texts += [" ".join(draw.choice("ab") for _ in range(n)) for n in (4, 5, 6, 9, 40, 300)]
    texts += [" ".join(draw.choice("abc") for _ in range(n)) for n in (12, 30, 80)]

    def plain(w, n=5):
        seen = {}
        for i in range(len(w) - n + 1):
            seen.setdefault(tuple(w[i : i + n]), []).append(i)
        return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + n)})

    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r[0]: r[1] for r in frame.select("doc_id", quality.repeated_words(quality.words(frame.text))).collect()}
    assert found == {i: plain(brute.words(t)) for i, t in enumerate(texts)}


def test_quality_score(spark):
    """The score from plain counts of buckets, which Spark's hash gives."""
    import math

    made = [(1, "a b c a"), (2, "b c d"), (3, None)]
    frame = spark.createDataFrame(made, DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    grams = {r[0]: r[1] for r in frame.select("doc_id", quality.ngrams(quality.words(frame.text), 64)).collect()}
    raw = [b for g in grams.values() for b in g]
    own = grams[1]
    ratio = lambda b: math.log((own.count(b) + 0.5) / (len(own) + 32)) - math.log((raw.count(b) + 0.5) / (len(raw) + 32))
    model = quality.model(frame, labels, 64)
    found = {r[0]: r[1] for r in frame.select("doc_id", quality.score(quality.words(frame.text), model)).collect()}
    assert found[3] is None
    for doc in (1, 2):
        assert abs(found[doc] - sum(map(ratio, grams[doc])) / len(grams[doc])) < 1e-4


def test_chat_round_trip(spark):
    import hashlib

    conv = {}
    source = table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()
    probe = "<|im_end|><|im_start|>assistant ok"
    for c, t, role, text in [*map(tuple, source), (-1, 0, "user", probe), (-1, 1, "assistant", probe)]:
        conv.setdefault(c, []).append((t, role or "", text or ""))
    want = []
    for c, turns in conv.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss)))
    assert got(registry.op4_chat(spark, SF), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == sorted(want)
    for text in ("<|im_end|>", "\\<|", "<\\|", "\\n\n", "\\\\<||>"):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


@pytest.mark.parametrize("sf", [SF, None])
def test_sharding(spark, docs, sf):
    made = docs.select("doc_id", "text") if sf else spark.createDataFrame([(i, "same " * 50) for i in range(3000)] + [(9000 + i, str(i)) for i in range(50)], DOCS)
    out = [r.asDict() for r in sharding.shard_digest(made).collect()]
    texts = dict(map(tuple, made.collect()))
    load, slots = [0] * 16, {}
    for r in out:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(out) == len(texts)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(load) / 16
    assert max(load) - mean <= max(r["size"] for r in out) + mean / 32


def test_warc(spark):
    pages = [(i, f"http://h/{i}", "p" * 1000 if i % 3 else f"q{i}" * 400) for i in range(30)] + [(30, "bad url\r\nX: 1", "small"), (31, None, "small"), (32, "u", None)]
    out = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    import hashlib

    assert len(out) == len(pages)
    for i, _, html in pages:
        raw = (html or "").encode()
        twin = max(j for j, _, h in pages if (h or "") == (html or ""))
        again = len(raw) >= 1000 and twin != i
        assert (out[i].payload_bytes, out[i].payload_digest, out[i].record_type, out[i].refers_to) == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", twin if again else None)


def test_html(spark):
    body = "The quick brown fox jumps over the lazy dog, again &amp; again, until the evening comes."
    html = f"""<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=x>Home</a></nav><header>Head</header>
      <article><h1>Title</h1><p>{body}</p><p>{body}
      second   line</p></article><aside>side</aside><div class="comments"><p>{body} reader</p></div><footer>foot</footer><script>var x = "<p>no</p>";</script></body></html>"""
    frame = spark.createDataFrame([(1, "u", html), (2, None, None), (3, "u", "")], "page_id long, url string, html string")
    out = {r.page_id: r for r in html_text.extract(frame).collect()}
    clean = body.replace("&amp;", "&")
    assert out[1].text == f"Title\n{clean}\n{clean} second line"
    assert (out[2].text, out[2].n_chars, out[3].text) == ("", 0, "") and out[1].n_chars == len(out[1].text)
    assert got(registry.op1_html_text(spark, SF), "page_id") == got(table(spark, SF, "pages"), "page_id")


def test_decontamination_finds_substitutions(spark):
    item = [f"k{i}" for i in range(30)]
    changed = [x if i % 9 else "zz" for i, x in enumerate(item)]
    made = [(1, "pre " + " ".join(item) + " post"), (2, "p q r " + " ".join(changed)), (3, " ".join(reversed(item))), (4, None), (5, "some other text " * 20)]
    frame = spark.createDataFrame([(*r, 1) for r in made], DOCS + ", item_id int")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (8, "")], "item_id long, text string")
    assert got(decontaminate.overlaps(frame, bench), "doc_id", "item_id") == [(1, 7), (2, 7)]
    assert got(decontaminate.clean(frame, bench), "doc_id") == [(3,), (4,), (5,)]
    assert decontaminate.clean(frame, bench.limit(0)).count() == 5


def test_decontamination_matches_exact_windows(spark, docs, rows):
    """Every document that holds 13 consecutive words of an item is found."""
    import re

    tok = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = {}
    for item, text in table(spark, SF, "benchmark").select("item_id", "text").collect():
        w = tok(text)
        for i in range(len(w) - 12):
            grams.setdefault(tuple(w[i : i + 13]), set()).add(item)
    want = set()
    for doc, text in rows:
        w = tok(text)
        want |= {(doc, i) for k in range(len(w) - 12) for i in grams.get(tuple(w[k : k + 13]), ())}
    assert want <= set(got(registry.op6_decontaminate(spark, SF), "doc_id", "item_id"))


def test_mixing_meets_targets(spark):
    out = registry.op5_mixing(spark, "/root/testdata/sf0.01").toPandas()
    total = out["n_tokens"].sum()
    for domain, share in registry.MIX_WEIGHTS.items():
        expected = (out["rate"] * out["n_tokens"] * out[f"p_{domain}"]).sum()
        assert abs(expected - share * total) < 0.01 * total
    assert (out["rate"] >= 0).all()


def test_mixing_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    docs = table(spark, sf, "documents")
    model = mixing.train(docs, labels.where("doc_id % 5 <> 0"))
    post = mixing.posteriors(docs.join(labels.where("doc_id % 5 = 0").select("doc_id").distinct(), "doc_id", "left_semi"), model)
    rows = post.join(labels.groupBy("doc_id").agg({"toxic": "max"}), "doc_id").select("p_toxic", "max(toxic)").collect()
    right = sum((p > 0.5) == bool(t) for p, t in rows)
    assert right / len(rows) > 0.95


def test_edges_run_everywhere(spark):
    """Nulls, empty and long texts, repeated rows and clashing columns."""
    frame = edge_frame(spark)
    labels = spark.createDataFrame([(4, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    n = len(EDGES)
    assert quality.judge(frame, labels).count() == n
    assert neardup.groups(frame).count() == n
    assert substring.remove_repeats(frame).count() == n
    assert suffix.remove_repeats(frame).count() == n
    assert sharding.assign_shards(frame).count() == n
    assert mixing.rates(frame, labels, {"clean": 1.0}).count() == n
    assert decontaminate.overlaps(frame, spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0
    empty = frame.limit(0)
    none = labels.limit(0)
    for out in (quality.judge(empty, none), neardup.groups(empty), substring.remove_repeats(empty), suffix.remove_repeats(empty), sharding.assign_shards(empty), mixing.rates(empty, none, {"clean": 1.0})):
        assert out.count() == 0


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    kept = corpus_pipeline.quality_rules(spark, docs, sf)
    assert kept.columns == docs.columns
    good = labels.where("quality = 1 and toxic = 0").select("doc_id").distinct()
    assert kept.join(good, "doc_id", "left_semi").count() >= 0.95 * docs.join(good, "doc_id", "left_semi").count()
    mixed = corpus_pipeline.mixing_to_targets(spark, kept, sf)
    assert mixed.join(good, "doc_id", "left_semi").count() >= 0.98 * kept.join(good, "doc_id", "left_semi").count()
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    assert mixed.join(toxic, "doc_id", "left_semi").count() <= 2
    assert mixed.count() == mixed.select("doc_id").distinct().count()
    out = corpus_pipeline.run(spark, sf)
    assert set(docs.columns) < set(out.columns)
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])
