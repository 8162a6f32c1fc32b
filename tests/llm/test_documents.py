"""Document operators (2, 3, 4, 7, 9, 10) and the pipeline against brute force or held-out labels."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from logloom.llm import language_id, media, ngram_join, pii, quality_classifier, quality_rules, queries, tables, textblocks

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# media


def test_media_payloads(request, spark, tmp_path):
    for table in ("docs", "hard"):
        df = request.getfixturevalue(table)
        df.write.mode("overwrite").parquet(f"{tmp_path}/{table}/documents.parquet")
        got = queries.op2_media_columns(spark, f"{tmp_path}/{table}").collect()
        want = []
        for r in df.collect():
            raw = (r.text or "").encode()
            payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
            want.append((r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), media.features(payload)))
        assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) for r in got), key=str) == sorted(want, key=str)
        assert all(len({(r.media_sha256, r.media_bytes) for r in got if r.payload_sha256 == d}) == 1 for d in {r.payload_sha256 for r in got})


def test_salted_join_equals_a_plain_one(spark):
    left = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 7}") for i in range(200)] + [(999, None)], "i long, k string")
    right = spark.createDataFrame([("hot", 1), ("k2", 2)], "k string, v int")
    got = tables.salted_join(left, right, ["k"], hot_rows=20, salts=5)
    assert sorted(map(str, got.select("k", "i", "v").collect())) == sorted(map(str, left.join(right, "k", "left").select("k", "i", "v").collect()))


@settings(max_examples=30, deadline=None)
@given(st.binary(min_size=0, max_size=1500))
def test_png_round_trip(data):
    payload = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
    assert media.from_png(media.to_png(payload)) == payload


def test_sequences_keep_order_and_captions(spark, sf):
    page = "<html><head><title>no</title></head><body>One <b>two</b><script>x()</script><figure><img src='sha256:aa' alt='old'><figcaption>new\n one</figcaption></figure>three<img src='sha256:zz' alt='z'><p>four</p></body></html>"
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p>broken <img src=q")], "page_id long, html string")
    got = {r.page_id: [(x["position"], x["kind"], x["text"], x["ref"], x["caption"]) for x in r["items"]] for r in media.parse_html(df, "page_id", "html").collect()}
    assert got[1] == [(0, "text", "One two", None, None), (1, "media", None, "sha256:aa", "new one"), (2, "text", "three", None, None), (3, "media", None, "sha256:zz", "z"), (4, "text", "four", None, None)]
    assert got[2] == got[3] == []
    read = spark.createDataFrame([("aa", 576)], "digest string, payload_bytes long")
    joined = media.resolve(media.parse_html(df, "page_id", "html"), "page_id", read).where("page_id = 1").orderBy("position").collect()
    assert [(r.position, r.digest, r.caption, r.payload_bytes) for r in joined] == [(1, "aa", "new one", 576), (3, "zz", "z", None)]
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert media.parse_html(pages, "page_id", "html").count() == pages.count()


# quality rules


def plain_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    found = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    cover = {j for i in range(len(words) - 4) if found[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    n, k = len(words), len(cover)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, k, n < 10 or 100 * k > 20 * n


@pytest.mark.parametrize("table", ["docs", "hard"])
def test_rule_counts(request, labels, table):
    df = request.getfixturevalue(table)
    got = quality_rules.apply_rules(df, labels)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    rows = got.collect()
    assert sorted((tuple(r[n] for n in names) for r in rows), key=str) == sorted(((r.doc_id, *plain_counts(r.text)) for r in df.collect()), key=str)
    assert not any(r.kept and r.base_failed for r in rows)


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 3])
def test_rules_score_is_the_mean_log_ratio(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(tables, "BROADCAST_ROWS", broadcast_rows)
    docs = [(i, "good words here " * 5) for i in range(20)] + [(i, "bad $$$ junk " * 5) for i in range(20, 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i < 20 else 0, 0) for i in range(40)] + [(3, 0, 0)], "doc_id long, quality int, toxic int")
    rules = quality_rules.Rules(bits=20, max_repeat_percent=100, weight=1.0)
    got = {r.doc_id: r for r in quality_rules.apply_rules(df, labels, rules).collect()}
    raw, good = Counter(), Counter()
    for i, t in docs:
        w = t.split()
        grams = w + [*zip(w, w[1:], strict=False)]
        raw.update(grams)
        if i < 20 and i != 3:
            good.update(grams)
    scale = good.total() / raw.total()
    for i, t in docs:
        w = t.split()
        grams = w + [*zip(w, w[1:], strict=False)]
        want = sum(np.log((good[g] + 1) / (raw[g] * scale + 1)) for g in grams) / len(grams)
        assert got[i].score == pytest.approx(want) and got[i].kept == (want >= rules.threshold)
    assert got[0].kept and not got[20].kept


def test_rules_without_labels_or_rows(docs, labels, none):
    assert all(r.score == 0 and r.kept == (not r.base_failed) for r in quality_rules.apply_rules(docs, labels.where("1 = 0")).collect())
    assert quality_rules.apply_rules(none, labels).count() == 0


# languages


def test_languages_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.op4_language_id(spark, sf).collect()]
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and 0.15 < len(held) / len(rows) < 0.35
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held) and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)


def test_language_cases(spark, docs, hard, none):
    model = language_id.train(docs, F.lit(True))
    got = {r.doc_id: r for r in language_id.identify(hard, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (1, 2, 3, 11))
    assert got[6].lang_pred == got[7].lang_pred == "en" and got[8].lang_pred in model.langs and got[4].kept == 1
    noise = spark.createDataFrame([(1, "xqzj wvkq jxzq qqxz zzkj " * 20)], "doc_id long, text string")
    assert language_id.identify(noise, model).first().rejected
    empty = language_id.train(none, F.lit(True))
    assert empty.langs == [] and {r.lang_pred for r in language_id.identify(hard, empty).collect()} == {"und"}
    assert language_id.identify(none, model).count() == 0


def test_rejection_outlasts_an_odd_learning_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, "".join(chr(0x4E00 + 37 * k) for k in range(300)), "fr")], docs.schema)
    for left_out in ("en", "es"):
        learn = F.col("lang") != left_out
        clean, spoiled = language_id.train(docs, learn), language_id.train(docs.unionByName(odd), learn)
        assert np.abs(clean.limit - spoiled.limit).max() < 0.1
        got = language_id.identify(docs, spoiled, keep=["lang"]).where("bits_per_char > 0").groupBy("lang").agg(F.avg(F.col("rejected").cast("int")).alias("share")).collect()
        assert all(r.share > 0.98 if r.lang == left_out else r.share < 0.01 for r in got)


def test_calibration_covers_all_rows(spark):
    texts = ["abab abba"] * 3_000 + ["zqxjkvwp"] * 10
    df = spark.createDataFrame([(i, t, "l") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = language_id.train(df, F.lit(True))
    own = float(model.measure(pa.array(texts[:1]))[0][0, 0])
    assert abs(model.limit[0] - 2 * own) < 0.02


def test_texts_without_a_letter_of_any_length(spark, docs):
    model = language_id.train(docs, F.lit(True))
    texts = [" ".join(c * 100) for c in "—€•😀①"] + ["1 — 2 € 3 • " * 500, "—" * 5000, "— " * 100 + "é", "— " * 100 + "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in range(7))
    assert got[7].lang_pred in model.langs and got[8].lang_pred in model.langs


def test_components_are_whole_or_fail(spark):
    path = spark.createDataFrame([((i * 37) % 101, ((i + 1) * 37) % 101) for i in range(100)], "a long, b long")
    with pytest.raises(RuntimeError, match="not settled"):
        ngram_join.components(path, most_rounds=1)
    assert {(r.id, r.component) for r in ngram_join.components(path).collect()} >= {(i, 0) for i in range(1, 101)}


def test_short_ipv6_addresses_are_candidates(spark):
    takes = ["2001:db8::1", "fe80::1", "::1", "2001:db8::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::4:5:6:7:8", "2001:DB8:0:0:8::417A", "1:2:3:4:5:6:7:8"]
    leaves = ["::", "std::vector", ":::1", "1::2::3", "1:2:3:4:5:6:7::8:9", "12345::1", "x::1", "12:30"]
    df = spark.createDataFrame([(i, f"host {t}, up") for i, t in enumerate(takes + leaves)], "doc_id int, text string")
    got = {r.doc_id: [(x.kind, x.start, x.found) for x in r.loose] for r in pii.candidates(df).collect()}
    assert [got[i] for i in range(len(got))] == [[("ip", 5, t)] for t in takes] + [[] for _ in leaves]


def test_kneser_ney_by_hand(spark):
    texts = ["abab ba", "aab b"]
    df = spark.createDataFrame([(i, t, "l") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = language_id.train(df, F.lit(True))
    counts = [Counter() for _ in range(5)]
    for t in texts:
        for w in t.split():
            s = "\x02\x02\x02" + w + "\x03"
            counts[4].update(s[i - 3 : i + 1] for i in range(3, len(s)))
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def p(g):
        out = 1 / (2.0 * (len(counts[1]) + 1))
        for n in range(1, 5):
            c, own = counts[n], g[4 - n :]
            n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            d = max(0.1, min(0.95, n1 / (n1 + 2 * n2) if n1 else 0.5))
            same = [x for x in c if x[:-1] == own[:-1]]
            if same:
                total = sum(c[x] for x in same)
                out = max(c[own] - d, 0) / total * (own in c) + d * len(same) / total * out
        return out

    grams = sorted(counts[4]) + ["\x02\x02az", "zzzz"]
    got = model.entropy(np.array([list(map(ord, g)) for g in grams], np.uint32))[:, 0]
    assert got == pytest.approx([-np.log2(p(g)) for g in grams])


# n-gram join


def plain_components(rows, percent=85):
    sets, inverted = {}, defaultdict(list)
    for i, text in rows:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
        for g in sets[i]:
            inverted[g].append(i)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, own in sets.items():
        for j, both in Counter(j for g in own for j in inverted[g] if j < i).items():
            if 100 * both >= percent * (len(own) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("chunk", [2048, 3])
def test_join_components(spark, docs, chunk):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
    near = [(10_000 + k, " ".join([*base * 2, *[f"v{j}" for j in range(k)]])) for k in range(12)]  # a chain
    rows = [(r.doc_id, r.text) for r in docs.collect()] + near + [(20_000, "Only Three words"), (20_001, "only three\nWORDS"), (20_002, ""), (20_003, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df, ngram_join.Settings(chunk=chunk)).collect()}
    assert got == plain_components(rows)
    assert got[20_001] == (1, 20_000) and got[20_002] == (0, 20_002)


def test_rows_that_share_an_id(spark, sf):
    text = " ".join(f"w{k}" for k in range(40))
    other = " ".join(f"x{k}" for k in range(40))
    rows = [(1, text), (1, other), (2, text + " more"), (3, other), (3, other), (4, "alone"), (4, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, ngram_join.jaccard_components(df).collect()))
    assert got == [(1, 37, 1), (1, 37, 1), (2, 38, 1), (3, 37, 1), (3, 37, 1), (4, 0, 4), (4, 0, 4), (4, 1, 4)]
    kept = corpus_pipeline.near_duplicates(spark, df, sf).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, text), (1, other), (4, "alone"), (4, None), (4, "")], key=str)


def test_join_of_long_sets_and_hot_lists(spark):
    """Long sets, and families that share most n-grams without linking, over tries of a few sets."""
    rng = np.random.default_rng(3)
    common = [f"c{k}" for k in range(400)]
    rows = [(i, " ".join([*common[: int(rng.integers(250, 400))], *[f"v{rng.integers(0, 60)}" for _ in range(int(rng.integers(0, 60)))]])) for i in range(50)]
    rows += [(1000 + i, " ".join(f"w{(k * 31 + 7) % 9973}" for k in range(9000 + 400 * i))) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain_components(rows)
    for chosen in (ngram_join.Settings(chunk=20, chunk_bytes=60_000),):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df, chosen).collect()} == want
    assert len({c for _, c in want.values()}) > 3


def test_cells_cover_all_pairs(spark):
    """Each pair of a list in size reach with an index side meets in a cell."""
    sizes = [100, 100, 101, 90, 86, 85, 84, 70, 118, 120, 400]
    rows = [(7, i, s, 8 * s, i % 3 != 2, len(sizes), 8 * sum(sizes), i) for i, s in enumerate(sizes)]
    hot = spark.createDataFrame(rows, "gram long, node long, size long, bytes long, index boolean, n long, list_bytes long, component long")
    cells = defaultdict(lambda: (set(), set()))
    for r in ngram_join._cells(hot, ngram_join.Settings(chunk=2)).collect():
        cells[r.name][r.role - 1].add(r.node)
    met = {(x, y) for stand, probe in cells.values() for x in probe for y in stand}
    for x, s in enumerate(sizes):
        for y, t in enumerate(sizes):
            if x != y and y % 3 != 2 and 85 * s <= 100 * t and t <= s:
                assert (x, y) in met
    assert all(len(part) <= 11 for pair in cells.values() for part in pair)


def test_join_cases(hard, none):
    got = sorted(map(tuple, ngram_join.jaccard_components(hard).collect()), key=str)
    want = plain_components([(i, t) for i, t in {(r.doc_id, r.text) for r in hard.collect()} if i is not None])
    assert len(got) == hard.count() and all(want[i] == (n, c) for i, n, c in got if i is not None)
    assert [g[2] for g in got if g[0] is None] == [None]
    assert ngram_join.jaccard_components(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 25), min_size=1, max_size=20), st.integers(0, 2)), min_size=2, max_size=14), st.sampled_from([50, 70, 85]))
def test_trie_join(sets, percent):
    keys = [np.array(sorted(s), np.uint64) for s, _ in sets]
    sizes = np.array([len(s) + k for s, k in sets])
    got = ngram_join.join_list(keys, sizes, np.arange(len(sets)), percent)
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i][0] & sets[j][0])
            if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    assert len({*zip(label, got.tolist(), strict=True)}) == len(set(label)) == len(set(got.tolist()))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in ngram_join.components(edges).collect()}
    assert all(got[i] == 1 for i in range(2, 61)) and got[101] == 100


# personal data

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(digits[::-1])) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain_spans(text):
    return [(k, a, b) for a, _, b, k in sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(BASE) for m in re.finditer(p, text or "") if passes(k, m[0]))]


MIXED = ["a@b.c@d.e x@y.z", "1.2.3.4.5.6.7.8 0001.002.3.255 1.2.3.256", "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111", "é😀 x@y.zz 😀+49 30 1234567", "1" * 400 + " a@" + "b." * 300 + "c", "x@y.z " * 700, "+1 2 +1234567890", "a" * 3000 + "@.x", "- 4-1-1-1-1111-1111-1111-1"]


@pytest.mark.parametrize("table", ["docs", "hard", "mixed"])
def test_base_spans(request, spark, table):
    df = spark.createDataFrame([*enumerate(MIXED)], "doc_id long, text string") if table == "mixed" else request.getfixturevalue(table)
    found = pii.annotate(pii.candidates(df, keep=["doc_id", "text"]), {})
    for r in found.collect():
        assert [tuple(x) for x in r.base] == plain_spans(r.text)
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))


def test_pii_random_texts(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ab1234 05.@+-()"), 60)) for _ in range(400)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert all([tuple(x) for x in r.base] == plain_spans(r.text) for r in pii.annotate(pii.candidates(df), {}).collect())


def test_weak_supervision_and_masking(spark, docs, none):
    extra = ["mail bob (at) mail (dot) com", "call 743 555 3824 or +1 743 555 3824", "Dear Dr. Anna Smith, hello", "order 1234567 of version 1.2.3.4"]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(extra * 20)], "doc_id long, text string"))
    weights = pii.train(pii.candidates(rows, keep=["doc_id"]))
    assert all(np.isfinite(w) for w in weights.values()) and {"email", "phone"} <= set(weights)
    got = pii.annotate(pii.candidates(rows), weights).withColumn("masked", pii.redacted(F.col("text"), F.col("spans")))
    for r in got.collect():
        want, at = "", 0
        for s in r.spans:
            want += r.text[at : max(at, s.start)] + (f"[{s.kind.upper()}]" if s.start >= at else "")
            at = max(at, s.end)
        assert r.masked == want + r.text[at:]
    assert pii.annotate(pii.candidates(none), pii.train(pii.candidates(none))).count() == 0


def test_reliabilities_find_the_better_labeler(spark):
    rng = np.random.default_rng(0)
    truth = rng.random(3000) < 0.6
    votes = [[int(v) for v in (1 if rng.random() < q else -1 for q in ((0.95, 0.9, 0.85, 0.6, 0.5) if t else (0.05, 0.1, 0.15, 0.4, 0.5)))] for t in truth]
    patterns = spark.createDataFrame([("email", v) for v in votes], "kind string, votes array<int>").groupBy("kind", "votes").agg(F.count("*").cast("double").alias("n"))
    r = pii.reliabilities(patterns).first()
    assert r.prior == pytest.approx(0.6, abs=0.05) and r.yes[2] > 0.9 and r.no[0] > 0.9 and abs(r.yes[14] - 0.5) < 0.06


# classifier


def test_classifier_separates_labels(spark, docs, labels):
    got = quality_classifier.classify(docs, labels, F.col("source"), F.col("lang"))
    assert set(docs.columns) < set(got.columns)
    rows = got.join(labels, "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.97 * len(rows)


def test_site_posteriors_shrink(spark):
    rows = [("big", "p", -3.0)] * 900 + [("big", "q", 3.0)] * 100 + [("bad", "p", 3.0)] * 300 + [("tiny", "p", 3.0), (None, None, -3.0)]
    sums, priors = quality_classifier.site_sums(spark.createDataFrame(rows, "host string, path string, evidence double"))
    got = sums.withColumn("odds", priors.path_odds(F.col("n"), F.col("s"), F.col("host_n"), F.col("host_s"))).collect()
    odds = {(r.host, r.path): r.odds for r in got}
    assert odds["big", "p"] < odds[None, None] < priors.base < odds["tiny", "p"] < odds["bad", "p"]


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 3])
def test_classifier_by_hand(spark, docs, labels, monkeypatch, broadcast_rows):
    """The fit by plain gradient steps, and each document's posterior from sums over all others."""
    monkeypatch.setattr(tables, "BROADCAST_ROWS", broadcast_rows)
    settings_ = quality_classifier.Settings()
    got = {r.doc_id: r for r in quality_classifier.classify(docs, labels, F.col("source"), F.col("lang"), settings_, keep=["doc_id"]).collect()}
    rows = docs.select("doc_id", "text", "source", "lang").collect()
    x = {r.doc_id: quality_classifier.features(pa.array([r.text], pa.string()))[0] for r in rows}
    truth = defaultdict(lambda: 1)
    for r in labels.where("quality is not null").collect():
        truth[r.doc_id] = min(truth[r.doc_id], r.quality)
    known = [i for i in truth if i in x]
    features, y = np.stack([x[i] for i in known]), np.array([truth[i] == 0 for i in known], float)
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-9
    z = (features - mean) / scale
    w, b = np.zeros(z.shape[1]), 0.0
    for _ in range(60_000):
        error = y - 1 / (1 + np.exp(-(z @ w + b)))
        w, b = w + 0.5 * (z.T @ error - settings_.ridge * w) / len(y), b + 0.5 * error.sum() / len(y)
    for i, f in x.items():
        assert got[i].evidence == pytest.approx(np.clip((f - mean) / scale @ w + b, -20, 20), abs=0.05)
    site = {r.doc_id: (r.source, r.lang) for r in rows}
    p = {i: 1 / (1 + np.exp(-r.evidence)) for i, r in got.items()}
    groups, hosts = defaultdict(list), defaultdict(list)
    for i, (host, path) in site.items():
        groups[host, path].append(p[i])
        hosts[host].append(p[i])
    n, share = len(p), sum(p.values()) / len(p)

    spread = sum(len(g) * (np.mean(g) - share) ** 2 for g in hosts.values()) / n
    noise = sum(share * (1 - share) for g in hosts.values()) / n
    a = max(share * (1 - share) / max(spread - noise, 1e-6) - 1, 1.0)
    around = {k: np.mean(hosts[k[0]]) for k in groups}
    spread = sum(len(g) * (np.mean(g) - around[k]) ** 2 for k, g in groups.items()) / n
    noise = sum(around[k] * (1 - around[k]) for k in groups) / n
    c = max(share * (1 - share) / max(spread - noise, 1e-6) - 1, 1.0)
    for i, (host, path) in site.items():
        of_host = (sum(hosts[host]) - p[i] + a * share) / (len(hosts[host]) - 1 + a)
        of_path = (sum(groups[host, path]) - p[i] + c * of_host) / (len(groups[host, path]) - 1 + c)
        odds = got[i].evidence + settings_.site_weight * (np.log(of_path / (1 - of_path)) - np.log(share / (1 - share)))
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-6) and got[i].kept == (got[i].score <= settings_.reject_above)


def test_classifier_cases(spark, hard, labels, none):
    got = quality_classifier.classify(hard, labels, F.col("source"), F.col("lang"))
    assert got.count() == hard.count() and len(set(got.columns)) == len(got.columns) and dict(got.dtypes)["kept"] == "boolean"
    assert quality_classifier.classify(none, labels, F.col("source"), F.col("lang"), keep=["doc_id"]).count() == 0
    assert quality_classifier.classify(hard, labels.where("1 = 0"), F.col("source"), F.col("lang"), keep=["doc_id"]).where("not kept").count() == 0


#: Every name that an operator of the pipeline gives or works with.
CLASHING = ["__text", "__text_", "__id", "__mark", "__quality", "__language", "__spans", "__site", "__evidence", "__host", "__path", "__sums", "__hot", "__salt", "base", "loose", "spans", "kept", "score", "evidence", "host", "path", "lang_pred", "rejected", "bits_per_char", "id", "mark", "node", "leader", "n", "component_id", "n_shingles", "class", "start", "length", "sequence_id", "offset", "ids_crc32", "doc_tokens", "quality", "Score", "gram", "size", "trusted", "bucket"]


def test_stages_keep_columns_of_any_name(spark, sf, docs):
    names = [c for i, c in enumerate(CLASHING) if c.lower() not in {x.lower() for x in CLASHING[:i]}]
    wide = docs.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id")).alias(c) for c in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        then = stage(spark, wide, sf)
        assert then.dtypes == wide.dtypes, name
        rows = then.collect()
        assert rows and all(r[c] == f"{c} {r.doc_id}" for r in rows[:50] for c in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, wide, sf).count() >= wide.count()


# pipeline


def test_pipeline_stages(spark, sf, docs, labels, staged):
    ids = []
    for name, then, now in staged:
        assert then.columns == docs.columns and then.dtypes == docs.dtypes, name
        ids.append({r.doc_id for r in now.collect()})
    kept = {r.doc_id: r.text for r in docs.collect()}
    want = {i for i, (_, c) in plain_components([(i, kept[i]) for i in ids[1]]).items() if i == c}
    assert ids[2] == want == ids[3]
    for r in now.collect():
        assert not plain_spans(r.text) and r.n_chars == len(r.text)
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(bad & ids[0]) <= 0.1 * len(bad) and len(good & ids[1]) >= 0.98 * len(good)
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
    assert {r.doc_id for r in pieces} == want


def test_pipeline_of_nothing_and_of_copies(spark, sf, docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("1 = 0"), sf).count() == 0, name
    twice = docs.unionByName(docs.where("doc_id % 7 = 0"))
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, twice, sf).collect()]
    assert sorted(got) == sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect())


def test_words_and_lines():
    words = textblocks.Words(*textblocks.flat(pa.array(["A b\x0bB", None, "é\xa0x"])), lower=True)
    assert words.counts().tolist() == [3, 0, 1] and words.chars().tolist() == [3, 0, 3]
