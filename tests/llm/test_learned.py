"""Language ID, personal data, quality and URL filters: brute force where results are fixed, held-out accuracy where they are learned."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cataloom.llm import langid, pii, quality, queries, url_filter

FOLDER = "/root/testdata/sf0.01"
AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out string, label int"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with those of results."""
    rows = [(1, None, None, None, None, 0.5, "x", 1), (2, "", "en", "a", 0, None, None, 0), (3, " 12 !", "en", "a", 5, 0.1, "y", 1)]
    rows += [(7, "the cat and the dog " * 20_000, "en", "a", 1, 0.2, "z", 0)] + [(8, "der Hund und die Katze", "de", "a", 22, 0.3, "z", 0)] * 2
    return spark.createDataFrame([*rows, (None, "the dog", "en", "a", 7, 0.0, "", 0)], AWKWARD)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = queries.QUERIES["op1_langid"](spark, FOLDER).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.lang and any(c.isalpha() for c in r.text)]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_edge_cases(spark, awkward):
    model = langid.train(awkward)
    rows = langid.identify(awkward, model).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 7, 8, 8]
    assert [r.lang_pred for r in rows][1:5] == ["und", "und", "und", "en"] and rows[0].held_out is False
    kept = langid.keep_identified(awkward, model=model)
    assert kept.schema == awkward.schema and kept.count() == 4
    assert langid.identify(awkward.limit(0)).count() == 0
    unlabelled = awkward.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def brute_bundle(text):
    """A text's vector, letter by letter: rolled, multiplied and added."""
    table, (_, _, one) = langid._symbols(), langid._letters()
    s = "".join(chr(table[ord(c)]) for c in text.lower())
    s = re.sub("\0+", "\0", f"\0{s}\0")
    return sum((np.roll(one[ord(a)], 2) * np.roll(one[ord(b)], 1) * one[ord(c)] for a, b, c in zip(s, s[1:], s[2:], strict=False)), np.zeros(langid.DIMENSIONS))


def test_bundles_of_many_distinct_trigrams(monkeypatch):
    """A text of mixed letters holds its vectors in blocks."""
    r = np.random.default_rng(1)
    text = "".join(map(chr, r.integers(97, 97 + 26, 3000))) + "".join(chr(c) for c in r.integers(0x0410, 0x0450, 3000))
    whole, _ = langid.bundles([text, "the cat"])
    monkeypatch.setattr(langid, "VECTORS", 100)
    assert np.allclose(langid.bundles([text, "the cat"])[0], whole)
    assert np.allclose(whole[0], brute_bundle(text))


def test_bundles_are_sums_of_bound_letters():
    texts = ["Der Hund, 12 Katzen!", "a", "ñandú été"]
    got, lettered = langid.bundles([*texts, "12", None])
    assert lettered.tolist() == [True, True, True, False, False]
    for row, text in zip(got, texts, strict=False):
        assert np.allclose(row, brute_bundle(text))


def brute_spans(text):
    """The contract's patterns as they stand."""
    patterns = (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    )
    out = []
    for kind, pattern in enumerate(patterns):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            checksum = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1]))
            fine = (True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True, 12 <= len(digits) <= 19 and checksum % 10 == 0, 9 <= len(digits) <= 15)
            if fine[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "Z", "0", "1", "9", "255", "256", ".", "..", "@", "-", " ", "+", "+4", "(", ")", "é", "4111 1111 1111 1111", "\n", "%", "_", "x@y.z", "1.2.3.4"]), max_size=40).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == brute_spans(text)


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_the_gradient_is_that_of_the_loss():
    tagger = pii.Tagger(1)
    r = np.random.default_rng(0)
    tagger.w = {k: v.astype(np.float64) for k, v in tagger.w.items()}
    ids, tags = r.integers(0, pii.SYMBOLS, (3, 7)), np.array([[0, 1, 2, 0, 3, 4, 0]] * 3)
    _, g = tagger.gradient(ids, tags)
    for name in ("embed", "out", "move", "xf", "hb", "bf"):
        at = tuple(r.integers(0, n) for n in tagger.w[name].shape) if name != "embed" else (ids[0, 2], 3)
        if name == "move":
            at = (1, 2)
        old, loss = tagger.w[name][at], []
        for step in (1e-4, -1e-4):
            tagger.w[name][at] = old + step
            loss.append(tagger.gradient(ids, tags)[0])
        tagger.w[name][at] = old
        assert g[name][at] == pytest.approx((loss[0] - loss[1]) / 2e-4, rel=0.02, abs=2e-4)


def test_personal_data_of_whole_documents(spark, tagger):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = pii.detect(docs, tagger).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        base = brute_spans(r.text or "")
        assert r.base_sha256 == hashlib.sha256(pii.listing(base).encode()).hexdigest()
        spans = [(int(a), pii.KINDS.index(k), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        assert set(base) <= set(spans) and spans == sorted(spans) and all(0 <= a < b <= len(r.text or "") for a, _, b in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_secret] == [sum(k == i for _, k, _ in spans) for i in range(5)]
        assert r.n_added == len(spans) - len(base)
    tokens = {(r.doc_id, m.start(1), m.end(1)) for r in rows for m in re.finditer('token = "([0-9a-f]{40})"', r.text or "")}
    secrets = {(r.doc_id, int(x.split(":")[1]), int(x.split(":")[2])) for r in rows for x in r.spans.split(",") if x.startswith("secret")}
    assert len(tokens & secrets) >= 0.9 * len(tokens) > 5 and len(secrets - tokens) <= 0.1 * len(tokens)


def test_disguised_items_in_whole_documents(spark, tagger):
    """Items that no pattern finds, put into documents that the network hasn't seen, and look-alikes."""
    texts = [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id >= 200").select("text").collect() if 200 < len(r.text or "") < 4000]
    r = np.random.default_rng(77)
    cases = []
    for text in texts * 2:
        item, before, after, kind = pii._made_up(r)
        at = text.find(" ", int(r.integers(0, len(text) - 100))) + 1
        if at and not pii.base_spans(item):
            cases.append((kind, f"{text[:at]}{before}{item}{after} {text[at:]}", at + len(before), at + len(before) + len(item)))
    found = pii.find([c[1] for c in cases], tagger)
    for kind in (0, 3, 4):
        exact = [(a, k, b) in every for (k, _, a, b), (_, every) in zip(cases, found, strict=True) if k == kind]
        assert len(exact) > 40 and np.mean(exact) >= 0.9, pii.KINDS[kind]
    assert np.mean([any(x < b and y > a for x, _, y in every) for (k, _, a, b), (_, every) in zip(cases, found, strict=True) if k < 0]) < 0.06


def test_spans_longer_than_a_window_are_put_together(tagger):
    code = "9f3b27c1d05e4a68" * 12
    _, every = pii.find([f'so it was, and token = "{code}" then came the end of it'], tagger)[0]
    assert [(k, b - a) for a, k, b in every] == [(4, len(code))]
    assert pii._joined([(0, 4, 128), (64, 4, 150), (70, 3, 80), (300, 4, 340)]) == [(0, 4, 150)]


def test_the_network_adds_spans(tagger):
    texts = [f"Ereren {w} thing on of the ({100 + i}) {200 + i}-{3000 + i} or inand there was it." for i, w in enumerate(["call", "the", "ions", "an", "with", "here"] * 5)]
    found = [{(k, t[a:b]) for a, k, b in every} for t, (_, every) in zip(texts, pii.find(texts, tagger), strict=True)]
    assert np.mean([any(k == 3 and "-3" in s for k, s in f) for f in found]) > 0.6
    plain = ["In 1999 the 3 rivers of 42 lands met, at 10:30, for 7.5 days.", "Version 1.2 of the 12 books.", "@ 7 pm"]
    assert all(not every for _, every in pii.find(plain, tagger))


def test_long_texts_are_tagged_beyond_the_first_window(tagger):
    text = "so it was with them. " * 3000 + "call (212) 555-0187 now " + "1 and 2 or 3 " * 50 + "x@y.org"
    base, every = pii.find([text], tagger)[0]
    assert base == brute_spans(text) and set(base) <= set(every)


def test_spans_that_are_no_numbers_raise_nothing(monkeypatch):
    """The network may call anything an address; what isn't four numbers is left out, and the rows beside it stay."""
    said = {"im. 33.77.44.36": False, "v1.2.3.4": False, "1.2.+3.4": False, "1.2.3.4\n5": False, "1..2.3": False, "1.2.3.256": False, "10. 0.0.001": True, "1.2.3.4": True}
    assert {s: pii._plausible(1, s) for s in said} == said
    monkeypatch.setattr(pii, "SURE", 0.0)
    r = np.random.default_rng(3)
    texts = ["".join(r.choice(list("0123456789.. +@azé\n"), 200)) for _ in range(200)]
    tagger = pii.Tagger(1)
    tagger.w["out"] *= 3  # an untrained network, sure of itself
    found = pii.find(texts, tagger)
    assert [b for b, _ in found] == [brute_spans(t) for t in texts] and any(len(every) > len(b) for b, every in found)


def test_reconciled_spans_do_not_overlap():
    found = {(0, 3, 10): 5.0, (8, 3, 20): 7.0, (21, 3, 30): 1.0, (29, 3, 33): 0.5, (40, 3, 50): 9.0}
    assert sorted(pii._reconcile(found, [(45, 0, 60)])) == [(8, 3, 20), (21, 3, 30)]


def test_redaction_keeps_columns(spark, awkward, tagger):
    docs = awkward.unionByName(spark.createDataFrame([(9, "write to a@b.org or 10.0.0.1", "en", "s", 28, 0.0, "", 0)], AWKWARD))
    out = pii.redact(docs, tagger)
    assert out.schema == docs.schema and out.count() == docs.count()
    assert out.where("doc_id = 9").first()[:5] == (9, "write to [EMAIL] or [IP]", "en", "s", 24)
    assert out.where("doc_id = 1").first().text is None
    assert pii.detect(docs.limit(0), tagger).count() == 0
    assert pii.detect(awkward, tagger).where("doc_id = 1").first().spans == ""


def test_redaction_stands_spans_that_are_no_numbers(spark):
    """The pipeline's stage keeps every row when the network calls odd strings addresses."""
    r = np.random.default_rng(4)
    rows = [(i, "".join(r.choice(list("0123456789.. +@azé\n"), 200))) for i in range(300)]
    network = pii.Tagger(1)
    network.w["out"] *= 100  # an untrained network, sure of itself
    got = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string"), network).collect()}
    assert got == {i: pii.redacted(t, every) for (i, t), (_, every) in zip(rows, pii.find([t for _, t in rows], network), strict=True)}
    assert any(t != got[i] for i, t in rows)


def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = queries.QUERIES["op5_quality"](spark, FOLDER)
    assert rows.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    known = rows.where("held_out").join(labels, "doc_id").toPandas()
    good, bad = (known[known.quality == q].score.to_numpy() for q in (1, 0))
    assert ((good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2) > 0.9
    assert (known.predicted == (known.score >= 0.5)).all() and known.score.between(0, 1).all()


def test_flat_trees_walk_as_nested_ones():
    r = np.random.default_rng(3)
    x = r.normal(size=(900, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = quality.boost(x, y, trees=20, depth=3)

    def walk(tree, row, node=0):
        if node >= model.feature.shape[1]:
            return model.value[tree][node - model.feature.shape[1]]
        return walk(tree, row, 2 * node + 1 + int(row[model.feature[tree][node]] > model.threshold[tree][node]))

    brute = [1 / (1 + np.exp(-(model.base + sum(walk(k, row) for k in range(20))))) for row in x[:50]]
    assert np.allclose(model.score(x[:50]), brute)
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.95


def test_quality_edge_cases(spark, awkward):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(awkward, none).collect()} == {0.5}
    labels = spark.createDataFrame([(2, 0, 0), (7, 1, 0), (8, None, 0), (None, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score(awkward, labels).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(awkward.limit(0), labels).count() == 0


def brute_judgement(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_url_rules(spark):
    urls = [None, "", "no scheme", "://", "http://", "http://COM/en/1", "http://a.example.com/en/7x", "http://example.com/en/8", "http://example.com/EN/7", "http://xcom/en/", "x://b.net?/de/",
            "http://a.ORG/es/1#/q", "http://example.net/de/88", "http://Éa.net/de/", "http://example.com", "http://u:p@h.org:80/es/"]
    model = url_filter.train(spark)
    pages = spark.createDataFrame([(i, u, "host", "rule") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    whole = spark.read.parquet(f"{FOLDER}/pages.parquet")
    for table in (pages, whole):
        wanted = {r.page_id: brute_judgement(r.url) for r in table.collect()}
        rows = url_filter.judge(table, model=model).collect()
        assert len(rows) == len(wanted)
        for r in rows:
            host, path, rule, verdict = wanted[r.page_id]
            assert (r.host, r.path, r.rule) == (host, path, rule)
            assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    assert url_filter.judge(pages.limit(0), model=model).count() == 0


def test_url_model_on_unseen_hosts(spark):
    rows = url_filter.labelled_urls()
    held = [r for r in rows if zlib.crc32(r[0].encode()) % 4 == 0]
    model = url_filter.train(spark, [r for r in rows if r not in held])
    scored = model.transform(url_filter.features(spark.createDataFrame(held, "host string, path string, label double"))).select("label", "prediction").collect()
    assert all(np.mean([r.label == r.prediction for r in scored if r.label == label]) > 0.88 for label in (0, 1))
    given_ = {r.host for r in url_filter.judge(spark.read.parquet(f"{FOLDER}/pages.parquet"), model=model).collect()}
    stems = {h.split(".")[-3] for h in given_ if h.count(".") > 1}
    assert not stems & {part for host, _, _ in rows for part in host.split(".")} and not given_ & {r[0] for r in rows}
    plan = url_filter.judge(spark.read.parquet(f"{FOLDER}/pages.parquet"), model=model)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_a_repeated_row_is_drawn_once_for_quality(spark):
    """Rows that come a thousand times count as one: the bound on the sample holds, and they weigh no more than others."""
    rows = [(i, ("good words in a row, " if i % 2 else "bad $$ ") * (1 + i % 5)) for i in range(3, 60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    once = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    often = quality.train(spark.createDataFrame(rows + rows[:1] * 1000, "doc_id long, text string"), labels)
    assert once.base == often.base and np.array_equal(once.value, often.value)


def test_url_rules_are_those_of_the_contract(spark):
    """Each rule's word, host and path, written out here once more; with the longest rule of each host and its shorter neighbour."""
    assert set(url_filter.RULES) == {("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")}
    wanted = {"http://a.com/en/1": "block", "http://example.com/en/77": "allow", "http://casino-slots.net/de/1": "allow", "http://example.net/de/7": "allow", "http://www.example.net/de/80": "block", "http://b.org/es/": "block"}
    pages = spark.createDataFrame(list(enumerate(wanted)), "page_id long, url string")
    assert {list(wanted)[r.page_id]: r.verdict for r in url_filter.judge(pages).collect()} == wanted
