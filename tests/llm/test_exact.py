"""HTML extraction, near-dedup, passages, packing, decontamination and top-k against brute force."""

import hashlib
import re
import time
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from cataloom.llm import components, decontaminate, html_extract, packing, simhash, suffix_dedup, topk

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, length int"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "w" * 100_000), (7, "x y z " * 30_000), (8, "a b c d e"), (8, "a b c d e"), (None, "a b c d e"), (None, None)]
    return spark.createDataFrame([(i, t, "en", "s", 0, "f", 1) for i, t in rows], DOCS)


# ---- HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header class="site-header"><p>Site</p></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="layout"><div class="post-{n}"><h1>A &amp; B {n}</h1><p>First   para,\n with <a href="x">a link</a> and some more words in it.<p>Second one &lt;x&gt; é.
<script>var a = "</p>";</script><ul><li>one<li>two</ul><form><input><p>Sign up</p></form><aside>Aside</aside></div><div class="sidebar"><p>Related stuff</p></div></div>
<section id="comments"><p>A reader says things, many of them, and at some length too, as readers do.</p></section><div class="ad">Buy</div><footer>Foot</footer></body></html>"""


def test_main_text(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE.format(n=i), "host", "text") for i in range(6)]
    rows += [(10, None, None, "h", ""), (11, "x", "", "", ""), (12, "http://z.org", "just text\n here", "", ""), (13, "http://h0.org/x", "<p>only</p>", "", ""), (13, "http://h0.org/x", "<p>only</p>", "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, path string")
    got = {r.page_id: r for r in html_extract.main_text(pages).collect()}
    for i in range(6):
        assert got[i].text == f"A & B {i}\nFirst para, with a link and some more words in it.\nSecond one <x> é.\none\ntwo"
        assert got[i].n_chars == len(got[i].text)
    assert [got[i].text for i in (10, 11, 12, 13)] == ["", "", "just text here", "only"]
    joined = {r.page_id: r for r in html_extract.main_text(pages, small_table=0).collect()}
    assert joined == got and html_extract.main_text(pages).count() == len(rows)
    assert html_extract.main_text(pages.limit(0)).count() == 0


def test_the_hosts_vote_decides_a_page(spark):
    """A page whose own best container is another one gives the text at its host's path; alone on its host it doesn't."""
    long = "<div class='archive'>" + "<p>old entries of the archive, one after the other, with many words</p>" * 40 + "</div>"
    odd = "<html><body>" + long + "<div class='post-99'><h1>New</h1><p>The entry itself.</p></div></body></html>"
    rows = [(i, f"http://h.org/{i}", f"<html><body><div class='post-{i}'><h1>N {i}</h1><p>An entry of some words, which are its text.</p></div></body></html>") for i in range(9)]
    rows += [(50, "http://h.org/odd", odd), (51, "http://alone.org/odd", odd)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[50] == "New\nThe entry itself." and got[51].startswith("old entries")
    few = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), small_table=1).collect()}
    assert few == got


@pytest.mark.parametrize("html", ["<div>" * 50_000 + "text", "<b>" * 20_000 + "text" + "</i>" * 20_000, "<ul><li>" * 20_000 + "text", '<div class="c1">' * 50_000 + "text", "<b>" * 10_000 + "<p>text"])
def test_deep_and_unclosed_markup_takes_linear_time(html):
    began = time.process_time()
    assert html_extract.extract(html, []) == "text"
    assert time.process_time() - began < 10
    assert max(map(len, html_extract.Page(html).path)) < 200


def test_hosts_vote_on_generalised_paths(spark):
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", PAGE.format(n=i)) for i in range(20)], "page_id long, url string, html string")
    host, _ = html_extract.host_and_path(pages["url"])
    winners = html_extract.winning_paths(pages.select("page_id", "html", host.alias("host"))).collect()
    assert [(r.host, r.winners[0].rpartition("/")[2]) for r in winners] == [("h.org", "div.post-N")]


def test_all_articles_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    plain = {}
    for r in pages.collect():  # these pages have one template
        body = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html_extract.entities.unescape(re.sub("<[^>]*>", "", re.sub("<br>", " ", x))).split()) for x in re.split("</?(?:p|h1)>", body)]
        plain[r.page_id] = "\n".join(x for x in blocks if x)
    assert {r.page_id: r.text for r in html_extract.main_text(pages).collect()} == plain


# ---- SimHash


def brute_fingerprint(text):
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_groups(rows):
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    near = [(a, b) for (a, x), (b, y) in combinations([p for p in prints if p[0] is not None], 2) if (x ^ y).bit_count() <= 4]
    return prints, brute_components(near, {i for i, _ in prints if i is not None})


def test_groups_of_near_copies(documents, awkward):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    base = rows[0][1].split()
    more = [(10_000 + k, " ".join(base[:k] + ["new"] + base[k:])) for k in range(0, 40, 4)]
    spark = documents.sparkSession
    for table in (documents.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")), awkward):
        own = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
        prints, root = brute_groups(own)
        by_print = {f: root[i] for i, f in prints if i is not None}
        want = sorted(((i, f"{f:016x}", by_print.get(f)) for i, f in prints), key=repr)
        assert sorted((tuple(r) for r in simhash.groups(table).collect()), key=repr) == want
    assert simhash.groups(awkward.limit(0)).count() == 0


def test_long_texts_are_hashed_in_stretches(monkeypatch):
    monkeypatch.setattr(simhash, "STRETCH", 50)
    for text in ("ab cd " * 200, "x" * 300, " y" * 77, "one two three"):
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


@pytest.mark.parametrize(("block_rows", "deal"), [(65_536, None), (300, None), (100, (6, 2)), (65_536, (7, 3))])
def test_the_index_loses_no_link(spark, block_rows, deal):
    r = np.random.default_rng(1)
    centres = r.integers(0, 2**63, 60, dtype=np.uint64)
    near = [int(c) ^ sum(1 << int(b) for b in r.choice(64, int(r.integers(0, 7)), replace=False)) for c in centres for _ in range(12)]
    hub = [int(x) & ~((1 << 51) - 1) & 0xFFF8_0000_0000_0000 | int(y) for x, y in zip([5 << 51] * 700, r.integers(0, 2**20, 700), strict=True)]  # one block of the first band
    prints = sorted({*near, *hub})
    table = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)), i) for i, p in enumerate(prints)], "fp long, node long")
    got = {x.node: x.root for x in components.components(simhash.links(table, block_rows=block_rows, deal=deal)).collect()}
    want = brute_components([(i, j) for (i, a), (j, b) in combinations(enumerate(prints), 2) if (a ^ b).bit_count() <= 4], range(len(prints)))
    assert {n: got.get(n, n) for n in want} == want


def test_deals_leave_as_many_bands_equal_as_they_need():
    assert [simhash.deals(n) for n in (10, 10**8, 10**9, 10**11)] == [(5, 1), (6, 2), (6, 2), (7, 3)]
    for bands, chosen in ((5, 1), (6, 2), (7, 3)):
        own = simhash.masks(bands, chosen)
        assert len(set(own)) == len(own) and sum(m.bit_count() for m in own) == 64 * len(own) * chosen // bands


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(50)] + [(7, 7)] + [(3, 2)] * 3
    table = spark.createDataFrame(pairs, "u long, v long")
    got = {r.node: r.root for r in components.components(table).collect()}
    assert got == {n: r for n, r in brute_components(pairs, {x for p in pairs for x in p}).items() if n != r}
    assert components.components(table.limit(0)).count() == 0


# ---- repeated passages


def brute_windows(rows):
    """{(doc_id, start): first place} of every window that stands at two places."""
    where = defaultdict(set)
    size = suffix_dedup.LENGTH
    for i, t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
        for k in range(len(w) - size + 1):
            where[tuple(w[k : k + size])].add((i, k))
    return {place: min(places) for places in where.values() if len(places) > 1 for place in places}


def brute_passages(windows):
    out, runs = set(), []
    for (i, k), (least, _) in sorted(windows.items()):
        if runs and runs[-1][0] == i and k <= runs[-1][2]:
            runs[-1] = (i, runs[-1][1], k + suffix_dedup.LENGTH, min(least, runs[-1][3]))
        else:
            runs.append((i, k, k + suffix_dedup.LENGTH, least))
    for i, a, b, least in runs:
        out.add((i, a, b, b - a, least))
    return out


def passage_rows(documents):
    rows = [(r.doc_id, re.sub("[\x1c-\x1f\x85\xa0\u2000-\u3000]", "-", r.text or "")) for r in documents.select("doc_id", "text").collect()]
    words = rows[3][1].split()
    rows += [(90_001, "Fresh start " + " ".join(words[:60]).upper() + " end"), (90_002, " ".join(f"n{i}" for i in range(49))), (90_003, " ".join(f"n{i}" for i in range(49)))]
    rows += [(90_004, " ".join(f"m{i}" for i in range(50))), (90_005, "x " + "\n".join(f"m{i}" for i in range(50)) + " y"), (90_006, "again " * 500)]
    twice = " ".join(f"t{i}" for i in range(60))
    rows += [(90_007, f"{twice} once {twice} more"), (90_008, "one two three " * 200), (90_009, "one two three " * 90 + "four")]
    return rows


def test_repeated_passages(spark, documents, awkward):
    rows = passage_rows(documents)
    got = suffix_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {tuple(r) for r in got.collect()}
    assert found == brute_passages(brute_windows(rows))
    assert {90_004, 90_005, 90_006, 90_007} <= {r[0] for r in found} and not {90_002, 90_003} & {r[0] for r in found}
    assert {tuple(r) for r in suffix_dedup.passages(awkward).collect()} == {(7, 0, 90_000, 90_000, 7)}
    assert suffix_dedup.passages(awkward.limit(0)).count() == 0
    same = spark.createDataFrame([(1, rows[3][1]), (1, rows[3][1]), (1, "other " * 60), (2, rows[3][1])], "doc_id long, text string")
    n = len(rows[3][1].split())
    assert sorted(map(tuple, suffix_dedup.passages(same).collect())) == [(1, 0, 60, 60, 1), (1, 0, n, n, 1), (2, 0, n, n, 1)]


@pytest.mark.parametrize(("range_rows", "chunk_rows", "run_rows", "bits"), [(10**6, 10**6, 10**6, 64), (10**6, 7, 10**6, 3), (40, 10**6, 5, 64), (25, 10, 1, 64)])
def test_windows_are_the_same_however_the_suffixes_are_split(spark, documents, range_rows, chunk_rows, run_rows, bits):
    """Also where only 3 bits of the first words' hash are kept, so that it takes different suffixes for equal."""
    rows = passage_rows(documents)
    found, ids = suffix_dedup._found(spark.createDataFrame(rows, "doc_id long, text string"), range_rows, chunk_rows, run_rows, bits)
    got = {}
    for r in ids.join(found, "mark").collect():
        for w in r.w or ():
            for k in range(w.start, w.stop):
                assert (r.doc_id, k) not in got
                got[r.doc_id, k] = (w.first_doc_id, w.first_start + k - w.start)
        for k in range(r["windows"] or 0) if r.own is not None else ():
            got.setdefault((r.doc_id, k), (r.own, k))
    assert got == brute_windows(rows)


# ---- packing


def test_every_piece_has_a_place(spark, documents, awkward):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    for table in (documents.select("doc_id", "text"), awkward):
        want = []
        for r in table.collect():
            ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
            for k in range(0, len(ids), 2048):
                part = ids[k : k + 2048]
                want.append((r.doc_id, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
        rows = packing.pack(table).collect()
        assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(want, key=repr)
        sequences = defaultdict(list)
        for r in rows:
            sequences[r.sequence_id].append((r.offset, r.length))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
    assert packing.pack(awkward.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abZÉé'’ .,\n\t!1½ﬁİß中 \u0301", max_size=60))
def test_ids_are_those_of_whole_texts(text):
    own = packing.encoder(packing.tokenizer_path())
    assert own.encode([text]) == [np.array(own.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), max_size=25))
def test_plans_are_tight(counts):
    groups = packing.plan(counts, 60)
    held = defaultdict(int)
    for bins, inside in groups:
        assert sum(s * n for s, n in inside) <= 60 and sum(n for s, n in inside if 3 * s > 60) <= 2
        for s, n in inside:
            held[s] += bins * n
    assert dict(held) == counts
    gaps = []  # best fit, piece by piece, in falling length
    for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else 60) - s)
    total = sum(s * n for s, n in counts.items())
    bins = sum(b for b, _ in groups)
    assert -(-total // 60) <= bins <= max(len(gaps) + 1, round(1.1 * len(gaps)))


# ---- decontamination


def brute_report(docs, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shapes = []
    for item_id, text in items:
        w = words(text)
        shapes.append((item_id, {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()))
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item_id, grams in shapes:
            for g in grams:
                for i in range(len(w) - len(g) + 1):
                    if w[i] == g[0] and tuple(w[i : i + len(g)]) == g:
                        hit |= set(range(i, i + len(g)))
                        found.add("" if item_id is None else str(item_id))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_decontamination(spark, documents, awkward):
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    more = [(500, "One-two"), (501, None), (502, "!!"), (503, "x y"), (None, "a b c d e"), (504, items[0][1]), (504, "é w " * 6)]
    docs = [(r.doc_id, r.text) for r in documents.collect()] + [(8_000, "x" + (items[1][1] or "") + "y, é W é w é w é w é w é w"), (8_001, "X,y;X y"), (8_002, "xx y x yy")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    big = spark.createDataFrame(items + more, "item_id long, text string")
    want = brute_report(docs, items + more)
    assert sorted((tuple(r) for r in decontaminate.report(table, big).collect()), key=repr) == want
    blocks = decontaminate.find_windows(table, big, block_chars=2000)
    assert {r.doc_id: (len(r.hits), len(r["items"])) for r in blocks.collect()} == {w[0]: (w[2], w[3]) for w in want}
    clean = decontaminate.drop_contaminated(table, big)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(w[0] for w in want if not w[5])
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert sorted((tuple(r) for r in decontaminate.report(awkward, big).collect()), key=repr) == brute_report(rows, items + more)
    assert decontaminate.drop_contaminated(awkward, big).schema == awkward.schema
    assert not any(r.contaminated for r in decontaminate.report(table, big.limit(0)).collect())
    assert decontaminate.report(table.limit(0), big).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab ", min_size=1, max_size=12), min_size=1, max_size=8), st.text(alphabet="abc ", max_size=300))
def test_wu_manber_finds_every_occurrence(patterns, text):
    patterns = sorted({p.encode() for p in patterns})
    matcher = decontaminate.WuManber(patterns)
    want = sorted((i, k) for k, p in enumerate(patterns) for i in range(len(text) - len(p) + 1) if text.encode().startswith(p, i))
    assert sorted(matcher.find(text.encode())) == want


# ---- top-k


def brute_nearest(rows, k=5, every=50):
    fine = [(i, [int(np.floor(float(c) * 256)) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for q, qv in fine:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(qv, v, strict=False)), i) for i, v in fine if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e6])
def test_nearest_is_exact(spark, scale):
    r = np.random.default_rng(2)
    vectors = np.round(r.normal(size=(400, 8)) * scale, 1)
    vectors[50:90] = vectors[100]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000, None), (1050, [float("nan")] * 8), (1100, [1.0, None]), (None, [1.0] * 8), (1150, [0.0] * 8)]
    table = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int")
    assert sorted(tuple(x) for x in topk.nearest(table).collect()) == brute_nearest(rows)


def test_nearest_over_chunks_and_blocks(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert sorted(tuple(x) for x in topk.nearest(table, chunk=60, block=2).collect()) == brute_nearest(rows)


def evaluated_share(vectors):
    """Share of (query, candidate) pairs whose product is computed, over chunks; the results are compared with all products."""
    v, ids = np.floor(vectors * 256).astype(np.int64), np.arange(len(vectors))
    top = float((v.astype(float) ** 2).sum(1).max())
    table = topk.pivot_table(v, topk.choose_pivots(v[np.random.default_rng(0).permutation(len(v))[: topk.SAMPLE]]), top)
    asked = ids % 50 == 0
    search = topk.Search(ids[asked], v[asked], table[asked], top, 5)
    for lo in range(0, len(v), 700):
        search.add(ids[lo : lo + 700], v[lo : lo + 700], table[lo : lo + 700])
    for i, q in enumerate(ids[asked]):
        want = sorted((-s, j) for j, s in enumerate((v @ v[q]).tolist()) if j != q)[:5]
        assert want == list(zip((-search.best[i]).tolist(), search.best_ids[i].tolist(), strict=True))
    return search.evaluated / (asked.sum() * len(v))


def test_pivots_eliminate_most_candidates(spark):
    r = np.random.default_rng(1)
    clustered = r.normal(size=(40, 64))[r.integers(0, 40, 3000)] + 0.3 * r.normal(size=(3000, 64))
    assert evaluated_share(clustered / np.linalg.norm(clustered, axis=1, keepdims=True)) < 0.1
    given_ = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").toPandas()
    assert evaluated_share(np.stack(given_.embedding.to_numpy()).astype(float)) < 0.35


def test_nearest_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.nearest(spark.createDataFrame([], schema)).count() == 0
    assert topk.nearest(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    assert [tuple(r) for r in topk.nearest(spark.createDataFrame([(0, [1.0]), (1, [-1.0])], schema)).collect()] == [(0, 1, 1, -65536)]
    assert topk.nearest(spark.createDataFrame([(1, None), (50, None)], schema)).count() == 0
