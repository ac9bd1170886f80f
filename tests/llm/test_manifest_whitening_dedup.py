"""Merkle manifest, whitening and exact dedup against brute force, with awkward rows."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest

from cataloom.llm import cuckoo, merkle, queries, whitening

FOLDER = "/root/testdata/sf0.001"
SPEC = "doc_id long, source string, lang string, n_chars long, text string"


def sha(said: str) -> str:
    return hashlib.sha256(said.encode()).hexdigest()


def leaf(row) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, i):
    for level in tree[:-1]:
        lo = i // 16 * 16
        yield "".join(level[lo:i]), "".join(level[i + 1 : lo + 16])
        i //= 16


def brute_proofs(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append(row)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = levels([leaf(r) for r in sources[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, row in enumerate(sources[s]):
            path = [*siblings(trees[s], i), *siblings(top, k)]
            changed = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                changed = (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))
            at = leaf(changed)
            for before, after in path:
                at = sha(before + at + after)
            out.append((row[0], leaf(row), trees[s][-1][0], top[-1][0], sha("".join(b + a for b, a in path)), at, at == top[-1][0]))
    return out


def key(rows):
    return sorted(map(tuple, rows), key=repr)


def test_proofs_of_the_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = queries.QUERIES["op11_merkle"](spark, FOLDER).collect()
    assert key(got) == key(brute_proofs(rows))
    assert not all(r.verified for r in got) and any(r.verified for r in got)


@pytest.mark.parametrize("sizes", [(1,), (16,), (17, 1), (257, 15, 16), (1100, 3)])
def test_trees_of_any_size(spark, sizes):
    rows = [(1000 * k + i, f"s{k}", "en", i, f"Text {i}") for k, n in enumerate(sizes) for i in range(n)]
    got = merkle.prove(spark.createDataFrame(rows, SPEC).repartition(5)).collect()
    assert key(got) == key(brute_proofs(rows))


def test_awkward_leaves(spark):
    long = "Ünï " * 50_000
    rows = [(None, None, None, None, None), (1, None, "", 0, ""), (1, None, "", 0, ""), (1, None, "", 0, "other"), (None, "", "x", 5, long), (5, "é", "de", None, long), (-3, "a" * 300, None, 2, "A")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], SPEC + ", key int, digest int")
    assert key(merkle.prove(docs).collect()) == key(brute_proofs(rows))
    assert merkle.prove(docs.limit(0)).count() == 0 and merkle.manifest(docs.limit(0)).count() == 0


def test_manifest_has_every_node_once(spark):
    rows = [(i, "hot" if i % 3 else None, "en", i, str(i)) for i in range(700)]
    got = merkle.manifest(spark.createDataFrame(rows, SPEC)).collect()
    want = []
    roots = []
    for s in (None, "hot"):
        tree = levels([leaf(r) for r in rows if r[1] == s])
        roots.append(tree[-1][0])
        want += [(s, level, i, d, False) for level, ds in enumerate(tree) for i, d in enumerate(ds)]
    want += [(None, level, i, d, True) for level, ds in enumerate(levels(roots)) for i, d in enumerate(ds)]
    assert key(got) == key(want)


# ---- whitening


def brute_whiten(rows):
    """Rows (vec_id, component) to n, deviation, whitened up to its sign, and explained."""
    width = max((len(v) for _, v in rows), default=0)
    x = [(i, tuple(int(np.floor(256 * float(c))) for c in v) + (0,) * (width - len(v))) for i, v in rows]
    fit = sorted({v for _, v in x})
    n = len(fit)
    sums = [sum(c) for c in zip(*fit, strict=True)]
    # each row as n x - S, in whole numbers: exact up to the division
    y = np.array([[n * a - s for a, s in zip(v, sums, strict=True)] for v in fit], object)
    cov = np.array([[float(Fraction(int(c), n**3)) for c in row] for row in y.T @ y])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, v in x:
        z = [n * a - s for a, s in zip(v, sums, strict=True)]
        for k in range(min(4, width)):
            if values[k] > 1e-12 * values[0]:
                out.append((i, k + 1, n, sum(c * c for c in z), abs(float(np.array([c / n for c in z]) @ vectors[:, k]) / np.sqrt(values[k])), values[k] / values.sum()))
    return out


def close(got, want):
    got = sorted((r.vec_id is None, r.vec_id or 0, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got)
    want = sorted((r[0] is None, r[0] or 0, *r[1:]) for r in want)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-9)


def test_whitening_of_the_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    got = queries.QUERIES["op12_whitening"](spark, FOLDER).collect()
    close(got, brute_whiten(rows))
    assert len(got) == 4 * len(rows) and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-12


def test_awkward_vectors(spark):
    inf, nan = float("inf"), float("nan")
    bad = [(90, None), (91, [1.0, None]), (92, [nan, 1.0]), (93, [inf, 1.0])]
    good = [(1, [1.0, 2.0, 0.5]), (2, [1.0, 2.0, 0.5]), (3, [-0.001, -0.0, 3.0]), (None, [5.0]), (5, []), (1, [7.0, 7.0, -9.25])] * 2
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in bad + good], "vec_id long, embedding array<double>, x int, n int")
    got = whitening.whiten(df).collect()
    assert all(r.identity_error < 1e-12 for r in got)
    close(got, brute_whiten(good))
    for few in (bad, [], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, []), (2, [])]):
        assert whitening.whiten(spark.createDataFrame(few, "vec_id long, embedding array<double>")).count() == 0
    far = [(i, [1e18 * (-1) ** i, float(i)]) for i in range(5)]  # x at a long's limits, deviations beyond them
    got = whitening.whiten(spark.createDataFrame(far, "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in got} == {2**63 - 1} and all(abs(r.identity_error) < 1e-4 for r in got)


def test_sums_in_two_doubles(spark):
    """Far from the origin a plain sum loses what these keep; and sums of many tasks are joined in rounds."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (40, 2)) + 2**40
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(40)
    n, sums = whitening.exact_sums(df)
    assert (n, sums) == (len(x), [int(v) for v in x.astype(object).sum(0)])
    high, low = whitening.outer_product_sum(df, whitening.Centre(n, sums))
    y = [[Fraction(int(a)) - Fraction(s, n) for a, s in zip(r, sums, strict=True)] for r in x]
    for i in range(2):
        for j in range(2):
            assert abs(Fraction(float(high[i, j])) + Fraction(float(low[i, j])) - sum(r[i] * r[j] for r in y)) < Fraction(1, 2**70)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 40])
@pytest.mark.parametrize("kind", ["full", "diagonal", "low rank", "clustered", "ones"])
def test_eigen(n, kind):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n))
    a = {"full": a + a.T, "diagonal": np.diag(rng.integers(0, 3, n).astype(float)), "low rank": a[:, : n // 3] @ a[:, : n // 3].T, "clustered": 5 * np.eye(n) + 1e-12 * (a + a.T), "ones": np.ones((n, n))}[kind]
    values, vectors = whitening.eigen(a)
    assert np.allclose(values[::-1], np.linalg.eigvalsh(a) if n else values, atol=1e-12 * max(1, n))
    assert np.abs(vectors.T @ vectors - np.eye(n)).max(initial=0) < 1e-12 and np.abs(a @ vectors - vectors * values).max(initial=0) < 1e-11


# ---- exact dedup


def brute_dedup(rows):
    groups = {}
    for i, text in rows:
        text = text or ""
        groups.setdefault("".join(c for c in text if c not in " \t\n\x0b\x0c\r"), []).append((-len(text), i is None, i or 0))
    out = []
    for plain, members in groups.items():
        best = min(members)
        kept = False
        for m in sorted(members):
            out.append((None if m[1] else m[2], None if best[1] else best[2], len(members), not kept, sha(plain)))
            kept = True
    return out


def test_dedup_of_the_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op13_exact_dedup"](spark, FOLDER).collect()
    assert key(got) == key(brute_dedup(rows)) and any(r.group_size > 1 for r in got)


def test_awkward_texts(spark):
    rows = [(3, None), (2, ""), (9, " \t\n\x0b\x0c\r"), (None, "a b"), (7, "ab"), (7, "ab"), (7, " ab"), (8, "a b"), (None, "only"), (1, "z" * 200_000), (0, " " + "z" * 200_000)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, part int, digest int, row int")
    assert key(cuckoo.dedup(docs).collect()) == key(brute_dedup(rows))
    assert cuckoo.dedup(docs.limit(0)).count() == 0


def test_parts_meet(spark, monkeypatch):
    monkeypatch.setattr(cuckoo, "PART", 8)
    monkeypatch.setattr(cuckoo, "SHARD", 10)
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 40}" + " " * (i % 5)) for i in range(300)]
    assert key(cuckoo.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == key(brute_dedup(rows))


def test_index_grows_and_forgets():
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    index = cuckoo.CuckooIndex(2)
    for d in digests:
        index.add(d, 1, d)
    assert index.resizes > 5 and len(index) == 5000 and all(index.find(d) >= 0 for d in digests)
    assert all(index.remove(d, 1) for d in digests[::2]) and not index.remove(digests[0], 1)
    assert [index.find(d) >= 0 for d in digests] == [i % 2 == 1 for i in range(5000)]
    for d in digests[::2]:
        index.add(d, 2, d)
    assert len(index) == len(index.digests) == 5000 and all(index.find(d) >= 0 for d in digests)


def test_a_fingerprint_alone_is_no_hit():
    a = bytes(range(32))
    b = a[:10] + bytes(22)  # same fingerprint, same buckets
    index = cuckoo.CuckooIndex()
    index.add(a, 1, 0)
    assert index.find(b) < 0
    for k in range(40):  # more of them than two buckets hold, until other bits of the digest count
        index.add(a[:2] + k.to_bytes(8, "little") + bytes(22), 1, k)
    assert len(index) == 41


def test_updates_equal_a_new_index(spark):
    spec = "doc_id long, text string"
    first = [(i, f"t{i % 30}" + " " * (i % 4)) for i in range(120)] + [(500, "gone")]
    new = [(200 + i, f"t{i % 50}" + " " * (i % 6)) for i in range(60)]
    out = [r for r in first if r[0] % 3 == 0] + [(500, "gone")]
    live = [r for r in first + new if r not in out]
    frame = lambda rows: spark.createDataFrame(cuckoo.digested(spark.createDataFrame(rows, spec)).collect(), "doc_id long, digest binary, points long, row long, part long")
    index = cuckoo.update(cuckoo.build(frame(first)), frame(live), frame(new), frame(out))
    state = lambda df: key((bytes(r.digest), r.rows, r.points, r.doc_id) for r in df.collect())
    assert state(index) == state(cuckoo.build(frame(live)))
