"""Near copies of the pipeline's stage against all pairs of shingle sets."""

import random
from itertools import combinations

import pytest

import corpus_pipeline
from cataloom.llm import near_copies

from .test_exact import brute_components


def brute_kept(rows):
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    near = [(a, b) for a, b in combinations(sets, 2) if not sets[a] | sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return {i for i, r in brute_components(near, sets).items() if i == r}, near


def near_rows():
    r = random.Random(3)
    rows = [(900, ""), (901, " "), (902, "one two"), (903, "One TWO")]
    for g in range(40):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice((30, 120, 400)))]
        for k in range(4):
            changed = list(words)
            for _ in range(r.randrange(1 + len(words) // 45)):
                changed[r.randrange(len(words))] = f"n{r.random()}"
            rows.append((1000 + g * 4 + k, " ".join(changed)))
    return rows


def test_the_stage_drops_all_near_copies(spark):
    rows = near_rows()
    want, near = brute_kept(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert len(near) > 60 and {r.doc_id for r in kept.collect()} == want


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_awkward_rows(spark, monkeypatch, small):
    """Broadcast or shuffled: nulls, repeated rows, one doc_id for several texts, columns with clashing names."""
    monkeypatch.setattr(near_copies, "SMALL", small)
    rows = [(1, None, "x", "a"), (2, " ", "x", "b"), (None, "", "x", "c"), (3, "some words", "y", "d"), (3, "some words", "b", "d"), (3, "other words here", "z", "e"), (None, "one more", "q", "f"), (None, "one more", "q", "f"), (None, "last", None, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string, row_id string")
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, None, "x", "a"), (3, "some words", "b", "d"), (3, "other words here", "z", "e"), (None, "one more", "q", "f"), (None, "last", None, "g")], key=repr)
    assert near_copies.keep_one(docs.limit(0)).count() == 0


def test_large_groups_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "GROUP", 3)
    words = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join([*words[:i], "new", *words[i:]])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in near_copies.keep_one(docs).collect()] == [0]


@pytest.mark.parametrize("part", [2048, 20])
def test_copies_of_one_text_that_are_no_copies_of_each_other(spark, monkeypatch, part):
    """Only the text that all of them were made from connects them; it comes last."""
    monkeypatch.setattr(near_copies, "GROUP", 3)
    monkeypatch.setattr(near_copies, "PART", part)
    r = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(60):
        own = list(words)
        for k in r.sample(range(0, 295, 6), 6):
            own[k] = f"n{i}.{k}"
        rows.append((i, " ".join(own)))
    rows.append((99, " ".join(words)))
    want, near = brute_kept(rows)
    assert len(near) < 600 and want == {0}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in near_copies.keep_one(docs).collect()} == want
