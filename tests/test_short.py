"""Short strings and short parts against trying them all."""

import random

from cataloom.operators import match


def test_short_names_by_their_places(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abAé ") for _ in range(rng.choice((1, 1, 2, 3, 3, 4, 6))))
    names, candidates = {word() for _ in range(60)}, {word() for _ in range(25)}
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "s string")
    got = {r.name: (r.distance, r.candidate) for r in match.nearest_names(frame(names), "s", frame(candidates), "s").collect()}
    want = {}
    for n in names:
        near = [(match.sliding_hamming(n, c), c) for c in candidates if n.strip() and c.strip()]
        if near and min(near)[0] <= 3:
            want[n] = min(near)
    assert got == want


def test_one_short_candidate_for_many_names(spark):
    names = spark.range(20_000).selectExpr("concat('name ', id) as s")
    got = match.nearest_names(names, "s", spark.createDataFrame([("zz",)], "s string"), "s")
    assert got.count() == 20_000 and got.where("candidate = 'zz' and distance = 2").count() == 20_000


def test_short_parts_by_an_automaton(spark, monkeypatch):
    monkeypatch.setattr(match, "AUTOMATON", 40)
    monkeypatch.setattr(match, "LONG", 12)
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("ab c\n") for _ in range(rng.randrange(40)))) for i in range(40)] + [(90, None), (91, "x" * 50)]
    parts = [(i, "".join(rng.choice("ab c") for _ in range(1 + i % 4))) for i in range(40)] + [(80, None), (81, ""), (82, "x" * 20), (83, "bab aab"), (84, "ab"), (85, "ab")]
    got = match.containing(spark.createDataFrame(texts, "t long, body string"), "t", "body", spark.createDataFrame(parts, "p long, said string"), "p", "said")
    assert {tuple(r) for r in got.collect()} == {(t, p) for t, body in texts for p, said in parts if body is not None and said and said in body}


def test_few_parts_read_each_text_once(spark, monkeypatch):
    """Parts of every number of words: one automaton has them all, where it has room; where it hasn't, the join over runs gives the rest."""
    rng = random.Random(4)
    some = lambda most: " ".join(rng.choice(("a", "bc", "d", "", "é\n")) for _ in range(rng.randrange(1, most)))
    texts, parts = [(i, some(40)) for i in range(60)] + [(90, None), (91, "")], [(i, some(12)) for i in range(60)] + [(80, None), (81, "")]
    frames = spark.createDataFrame(texts, "t long, body string"), spark.createDataFrame(parts, "p long, said string")
    want = {(t, p) for t, body in texts for p, said in parts if body is not None and said and said in body}
    generators = []
    for most in (500_000, 120, 1):
        monkeypatch.setattr(match, "AUTOMATON", most)
        got = match.containing(frames[0], "t", "body", frames[1], "p", "said")
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want and any(p.count(" ") > 3 for i, p in parts if p and (i in {r[1] for r in rows}))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        generators.append(plan.count("Generate explode"))
        if most == 500_000:
            assert plan.count("MapInArrow") == 1 and generators == [0]
    assert 0 < generators[1] < generators[2]
