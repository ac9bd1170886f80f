"""Strong components, closures and reachability against searches by hand, and the rounds that long ways take."""

import random

import pytest

from cataloom.operators import cycles


def reach(edges):
    """Least numbers of edges between nodes."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found = {}
    for start in out:
        level, depth = set(out[start]), 1
        while level:
            found |= {(start, x): depth for x in level}
            level, depth = {y for x in level for y in out.get(x, ())} - {y for x, y in found if x == start}, depth + 1
    return found


def frame(spark, edges):
    return spark.createDataFrame(list(edges), "src long, dst long")


def random_edges(n, m, seed):
    rng = random.Random(seed)
    return {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}


@pytest.mark.parametrize("n, m", [(6, 8), (30, 45), (40, 200)])
def test_random_graphs(spark, n, m):
    edges = random_edges(n, m, n)
    ways = reach(edges)
    df = frame(spark, edges)
    assert {tuple(r) for r in cycles.cyclic_edges(df).collect()} == {(a, b) for a, b in edges if (b, a) in ways or a == b}
    assert {(r.src, r.dst): r.depth for r in cycles.closure(df).collect()} == ways
    pairs = [(a, b) for a in range(0, n, 2) for b in range(0, n, 3)]
    got = cycles.ReachIndex(df).reaches(frame(spark, pairs * 2)).collect()
    assert {(r.src, r.dst): r.reached for r in got} == {p: p in ways for p in pairs} and len(got) == len(pairs)


def test_components_go_by_their_greatest_node(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (6, 7), (4, 5), (None, 1), (1, None), (1, 2)]
    assert {(r.node, r.component) for r in cycles.strong_components(frame(spark, edges)).collect()} == {(1, 3), (2, 3), (3, 3), (5, 5)}
    names = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    assert {(r.node, r.component) for r in cycles.strong_components(names).collect()} == {("a", "b"), ("b", "b")}
    none = frame(spark, [])
    assert cycles.strong_components(none).count() == cycles.closure(none).count() == cycles.ReachIndex(none).reaches(none).count() == 0


def test_a_node_between_two_cycles_is_on_none(spark):
    edges = [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4)]
    assert {tuple(r) for r in cycles.cyclic_edges(frame(spark, edges)).collect()} == {(1, 2), (2, 1), (4, 5), (5, 4)}


def test_a_long_chain_of_cycles_takes_few_rounds(spark):
    n = 10_000
    edges = [(2 * i, 2 * i + 1) for i in range(n)] + [(2 * i + 1, 2 * i) for i in range(n)] + [(2 * i + 1, 2 * i - 2) for i in range(1, n)]
    steps = cycles._Condensing(frame(spark, edges))
    steps.run()
    assert steps.rounds <= 3 and not steps.colourings
    parts = steps.components()
    assert parts.count() == 2 * n and parts.select("component").distinct().count() == n


def test_a_core_that_withstands_is_coloured(spark, monkeypatch):
    monkeypatch.setattr(cycles, "HOPS", 2)
    wide = [(2 * i + a, 2 * i + 2 + b) for i in range(40) for a in (0, 1) for b in (0, 1)] + [(60, 20)]
    got = {tuple(r) for r in cycles.cyclic_edges(frame(spark, wide)).collect()}
    ways = reach(wide)
    assert got == {(a, b) for a, b in wide if (b, a) in ways}
    steps = cycles._Condensing(frame(spark, [(a, b) for a in range(30) for b in ((a + 1) % 30, (a + 7) % 30)]))
    steps.run()
    assert steps.colourings == 1 and steps.components().select("component").distinct().count() == 1


def test_closures_double_their_depth(spark, monkeypatch):
    written = []
    keep = cycles.tabled
    monkeypatch.setattr(cycles, "tabled", lambda df, *a: written.append(1) or keep(df, *a))
    n = 300
    path = [(i, i + 1) for i in range(n)]
    got = cycles.closure(frame(spark, path))
    assert got.count() == n * (n + 1) // 2 and got.agg({"depth": "max"}).first()[0] == n
    assert len(written) <= 11
    assert {(r.src, r.dst) for r in cycles.closure(frame(spark, path), max_depth=3).collect()} == {(i, j) for i in range(n) for j in range(i + 1, min(n, i + 3) + 1)}
    assert {r.dst for r in cycles.upstream(frame(spark, path), frame(spark, [(7, 0)])).collect()} == set(range(7))


def test_a_long_way_is_found_in_few_rounds(spark, monkeypatch):
    n = 600
    index = cycles.ReachIndex(frame(spark, [(i, i + 1) for i in range(n)]))
    written = []
    keep = cycles.tabled
    monkeypatch.setattr(cycles, "tabled", lambda df, *a: written.append(1) or keep(df, *a))
    pairs = [(0, n), (n, 0), (17, 400), (500, 500), (400, 399), (n - 1, n)]
    got = {(r.src, r.dst): r.reached for r in index.reaches(frame(spark, pairs)).collect()}
    assert got == {(a, b): a < b for a, b in pairs}
    assert len(written) < 5 * 11


def test_pointers_stop_once_nothing_changes(spark, monkeypatch):
    """2,000 nodes in rings of four and in chains of eight: as many rounds as one way needs, not as all nodes have binary digits."""
    written = []
    keep = cycles.tabled
    monkeypatch.setattr(cycles, "tabled", lambda df, *a: written.append(1) or keep(df, *a))
    rings = [(4 * r + k, 4 * r + (k + 1) % 4) for r in range(250) for k in range(4)]
    chains = [(5000 + 9 * c + k, 5000 + 9 * c + k + 1) for c in range(125) for k in range(8)]
    got = {r.node: (r.to, r.low, r.ring) for r in cycles.followed(frame(spark, rings + chains).toDF("node", "to")).collect()}
    assert all(got[a][1:] == (a - a % 4, True) for a, _ in rings)
    assert all(got[a][0] == a - (a - 5000) % 9 + 8 and not got[a][2] for a, _ in chains) and len(got) == 2000
    assert len(written) <= 6


def test_closures_are_dealt_to_as_many_tasks_as_their_rows_need(spark, monkeypatch):
    monkeypatch.setattr(cycles, "ROWS", 40)
    parts = []
    keep = cycles._dealt
    monkeypatch.setattr(cycles, "_dealt", lambda df, *a: (lambda out: parts.append("REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()) or out)(keep(df, *a)))
    edges = random_edges(40, 90, 5)
    ways = reach(edges)
    assert {(r.src, r.dst): r.depth for r in cycles.closure(frame(spark, edges)).collect()} == ways
    assert any(parts) and len(ways) > 4 * 40
