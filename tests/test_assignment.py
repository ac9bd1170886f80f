"""greedy_match against a fold over all pairs."""

import numpy as np
import pytest

from cataloom.operators import match
from cataloom.plans import queries as plans


def brute(rows, least):
    v = {i: np.array(x, np.float64) for i, x in rows}
    used, out = set(), {}
    for q in sorted(i for i in v if i % 20 == 0):
        best = sorted((-round(float(v[q] @ v[t]), 9), t) for t in v if t % 20 and t not in used)
        if best and -best[0][0] >= least:
            used.add(best[0][1])
        out[q] = best[0][1] if best and -best[0][0] >= least else None
    return out


def test_copies_of_one_vector_all_find_a_target(spark, tmp_path):
    r = np.random.default_rng(4)
    vectors = r.normal(size=(300, 8))
    vectors[r.choice(300, 150, replace=False)] = vectors[0]
    rows = [(i, (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = brute(rows, 0.25)
    assert {x.query: x.target for x in plans.QUERIES["greedy_match"](spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize(("keep", "block"), [(2, 8), (64, 4096)])
def test_rounds_give_the_folds_choice(spark, keep, block):
    r = np.random.default_rng(6)
    pairs = [(int(q), int(t), float(s)) for (q, t), s in {(q, t): r.integers(1, 9) / 10 for q, t in r.integers(0, 30, (250, 2))}.items()]
    used, want = set(), {}
    for q in sorted({p[0] for p in pairs}):
        left = sorted((-s, t) for x, t, s in pairs if x == q and t not in used)
        if left:
            used.add(left[0][1])
            want[q] = left[0][1]
    got = match.assign_greedily(spark.createDataFrame(pairs, "query long, target long, score double"), keep=keep, block=block)
    assert {x.query: x.target for x in got.collect()} == want
