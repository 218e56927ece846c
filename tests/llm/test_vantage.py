import math

import numpy as np
import pytest

from swarmsift.llm import queries as Q
from swarmsift.llm import vantage as V

VECS = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5, every=50):
    """All pairs, plainly; (query's row, query_id, rank, vec_id, score)."""
    good = [(r, i, [float(np.float32(v)) for v in e]) for r, (i, e, *_) in enumerate(rows)
            if e and None not in e and np.isfinite(e).all() and any(v != 0 for v in e)]
    out = []
    for r, i, a in good:
        if i is None or i % every:
            continue
        near = []
        for s, j, b in good:
            if s != r and len(a) == len(b):
                dot = sum(x * y for x, y in zip(a, b, strict=True))
                near.append((-dot / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b))), j is None, j or 0, j))
        out += [(i, rank, j, -c) for rank, (c, _, _, j) in enumerate(sorted(near)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted([tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()], key=str)


def same(got, want):
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], atol=1e-12, rtol=0)


def clustered(n, dims, clusters, spread=0.25, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dims))
    x = centres[rng.integers(0, clusters, n)] + spread * rng.standard_normal((n, dims))
    return [(int(i), v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)]


def test_whole_table_equals_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    same(found(Q.op12_nearest_neighbours(spark, sf)), brute(rows))


def test_edges(spark):
    """Null, empty, zero and non-finite vectors, null ids, repeated ids and vectors, other lengths, ties."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (50, [2.0, 2.0]), (None, [3.0, 0.0]), (7, [4.0, 0.0]), (3, [4.0, 0.0]), (3, [4.0, 0.0]),
            (100, None), (150, []), (200, [0.0, 0.0]), (250, [1.0, None]), (300, [nan, 1.0]), (350, [inf, 1.0]),
            (400, [1.0, 2.0, 3.0]), (-50, [-1.0, 1e-20]), (450, [1e38, 1e38]), (1, [1e-30, 0.0])]
    df = spark.createDataFrame([(*r, 0, 1.0, "x") for r in rows], VECS + ", score double, query string")
    got = found(V.nearest(df))
    same(got, brute(rows))
    assert {x[0] for x in got} == {0, 50, -50, 450}
    assert V.nearest(df.limit(0)).collect() == []


def test_many_copies_and_ties(spark, monkeypatch):
    """A third of all rows are one vector; shards, leaves and batches are small."""
    for name, value in (("LEAST_ROWS", 40), ("LEAF", 8), ("BATCH", 3)):
        monkeypatch.setattr(V, name, value)
    rng = np.random.default_rng(5)
    rows = [(int(i), [1.0, 1.0, 0.5] if i % 3 == 0 else rng.integers(-2, 3, 3).astype(float).tolist()) for i in rng.permutation(420)]
    df = spark.createDataFrame([(*r, 0) for r in rows], VECS)
    same(found(V.nearest(df)), brute(rows))


def test_relaxed_factor_trades_recall_for_work():
    rows = clustered(6000, 16, 40)
    x = np.array([r[1] for r in rows], float)
    ids = np.arange(len(x))
    asked = ids[::50]
    work, recall = {}, {}
    exact = None
    for factor in (1.0, 2.0, 4.0):
        tree = V.Tree(x, ids, ids)
        score, at = tree.search(x[asked], asked, 5, factor)
        got = tree.ids[at]
        exact = got if exact is None else exact
        work[factor] = tree.compared / (len(asked) * len(ids))
        recall[factor] = np.mean([len(set(a) & set(b)) / 5 for a, b in zip(got, exact, strict=True)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    like = unit[asked] @ unit.T
    like[np.arange(len(asked)), asked] = -2
    assert np.array_equal(np.sort(exact), np.sort(np.argsort(-like, axis=1, kind="stable")[:, :5]))
    assert recall[2.0] >= 0.9 and work[4.0] < work[2.0] < work[1.0] < 0.6


def test_relaxed_search_reaches_recall_over_shards(spark, monkeypatch):
    monkeypatch.setattr(V, "LEAST_ROWS", 300)
    rows = clustered(2400, 12, 30, seed=3)
    df = spark.createDataFrame(rows, VECS)
    want = {(q, v) for q, _, v, _ in brute(rows)}
    got = {(q, v) for q, _, v, _ in found(V.nearest(df, factor=2.0))}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_factor_below_one_is_refused(spark):
    with pytest.raises(ValueError):
        V.nearest(spark.createDataFrame([], VECS), factor=0.5)
