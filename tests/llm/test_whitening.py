import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from swarmsift.llm import queries as Q
from swarmsift.llm import whitening as W

VECS = "vec_id long, embedding array<float>, label int"


def random_symmetric(seed, d):
    m = np.random.default_rng(seed).standard_normal((d, d))
    return m + m.T


@given(st.integers(0, 10**6), st.integers(1, 14), st.floats(-3, 3))
@settings(max_examples=60, deadline=None)
def test_inertia_counts_eigenvalues_below(seed, d, shift):
    m = random_symmetric(seed, d)
    assert W.inertia_below(m, shift) == int((np.linalg.eigvalsh(m) < shift).sum())


def test_inertia_needs_pivots_of_two():
    assert W.inertia_below(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert W.inertia_below(np.zeros((3, 3)), 0.0) == 0 and W.inertia_below(-np.eye(3), 0.0) == 3


Q40 = np.linalg.qr(random_symmetric(1, 40))[0]
CASES = {
    "random": random_symmetric(2, 50) @ random_symmetric(2, 50),
    "rank 5": (lambda a: a.T @ a)(np.random.default_rng(3).standard_normal((5, 30))),
    "identity": np.eye(20),
    "equal eigenvalues": (Q40 * np.repeat([4.0, 4.0 - 1e-9, 2.0, 1.0], 10)) @ Q40.T,
    "graded": (Q40 * 10.0 ** -np.arange(40)) @ Q40.T,
    "tiny": 1e-200 * np.diag([3.0, 2.0, 1.0]),
    "one": np.array([[2.0]]),
}


@pytest.mark.parametrize("name", CASES)
def test_pairs_equal_a_dense_solver(name):
    v = (CASES[name] + CASES[name].T) / 2
    e, u = W.top_components(v)
    want = np.linalg.eigvalsh(v)[::-1]
    k = min(16, int((want > W.NULL_SPACE * want[0]).sum()))
    assert abs(len(e) - k) <= (1 if name == "graded" else 0)
    assert np.abs(e - want[:len(e)]).max() <= 1e-14 * want[0]
    assert np.abs(v @ u - u * e).max() <= 1e-12 * want[0]
    assert np.abs(u.T @ u - np.eye(len(e))).max() <= 1e-14


def test_intervals_cover_the_top_without_gaps():
    v = CASES["random"]
    cut = W.intervals(v, 16)
    e = np.linalg.eigvalsh(v)
    assert sum(c for _, _, c in cut) >= 16 and all(c <= W.BLOCK for _, _, c in cut)
    assert [int(((e > lo) & (e < hi)).sum()) for lo, hi, _ in cut] == [c for _, _, c in cut]


def test_a_missed_eigenvalue_is_noticed():
    with pytest.raises(ArithmeticError):
        W.feast(np.diag([3.0, 2.0, 1.0]), 0.5, 3.5, 2)  # there are three


def plain(rows, components=16):
    """The contract by numpy's dense solver."""
    good = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v, *_ in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    z = np.array(fit, float) - np.array(s) / n
    v = z.T @ z / n
    e, u = (x[..., ::-1][..., :components] for x in np.linalg.eigh(v))
    out = {}
    for i, x in good:
        dev = sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        w = (np.array(x) - np.array(s) / n) @ u / np.sqrt(e)
        out.setdefault(i, []).append((n, dev, w, e / np.trace(v)))
    return out


def check(df, rows, components=16):
    want, got = plain(rows, components), {}
    for r in df.collect():
        got.setdefault((r.vec_id, r.component), []).append(r)
    assert len(got) == len(want) * components
    sign = {}
    for (i, c), found in got.items():
        assert len(found) == len(want[i])
        assert sorted((r.n, r.deviation) for r in found) == sorted(x[:2] for x in want[i])
        for r, x in zip(sorted(found, key=lambda r: abs(r.whitened)), sorted(want[i], key=lambda x: abs(x[2][c - 1])), strict=True):
            sign.setdefault(c, math.copysign(1, r.whitened * x[2][c - 1]) if abs(x[2][c - 1]) > 1e-6 else None) or sign.pop(c)
            assert abs(r.whitened - sign.get(c, 1) * x[2][c - 1]) < 1e-8
            assert abs(r.explained / x[3][c - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    assert len({r.identity_error for rs in got.values() for r in rs}) == 1


def test_whole_table_equals_a_dense_solver(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(Q.op13_whitening(spark, sf), rows)


def test_edges(spark):
    """Nulls, non-finite entries, null ids, repeated ids, a third of all rows equal, extra columns."""
    rng = np.random.default_rng(8)
    nan, inf = float("nan"), float("inf")
    rows = [(i, rng.standard_normal(5).tolist()) for i in range(60)] + [(100 + i, [0.5, -0.25, 0.0, 1.0, -0.0]) for i in range(40)]
    rows += [(3, rows[4][1]), (None, rows[5][1]), (200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [nan] * 5), (203, [inf] * 5)]
    df = spark.createDataFrame([(i, v, 0, 7, "x") for i, v in rows], VECS + ", n long, x string").repartition(7)
    check(W.whiten(df, 5), rows, 5)
    assert len(W.whiten(df.filter("vec_id = 200 or vec_id > 201")).collect()) == 0
    one = W.whiten(df.filter("vec_id >= 100 and vec_id < 200"))  # one distinct vector: nothing to divide by
    assert one.collect() == [] and one.columns == [c.split()[0] for c in W.SCHEMA.split(", ")]


def test_lengths_are_whitened_among_themselves_and_null_space_left_out(spark):
    rng = np.random.default_rng(9)
    short = [(i, [float(x), float(x), 1.0]) for i, x in enumerate(np.linspace(-2, 2, 30))]  # rank one
    rows = short + [(100 + i, rng.standard_normal(2).tolist()) for i in range(20)] + [(900, [])]
    got = W.whiten(spark.createDataFrame([(*r, 0) for r in rows], VECS)).collect()
    assert {(r.vec_id < 100, r.component, r.n) for r in got} == {(True, 1, 30), (False, 1, 20), (False, 2, 20)}


def test_wide_entries(spark):
    rows = [(i, [25.0 * i, float(i % 7)], 0) for i in range(2000)]
    got = {r.vec_id: r for r in W.whiten(spark.createDataFrame(rows, VECS)).filter("component = 1").collect()}
    assert got[1999].deviation is None and got[1000].deviation is not None and got[0].identity_error < 1e-6
    with pytest.raises(Exception, match="beyond 2"):
        W.whiten(spark.createDataFrame([(0, [1e13], 0), (1, [0.0], 0)], VECS)).collect()
