import numpy as np
import pytest

from swarmsift.llm import embed_dedup as E
from swarmsift.llm import queries

from .test_minhash_forest import smallest

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    n = {i: 0 for i, _, _ in rows}
    links = []
    good = [r for r in rows if r[1] is not None and r[2] is not None and len(r[1]) and None not in r[1]
            and np.isfinite(np.array(r[1], np.float64)).all() and np.any(r[1])]
    for lab in {(r[2], len(r[1])) for r in good}:
        part = [r for r in good if (r[2], len(r[1])) == lab]
        X = np.array([r[1] for r in part], np.float32).astype(np.float64)
        X /= np.linalg.norm(X, axis=1, keepdims=True)
        a, b = np.nonzero(np.triu(X @ X.T >= 0.98, 1))
        for i, j in zip(a, b, strict=True):
            links.append((part[i][0], part[j][0]))
            n[part[i][0]] += 1
            n[part[j][0]] += 1
    return n, smallest(links, n)


def check(got, rows):
    n, comp = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (n[r.vec_id], comp[r.vec_id], comp[r.vec_id] == r.vec_id), r
    return n


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.1"])
def test_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(queries.op3_embedding_dedup(spark, sf).collect(), rows)


def clusters(seed, groups, size, spread, dim=64):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        c = rng.standard_normal(dim)
        c /= np.linalg.norm(c)
        out += [(c + spread * rng.standard_normal(dim) / np.sqrt(dim)).astype(np.float32).tolist() for _ in range(size)]
    return out


def test_around_the_threshold_and_blocks(spark, monkeypatch):
    """Pairs whose cosines lie around 0.98, in cells compared block by block."""
    monkeypatch.setattr(E, "BLOCK", 40)
    vec = clusters(1, 60, 6, 0.145) + clusters(2, 1, 150, 0.13) + clusters(3, 2, 100, 0.05)
    rows = [(i, v, 1) for i, v in enumerate(vec)]
    n, comp = brute(rows)
    got = E.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    found, true = sum(r.n_links for r in got), sum(n.values())
    assert 0.999 * true <= found <= true
    assert sum(r.component_id == comp[r.vec_id] for r in got) >= 0.99 * len(rows)


def test_edges(spark, write_tables):
    nan, inf = float("nan"), float("inf")
    one = clusters(5, 1, 1, 0.1)[0]
    rows = [(0, one, 1), (1, one, 1), (2, [2 * x for x in one], 1), (3, one, 2), (4, one, None), (5, None, 1),
            (6, [0.0] * 64, 1), (7, [nan, *one[1:]], 1), (8, [inf, *one[1:]], 1), (9, [None, *one[1:]], 1), (10, [], 1),
            (11, [1.0, 0.0], 1), (12, [1.0, 0.0], 1), (13, [1.0, -0.0], 1), (14, [-1.0, 0.0], 1), (15, one, 1)]
    sf = write_tables(embeddings=(rows, SCHEMA))
    check(queries.op3_embedding_dedup(spark, sf).collect(), rows)
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_calibration():
    assert E.needed(8, 0.9973) == 7 or E.needed(8, 0.9973) == 6
    assert E.dims_for(10) == E.LEAST_DIMS and E.dims_for(10 ** 9) > 15


def test_an_id_with_two_vectors_links_for_both(spark):
    rng = np.random.default_rng(21)
    a, b = rng.standard_normal((2, 16))
    rows = [(1, a.tolist(), 0), (1, b.tolist(), 0), (2, (a * 1.001).tolist(), 0), (3, (b + 1e-4).tolist(), 0), (9, (-a).tolist(), 0)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (9, 0, 9, True)]


@pytest.mark.parametrize("dims", [4, 8, 18])
def test_recall_of_tables_and_count_at_the_threshold(dims):
    """Pairs at cosine 0.98 exactly: they share a cell of some table, and collide often enough."""
    rng = np.random.default_rng(dims)
    tables, half = E.tables_for(dims), E.SIGMAS * 0.2
    least = E.needed(E.COUNTED, 0.9973)
    met = enough = 0
    for _ in range(10):
        a = rng.standard_normal((1000, 64))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = rng.standard_normal((1000, 64))
        b -= (a * b).sum(1, keepdims=True) * a
        b = 0.98 * a + np.sqrt(1 - 0.98 ** 2) * b / np.linalg.norm(b, axis=1, keepdims=True)
        p, q = (E._project(x.tolist(), tables, dims) for x in (a, b))
        met += (E._cells(p, tables, dims, half) == E._cells(q, tables, dims, half)).any(1).sum()
        enough += ((np.abs(p - q)[:, :E.COUNTED] <= half).sum(1) >= least).sum()
    assert met >= 9990 and enough >= 9990


def test_cells_per_vector_are_the_tables():
    assert [E.tables_for(E.dims_for(n)) for n in (64_000, 10 ** 6, 10 ** 9)] == [7, 11, 27]
