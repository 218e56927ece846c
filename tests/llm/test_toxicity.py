import zlib

import numpy as np
import pytest

from swarmsift.llm import queries, toxicity

from .conftest import DOCS


@pytest.fixture(scope="module")
def held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op5_toxicity(spark, sf).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    return rows, labels, spark.read.parquet(f"{sf}/documents.parquet").count()


def test_held_out_accuracy(held_out):
    rows, labels, n = held_out
    assert len(rows) == n and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    test = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    pos, neg = [s for s, y in test if y], [s for s, y in test if not y]
    assert np.mean([s >= 0.7 for s in neg]) < 0.01
    assert np.mean([s >= 0.7 for s in pos]) > 0.8
    rank = np.searchsorted(np.sort(neg), pos).mean() / len(neg)
    assert rank > 0.95


def test_gradients():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in toxicity.init(3).items()}
    X = rng.standard_normal((9, 2 * toxicity.DIM))
    codes = rng.integers(0, 9, (toxicity.WINDOW, 5))
    up = rng.standard_normal(5)
    _, cache = toxicity.forward(p, X, codes, keep=True)
    g, dX = toxicity.backward(p, X, codes, cache, up)
    for k in [*g, "X"]:
        table = X if k == "X" else p[k]
        at = tuple(rng.integers(0, n) for n in table.shape)
        old, eps = table[at], 1e-5
        table[at] = old + eps
        a = toxicity.forward(p, X, codes)[0] @ up
        table[at] = old - eps
        b = toxicity.forward(p, X, codes)[0] @ up
        table[at] = old
        assert (a - b) / (2 * eps) == pytest.approx((dX if k == "X" else g[k])[at], rel=1e-3, abs=1e-6), k


def test_windows_cover_every_word():
    for n in range(0, 140):
        codes, uniq, counts = toxicity.words_of([b" ".join(b"w%d" % i for i in range(n)), b"x"])
        win, doc = toxicity.window_codes(codes, counts)
        seen = {uniq[c] for c in win[:, doc == 0].ravel()} - {b""}
        assert len(seen) == n


def test_edges(spark, write_tables):
    rows = [(0, None, None, None, None), (1, "", None, None, None), (1, "", None, None, None),
            (2, "idiot " * 30_000, None, None, None), (None, "x", None, None, None)]
    sf = write_tables(documents=(rows, DOCS), labels=([(0, 1, None), (7, 0, 1)], "doc_id long, quality int, toxic int"))
    out = queries.op5_toxicity(spark, sf).collect()
    assert len(out) == 5 and all(r.score == 0 and r.predicted == 0 for r in out)
    docs = spark.createDataFrame([], DOCS)
    assert toxicity.score(docs, toxicity.init() | {"pool": np.zeros(5)}).count() == 0


def test_keep_clean_keeps_columns(spark):
    p = toxicity.init() | {"pool": np.array([9.0, 0, 0, 0, 0])}
    docs = spark.createDataFrame([(1, "a", None), (2, None, 5)], "doc_id long, text string, `c1` long")
    assert toxicity.keep_clean(docs, p).count() == 0
    kept = toxicity.keep_clean(docs, p | {"pool": np.array([-9.0, 0, 0, 0, 0])})
    assert kept.schema == docs.schema and sorted(map(tuple, kept.collect())) == [(1, "a", None), (2, None, 5)]
