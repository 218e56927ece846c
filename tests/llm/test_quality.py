import numpy as np

from swarmsift.llm import quality as Q
from swarmsift.llm import queries

from .conftest import DOCS


def test_against_labels(spark):
    """No label is used in fitting, so all labelled rows are held out."""
    sf = "/root/testdata/sf0.1"
    rows = queries.op1_quality(spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    pos = [r.score for r in rows if labels.get(r.doc_id) == 1]
    neg = [r.score for r in rows if labels.get(r.doc_id) == 0]
    assert np.mean([s >= 0.5 for s in pos]) > 0.99 and np.mean([s >= 0.5 for s in neg]) < 0.02
    assert np.searchsorted(np.sort(neg), pos).mean() / len(neg) > 0.98


def test_top_word_of_a_very_long_text():
    s = Q.Texts([b"a " * (1 << 22), b"a b"]).stats
    assert s[0, 6] == 1.0 and s[1, 6] == 0.5


def test_em_finds_planted_accuracies():
    """Labellers with known accuracies vote; EM gets back the classes and who is better."""
    rng = np.random.default_rng(1)
    n = 20_000
    y = rng.random(n) < 0.85
    see = [0.9, 0.8, 0.7, 0.6, 0.5]
    v = np.stack([np.where(y, np.where(rng.random(n) < 0.004, 0, 1), np.where(rng.random(n) < s, 0, 1)) for s in see], axis=1)
    pat, counts = np.unique(v, axis=0, return_counts=True)
    tables, prior, post = Q.expectation_maximisation(pat, counts)
    where = {tuple(p): q for p, q in zip(pat.tolist(), post, strict=True)}
    got = np.array([where[tuple(x)] for x in v.tolist()]) >= 0.5
    assert abs(prior - 0.85) < 0.05 and (got == y).mean() > 0.97
    assert np.all(np.diff(tables[:, 0, 0]) < 0)


def test_scorer_learns_soft_labels():
    rng = np.random.default_rng(2)
    texts = [(b"word " * 60 if i % 2 else b" ".join(rng.choice([b"alpha", b"beta", b"Gamma."], 60))) for i in range(300)]
    t = Q.Texts(texts)
    rows, cols, vals = Q.hashed(t)
    feats = [(cols[rows == i], vals[rows == i]) for i in range(300)]
    w = Q.train_scorer(feats, np.array([0.05 if i % 2 else 0.95 for i in range(300)]))
    s = Q.score_texts(w, texts)
    assert (s[1::2] < 0.3).all() and (s[::2] > 0.7).all()


def test_edges(spark, write_tables):
    rows = [(0, None, None, None, None), (1, "", None, None, None), (1, "", None, None, None), (None, "x y", None, None, None),
            (2, "The quick brown fox jumps. " * 40_000, None, None, None)]
    sf = write_tables(documents=(rows, DOCS))
    out = queries.op1_quality(spark, sf).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in out)
    empty = spark.createDataFrame([], DOCS)
    assert Q.fit(empty)[0] is None and Q.score(empty, np.zeros((1 << Q.BITS) + 1)).count() == 0
