import numpy as np
import pytest

from swarmsift.llm import decontaminate as D
from swarmsift.llm import queries

from .conftest import DOCS

PUNCT = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return [w for w in (x.strip(PUNCT) for x in low.replace("\x0b", " ").split()) if w]


def best(item, doc):
    """Least word edit distance of item to any run of doc (Sellers)."""
    row = [0] * (len(doc) + 1)
    for i, x in enumerate(item, 1):
        cur = [i]
        for j, y in enumerate(doc, 1):
            cur.append(min(row[j - 1] + (x != y), row[j] + 1, cur[-1] + 1))
        row = cur
    return min(row)


def brute(docs, items):
    out = {}
    for d, t in docs.items():
        w = words(t)
        for i, u in items.items():
            v = words(u)
            if v and len(set(v) & set(w)) * 2 >= len(set(v)):
                e = best(v, w)
                if e <= len(v) // 5:
                    out[d, i] = e
    return out


def edited(rng, item, k, vocabulary):
    w = list(item)
    for _ in range(k):
        i, kind = rng.integers(0, len(w)), rng.integers(0, 3)
        new = vocabulary[rng.integers(len(vocabulary))]
        if kind == 0:
            w[i] = new
        elif kind == 1:
            w.insert(i, new)
        elif len(w) > 1:
            del w[i]
    return w


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.distance for r in queries.op7_decontaminate(spark, sf).collect()}
    assert got == brute(docs, items) and got


def test_recall_with_edits():
    """Passages edited as far as allowed, among words of the same vocabulary."""
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [" ".join(rng.choice(vocabulary, rng.integers(12, 60))) for _ in range(80)]
    docs = {}
    for d in range(240):
        w = items[d % 80].split()
        w = edited(rng, w, int(rng.integers(0, len(w) // 5 + 1)), vocabulary)
        docs[d] = " ".join([*rng.choice(vocabulary, rng.integers(0, 80)), *w, *rng.choice(vocabulary, rng.integers(0, 80))])
    want = brute(docs, dict(enumerate(items)))
    f = D.Index([(i, t.encode()) for i, t in enumerate(items)]).find([t.encode() for t in docs.values()])
    got = {(r.text, r.item): r.distance for r in f.itertuples()}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want)
    assert np.mean([got[k] == want[k] for k in got]) > 0.95


def test_recall_of_every_length():
    """Copies edited as far as allowed: long items among short ones reach RECALL too."""
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(20_000)]
    sizes = [10, 200]
    items = [list(rng.choice(vocabulary, n)) for n in sizes for _ in range(10)]
    index = D.Index([(i, " ".join(t).encode()) for i, t in enumerate(items)])
    for at, n in enumerate(sizes):
        docs = [" ".join([*rng.choice(vocabulary, 9), *edited(rng, items[10 * at + c % 10], n // 5, vocabulary), *rng.choice(vocabulary, 9)])
                for c in range(100)]
        f = index.find([t.encode() for t in docs])
        found = set(zip(f.text, f.item, strict=True))
        assert sum((c, 10 * at + c % 10) in found for c in range(100)) >= 100 * D.RECALL, n


def test_distances_are_exact_within_the_bound():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 25))
        k = n // 5
        a, w = rng.integers(1, 4, n), rng.integers(1, 4, n + k)
        if rng.random() < 0.7:
            w[:n] = a
        for _ in range(rng.integers(0, 4)):
            w = np.insert(w, rng.integers(0, len(w)), 9)[:n + k]
        d = int(D.distances(a[None].astype(np.uint64), w[None].astype(np.uint64), k)[0])
        row = list(range(len(w) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(w, 1):
                cur.append(min(row[j - 1] + (x != y), row[j] + 1, cur[-1] + 1))
            row = cur
        assert min(d, k + 1) == min(min(row), k + 1)


@pytest.mark.parametrize("block", [1_000_000, 10])
def test_edges(spark, block):
    items = [(1, "The quick, brown fox jumps over the lazy dog."), (2, None), (3, "..."), (4, "one two"), (5, "uniqueword"),
             (None, "alpha beta gamma delta epsilon"), (6, "The quick, brown fox jumps over the lazy dog.")]
    rows = [(0, None), (1, ""), (2, "x THE QUICK BROWN FOX jumps over a lazy dog y"), (3, "one\ttwo"), (3, "one\ttwo"), (4, "one or two"),
            (None, "say uniqueword."), (5, "filler " * 50_000 + "alpha beta gamma zeta epsilon"), (6, "dog lazy the over"), (7, "the quick brown")]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda x: tuple((v is None, v or 0) for v in x)
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in D.leaks(docs, bench, block_words=block).collect()), key=key)
    want = [(2, 1, 1), (2, 6, 1), (3, 4, 0), (3, 4, 0), (None, 5, 0), (5, None, 1)]
    assert got == sorted(want, key=key)
    kept = D.keep_clean(docs, bench, block_words=block)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == [0, 1, 4, 6, 7]
    assert D.leaks(docs.limit(0), bench).count() == 0 and D.leaks(docs, bench.limit(0)).count() == 0
    assert D.keep_clean(docs, bench.limit(0)).count() == len(rows)
