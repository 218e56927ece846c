import hashlib

import numpy as np
import pytest

from swarmsift.llm import queries
from swarmsift.llm import suffix_dedup as S

from .conftest import DOCS


def brute(texts):
    low = {}
    for d, t in sorted(texts.items()):
        for i in range(len(t) - 49):
            low.setdefault(t[i:i + 50], d)
    out = {}
    for d, t in texts.items():
        c = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 49):
            if low[t[i:i + 50]] < d:
                c[i] += 1
                c[min(len(t), i + 50)] -= 1
        c = np.cumsum(c[:-1]) > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~c])
        runs = int(c[:1].sum() + (c[1:] & ~c[:-1]).sum())
        out[d] = (len(t), int(c.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def check(rows, texts):
    want = brute(texts)
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r
    return want


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_whole_table(spark, sf):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sum(w[1] for w in check(queries.op2_suffix_dedup(spark, sf).collect(), texts).values()) > 0


def random_texts(seed, n, alphabet="abc "):
    """Short alphabets and copied passages, so that strings share starts, middles and ends."""
    rng = np.random.default_rng(seed)
    letters = list(alphabet)
    out = ["".join(rng.choice(letters, rng.integers(0, 300)))]
    while len(out) < n:
        t = ""
        for _ in range(rng.integers(1, 5)):
            if rng.random() < 0.6:
                src = out[rng.integers(0, len(out))]
                a = rng.integers(0, len(src) + 1)
                t += src[a:a + rng.integers(30, 90)]
            else:
                t += str(rng.choice(letters)) * int(rng.integers(0, 120)) if rng.random() < 0.2 else \
                    "".join(rng.choice(letters, rng.integers(0, 60)))
        out.append(t)
    return out


@pytest.mark.parametrize("size", [100, 700, 3000, 2_000_000])
def test_random_texts_in_small_batches(spark, size):
    """Batches smaller than texts cut a text's strings; parts and batches vary."""
    order = np.random.default_rng(size).permutation(250)
    texts = {int(order[i]): t.encode() for i, t in enumerate(random_texts(size, 250))}
    docs = spark.createDataFrame([(d, t.decode()) for d, t in texts.items()], "doc_id long, text string")
    check(S.remove_repeats(docs.repartition(5), batch_bytes=size).collect(), texts)


def test_edges(spark, write_tables):
    a = "x" * 30 + "The quick brown fox jumps over the lazy dog again."
    texts = [a, "", "y" * 49, a[:49], a, "é" * 40, "é" * 30, "z" * 500, "z" * 60, "q" + a[30:] + "r", a * 3000]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    sf = write_tables(documents=(rows, DOCS))
    check(queries.op2_suffix_dedup(spark, sf).collect(), {i: t.encode() for i, t in enumerate(texts)})


def test_nulls_repeats_empty(spark):
    a = "The quick brown fox jumps over the lazy dog again, and again."
    docs = spark.createDataFrame([(None, a), (5, a), (5, a), (7, a), (8, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed) for r in S.remove_repeats(docs).collect())
    assert got == [(-1, 0), (5, 0), (5, 0), (7, len(a)), (8, 0)]
    assert S.remove_repeats(docs.limit(0)).count() == 0
    kept = S.remove_repeats(docs, with_text=True).filter("doc_id = 5").first().kept
    assert bytes(kept).decode() == a
