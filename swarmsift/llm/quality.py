"""Quality scores from a weak-label model.

1. Heuristic labellers vote good (1), bad (0) or abstain (2) on every document.
2. Expectation-maximisation over the counts of vote patterns of the whole corpus (at most
   3^labellers rows, whatever its size) estimates how often each labeller gives each
   vote on good and on bad documents, and the posterior of each pattern.
3. Posteriors label a bounded sample of documents (``sample_rows``, half from either side of
   0.5, in hash order), on which a linear scorer over hashed features is trained: shapes of words,
   pairs of neighbouring shapes, repeated neighbours and binned text statistics.
4. The scorer scores every whole document.

Defined results: null or empty text: scored like a text without words; null ids are
returned as null; repeated rows each get a row; if all documents look alike to the labellers the
posterior itself is constant and so is the score; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cut_lineage

BITS = 14
SAMPLE_ROWS = 6000
GOOD, BAD, ABSTAIN = 1, 0, 2
LABELLERS = ("upper case", "capital words", "symbols", "symbol words", "varied words", "repeated neighbours",
             "repeated lines", "top word", "bare symbols", "exclamations")
STATS = 13
_PLAIN = frozenset(b".,;:'\"-!?()")
_ALNUM = frozenset(b"0Aa")
_TABLE = bytes(48 if 48 <= c < 58 else 65 if 65 <= c < 91 else 97 if 97 <= c < 123 or c > 127 else c for c in range(256))


# ---------------------------------------------------------------- texts

class Texts:
    """Words of a batch of texts, with their codes and per-text statistics."""

    def __init__(self, texts: list[bytes]):
        split = [t.split() for t in texts]
        self.n = np.array([len(s) for s in split], np.int64)
        codes, self.uniq = pd.factorize(np.array([w for s in split for w in s] + [b""], object))
        self.codes = codes[:-1]
        self.edge = np.concatenate([[0], np.cumsum(self.n)])
        self.stats = np.array([self._stats(i, t) for i, t in enumerate(texts)]).reshape(len(texts), STATS)

    def _stats(self, i: int, text: bytes) -> tuple:
        """words, upper-case share, symbol share, share of distinct words per 100, share of
        repeated lines, share of bare symbols, share of the top word, exclamation share,
        mean word length, words per line, shares of words in capitals, of words with symbols
        and of words equal to the one before."""
        words = self.codes[self.edge[i]:self.edge[i + 1]]
        n = len(words)
        if not n:
            return (0.0,) * STATS
        raw = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        letters = raw[65:91].sum() + raw[97:123].sum() + raw[128:].sum() / 2
        plain = letters + raw[48:58].sum() + raw[9:14].sum() + raw[32] + sum(raw[c] for c in _PLAIN)
        size = max(1.0, raw[:128].sum() + raw[128:].sum() / 2)
        blocks = (np.arange(n) // 100) * np.int64(len(self.uniq) + 1) + words
        distinct = len(np.unique(blocks)) / n
        lines = [x for x in text.split(b"\n") if x.strip()]
        seen = len(set(lines))
        bare, capital, symbol = (x[words].sum() / n for x in self._kinds())
        again = (words[1:] == words[:-1]).sum() / n
        return (n, raw[65:91].sum() / max(1.0, letters), max(0.0, size - plain) / size, distinct,
                1 - seen / max(1, len(lines)), bare, np.bincount(words).max() / n,
                raw[33] / n, (size - raw[9:14].sum() - raw[32]) / n, n / max(1, len(lines)), capital, symbol, again)

    def _kinds(self):
        """Which distinct words are bare symbols, in capitals, hold symbols beside letters."""
        if not hasattr(self, "_k"):
            shapes = [set(w.translate(_TABLE)) for w in self.uniq]
            word = [bool(s & _ALNUM) for s in shapes]
            self._k = (~np.array(word), np.array([x and 97 not in s and 65 in s and len(w) > 1 for x, s, w in zip(word, shapes, self.uniq, strict=True)]),
                       np.array([x and not s <= _ALNUM | _PLAIN for x, s in zip(word, shapes, strict=True)]))
        return self._k


def votes(s: np.ndarray) -> np.ndarray:
    """Text x labeller votes from the statistics."""
    n = s[:, 0]

    def by(value, bad, good, high_is_bad=True, least=1):
        is_bad, is_good = (value > bad, value < good) if high_is_bad else (value < bad, value > good)
        return np.where(n < least, ABSTAIN, np.where(is_bad, BAD, np.where(is_good, GOOD, ABSTAIN)))
    out = np.stack([
        by(s[:, 1], 0.5, 0.12),
        by(s[:, 10], 0.4, 0.1),
        by(s[:, 2], 0.04, 0.01),
        by(s[:, 11], 0.2, 0.05),
        by(s[:, 3], 0.45, 0.55, False, 30),
        by(s[:, 12], 0.2, 0.05, True, 10),
        by(s[:, 4], 0.3, 0.1, True, 30),
        by(s[:, 6], 0.25, 0.2, True, 15),
        by(s[:, 5], 0.1, 0.02),
        by(s[:, 7], 0.3, 0.05),
    ], axis=1)
    out[n < 1] = BAD
    return out


# ---------------------------------------------------------------- label model

# A priori a labeller rarely calls a good document bad, and sees a part of the bad ones
# only, as each looks for one defect; worth PRIOR_SHARE times the documents.
PRIOR_SHARE = 1.0
PRIOR_GOOD = np.array([0.0005, 0.8, 0.1995])  # of bad, good, abstain on good documents
PRIOR_BAD = np.array([0.2, 0.64, 0.16])


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200):
    """Vote tables (labeller x class x vote), prior of good, posterior of each pattern;
    starts from: bad if any labeller says so."""
    q = np.where((patterns == BAD).any(axis=1), 0.1, 0.95)
    w = counts.astype(np.float64)
    pseudo = PRIOR_SHARE * w.sum()
    for _ in range(rounds):
        prior = np.clip((w * q).sum() / w.sum(), 1e-3, 1 - 1e-3)
        tables = np.empty((patterns.shape[1], 2, 3))
        tables[:, 1] = PRIOR_GOOD * pseudo * prior
        tables[:, 0] = PRIOR_BAD * pseudo * (1 - prior)
        for k in range(patterns.shape[1]):
            tables[k, 1] += np.bincount(patterns[:, k], w * q, 3)
            tables[k, 0] += np.bincount(patterns[:, k], w * (1 - q), 3)
        tables /= tables.sum(axis=2, keepdims=True)
        logit = np.full(len(patterns), np.log(prior / (1 - prior)))
        for k in range(patterns.shape[1]):
            logit += np.log(tables[k, 1, patterns[:, k]] / tables[k, 0, patterns[:, k]])
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        done = np.abs(new - q).max() < 1e-6
        q = new
        if done:
            break
    return tables, prior, q


# ---------------------------------------------------------------- scorer

_SHAPE = re.compile(rb"(.)\1+", re.S)


def shape(word: bytes) -> bytes:
    """Letters, digits and case folded to classes; runs shortened to two."""
    return _SHAPE.sub(rb"\1\1", word.translate(_TABLE))


def _bucket(x: bytes) -> int:
    return zlib.crc32(x) & ((1 << BITS) - 1)


def hashed(t: Texts):
    """Per text: buckets and values of its features, as (text, bucket, value) arrays."""
    own = [shape(w) for w in t.uniq]
    shapes, names = pd.factorize(np.array(own, object))
    one = np.array([_bucket(b"1" + x) for x in names], np.int64)
    seed = np.array([zlib.crc32(b"2" + x) for x in names], np.uint64)
    s = shapes[t.codes]
    doc = np.repeat(np.arange(len(t.n)), t.n)
    scale = 1.0 / np.maximum(1, t.n)
    same_text = doc[1:] == doc[:-1]
    pair = ((seed[s[:-1]] * np.uint64(0x9E3779B97F4A7C15) + seed[s[1:]] * np.uint64(0xC2B2AE3D27D4EB4F))
            >> np.uint64(64 - BITS)).astype(np.int64)
    again = (t.codes[1:] == t.codes[:-1]) & same_text
    bins = []
    for k in range(STATS):
        x = t.stats[:, k]
        b = np.floor(np.log2(1 + x) * 2) if k in (0, 8, 9) else np.floor(np.sqrt(np.clip(x, 0, 1)) * 12)
        bins.append([_bucket(b"s%d %d" % (k, v)) for v in b.astype(int)])
    rows = np.concatenate([doc, doc[1:][same_text], doc[1:][again], np.tile(np.arange(len(t.n)), STATS)])
    cols = np.concatenate([one[s], pair[same_text], np.full(int(again.sum()), _bucket(b"again")), np.array(bins, np.int64).ravel()])
    vals = np.concatenate([scale[doc], scale[doc[1:][same_text]], 4 * scale[doc[1:][again]], np.full(STATS * len(t.n), 0.3)])
    return rows, cols, vals


def train_scorer(feats: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 60, l2: float = 1e-5, seed: int = 2):
    """Logistic regression on soft labels (AdaGrad, mini-batches); the last weight is the bias."""
    rng = np.random.default_rng(seed)
    w, acc = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-6)
    for epoch in range(epochs):
        order = rng.permutation(len(feats))
        for lo in range(0, len(order), 64):
            part = order[lo:lo + 64]
            cols = np.concatenate([feats[i][0] for i in part])
            vals = np.concatenate([feats[i][1] for i in part])
            row = np.repeat(np.arange(len(part)), [len(feats[i][0]) for i in part])
            z = np.bincount(row, vals * w[cols], len(part)) + w[-1]
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            g = np.bincount(cols, vals * err[row], len(w)) + l2 * w
            g[-1] = err.sum()
            acc += g * g
            w -= 0.15 / (1 + epoch / 20) * g / np.sqrt(acc)
    return w


def score_texts(w: np.ndarray, texts: list[bytes]) -> np.ndarray:
    t = Texts(texts)
    rows, cols, vals = hashed(t)
    return 1 / (1 + np.exp(-np.clip(np.bincount(rows, vals * w[cols], len(texts)) + w[-1], -30, 30)))


# ---------------------------------------------------------------- Spark

def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))


def vote_table(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and the vote pattern as a string of digits."""
    def run(it):
        for pdf in batches(it, 5000, 4_000_000, "text"):
            v = votes(Texts(pdf["text"].tolist()).stats)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "pattern": ["".join(map(str, r)) for r in v.tolist()]})
    return _rows(docs, text, key).mapInPandas(run, "doc_id long, pattern string")


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, text: str = "text", key: str = "doc_id"):
    """(scorer weights or None without documents, vote tables, prior)."""
    table = cut_lineage(vote_table(docs, text, key), "votes")
    counts = sorted((r.pattern, r["n"]) for r in table.groupBy("pattern").agg(F.count("*").alias("n")).collect())
    if not counts:
        return None, None, None
    patterns = np.array([[int(c) for c in p] for p, _ in counts])
    tables, prior, post = expectation_maximisation(patterns, np.array([n for _, n in counts]))
    spark = docs.sparkSession
    posterior = F.broadcast(spark.createDataFrame(  # 3^labellers rows at most
        [(p, float(x)) for (p, _), x in zip(counts, post, strict=True)], "pattern string, posterior double"))
    able = table.filter("doc_id is not null").join(posterior, "pattern")
    side = [able.filter(c).orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id", "pattern").limit(sample_rows // 2)
            for c in ("posterior < 0.5", "posterior >= 0.5")]
    chosen = F.broadcast(side[0].unionByName(side[1]).groupBy("doc_id").agg(F.max("posterior").alias("posterior")))

    def features(it):
        for pdf in batches(it, 500, 4_000_000, "text"):
            rows, cols, vals = hashed(Texts(pdf["text"].tolist()))
            out = []
            for i in range(len(pdf)):
                mine = rows == i
                c, inv = np.unique(cols[mine], return_inverse=True)
                out.append((c.tolist(), np.bincount(inv, vals[mine]).tolist()))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "posterior": pdf["posterior"],
                                "cols": [o[0] for o in out], "vals": [o[1] for o in out]})

    found = _rows(docs, text, key).join(chosen, "doc_id").select("doc_id", "posterior", "text") \
        .mapInPandas(features, "doc_id long, posterior double, cols array<int>, vals array<double>").collect()
    found.sort(key=lambda r: (r.doc_id, r.cols))
    feats = [(np.array(r.cols, np.int64), np.array(r.vals)) for r in found]
    if not feats:
        w = np.zeros((1 << BITS) + 1)
        w[-1] = np.log(prior / (1 - prior))
        return w, tables, prior
    return train_scorer(feats, np.array([r.posterior for r in found])), tables, prior


def score(docs: DataFrame, weights, text: str = "text", key: str = "doc_id", least: float = 0.5) -> DataFrame:
    """doc_id, score, kept: one row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(it):
        for pdf in batches(it, 5000, 4_000_000, "text"):
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": score_texts(shared.value, pdf["text"].tolist())})
    return _rows(docs, text, key).mapInPandas(run, "doc_id long, score double") \
        .withColumn("kept", F.col("score") >= least)
