"""Toxicity scores from a bidirectional gated recurrent network with attention
pooling over word and character inputs, trained here in numpy.

A text is cut into overlapping windows of ``WINDOW`` words, ``STRIDE`` apart,
to its end.  Each word enters as a hashed word vector (punctuation stripped)
next to the mean of its hashed character-trigram vectors; both directions of a
gated recurrent network read the window, attention over their states pools it
to one logit.  The text's score is a logistic function of a summary of all its
window logits (largest two, share and number of toxic ones).

Training sees a bounded, class-balanced sample of the labelled documents that
are not held out (``sample_rows`` of each class at most, in hash order, and
``sample_windows`` windows of each clean and toxic one); a document is a bag of windows of which
some may be toxic, so the loss is on the log-sum-exp of its window logits.
Scoring sees every window of every document.  The model (about 9 MB whatever
the data) is broadcast; texts are never shuffled.

Defined results: null or empty text: scored as one window of padding; null id:
not held out; repeated rows each get a row; rows without a label, and labels
that are null, are not trained on; without both classes to train on, every
score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, slices, tidy

WINDOW, STRIDE = 32, 24
WORD_BITS, CHAR_BITS = 18, 16
DIM, HIDDEN = 8, 8
THRESHOLD = 0.7
SAMPLE_ROWS, SAMPLE_WINDOWS = 2000, (32, 32)  # of clean and of toxic ones
PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())


# ---------------------------------------------------------------- inputs

def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word codes of all texts, the distinct words, and word counts per text."""
    split = [t.lower().split() for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    flat = np.array([w for ws in split for w in ws] + [b""], object)  # the last one pads
    codes, uniq = pd.factorize(flat)
    return codes.astype(np.int32), uniq, counts


def window_codes(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Step x window word codes over all texts, and the text of each window."""
    n_win = np.maximum(1, -(-(counts - (WINDOW - STRIDE)) // STRIDE))
    doc = np.repeat(np.arange(len(counts)), n_win)
    first = np.cumsum(counts) - counts
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
    at = (first[doc] + k * STRIDE) + np.arange(WINDOW)[:, None]
    pad = len(codes) - 1
    return codes[np.where(at < (first + counts)[doc], at, pad)], doc


def word_inputs(uniq) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per distinct word: word bucket, all its 3- and 6-gram buckets, and where each word's begin."""
    word = np.array([zlib.crc32(w.strip(PUNCT)) & ((1 << WORD_BITS) - 1) for w in uniq], np.int64)
    raw = np.frombuffer(b"".join(b"^" + w + b"$$$$$" for w in uniq), np.uint8).astype(np.uint64)
    each = np.array([len(w) + 1 for w in uniq], np.int64)
    tri = (raw[:-5] << np.uint64(16)) | (raw[1:-4] << np.uint64(8)) | raw[2:-3]
    six = (tri << np.uint64(24)) | (raw[3:-2] << np.uint64(16)) | (raw[4:-1] << np.uint64(8)) | raw[5:]
    grams = np.stack([tri, six], axis=1) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - CHAR_BITS)
    starts = np.cumsum(each + 5) - (each + 5)
    offsets = np.cumsum(each) - each
    idx = np.arange(int(each.sum())) + np.repeat(starts - offsets, each)
    return word, grams[idx].astype(np.int64).ravel(), 2 * offsets


# ---------------------------------------------------------------- network

def init(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    f32 = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    p = {"word": np.zeros((1 << WORD_BITS, DIM), np.float32), "char": f32(1 << CHAR_BITS, DIM, s=0.3)}
    for d in "fb":
        p["W" + d] = f32(2 * DIM, 3 * HIDDEN, s=0.35)
        p["U" + d] = f32(HIDDEN, 3 * HIDDEN, s=0.25)
        p["b" + d] = np.zeros(3 * HIDDEN, np.float32)
    return p | {"att": f32(2 * HIDDEN, s=0.3), "out": f32(2 * HIDDEN, s=0.3), "bias": np.zeros(1, np.float32)}


def embed(p, inputs) -> np.ndarray:
    word, tri, offsets = inputs
    n = np.diff(np.append(offsets, len(tri)))[:, None].astype(np.float32)
    chars = np.add.reduceat(p["char"][tri], offsets, axis=0) / n
    return np.concatenate([p["word"][word], chars], axis=1)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def _run(xw, codes, U, reverse, keep):
    """Hidden states per step; with ``keep`` also what the backward pass needs."""
    n, h = codes.shape[1], HIDDEN
    state = np.zeros((n, h), xw.dtype)
    states = np.empty((WINDOW, n, h), xw.dtype)
    cache = []
    for t in (reversed(range(WINDOW)) if reverse else range(WINDOW)):
        x = np.take(xw, codes[t], axis=0)
        s = state @ U
        g = x[:, :2 * h]
        g += s[:, :2 * h]
        g *= 0.5
        np.tanh(g, out=g)
        g += 1
        g *= 0.5
        z, r = g[:, :h], g[:, h:]
        new = np.tanh(x[:, 2 * h:] + r * s[:, 2 * h:])
        nxt = states[t]
        np.subtract(state, new, out=nxt)
        nxt *= z
        nxt += new
        if keep:
            cache.append((t, state, z, r, new, s[:, 2 * h:]))
        state = nxt
    return states, cache


def forward(p, X, codes, keep=False):
    """Logit of each window; X holds the input vector of each distinct word, ``codes`` is step x window."""
    hf, cf = _run(X @ p["Wf"] + p["bf"], codes, p["Uf"], False, keep)
    hb, cb = _run(X @ p["Wb"] + p["bb"], codes, p["Ub"], True, keep)
    H = np.concatenate([hf, hb], axis=2)  # step x window x state
    a = H @ p["att"]
    a = np.exp(a - a.max(axis=0))
    a /= a.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", a, H)
    logit = pooled @ p["out"] + p["bias"][0]
    return logit, (H, a, pooled, cf, cb)


def backward(p, X, codes, cache, dlogit):
    """Gradients of the dense parameters and of X."""
    H, a, pooled, cf, cb = cache
    g = {"bias": np.array([dlogit.sum()], np.float32), "out": pooled.T @ dlogit}
    dpool = dlogit[:, None] * p["out"]
    da = np.einsum("nh,tnh->tn", dpool, H)
    ds = a * (da - (a * da).sum(axis=0))
    g["att"] = np.einsum("tn,tnh->h", ds, H)
    dH = a[:, :, None] * dpool + ds[:, :, None] * p["att"]
    dX = np.zeros_like(X)
    h = HIDDEN
    for d, cs, lo in (("f", cf, 0), ("b", cb, h)):
        U = p["U" + d]
        dxw = np.zeros((len(X), 3 * h), X.dtype)
        dU = np.zeros_like(U)
        dstate = np.zeros((codes.shape[1], h), X.dtype)
        for t, prev, z, r, new, sn in reversed(cs):
            dh = dH[t, :, lo:lo + h] + dstate
            dn = dh * (1 - z) * (1 - new * new)
            dz = dh * (prev - new) * z * (1 - z)
            dr = dn * sn * r * (1 - r)
            dsum = np.concatenate([dz, dr, dn * r], axis=1)
            dU += prev.T @ dsum
            dstate = dh * z + dsum @ U.T
            dx = np.concatenate([dz, dr, dn], axis=1)
            order = np.argsort(codes[t], kind="stable")
            at = codes[t, order]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            dxw[at[first]] += np.add.reduceat(dx[order], first, axis=0)
        g["U" + d], g["W" + d], g["b" + d] = dU, X.T @ dxw, dxw.sum(axis=0)
        dX += dxw @ p["W" + d].T
    return g, dX


# ---------------------------------------------------------------- training

def train(bags: list[tuple[list[bytes], int]], seed: int = 7):
    """Fit on (window texts, label) bags: the network on three quarters, the
    pooling of window scores on the rest; None without both classes."""
    both = lambda part: len({y for _, y in part}) == 2
    if not both(bags):
        return None
    order = np.random.default_rng(seed).permutation(len(bags))
    cut = len(bags) * 3 // 4
    own, rest = [bags[i] for i in order[:cut]], [bags[i] for i in order[cut:]]
    p = train_network(own if both(own) else bags, seed=seed)
    p["pool"] = fit_pool(p, rest) if both(rest) else np.array([0, 1, 0, 0, 0], np.float64)
    return p


def fit_pool(p, bags, l2: float = 0.05) -> np.ndarray:
    """Logistic regression on the window-score summary of each bag (Newton steps)."""
    codes, uniq, counts = words_of([w for b in bags for w in b[0]])
    codes, of_text = window_codes(codes, counts)
    logit = window_logits(p, codes, uniq)
    F_ = summary(logit, np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])[of_text])
    y = np.array([b[1] for b in bags], np.float64)
    w = np.zeros(F_.shape[1])
    for _ in range(30):
        q = _sigmoid(F_ @ w)
        H = (F_ * (q * (1 - q))[:, None]).T @ F_ + l2 * len(y) / 100 * np.eye(len(w))
        w += np.linalg.solve(H, F_.T @ (y - q) - l2 * len(y) / 100 * w)
    return w


def summary(logit: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Per text: 1, largest and second largest window logit (scaled down),
    share of toxic windows, log of their number."""
    logit = np.clip(logit.astype(np.float64), -8, 8)
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    order = np.lexsort((-logit, doc))
    top = logit[order][first]
    n = np.diff(np.append(first, len(doc)))
    second = np.where(n > 1, logit[order][np.minimum(first + 1, len(doc) - 1)], -8.0)
    hot = np.add.reduceat(_sigmoid(logit), first)
    return np.stack([np.ones(len(n)), top, second, 4 * hot / n, np.log1p(hot)], axis=1)


def train_network(bags, epochs: int = 4, batch: int = 24, seed: int = 7):
    rng = np.random.default_rng(seed)
    p = init(seed)
    dense = [k for k in p if k not in ("word", "char")]
    m = {k: np.zeros_like(p[k]) for k in dense}
    v = {k: np.zeros_like(p[k]) for k in dense}
    acc = {k: np.full(p[k].shape[0], 1e-9, np.float32) for k in ("word", "char")}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        for lo in range(0, len(order), batch):
            part = [bags[i] for i in order[lo:lo + batch]]
            y = np.array([b[1] for b in part], np.float32)
            codes, uniq, counts = words_of([w for b in part for w in b[0]])
            codes, of_text = window_codes(codes, counts)
            bag = np.repeat(np.arange(len(part)), [len(b[0]) for b in part])[of_text]
            inputs = word_inputs(uniq)
            X = embed(p, inputs)
            logit, cache = forward(p, X, codes, keep=True)
            first = np.flatnonzero(np.r_[True, bag[1:] != bag[:-1]])
            top = np.maximum.reduceat(logit, first)
            e = np.exp(logit - top[bag])
            total = np.add.reduceat(e, first)
            pooled = top + np.log(total)
            err = (_sigmoid(pooled) - y) * (1 + 2 * y) / len(part)
            dlogit = ((e / total[bag]) * err[bag]).astype(np.float32)
            g, dX = backward(p, X, codes, cache, dlogit)
            step += 1
            for k in dense:
                gk = np.clip(g[k], -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk * gk
                p[k] -= (rate * (m[k] / (1 - 0.9 ** step))
                         / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
            word, tri, offsets = inputs
            n = np.diff(np.append(offsets, len(tri)))
            _adagrad(p["word"], acc["word"], word, dX[:, :DIM])
            _adagrad(p["char"], acc["char"], tri, np.repeat(dX[:, DIM:] / n[:, None], n, axis=0))
    return p


def _adagrad(table, acc, rows, grad, rate=0.1):
    order = np.argsort(rows, kind="stable")
    at = rows[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    g = np.add.reduceat(grad[order], first, axis=0)
    at = at[first]
    acc[at] += (g * g).mean(axis=1)
    table[at] -= rate * g / np.sqrt(acc[at])[:, None]


def window_logits(p, codes, uniq, chunk: int = 1024) -> np.ndarray:
    X = embed(p, word_inputs(uniq))
    return np.concatenate([forward(p, X, codes[:, lo:lo + chunk])[0] for lo in range(0, codes.shape[1], chunk)])


def score_texts(p, texts: list[bytes]) -> np.ndarray:
    """Score of each text, pooled from all its windows."""
    if p is None:
        return np.zeros(len(texts))
    codes, uniq, counts = words_of(texts)
    codes, doc = window_codes(codes, counts)
    return _sigmoid(summary(window_logits(p, codes, uniq), doc) @ p["pool"])


# ---------------------------------------------------------------- Spark

def training_bags(docs: DataFrame, labels: DataFrame, sample_rows: int, sample_windows: tuple[int, int]):
    """Windows of the sampled labelled documents, a list of bounded size."""
    able = labels.filter("doc_id is not null and toxic is not null") \
        .filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = [able.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample_rows)
            for y in (1, 0)]
    chosen = F.broadcast(pick[0].unionByName(pick[1]))  # 2 * sample_rows rows at most

    def cut(it):
        for pdf in batches(it, 500, 4_000_000, "text"):
            out = []
            for doc, y, text in zip(pdf["doc_id"], pdf["toxic"], pdf["text"], strict=True):
                words = text.lower().split()
                at = list(range(0, max(1, len(words) - (WINDOW - STRIDE)), STRIDE))
                if len(at) > sample_windows[int(y)]:
                    at = sorted(np.random.default_rng(doc % (1 << 32)).choice(at, sample_windows[int(y)], replace=False))
                out.append((doc, int(y), [b" ".join(words[k:k + WINDOW]) for k in at]))
            yield pd.DataFrame(out, columns=["doc_id", "toxic", "windows"])

    rows = docs.select("doc_id", "text").join(chosen, "doc_id") \
        .select("doc_id", "toxic", F.coalesce("text", F.lit("")).cast("binary").alias("text")) \
        .mapInPandas(cut, "doc_id long, toxic int, windows array<binary>") \
        .dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    return [([bytes(w) for w in r.windows], r.toxic) for r in rows]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_windows=SAMPLE_WINDOWS):
    return train(training_bags(docs, labels, sample_rows, sample_windows))


def score(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it):
        for pdf in batches(it, 5000, 4_000_000, "text"):
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"),
                                "score": score_texts(shared.value, pdf["text"].tolist())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return rows.mapInPandas(run, "doc_id long, score double").select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(docs.columns))]  # columns may have any names
    at = docs.columns.index(text)

    def keep(it):
        for batch in it:
            for part in slices(batch, at, 500, 1_000_000):
                got = score_texts(shared.value, [(t or "").encode() for t in part.column(at).to_pylist()])
                yield part.filter(pa.array(got < THRESHOLD))

    renamed = docs.toDF(*names)
    return renamed.mapInArrow(tidy(keep), renamed.schema).toDF(*docs.columns)
