"""Removal of repeated byte strings by bucket-pointer refinement.

Every byte covered by a string of ``SPAN`` bytes that also starts in a document with a
smaller id is removed; strings are judged on the input.

Suffixes are sorted into buckets by their first ``GRAM`` bytes; a bucket's identifier
is a hash, so that workers agree on it without a common sort.  Buckets are refined on
the bucket identifiers of later offsets, and refined identifiers are used again: 20
bytes and the 20 after them give 40, a 40 and the 40 ten bytes on give 50.  Most
suffixes never need it:

1. Of each run of SPAN-byte strings only the suffix with the smallest bucket in the
   string (its anchor) is placed in a bucket; equal strings choose the same one.  With
   it goes the hash of its context, the bytes of all strings that chose it.
2. An anchor whose whole context starts in a smaller document settles all its strings
   at once.  If its bucket has one context only, nothing is left to refine.
3. Only the first documents of the contexts in buckets that hold several are refined
   to SPAN bytes, string by string.

Documents lie in batches (compressed, written once, bucketed by batch so that results
come back to a batch without moving texts).  A batch sends each key once, with its
smallest document, whatever the number of copies in it; a key found in a third of all
documents is so many short entries per batch, not per document.  Keys are 96 bits.

Defined results: null or empty text: no bytes, the hash of nothing; null id: sorts
after all others, so it covers nothing, and nothing of it is removed; rows of one id do
not cover each other, and each gets a row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, groups_for, mix64, scratch_path

SPAN, GRAM = 50, 20
BATCH_BYTES = 1_000_000
PART_BYTES = 12_000_000       # text per part of the key space
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(42).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: list[np.ndarray] = []
NO_ID = np.iinfo(np.int64).max


def _powers(n: int):
    if not _POWERS or len(_POWERS[0]) < n:
        m = max(n, BATCH_BYTES + 1)
        _POWERS[:] = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(m, np.uint64(b))
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype=np.uint64))
    return _POWERS


class Batch:
    """Texts of a batch in one buffer, and the anchors of their strings."""

    def __init__(self, ids: np.ndarray, lens: np.ndarray, data: bytes, step: int = BATCH_BYTES):
        self.ids, self.lens, self.step = ids, lens, step  # hashes are made for ``step`` bytes at a time
        self.buf = np.frombuffer(data, np.uint8)
        self.first = np.cumsum(lens) - lens
        parts = []
        for lo in range(0, max(1, len(self.buf)), step):
            parts.append(self._anchors(lo, min(len(self.buf), lo + step + SPAN - 1)))
        self.start, self.n, self.bucket, self.context = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.doc = ids[np.searchsorted(self.first + lens, self.start, side="right")]

    def _hashes(self, lo: int, hi: int):
        b = self.buf[lo:hi]
        power, inverse = _powers(len(b) + 1)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * power[:len(b)], out=total[1:])
        return total, inverse

    def _anchors(self, lo: int, hi: int):
        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64))
        n = hi - lo - SPAN + 1
        if n < 1:
            return none
        # Strings that lie within one document.
        inside = np.zeros(n + 1, np.int32)
        a = np.clip(self.first - lo, 0, n)
        b = np.clip(self.first + self.lens - SPAN + 1 - lo, 0, n)
        fits = (self.lens >= SPAN) & (b > a)
        np.add.at(inside, a[fits], 1)
        np.add.at(inside, b[fits], -1)
        inside = np.cumsum(inside[:-1]) > 0
        total, inverse = self._hashes(lo, hi)
        m = len(total) - GRAM
        bucket = mix64((total[GRAM:] - total[:m]) * inverse[:m])
        low = np.uint64((1 << 22) - 1)
        least = (bucket & ~low) | np.arange(m, dtype=np.uint64)
        width, w = SPAN - GRAM + 1, 1
        while 2 * w <= width:
            least = np.minimum(least[:-w], least[w:])
            w *= 2
        if width > w:
            least = np.minimum(least[:n], least[width - w:width - w + n])
        at = (least & low).astype(np.int64)
        new = inside & np.r_[True, (at[1:] != at[:-1]) | ~inside[:-1]]
        # A string whose predecessor is in another document starts a run of its own.
        edge = self.first - lo
        edge = edge[(edge > 0) & (edge < n)]
        new[edge] = inside[edge]
        start = np.flatnonzero(new)
        if not len(start):
            return none
        stop = np.r_[start[1:], n]
        gap = np.concatenate([[0], np.cumsum(~inside)])
        size = stop - start - (gap[stop] - gap[start])  # strings of the run; gaps only follow a run
        context = mix64((total[start + size + SPAN - 1] - total[start]) * inverse[start] + size.astype(np.uint64))
        # Chosen as the smallest, these are small numbers: mixed again, they spread over all parts.
        return start + lo, size, mix64(bucket[at[start]] ^ np.uint64(_BASE)), context

    def strings(self, chosen: np.ndarray):
        """Start, refined bucket and second hash of every string of the chosen anchors."""
        size = self.n[chosen]
        offs = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        start = np.repeat(self.start[chosen], size) + offs
        bucket, second = np.empty(len(start), np.uint64), np.empty(len(start), np.uint64)
        for lo in range(0, max(1, len(self.buf)), self.step):
            hi = min(len(self.buf), lo + self.step + SPAN - 1)
            mine = np.flatnonzero((start >= lo) & (start < lo + self.step))
            if not len(mine):
                continue
            total, inverse = self._hashes(lo, hi)
            m = len(total) - GRAM
            once = mix64((total[GRAM:] - total[:m]) * inverse[:m])

            def twice(p, once=once):
                return mix64(once[p] * np.uint64(3) + once[p + GRAM])
            p = start[mine] - lo
            bucket[mine] = mix64(twice(p) * np.uint64(5) + twice(p + SPAN - 2 * GRAM))
            second[mine] = mix64((total[p + SPAN] - total[p]) * inverse[p])
        return start, np.repeat(self.doc[chosen], size), bucket, second


class Keys:
    """Distinct keys of a batch: smallest document of each, dealt to parts."""

    def __init__(self, k1, k2, doc, n_parts: int):
        order = np.lexsort((doc, k2, k1))
        a, b, d = k1[order], k2[order], doc[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.empty(0, bool)
        self.group = np.empty(len(a), np.int64)   # of each row: its key
        self.group[order] = np.cumsum(new) - 1
        self.k1, self.k2, self.doc = a[new], b[new], d[new]
        self.later = doc > self.doc[self.group] if len(a) else np.empty(0, bool)  # known within the batch
        self.part = ((self.k1 >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64)
        self.edge = np.searchsorted(self.part, np.arange(n_parts + 1))  # k1 ascends, so parts do

    def rows(self, batch: int):
        for p in np.flatnonzero(np.diff(self.edge)):
            s = slice(self.edge[p], self.edge[p + 1])
            yield int(p), batch, _planes(self.k1[s], 6) + _planes(self.k2[s], 6) + _planes(self.doc[s], 8)

    def flags(self, replies) -> np.ndarray:
        out = np.zeros(len(self.k1), np.uint8)
        for r in replies:
            out[self.edge[r["part"]]:self.edge[r["part"] + 1]] = np.frombuffer(r["flags"], np.uint8)
        return out[self.group] if len(self.group) else np.empty(0, np.uint8)


def _planes(x: np.ndarray, n: int) -> bytes:
    """The low n bytes of each number, byte by byte, which compresses well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _unplanes(data: bytes, n: int, at: int, size: int) -> np.ndarray:
    out = np.zeros((size, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8, n * size, at).reshape(n, size).T
    return out.view(np.uint64).ravel()


def _judge(pdf: pd.DataFrame, refine: bool) -> pd.DataFrame:
    """Flags per entry: 1 a smaller document has the key, 2 to be refined."""
    sizes = np.array([len(x) // 20 for x in pdf["entries"]])
    cols = [[], [], []]
    for data, n in zip(pdf["entries"], sizes, strict=True):
        cols[0].append(_unplanes(data, 6, 0, n))
        cols[1].append(_unplanes(data, 6, 6 * n, n))
        cols[2].append(_unplanes(data, 8, 12 * n, n).view(np.int64))
    k1, k2, doc = (np.concatenate(c) for c in cols)
    order = np.lexsort((doc, k2, k1))
    a, b, d = k1[order], k2[order], doc[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    key = np.cumsum(new) - 1
    lowest = d[new]
    flag = (d > lowest[key]).astype(np.uint8)
    if refine:
        bucket = np.r_[True, a[new][1:] != a[new][:-1]]
        at = np.flatnonzero(bucket)
        several = np.minimum.reduceat(lowest, at) != np.maximum.reduceat(lowest, at)
        wanted = several[np.cumsum(bucket) - 1]
        flag[(flag == 0) & wanted[key]] = 2
    out = np.empty(len(a), np.uint8)
    out[order] = flag
    edge = np.cumsum(sizes)
    parts = [out[e - n:e] for e, n in zip(edge, sizes, strict=True)]
    found = [i for i, p in enumerate(parts) if p.any()]
    return pd.DataFrame({"batch": pdf["batch"].to_numpy()[found], "part": pdf["part"].to_numpy()[found],
                         "flags": [parts[i].tobytes() for i in found]})


ENTRIES = "part long, batch long, entries binary"


def _replies(entries: DataFrame, refine: bool, name: str) -> DataFrame:
    """Per batch, the flags of its keys."""
    flags = entries.groupBy("part").applyInPandas(lambda pdf: _judge(pdf, refine), "batch long, part long, flags binary")
    return cut_lineage(flags, name).groupBy("batch").agg(F.collect_list(F.struct("part", "flags")).alias(name))


def _load(row, step: int) -> Batch:
    data = zstandard.ZstdDecompressor().decompress(row.data, max_output_size=max(1, int(row.size)))
    return Batch(np.frombuffer(row.ids, np.int64), np.frombuffer(row.lens, np.int64), data, step)


def batched(docs: DataFrame, text: str, key: str, buckets: int, batch_bytes: int) -> DataFrame:
    """Documents in compressed batches, written once as a table bucketed by batch."""
    def run(it):
        base, seq = TaskContext.get().partitionId() << 32, 0
        ids, texts, size = [], [], 0
        pack = zstandard.ZstdCompressor(level=3)

        def row():
            data = b"".join(texts)
            return pd.DataFrame({"batch": [base + seq], "ids": [np.array(ids, np.int64).tobytes()],
                                 "lens": [np.array([len(t) for t in texts], np.int64).tobytes()],
                                 "size": [len(data)], "data": [pack.compress(data)]})
        for pdf in it:
            for i, null, t in zip(pdf["doc_id"].tolist(), pdf["none"].tolist(), pdf["text"].tolist(), strict=True):
                if texts and size + len(t) > batch_bytes:
                    yield row()
                    ids, texts, size, seq = [], [], 0, seq + 1
                ids.append(NO_ID if null else i)
                texts.append(t)
                size += len(t)
        if texts:
            yield row()

    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("doc_id"), F.col(key).isNull().alias("none"),
                       F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    out = rows.mapInPandas(run, "batch long, ids binary, lens binary, size long, data binary")
    spark, name = docs.sparkSession, f"batches_{uuid.uuid4().hex}"
    out.write.bucketBy(buckets, "batch").option("path", scratch_path(spark, "batches")).saveAsTable(name)
    return spark.table(name)


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", with_text: bool = False,
                   batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the
    remaining bytes, if asked for): one row per row of ``docs``."""
    spark = docs.sparkSession
    batches = batched(docs, text, key, groups_for(spark, 1, 1), batch_bytes)
    total = batches.agg(F.sum("size")).first()[0] or 0
    n_parts = groups_for(spark, int(total), PART_BYTES)

    def contexts(it):
        for pdf in it:
            for row in pdf.itertuples():
                b = _load(row, batch_bytes)
                yield pd.DataFrame(Keys(b.bucket, b.context, b.doc, n_parts).rows(row.batch),
                                   columns=["part", "batch", "entries"])

    first = _replies(batches.mapInPandas(contexts, ENTRIES), True, "first")

    def judged(row):
        """What the first replies settle, and the strings that are to be refined."""
        b = _load(row, batch_bytes)
        k = Keys(b.bucket, b.context, b.doc, n_parts)
        flags = k.flags(row.first if row.first is not None else [])
        gone = k.later | (flags == 1)
        return b, gone, b.strings(np.flatnonzero(~gone & (flags == 2)))

    def strings(it):
        for pdf in it:
            for row in pdf.itertuples():
                _, _, (_, doc, k1, k2) = judged(row)
                yield pd.DataFrame(Keys(k1, k2, doc, n_parts).rows(row.batch), columns=["part", "batch", "entries"])

    asked = batches.join(first, "batch")
    second = _replies(asked.mapInPandas(strings, ENTRIES), False, "second")

    def finish(it):
        for pdf in it:
            for row in pdf.itertuples():
                b, gone, (start, doc, k1, k2) = judged(row)
                k = Keys(k1, k2, doc, n_parts)
                hit = k.later | (k.flags(row.second if row.second is not None else []) == 1)
                cover = np.zeros(len(b.buf) + 1, np.int32)
                np.add.at(cover, b.start[gone], 1)
                np.add.at(cover, b.start[gone] + b.n[gone] - 1 + SPAN, -1)
                np.add.at(cover, start[hit], 1)
                np.add.at(cover, start[hit] + SPAN, -1)
                cover = np.cumsum(cover[:-1]) > 0
                out = []
                for i, at, n in zip(b.ids.tolist(), b.first.tolist(), b.lens.tolist(), strict=True):
                    c = cover[at:at + n] & (i != NO_ID)
                    kept = b.buf[at:at + n][~c].tobytes()
                    spans = int(c[:1].sum() + (c[1:] & ~c[:-1]).sum())
                    out.append((None if i == NO_ID else i, n, n - len(kept), spans,
                                hashlib.sha256(kept).hexdigest(), kept if with_text else None))
                frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

    done = batches.join(first, "batch", "left").join(second, "batch", "left").mapInPandas(
        finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done if with_text else done.drop("kept")
