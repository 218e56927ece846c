"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

An item is found in a document where some run of the document's words is within a word
edit distance of a fifth of the item's words (similarity 0.8 or more).  Words are
lower-cased (ASCII) and stripped of ASCII punctuation.

A CGK walk reads a window from its start: step j writes the word under the pointer and
moves on if bit j of that word's hash says so.  Two windows a few edits apart fall into
step again by chance, so edit distance becomes Hamming distance of what was written.
Each repetition has its own walk and samples ``SAMPLES`` steps; windows of an item's size
whose samples equal the item's are candidates and are verified by the exact edit
distance.  The number of repetitions is set by trial for each class of item lengths: of
copies of the class's own items, each edited as far as its length allows, so many must be
caught by these very walks that ``RECALL`` holds beyond the trial's own error.

Windows start at every word; those that cannot match are passed over before the walk by
the q-gram lemma: a run of words within k edits of an n-word item keeps n-2-3k of its
three-word and n-3-4k of its four-word shingles.  This filter loses nothing.

Documents are read once, in place: no shuffle.  Items are broadcast in blocks of at
most ``BLOCK_WORDS`` words; more items take more passes.

Defined results: null or empty document or item text (or one of punctuation only):
nothing is found; null ids are returned as null; repeated documents each get their rows;
an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, gather_ranges, mix64, slices, tidy

PERCENT = 80          # least similarity, 1 - distance / words of the item
SAMPLES, RECALL, TRIALS = 4, 0.99, 1000
BLOCK_WORDS = 1_000_000
TABLE_WORDS = 500_000  # words whose hash a process remembers
PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())
GRAM = np.uint64(0x9E3779B97F4A7C15)
PAD = np.uint64(0)


def allowed(n: int, percent: int = PERCENT) -> int:
    return n * (100 - percent) // 100


class WordTable(dict):
    """Hash of each word met, 0 if it is of punctuation only; forgets all when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= TABLE_WORDS:
            self.clear()
        bare = word.strip(PUNCT)
        got = self[word] = xxhash.xxh3_64_intdigest(bare) | 1 if bare else 0
        return got


WORDS = WordTable()  # one in each process


def forget_words() -> None:
    WORDS.clear()


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words one after another, and how many each text has."""
    split = [t.lower().split() for t in texts]
    words = np.fromiter(map(WORDS.__getitem__, chain.from_iterable(split)), np.uint64, sum(map(len, split)))
    total = np.concatenate([[0], np.cumsum(words != 0)])  # words of punctuation only do not count
    edge = np.cumsum([0, *map(len, split)])
    return words[words != 0], np.diff(total[edge])


def grams(words: np.ndarray, q: int) -> np.ndarray:
    h = np.ones(max(0, len(words) - q + 1), np.uint64)
    for i in range(q):
        h = mix64(h * GRAM + words[i:len(words) - q + 1 + i])
    return h


def walk(words: np.ndarray, start: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Pointer offset before each step (step x window)."""
    out = np.empty((len(factors), len(start)), np.int16 if len(factors) < 1 << 15 else np.int32)
    last = len(words) - 1
    near_end = start.max(initial=0) + len(factors) > last
    place = start.astype(np.int64)
    for j, f in enumerate(factors):
        np.subtract(place, start, out=out[j], casting="unsafe")
        here = words[np.minimum(place, last) if near_end else place]
        here *= f
        here >>= np.uint64(63)
        place += here.view(np.int64)
    return out


def sample_keys(words, start, offs, n) -> np.ndarray:
    """Hash of what the walk wrote at the sampled steps (pointer offsets ``offs``), for windows of n words (each)."""
    h = np.full(len(start), n, np.uint64)
    for o in offs:
        w = words[np.minimum(start + o, len(words) - 1)]
        h = mix64(h * np.uint64(0xC2B2AE3D27D4EB4F) + np.where(o < n, w, PAD))
    return h


def distances(items: np.ndarray, windows: np.ndarray, k: int) -> np.ndarray:
    """Least word edit distance of each item (row) to a prefix of its window (row,
    k words longer than the item), exact up to k; only diagonals up to k are filled."""
    n, width = items.shape[1], 2 * k + 1
    left = np.zeros((len(windows), k), windows.dtype)
    w = np.concatenate([left, windows], axis=1)
    ramp = np.arange(width, dtype=np.int16)
    row = np.broadcast_to(np.where(ramp < k, k + 1, ramp - k), (len(items), width)).astype(np.int16)
    for i in range(n):
        cur = row + (w[:, i:i + width] != items[:, i:i + 1])
        np.minimum(cur[:, :-1], row[:, 1:] + np.int16(1), out=cur[:, :-1])
        if i < k:  # the diagonal on which nothing of the window is used yet
            cur[:, :k - i - 1] = k + 1
            cur[:, k - i - 1] = i + 1
        row = np.minimum.accumulate(cur - ramp, axis=1) + ramp
    return row.min(axis=1)


class Index:
    """Items by length, their sampled keys in every repetition, and the shingle filter."""

    def __init__(self, items: list[tuple[int | None, bytes]], percent: int = PERCENT, seed: int = 5):
        flat, counts = words_of([t for _, t in items])
        first = np.cumsum(counts) - counts
        self.percent = percent
        self.items: dict[int, tuple[list, np.ndarray]] = {}
        for n in sorted(set(counts.tolist()) - {0}):
            at = np.flatnonzero(counts == n)
            self.items[n] = ([items[i][0] for i in at], np.stack([flat[first[i]:first[i] + n] for i in at]))
        self.longest = max(self.items, default=0)
        rng = np.random.default_rng(seed)
        self.factors: list[np.ndarray] = []  # per repetition: the walk, and where it is sampled
        self.places: list[np.ndarray] = []
        self.repeats: dict[int, int] = {}
        for lengths in self._classes():
            self.repeats |= dict.fromkeys(lengths, self._trial(rng, lengths))
        self.keys = {}
        for n, (_, w) in self.items.items():
            flat, start = np.append(w.ravel(), PAD), np.arange(len(w)) * n
            for r in range(self.repeats[n]):
                keys = sample_keys(flat, start, walk(flat, start, self.factors[r][:3 * n])[self._steps(r, n)], n)
                order = np.argsort(keys, kind="stable")
                self.keys[n, r] = keys[order], order
        # Per repetition, the keys of all lengths that take part in it, sorted, with length and item.
        self.tables = []
        for r in range(len(self.factors)):
            mine = [n for n in self.items if r < self.repeats[n]]
            keys, order = (np.concatenate([self.keys[n, r][i] for n in mine]) for i in (0, 1))
            length = np.repeat(mine, [len(self.keys[n, r][0]) for n in mine])
            by = np.argsort(keys, kind="stable")
            self.tables.append((keys[by], length[by], order[by]))
        self.filters = {}
        for n, (_, w) in self.items.items():
            for q, _ in self._shared(n):
                self.filters.setdefault(q, []).extend(grams(x, q) for x in w)
        for q, parts in self.filters.items():
            g = np.unique(np.concatenate(parts))
            size = max(12, int(np.ceil(np.log2(64 * len(g)))))  # one in 64 is set, however many there are
            shift = np.uint64(64 - size)
            bits = np.zeros(1 << size, bool)
            bits[(g >> shift).view(np.int64)] = True
            self.filters[q] = g, bits, shift

    def _shared(self, n: int) -> list[tuple[int, int]]:
        """(q, how many q-grams an allowed window shares at least with an item of n words)."""
        k = allowed(n, self.percent)
        return [(q, n - q + 1 - q * k) for q in ((3, 4) if n > 3 else (n,)) if n - q + 1 - q * k > 0] or [(1, n - k)]

    def _steps(self, r: int, n: int) -> np.ndarray:
        """The sampled steps of repetition r for windows of n words."""
        return (self.places[r] * (3 * n)).astype(np.int64)

    def _classes(self) -> list[list[int]]:
        """Lengths by the edits they allow: one class each up to eight edits, then six classes per doubling."""
        out: dict[int, list[int]] = {}
        for n in self.items:
            k = allowed(n, self.percent)
            out.setdefault(k if k <= 8 else int(6 * np.log2(k / 8)) + 9, []).append(n)
        return list(out.values())

    def _trial(self, rng, lengths: list[int]) -> int:
        """Repetitions after which enough copies of items of these lengths, edited as far as is allowed, are caught."""
        own, copies, sizes = [], [], []
        for i in range(max(TRIALS, len(lengths))):
            n = lengths[i % len(lengths)]
            w = self.items[n][1][rng.integers(len(self.items[n][1]))]
            e = w.tolist()
            for _ in range(allowed(n, self.percent)):
                at, kind = int(rng.integers(0, len(e))), rng.integers(0, 3)
                new = int(rng.integers(1, 1 << 62))
                if kind == 0:
                    e[at] = new
                elif kind == 1:
                    e.insert(at, new)
                elif len(e) > 1:
                    del e[at]
            e += rng.integers(1, 1 << 62, max(0, n - len(e))).tolist()  # a document goes on after the copy
            own.append(w)
            copies.append(np.array(e[:n], np.uint64))
            sizes.append(n)
        n = np.array(sizes)
        first = np.cumsum(n) - n
        flat = [np.concatenate(own), np.concatenate(copies)]
        # Two standard errors better than RECALL, so that the class itself, not only its trial, reaches it.
        enough = RECALL + 2 * np.sqrt(RECALL * (1 - RECALL) / len(n))
        open_, r = np.arange(len(n)), 0
        while r < 4 or len(open_) > (1 - enough) * len(n):
            if r == len(self.factors):
                self.factors.append(rng.integers(0, 1 << 63, 3 * self.longest, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
                self.places.append(rng.random(SAMPLES))
            steps, at = (self.places[r][:, None] * (3 * n[open_])).astype(np.int64), first[open_]
            keys = []
            for words in flat:
                offs = walk(words, at, self.factors[r][:int(steps.max(initial=0)) + 1])
                keys.append(sample_keys(words, at, offs[steps, np.arange(len(at))], n[open_]))
            open_ = open_[keys[0] != keys[1]]
            r += 1
        return r

    def hits(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """Per q, the running count of positions whose q-gram occurs in an item."""
        out, three = {}, None
        for q in sorted(self.filters):
            g, bits, shift = self.filters[q]
            if q == 4 and three is not None:
                # A known four-gram begins with two known three-grams; its hash goes on from the first.
                at, h3 = three
                at = at[:-1][at[1:] == at[:-1] + 1]
                h = mix64(h3[at] * GRAM + words[at + 3])
            else:
                every = grams(words, q)
                at = np.flatnonzero(bits[(every >> shift).view(np.int64)])
                h = every[at]
            known = g[np.minimum(np.searchsorted(g, h), len(g) - 1)] == h
            at = at[known]
            if q == 3:
                three = at, every
            seen = np.zeros(len(words) + 1, np.int8)
            seen[1 + at] = 1
            out[q] = np.cumsum(seen, dtype=np.int32)
        return out

    def _loosest(self, words, running) -> np.ndarray:
        """Positions that pass the filter of some length, judged by the widest window and least count."""
        ok = np.zeros(len(words), bool)
        rules: dict[int, tuple[int, int]] = {}
        for n in self.items:
            q, least = self._shared(n)[0]
            span = max(1, n + allowed(n, self.percent) - q + 1)
            old = rules.get(q, (span, least))
            rules[q] = max(span, old[0]), min(least, old[1])
        for q, (span, least) in rules.items():
            c = running[q]
            if span < len(words):
                ok[:-span] |= c[span:-1] - c[:-1 - span] >= least
            tail = max(0, len(words) - span)
            ok[tail:] |= c[-1] - c[tail:-1] >= least
        return np.flatnonzero(ok & (words != PAD))

    def find(self, texts: list[bytes]) -> pd.DataFrame:
        """text, item, distance and word position of each item found in each text (best place)."""
        flat, counts = words_of(texts)
        gap = self.longest + allowed(self.longest, self.percent) + 1
        first = np.cumsum(counts + gap) - (counts + gap)  # padding, so that no window reaches the next text
        words = np.zeros(int((counts + gap).sum()) + 3 * self.longest + 1, np.uint64)  # walks end inside
        words[gather_ranges(first, counts)] = flat
        found = []
        running = self.hits(words)
        starts = {}
        near = self._loosest(words, running)
        for n in self.items:
            ok = near
            for q, least in self._shared(n):
                c = running[q]
                span = max(1, n + allowed(n, self.percent) - q + 1)
                ok = ok[c[np.minimum(ok + span, len(words))] - c[ok] >= least]
            starts[n] = ok
        every = np.unique(np.concatenate([*starts.values(), np.empty(0, np.int64)])).astype(np.int64)
        pairs: dict[int, list] = {n: [] for n in self.items}
        size = max(1, 3_600_000 // max(1, 3 * self.longest))
        for lo in range(0, len(every), size):
            part = every[lo:lo + size]
            own = [(n, np.searchsorted(part, s[np.searchsorted(s, part[0]):np.searchsorted(s, part[-1], "right")]))
                   for n, s in sorted(starts.items(), key=lambda x: -self.repeats[x[0]])]
            # Windows with the lengths they are tried for; those with most repetitions first.
            window = np.concatenate([w for _, w in own])
            length = np.repeat([n for n, _ in own], [len(w) for _, w in own])
            last = np.repeat([self.repeats[n] for n, _ in own], [len(w) for _, w in own])
            now = -1
            for r in range(int(last.max(initial=0))):
                active = int(np.searchsorted(-last, -r))
                if active != now:  # lengths that have had their repetitions drop out
                    now = active
                    rows, at = np.unique(window[:now], return_inverse=True)
                    start, n = part[window[:now]], length[:now]
                steps = (self.places[r][:, None] * (3 * n)).astype(np.int64)
                offs = walk(words, part[rows], self.factors[r][:int(steps.max()) + 1])
                mykeys = sample_keys(words, start, offs[steps, at], n)
                keys, lengths, order = self.tables[r]
                a, b = np.searchsorted(keys, mykeys, "left"), np.searchsorted(keys, mykeys, "right")
                hit = np.flatnonzero(b > a)
                if len(hit):
                    who = np.repeat(hit, (b - a)[hit])
                    which = gather_ranges(a[hit], (b - a)[hit])
                    for n_hit in np.unique(lengths[which]).tolist():
                        same = (lengths[which] == n_hit) & (n[who] == n_hit)
                        pairs[n_hit].append(np.stack([start[who[same]], order[which[same]]], axis=1))
        for n, parts in pairs.items():
            if not parts:
                continue
            ids, item_words = self.items[n]
            k = allowed(n, self.percent)
            both = np.unique(np.concatenate(parts), axis=0)
            windows = np.lib.stride_tricks.sliding_window_view(words, n + k)  # the padding leaves room
            for lo in range(0, len(both), 4096):
                s, i = both[lo:lo + 4096].T
                d = distances(item_words[i], windows[s], k)
                ok = d <= k
                found += [(int(x), ids[y], int(z)) for x, y, z in zip(s[ok], i[ok], d[ok], strict=True)]
        best: dict = {}
        for s, item, d in sorted(found, key=lambda x: (x[2], x[0])):
            text = int(np.searchsorted(first, s, "right")) - 1
            best.setdefault((text, item), (d, s - int(first[text])))
        return pd.DataFrame([(t, i, d, s) for (t, i), (d, s) in best.items()],
                            columns=["text", "item", "distance", "position"])


def item_blocks(benchmark: DataFrame, text: str = "text", key: str = "item_id", block_words: int = BLOCK_WORDS):
    """Items in lists of at most ``block_words`` words (or one longer item); only one list is held at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    for r in rows.toLocalIterator():
        n = len(bytes(r.t).split())
        if block and size + n > block_words:
            yield _sorted(block)
            block, size = [], 0
        block.append((r.k, bytes(r.t)))
        size += n
    if block:
        yield _sorted(block)


def _sorted(block: list) -> list:
    """In an order that does not depend on how the rows were read: the trial's copies follow it."""
    return sorted(block, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, text: str = "text", key: str = "doc_id",
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, distance, position (in words): a row per document and item it holds."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, distance int, position long"
    out = spark.createDataFrame([], schema)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    for block in item_blocks(benchmark, block_words=block_words):
        index = spark.sparkContext.broadcast(Index(block, percent))

        def run(it, index=index):
            for pdf in batches(it, 2000, 2_000_000, "text"):
                got = index.value.find(pdf["text"].tolist())
                yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64").to_numpy()[got["text"].to_numpy(np.int64)],
                                    "item_id": got["item"].astype("Int64"), "distance": got["distance"].astype("int32"),
                                    "position": got["position"].astype("int64")})
        out = out.unionByName(rows.mapInPandas(run, schema))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, text: str = "text",
               block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # columns may have any names
    at = docs.columns.index(text)
    out = docs.toDF(*names)
    schema = out.schema
    for block in item_blocks(benchmark, block_words=block_words):
        index = docs.sparkSession.sparkContext.broadcast(Index(block, percent))

        def keep(it, index=index):
            for batch in it:
                for part in slices(batch, at, 500, 2_000_000):
                    bad = set(index.value.find([(t or "").encode() for t in part.column(at).to_pylist()])["text"].tolist())
                    yield part.filter(pa.array([i not in bad for i in range(part.num_rows)], pa.bool_()))
        out = out.mapInArrow(tidy(keep, forget_words), schema)
    return out.toDF(*docs.columns)

