"""Population decision trees keyed by split path.

All candidate subsets of a population are grown at the same time, one Spark job per level.
A node is known by its *path*, the splits that lead to it.  Candidates that took the same
splits share the node, its rows and its histogram: the root's histogram serves the whole
population, and work grows with the distinct paths, not with the candidates.

Data layout (prepared once, written): one row per example with ``label`` (int index),
``bins`` (array<int>, one quantile bin per feature, at most ``max_bins`` bins like MLlib's
default) and ``packed`` (the same bins, one byte each, in one binary value).

Per level:

1. tasks send their rows down the trie of paths (a few numpy comparisons per path and
   batch, no row is copied per candidate) and count (path, feature, bin, class) for the
   *smaller* child of each split only; a task hands on one row per non-empty bin;
2. Spark adds the counts up; the *larger* child is its parent's histogram less its sibling's;
3. cumulative class counts over bins (a window per path and feature, at most ``max_bins``
   rows) give every threshold's entropy gain and the best one per path and feature;
4. these, at most paths x features rows whatever the data's size, go to the driver (as
   MLlib's best split per node does), where each candidate takes the best of its own
   features: gain descending, feature, bin.

A level of up to ``LOCAL_CELLS`` cells, a bound on the model whatever the rows, takes steps 2
(subtraction) and 3 on the driver, which saves their jobs; the results are the same.

A node splits when both sides are non-empty and the (9-decimal rounded) gain is positive.
Leaves predict the most frequent class (lowest index on ties).  Importance = sum of gain x n
per feature, normalised per tree.  Scoring counts labels per leaf path over the test rows and
joins the candidates' leaves, so it too makes no row x candidate rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import col, finite_or_zero
from ..session import Scratch, cut_lineage
from . import blocks as B
from . import discretize as Z
from . import prepare as PR

GAIN_DIGITS = 9


#: Most bins that one byte of ``packed`` can tell apart (as one UTF-8 character).
MOST_BINS = 128


@dataclass
class TreeData:
    rows: DataFrame        # is_train boolean, label int, bins array<int>, packed binary
    n_labels: int
    features: list
    splits: dict
    labels: DataFrame      # (label string, label_idx double)
    indexed: DataFrame | None = None  # imputed features, __lab, __is_train
    held: list = field(default_factory=list)  # persisted frames

    @property
    def n_classes(self) -> int:
        """Indexed labels plus the extra index that NULL and unseen labels share."""
        return self.n_labels + 1

    @property
    def ml_rows(self) -> DataFrame:
        """features vector, label, is_train for MLlib fits; made when first asked for."""
        if not hasattr(self, "_ml"):
            ml = PR.assemble_vector(self.indexed, list(self.features)).select(
                "features", F.col("__lab").alias("label"), F.col("__is_train").alias("is_train"))
            # MLlib makes several passes per fit; keep its input in memory/disk
            self._ml = cut_lineage(ml, "ml_rows").persist(StorageLevel.MEMORY_AND_DISK)
            self.held.append(self._ml)
        return self._ml

    def blocks(self) -> DataFrame:
        """The rows as blocks of columns; made when first asked for."""
        if not hasattr(self, "_blocks"):
            self._blocks = B.of_packed(self.rows, len(self.features), self.n_classes)
        return self._blocks

    def release(self) -> None:
        """Drop what is persisted; the written tables stay under the checkpoint folder."""
        while self.held:
            self.held.pop().unpersist()
        if hasattr(self, "_ml"):
            del self._ml


def prepare_tree_data(df: DataFrame, features: list, label: str, is_train: Column,
                      max_bins: int = 32, checkpoint: bool = True, written: bool = False) -> TreeData:
    """Impute, index the label on train, fit ``max_bins`` exact quantile bins on train, and keep
    only (is_train, label, bins).  ``written``: df is read from a written table, of which no second
    copy is made: its numbers are counted and binned column by column, and written as blocks."""
    if max_bins > MOST_BINS:
        raise ValueError(f"at most {MOST_BINS} bins")
    base = (PR.impute_zero(df, features).withColumn("__is_train", is_train)
            .select(*[col(c) for c in features], col(label), "__is_train"))
    if checkpoint and not written:
        base = cut_lineage(base)  # several passes below; read it once
    train = base.filter(F.col("__is_train"))
    labels = PR.label_index(train, label)
    if checkpoint:
        labels = cut_lineage(labels, "labels")
    n_labels = labels.count()
    in_blocks = written and n_labels < B.MOST_CLASSES
    if in_blocks:
        numbers = [col(c).try_cast("double") for c in features]
        given = df.withColumn("__is_train", is_train)
        splits = dict(zip(features, B.exact_splits(given.filter(F.col("__is_train")), numbers, max_bins), strict=True))
    else:
        splits = Z.fit_splits(train, features, num_buckets=max_bins)
    indexed = PR.apply_label_index(base, label, labels, "__lab")
    binned = indexed.select(F.col("__is_train").alias("is_train"), F.col("__lab").cast("int").alias("label"),
                            F.array(*[tree_bin(col(c), splits[c]) for c in features]).alias("bins"))
    rows = binned.withColumn("packed", pack_bins(F.col("bins")))
    if checkpoint and not in_blocks:
        rows = cut_lineage(rows, "tree_rows")
    data = TreeData(rows, n_labels, list(features), splits, labels, indexed)
    if in_blocks:
        given = PR.apply_label_index(given.select(*[x.alias(f"__x{i}") for i, x in enumerate(numbers)], col(label), "__is_train"), label, labels, "__lab")
        data._blocks = B.of_numbers(given.withColumnsRenamed({"__is_train": "is_train"}).withColumn("label", F.col("__lab").cast("int")),
                                    [F.col(f"__x{i}") for i in range(len(features))], list(splits.values()), data.n_classes)
    return data


def pack_bins(bins: Column) -> Column:
    """array<int> of bins below 128 -> binary, a byte each."""
    return F.array_join(F.transform(bins, lambda b: F.char(b)), "").cast("binary")


def tree_bin(x: Column, splits: list) -> Column:
    """Bin b = number of cut values strictly below x, so the split "bin ≤ b"
    is "x ≤ cut_b" — the threshold sits right after a value, as MLlib's
    midpoint thresholds do (a heavy 0 separates from the positives)."""
    inner = [float(v) for v in splits[1:-1]]
    if not inner:
        return F.lit(0)
    arr = F.array(*[F.lit(v) for v in inner])
    return F.size(F.filter(arr, lambda s: s < x.cast("double"))).cast("int")


def mask_features(mask: Column) -> Column:
    """array<int> 0/1 mask → array of selected feature positions."""
    return F.filter(F.transform(mask, lambda b, i: F.when(b == 1, i)), lambda x: x.isNotNull())


def _entropy(counts: list, n: Column) -> Column:
    terms = [F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(F.lit(0.0)) for c in counts]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return F.when(n > 0, out).otherwise(F.lit(0.0))


TREE_TYPE = "array<struct<node:int,f:int,b:int,pred:int,l:int,r:int,depth:int>>"


def _walk(tree: Column, bins: Column, steps: int) -> Column:
    """Fold ``steps`` levels down a compact tree (1-based child pointers);
    returns the entry where the row stops."""
    if steps == 0:
        return tree[0]

    def step(i, _k):
        e = tree[i - 1]
        return F.when(e["f"].isNull(), i).otherwise(
            F.when(bins[e["f"]] > e["b"], e["r"]).otherwise(e["l"]))

    idx = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(1), step)
    return tree[idx - 1]


def _compact(nodes: dict) -> list:
    """{heap id: (f, b, pred, depth)} → compact entry list in heap order
    with child pointers (entries are few: ≤ 2 × splits + 1)."""
    ids = sorted(nodes)
    pos = {n: i + 1 for i, n in enumerate(ids)}
    out = []
    for n in ids:
        f, b, pred, depth = nodes[n]
        out.append((n, f, b, pred, pos.get(2 * n, 0), pos.get(2 * n + 1, 0), depth))
    return out


def _trees_df(spark, per_cand: dict) -> DataFrame:
    rows = [(c, _compact(nd)) for c, nd in sorted(per_cand.items())]
    return spark.createDataFrame(rows, f"cand int, tree {TREE_TYPE}")


def _argmax(counts: list) -> Column:
    best_i, best_v = F.lit(0), counts[0]
    for i, c in enumerate(counts[1:], start=1):
        better = c > best_v
        best_i = F.when(better, F.lit(i)).otherwise(best_i)
        best_v = F.when(better, c).otherwise(best_v)
    return best_i


def _py_argmax(counts) -> int:
    best = 0
    for i, c in enumerate(counts):
        if c > counts[best]:
            best = i
    return best


NODE_SCHEMA = ("cand int, node int, depth int, n long, counts array<long>, f int, b int, "
               "gain double, pred int, path int")

#: A level of at most so many (path, feature, bin) cells is kept by the driver (some 70 MB); larger
#: ones stay tables.  The bound is on the model, not on the rows.
LOCAL_CELLS = 1_500_000

#: Histogram cells that a task holds before it hands them on.
HELD_CELLS = 2_000_000


class Trie:
    """Paths of all candidates; path 0 is the root.  ``splits[path]`` lists the distinct
    (feature, bin, left path, right path) taken there."""

    def __init__(self):
        self.splits: dict[int, list] = {}
        self.parent: dict[int, int] = {}
        self.known: dict[tuple, tuple] = {}

    def split(self, path: int, f: int, b: int) -> tuple[int, int]:
        """Left and right child of ``path`` for "bin of f <= b", the same for all who ask."""
        if (path, f, b) not in self.known:
            left = 1 + len(self.parent)
            self.known[path, f, b] = left, left + 1
            self.parent |= {left: path, left + 1: path}
            self.splits.setdefault(path, []).append((f, b, left, left + 1))
        return self.known[path, f, b]

    def route(self, wanted) -> "Route":
        """Plain arrays with which tasks find the rows of the wanted paths."""
        size = 1 + len(self.parent)
        target, on_way = np.zeros(size, bool), np.zeros(size, bool)
        for path in wanted:
            target[path] = True
            while not on_way[path]:
                on_way[path] = True
                path = self.parent.get(path, path)
        taken = [(p, *s) for p in np.flatnonzero(on_way).tolist() for s in self.splits.get(p, ()) if on_way[s[2]] or on_way[s[3]]]
        path, f, b, left, right = np.array(taken, np.int64).reshape(-1, 5).T
        first = np.searchsorted(path, np.arange(size + 1))
        return Route(target, on_way, first, f, b, np.stack([left, right]))


@dataclass
class Route:
    target: np.ndarray     # per path: is it wanted
    on_way: np.ndarray     # per path: is it wanted or above a wanted one
    first: np.ndarray      # per path: where its splits begin in f, b, child
    f: np.ndarray
    b: np.ndarray
    child: np.ndarray      # (left, right) x split

    def walk(self, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, path) of every row in every wanted path; bins is rows x features.

        All rows go down one level at a time; a row is in as many paths as the distinct
        splits on its way make."""
        row, path = np.arange(len(bins)), np.zeros(len(bins), np.int64)
        rows, paths = [], []
        while len(row):
            row, path = (x[self.on_way[path]] for x in (row, path))
            done = self.target[path]
            rows.append(row[done])
            paths.append(path[done])
            splits = self.first[path + 1] - self.first[path]
            at = np.repeat(self.first[path] - np.cumsum(splits) + splits, splits) + np.arange(splits.sum())
            row = np.repeat(row, splits)
            path = self.child[(bins[row, self.f[at]] > self.b[at]).astype(np.int64), at]
        return np.concatenate(rows or [row]), np.concatenate(paths or [path])


def _batch(batch, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """bins (rows x features) and labels of an Arrow batch with ``packed`` and ``label``."""
    bins = np.frombuffer(b"".join(batch.column("packed").to_pylist()), np.uint8).reshape(-1, n_features)
    return bins, batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)


def path_histogram(rows: DataFrame, trie: Trie, wanted: dict[int, list], n_features: int, n_bins: int, n_classes: int) -> DataFrame:
    """(path, f, b, c0 ...): class counts of each wanted path's features."""
    parts = _count_paths(rows, trie, wanted, n_features, n_bins, n_classes)
    return parts.groupBy("path", "f", "b").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(n_classes)])


def _count_paths(rows: DataFrame, trie: Trie, wanted: dict[int, list], n_features: int, n_bins: int, n_classes: int,
                 less: dict[int, int] | None = None) -> DataFrame:
    """What each task counts of (path, f, b, c0 ...); ``less`` maps a path to one that gets the same
    counts with a minus sign.

    ``wanted`` maps a path to its features (model-sized, as the trie; both go with the task)."""
    route = trie.route(wanted)
    first = np.zeros(len(route.target) + 1, np.int64)     # a slot per wanted (path, feature)
    for path, fs in wanted.items():
        first[path + 1] = len(fs)
    first = np.cumsum(first)
    slot_path = np.array([p for p in sorted(wanted) for _ in wanted[p]], np.int32)
    slot_f = np.array([f for p in sorted(wanted) for f in wanted[p]], np.int32)
    other = np.array([less[p] for p in slot_path.tolist()], np.int32) if less else None

    def run(it):
        held, cells = [], 0

        def out():
            keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([n for _, n in held])).astype(np.int64)
            cell, of = np.unique(keys // n_classes, return_inverse=True)
            c = np.zeros((n_classes, len(cell)), np.int64)
            c[keys % n_classes, of] = counts
            slot = cell // n_bins
            yield batch_of(slot_path[slot], slot, cell % n_bins, c)
            if less:
                yield batch_of(other[slot], slot, cell % n_bins, -c)

        def batch_of(path, slot, b, c):
            return pa.RecordBatch.from_pydict({"path": path, "f": slot_f[slot], "b": b.astype(np.int32)}
                                              | {f"c{i}": c[i] for i in range(n_classes)})

        for batch in it:
            bins, labels = _batch(batch, n_features)
            row, path = route.walk(bins)
            for lo in range(0, len(row), 1 << 18):
                r, p = row[lo:lo + (1 << 18)], path[lo:lo + (1 << 18)]
                many = first[p + 1] - first[p]
                slot = np.repeat(first[p] - np.cumsum(many) + many, many) + np.arange(many.sum())
                r = np.repeat(r, many)
                held.append(np.unique((slot * n_bins + bins[r, slot_f[slot]]) * n_classes + labels[r], return_counts=True))
                cells += len(held[-1][0])
                if cells > HELD_CELLS:
                    yield from out()
                    held, cells = [], 0
        if cells:
            yield from out()

    kinds = ", ".join(f"c{i} long" for i in range(n_classes))
    return rows.select("packed", "label").mapInArrow(run, f"path int, f int, b int, {kinds}")


def child_histograms(parents: DataFrame, rows: DataFrame, trie: Trie, pairs: list, n_features: int, n_bins: int,
                     n_classes: int) -> DataFrame:
    """Histograms of both children of each split: the smaller one is counted, the larger is its
    parent less its sibling.  ``pairs``: (parent, small, large, features).

    Parts with signs are added up by one aggregation: a counted cell goes to the small child
    and, negative, to the large one; a parent's cell goes to the large child."""
    counts = [f"c{i}" for i in range(n_classes)]
    counted = _count_paths(rows, trie, {small: fs for _, small, _, fs in pairs}, n_features, n_bins, n_classes,
                           {small: large for _, small, large, _ in pairs})
    to = np.array(sorted((parent * n_features + f, large) for parent, _, large, fs in pairs for f in fs), np.int64).reshape(-1, 2)

    def hand_down(it):
        for batch in it:
            cell = batch.column("path").to_numpy().astype(np.int64) * n_features + batch.column("f").to_numpy()
            lo, hi = (np.searchsorted(to[:, 0], cell, side) for side in ("left", "right"))
            at = np.repeat(np.arange(len(cell)), hi - lo)
            large = to[np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange(len(at)), 1]
            taken = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(large.astype(np.int32)), *taken.columns[1:]], names=["path", "f", "b", *counts])

    whole = parents.select("path", "f", "b", *counts).mapInArrow(hand_down, counted.schema)
    return whole.unionByName(counted).groupBy("path", "f", "b").agg(*[F.sum(c).alias(c) for c in counts]).filter(" + ".join(counts) + " > 0")


def grow_trees(data: TreeData, cands: DataFrame, max_depth: int, n_cands: int | None = None) -> DataFrame:
    """Grow one tree per row of ``cands`` (cand int, feats array<int>).

    Returns the node table (cand, node, depth, n, counts, f, b, gain, pred, path); node is the
    heap number in its tree; f/b NULL on leaves."""
    return node_table(data.rows.sparkSession, grow_population(data, cands, max_depth)[0])


def node_table(spark, records: list) -> DataFrame:
    return spark.createDataFrame(records, NODE_SCHEMA)


def grow_population(data: TreeData, cands: DataFrame, max_depth: int) -> tuple[list, Trie]:
    """The node records of all trees and the trie of their paths.

    A level's histograms are written under the checkpoint folder, so that the next level's
    plan does not hold this one's, and dropped at the end."""
    with Scratch(data.rows.sparkSession) as tables:
        return _grow(data, cands, max_depth, tables)


def _grow(data: TreeData, cands: DataFrame, max_depth: int, tables: Scratch) -> tuple[list, Trie]:
    L, n_features = data.n_classes, len(data.features)
    n_bins = 1 + max((len(s) - 2 for s in data.splits.values()), default=0)
    feats = {r["cand"]: sorted(r["feats"]) for r in cands.select("cand", "feats").collect() if r["feats"]}  # population-sized
    train = data.rows.filter("is_train")
    trie, records = Trie(), []
    open_ = [(c, 1, 0) for c in feats]            # (cand, heap node, path) still to be split
    totals: dict[int, list] = {}                  # class counts of a path
    pairs: list | None = None                     # children by (parent, small, large, features)
    hist = None
    for level in range(max_depth):
        if not open_:
            break
        needed: dict[int, set] = {}
        for c, _, path in open_:
            needed.setdefault(path, set()).update(feats[c])
        needed_list = {p: sorted(f) for p, f in needed.items()}
        cells = n_bins * max(sum(map(len, needed_list.values())), 2 * sum(len(fs) for *_, fs in pairs or ()))
        local = cells <= LOCAL_CELLS and (pairs is None or isinstance(hist, LocalHistogram))
        if not local and isinstance(hist, LocalHistogram):
            hist = hist.table(data.rows.sparkSession)
        if pairs is None:
            hist = path_histogram(train, trie, needed_list, n_features, n_bins, L)
            hist = LocalHistogram.of(hist, n_features, n_bins, L) if local else hist
        elif local:
            counted = path_histogram(train, trie, {small: fs for _, small, _, fs in pairs}, n_features, n_bins, L)
            hist = hist.children(counted, pairs)
        else:
            hist = child_histograms(hist, train, trie, pairs, n_features, n_bins, L)
        if level + 1 < max_depth and not local:
            hist = tables.cut(hist, "hist")
        best: dict[int, dict] = {}
        for r in hist.best() if local else best_thresholds(hist, L).toArrow().to_pylist():  # at most paths x features rows
            best.setdefault(r["path"], {})[r["f"]] = r
        nxt, children = [], {}
        open_ = [x for x in open_ if x[2] in best]  # without train rows there is no root either
        for c, node, path in open_:
            found = [best[path][f] for f in feats[c]]
            r = min(found, key=lambda r: (not r["valid"], -r["gain"], r["f"], r["b"]))
            counts = totals[path] = [r[f"t{i}"] for i in range(L)]
            split = r["valid"] and r["gain"] > 0
            records.append((c, node, level, sum(counts), counts, r["f"] if split else None, r["b"] if split else None,
                            r["gain"] if split else None, _py_argmax(counts), path))
            if not split:
                continue
            left, right = trie.split(path, r["f"], r["b"])
            low = [r[f"l{i}"] for i in range(L)]
            for child, kid, cnt in ((2 * node, left, low), (2 * node + 1, right, [t - x for t, x in zip(counts, low, strict=True)])):
                totals[kid] = cnt
                if level + 1 == max_depth or sum(x > 0 for x in cnt) < 2:  # as deep as allowed, or one class only
                    records.append((c, child, level + 1, sum(cnt), cnt, None, None, None, _py_argmax(cnt), kid))
                else:
                    nxt.append((c, child, kid))
            children.setdefault((path, left, right), set()).update(feats[c])
        alive = {path for _, _, path in nxt}
        pairs = []
        for (path, left, right), fs in children.items():
            if left in alive or right in alive:
                small, large = (left, right) if sum(totals[left]) <= sum(totals[right]) else (right, left)
                pairs.append((path, small, large, sorted(fs)))
        open_ = nxt
    return records, trie


class LocalHistogram:
    """A level's histogram of at most ``LOCAL_CELLS`` cells, held by the driver: the same steps as
    the tables take, without their jobs.  Cells are sorted by (path, f, b)."""

    def __init__(self, path, f, b, counts, n_features: int, n_bins: int):
        self.n_features, self.n_bins = n_features, n_bins
        key = (path.astype(np.int64) * n_features + f) * n_bins + b
        key, at = np.unique(key, return_inverse=True)
        added = np.stack([np.bincount(at, c, len(key)) for c in counts]).astype(np.int64)  # whole numbers below 2^53
        keep = added.sum(axis=0) > 0
        self.key, self.counts = key[keep], added[:, keep]
        self.group, self.b = self.key // n_bins, self.key % n_bins

    @classmethod
    def of(cls, hist: DataFrame, n_features: int, n_bins: int, n_classes: int) -> LocalHistogram:
        return cls(*_arrays(hist, n_classes), n_features, n_bins)

    def children(self, counted: DataFrame, pairs: list) -> LocalHistogram:
        """Of both children of each split, from the smaller children's counts."""
        path, f, b, counts = _arrays(counted, len(self.counts))
        to_large = {small: large for _, small, large, _ in pairs}
        large = np.array([to_large[p] for p in path.tolist()], np.int64)
        want = np.array(sorted((parent * self.n_features + i, big) for parent, _, big, fs in pairs for i in fs), np.int64).reshape(-1, 2)
        lo, hi = (np.searchsorted(self.group, want[:, 0], side) for side in ("left", "right"))
        at = np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange((hi - lo).sum())
        return LocalHistogram(np.concatenate([path, large, np.repeat(want[:, 1], hi - lo)]), np.concatenate([f, f, self.group[at] % self.n_features]),
                              np.concatenate([b, b, self.b[at]]), np.concatenate([counts, -counts, self.counts[:, at]], axis=1),
                              self.n_features, self.n_bins)

    def table(self, spark) -> DataFrame:
        cols = {"path": self.group // self.n_features, "f": self.group % self.n_features, "b": self.b}
        return spark.createDataFrame(pa.table({k: v.astype(np.int32) for k, v in cols.items()}
                                              | {f"c{i}": c for i, c in enumerate(self.counts)}))

    def best(self) -> list[dict]:
        """As :func:`best_thresholds`."""
        if not len(self.key):
            return []
        first = np.flatnonzero(np.r_[True, np.diff(self.group) > 0])
        of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(self.key)]))
        run = np.cumsum(self.counts, axis=1)
        left = run - (run[:, first] - self.counts[:, first])[:, of]
        total = np.add.reduceat(self.counts, first, axis=1)[:, of]
        n, nl = total.sum(axis=0), left.sum(axis=0)
        nr = n - nl

        def entropy(c, size):
            with np.errstate(divide="ignore", invalid="ignore"):
                share = c / size
                terms = np.where(c > 0, -share * np.log2(share), 0.0)
            out = terms[0]
            for t in terms[1:]:
                out = out + t
            return np.where(size > 0, out, 0.0)
        gain = entropy(total, n) - (nl / n) * entropy(left, nl) - (nr / n) * entropy(total - left, nr)
        scale = 10.0 ** GAIN_DIGITS
        gain = np.floor(gain * scale + 0.5) / scale
        valid = (nl >= 1) & (nr >= 1)
        by = np.lexsort((self.b, -gain, ~valid, of))
        top = by[first]
        return [{"path": int(self.group[i] // self.n_features), "f": int(self.group[i] % self.n_features), "b": int(self.b[i]),
                 "valid": bool(valid[i]), "gain": float(gain[i]) + 0.0} | {f"l{k}": int(x) for k, x in enumerate(left[:, i])}
                | {f"t{k}": int(x) for k, x in enumerate(total[:, i])} for i in top.tolist()]


def _arrays(hist: DataFrame, n_classes: int):
    t = hist.toArrow()
    return (*[t.column(c).to_numpy() for c in ("path", "f", "b")], np.stack([t.column(f"c{i}").to_numpy() for i in range(n_classes)]))


def best_thresholds(hist: DataFrame, L: int) -> DataFrame:
    """Best bin per (path, f): windows over at most ``max_bins`` rows, one shuffle."""
    w = Window.partitionBy("path", "f")
    cum = w.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    h = hist.select("path", "f", "b", *[F.sum(f"c{i}").over(cum).alias(f"l{i}") for i in range(L)],
                    *[F.sum(f"c{i}").over(w).alias(f"t{i}") for i in range(L)])
    left, tot = [F.col(f"l{i}") for i in range(L)], [F.col(f"t{i}") for i in range(L)]
    right = [F.col(f"t{i}") - F.col(f"l{i}") for i in range(L)]
    n, nl = sum(tot[1:], tot[0]), sum(left[1:], left[0])
    nr = n - nl
    gain = _entropy(tot, n) - (nl / n) * _entropy(left, nl) - (nr / n) * _entropy(right, nr)
    h = h.select("*", F.round(gain, GAIN_DIGITS).alias("gain"), ((nl >= 1) & (nr >= 1)).alias("valid"))
    best = w.orderBy(F.desc("valid"), F.desc("gain"), F.asc("b"))
    return h.withColumn("rk", F.row_number().over(best)).filter("rk = 1").drop("rk")


def leaf_labels(rows: DataFrame, records: list, trie: Trie, n_features: int, n_classes: int) -> DataFrame:
    """(path, label, n): how many rows of each label end in each leaf path."""
    route = trie.route({r[9] for r in records if r[5] is None})

    def run(it):
        total: np.ndarray | int = 0
        for batch in it:
            bins, labels = _batch(batch, n_features)
            row, path = route.walk(bins)
            total = total + np.bincount(path * n_classes + labels[row], minlength=len(route.target) * n_classes)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_pydict({"path": (at // n_classes).astype(np.int32), "label": (at % n_classes).astype(np.int32),
                                              "n": total[at].astype(np.int64)})

    return rows.select("packed", "label").mapInArrow(run, "path int, label int, n long").groupBy("path", "label").agg(F.sum("n").alias("n"))


def population_confusion(data: TreeData, records: list, trie: Trie, which: str = "test") -> DataFrame:
    """(cand, label, prediction, count) of every candidate, from label counts per leaf path."""
    rows = data.rows.filter(F.col("is_train") if which == "train" else ~F.col("is_train"))
    counts = leaf_labels(rows, records, trie, len(data.features), data.n_classes)
    leaves = data.rows.sparkSession.createDataFrame([(r[0], r[9], float(r[8])) for r in records if r[5] is None],
                                                    "cand int, path int, prediction double")
    return leaves.join(counts, "path").groupBy("cand", F.col("label").cast("double").alias("label"), "prediction") \
        .agg(F.sum("n").alias("count"))


def root_histogram(data: TreeData, cands: DataFrame) -> DataFrame:
    """(cand, node, f, b, c0 ...) of every candidate's root: one histogram, read by all."""
    n_bins = 1 + max(len(s) - 2 for s in data.splits.values())
    every = list(range(len(data.features)))
    hist = path_histogram(data.rows.filter("is_train"), Trie(), {0: every}, len(every), n_bins, data.n_classes)
    mine = cands.select("cand", F.explode("feats").alias("f"))
    return mine.join(hist.drop("path"), "f").withColumn("node", F.lit(1))


def predict(data: TreeData, nodes: DataFrame, max_depth: int, n_cands: int,
            which: str = "test") -> DataFrame:
    """(cand, label, prediction) for every test (or train) row and candidate, which is what
    the caller asks for; scores use population_confusion, which makes no such rows.
    The node table is model-sized; it is compacted on the driver and broadcast."""
    spark = data.rows.sparkSession
    per = {}
    for r in nodes.select("cand", "node", "f", "b", "pred", "depth").collect():
        per.setdefault(r["cand"], {})[r["node"]] = (r["f"], r["b"], r["pred"], r["depth"])
    if not per:
        return spark.createDataFrame([], "cand int, label double, prediction double")
    trees = _trees_df(spark, per)
    n_ids = max(per) + 1
    rows = data.rows.filter(F.col("is_train") if which == "train" else ~F.col("is_train"))
    pairs = rows.select(F.explode(F.sequence(F.lit(0), F.lit(n_ids - 1))).alias("cand"), "label", "bins")
    walked = pairs.join(F.broadcast(trees), "cand").select(
        "cand", "label", _walk(F.col("tree"), F.col("bins"), max_depth).alias("e"))
    return walked.select("cand", F.col("label").cast("double").alias("label"),
                         F.col("e.pred").cast("double").alias("prediction"))


def importances(nodes: DataFrame, features: list) -> DataFrame:
    """(cand, feature_idx, importance): Σ gain·n per feature / Σ per tree."""
    imp = (nodes.filter(F.col("f").isNotNull())
           .groupBy("cand", F.col("f").alias("feature_idx"))
           .agg(F.sum(F.col("gain") * F.col("n")).alias("raw")))
    w = Window.partitionBy("cand")
    return imp.select("cand", "feature_idx",
                      (F.col("raw") / F.sum("raw").over(w)).alias("importance"))


def dense_candidates(pop: DataFrame, member: str = "member", mask: str = "mask") -> DataFrame:
    """Give population members dense ids 0..P-1 (so rows can explode over
    ``sequence(0, P-1)`` instead of joining).  The population is small."""
    w = Window.orderBy(member)
    return pop.withColumn("cand", (F.row_number().over(w) - 1).cast("int")) \
        .withColumn("feats", mask_features(F.col(mask)))
