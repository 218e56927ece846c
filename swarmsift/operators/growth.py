"""Trees of a population grown and scored on blocks of binned rows (see :mod:`.blocks`).

The same trees as :mod:`.tree` grows: nodes are known by the splits that lead to them, the smaller
child of a split is counted, the larger one is its parent less its sibling, and the best threshold
is taken by rounded gain, feature, bin.  What differs is the work:

* A count holds train and test rows side by side, so the confusion of a tree is known with its
  splits, without another pass over the rows.
* Counts of (path, feature) stay with the :class:`Growth` of a search: the next generation counts
  what it does not know yet.
* Tasks send the rows of a chunk down the paths column by column and count a path's feature with
  one ``bincount``; a task hands on one array of counts.
* Deep trees end in one job: below ``WHOLE_LEVELS`` the rows of a node go to one task, which grows
  the rest of its tree.  Nodes of more than ``NODE_ROWS`` rows are still counted level by level.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..session import brief_session
from . import blocks as B
from .tree import GAIN_DIGITS, Trie, TreeData, _py_argmax

#: Levels that are counted whole, at least.
WHOLE_LEVELS = 4

#: Levels that must be left below those for rows to be sent.
LEVELS_SENT = 3

#: Most rows of a node that one task takes (some 100 MB with ten features while it works).
NODE_ROWS = 2_000_000

#: Bytes of counts that the driver takes from tasks; more are added up by Spark before.
DRIVER_BYTES = 32 << 20

#: Bytes of counts in one row.
PIECE_BYTES = 1 << 20

#: Counts of (path, feature) that a search keeps between generations, in bytes.
KEPT_BYTES = 64 << 20

#: Bytes of rows that a task holds before it sends them on.
SENT_BYTES = 32 << 20


def thresholds(hist: np.ndarray, n_classes: int) -> dict:
    """Best threshold of each (slot, bin, class) histogram, by the train classes: arrays over slots."""
    train = hist[:, :, :n_classes]
    left = np.cumsum(train, axis=1)
    total = left[:, -1:, :]
    n, nl = total.sum(axis=2), left.sum(axis=2)
    nr = n - nl

    def entropy(c, size):
        with np.errstate(divide="ignore", invalid="ignore"):
            share = c / size[..., None]
            terms = np.where(c > 0, -share * np.log2(share), 0.0)
        out = terms[..., 0]
        for k in range(1, n_classes):
            out = out + terms[..., k]
        return np.where(size > 0, out, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = entropy(total, n) - (nl / n) * entropy(left, nl) - (nr / n) * entropy(total - left, nr)
    scale = 10.0 ** GAIN_DIGITS
    gain = np.floor(gain * scale + 0.5) / scale
    valid = (nl >= 1) & (nr >= 1) & (train.sum(axis=2) > 0)
    b = np.argmax(np.where(valid, gain, -np.inf), axis=1)  # the first of the largest
    at = np.arange(len(hist))
    return {"b": b, "valid": valid[at, b], "gain": np.where(valid[at, b], gain[at, b], 0.0) + 0.0,
            "left": np.cumsum(hist, axis=1)[at, b]}


class Growth:
    """Trees of one search over ``data``."""

    def __init__(self, data: TreeData):
        self.features, self.n_classes = len(data.features), data.n_classes
        self.n_bins = 1 + max((len(s) - 2 for s in data.splits.values()), default=0)
        self.cells = 2 * self.n_classes
        self.spark = data.rows.sparkSession
        blocks = data.blocks()
        self.blocks = brief_session(self.spark).read.schema(blocks.schema).parquet(*blocks.inputFiles()) \
            if blocks.inputFiles() else blocks
        self.parts: int | None = None
        self.trie = Trie()
        self.level: dict[int, int] = {0: 0}
        self.hist: dict[tuple, np.ndarray] = {}   # (path, feature) -> bin x class
        self.best: dict[tuple, dict] = {}

    # -- one tree per candidate

    def grow(self, feats: dict[int, list], max_depth: int, send: bool = True) -> tuple[list, list]:
        """``feats``: features of each candidate.  Returns node records as
        :func:`.tree.grow_population` and the (cand, label, prediction, count) of the test rows; of
        rows that were sent on there are no records."""
        feats = {c: sorted(f) for c, f in feats.items() if f}
        records, confusion, sent = [], {}, []
        L = self.n_classes
        open_ = [(c, 1, 0) for c in feats]
        totals: dict[int, np.ndarray] = {}
        splits: list = []

        def leaf(c, node, depth, path):
            cnt = totals[path]
            pred = _py_argmax(cnt[:L].tolist())
            records.append((c, node, depth, int(cnt[:L].sum()), cnt[:L].tolist(), None, None, None, pred, path))
            for label in np.flatnonzero(cnt[L:]).tolist():
                key = c, label, pred
                confusion[key] = confusion.get(key, 0) + int(cnt[L + label])
        for depth in range(max_depth + 1):
            if send and depth >= WHOLE_LEVELS and max_depth - depth >= LEVELS_SENT:
                small = {p for _, _, p in open_ if totals[p].sum() <= NODE_ROWS}
                sent += [(c, p, depth) for c, _, p in open_ if p in small]
                open_ = [x for x in open_ if x[2] not in small]
            if not open_:
                break
            needed: dict[int, set] = {}
            for c, _, path in open_:
                needed.setdefault(path, set()).update(feats[c])
            self._know(needed, splits, totals)
            if 0 in needed:
                totals[0] = self.hist[0, next(iter(needed[0]))].sum(axis=0)
                if not totals[0][:L].sum():  # without train rows there is no root
                    break
            nxt, taken = [], {}
            for c, node, path in open_:
                r = min((self.best[path, f] for f in feats[c]), key=lambda r: (not r["valid"], -r["gain"], r["f"], r["b"]))
                if depth == max_depth or not (r["valid"] and r["gain"] > 0):
                    leaf(c, node, depth, path)
                    continue
                cnt = totals[path]
                records.append((c, node, depth, int(cnt[:L].sum()), cnt[:L].tolist(), r["f"], r["b"], r["gain"],
                                _py_argmax(cnt[:L].tolist()), path))
                left, right = self.trie.split(path, r["f"], r["b"])
                self.level[left] = self.level[right] = depth + 1
                totals[left], totals[right] = r["left"], cnt - r["left"]
                taken[path, left, right] = None
                for child, kid in ((2 * node, left), (2 * node + 1, right)):
                    if depth + 1 == max_depth or np.count_nonzero(totals[kid][:L]) < 2:  # as deep as allowed, or one class
                        leaf(c, child, depth + 1, kid)
                    else:
                        nxt.append((c, child, kid))
            open_, splits = nxt, list(taken)
        for c, label, pred, count in self._send(sent, feats, totals, max_depth) if sent else ():
            key = c, label, pred
            confusion[key] = confusion.get(key, 0) + count
        self._forget()
        return records, [(*key, count) for key, count in sorted(confusion.items())]

    def _know(self, needed: dict[int, set], splits: list, totals: dict) -> None:
        """Counts and best thresholds of the needed features of each path, those of the root or of
        the children of ``splits`` (parent, left, right)."""
        new = {p: {f for f in fs if (p, f) not in self.hist} for p, fs in needed.items()}
        count = {0: new[0]} if 0 in new else {}
        less = []
        for parent, left, right in splits:
            small, large = (left, right) if totals[left].sum() <= totals[right].sum() else (right, left)
            count[small] = {f for f in new.get(small, set()) | new.get(large, set()) if (small, f) not in self.hist}
            less.append((parent, small, large))
        count = {p: sorted(fs) for p, fs in count.items() if fs}
        if count:
            self.hist |= self._count(count)
        for parent, small, large in less:
            for f in new.get(large, ()):
                self.hist[large, f] = self.hist[parent, f] - self.hist[small, f]
        fresh = [(p, f) for p, fs in needed.items() for f in fs if (p, f) not in self.best]
        if fresh:
            found = thresholds(np.stack([self.hist[x] for x in fresh]), self.n_classes)
            for i, (p, f) in enumerate(fresh):
                self.best[p, f] = {"f": f, "b": int(found["b"][i]), "valid": bool(found["valid"][i]), "gain": float(found["gain"][i]),
                                   "left": found["left"][i]}

    def _forget(self) -> None:
        """Drops the counts of the deepest paths beyond ``KEPT_BYTES``."""
        most = KEPT_BYTES // (self.n_bins * self.cells * 8 + 600)
        if len(self.hist) > most:
            keys = sorted(self.hist, key=lambda x: self.level[x[0]])
            for key in keys[most:]:
                self.hist.pop(key)
                self.best.pop(key, None)

    # -- jobs

    def _route(self, paths) -> dict[int, list]:
        """{path: [(feature, bin, left child or None, right child or None)]} on the way to ``paths``."""
        on_way = set()
        for p in paths:
            while p not in on_way:
                on_way.add(p)
                p = self.trie.parent.get(p, p)
        return {p: s for p in on_way if (s := [(f, b, x if x in on_way else None, y if y in on_way else None)
                                               for f, b, x, y in self.trie.splits.get(p, ()) if x in on_way or y in on_way])}

    def _count(self, wanted: dict[int, list]) -> dict[tuple, np.ndarray]:
        slots = [(p, f) for p in sorted(wanted) for f in wanted[p]]
        first = {}
        for i, (p, _) in enumerate(slots):
            first.setdefault(p, i)
        route, cells, size = self._route(wanted), self.cells, self.n_bins * self.cells
        used = sorted({f for _, f in slots} | {s[0] for ss in route.values() for s in ss})
        piece = max(1, PIECE_BYTES // (8 * size))   # slots of one row

        def run(it):
            total = np.zeros((len(slots), size), np.int64)
            for cls, col in B.chunks(it, used):
                coded: dict[int, np.ndarray] = {}
                for path, rows in _walk(route, first, col, len(cls)):
                    for i, f in enumerate(wanted[path], first[path]):
                        if f not in coded:
                            coded[f] = _code(col[f], cls, cells)
                        total[i] += np.bincount(coded[f] if rows is None else coded[f].take(rows), minlength=size)
            for lo in range(0, len(slots), piece):
                if (part := total[lo:lo + piece]).any():
                    yield pa.RecordBatch.from_pydict({"piece": pa.array([lo], pa.int32()), "counts": pa.array([part.tobytes()], pa.binary())})

        def add(table: pa.Table) -> pa.Table:
            return pa.table({"piece": table.column("piece")[:1], "counts": pa.array([_sum(table.column("counts")).tobytes()], pa.binary())})
        parts = self.blocks.select("cls", *[f"b{f}" for f in used]).mapInArrow(run, "piece int, counts binary")
        if self.parts is None:
            self.parts = self.blocks._jdf.queryExecution().toRdd().getNumPartitions()
        if len(slots) * size * 8 * self.parts > DRIVER_BYTES:
            parts = parts.groupBy("piece").applyInArrow(add, "piece int, counts binary")
        total = np.zeros((len(slots), size), np.int64)
        t = parts.toArrow()
        for lo, counts in zip(t.column("piece").to_pylist(), t.column("counts"), strict=True):
            got = np.frombuffer(counts.as_buffer(), np.int64).reshape(-1, size)
            total[lo:lo + len(got)] += got
        return {slot: total[i].reshape(self.n_bins, cells) for i, slot in enumerate(slots)}

    def _send(self, nodes: list, feats: dict, totals: dict, max_depth: int) -> list:
        """(cand, label, prediction, count) of the test rows of ``nodes`` (cand, path, depth), whose
        trees are grown in one task each."""
        nodes = sorted(nodes, key=lambda x: -totals[x[1]].sum())  # the large ones to tasks of their own
        units: dict[int, list] = {}
        for u, (_, p, _) in enumerate(nodes):
            units.setdefault(p, []).append(u)
        mine = [feats[c] for c, _, _ in nodes]
        deep = [max_depth - d for _, _, d in nodes]
        route, L, n_bins = self._route(units), self.n_classes, self.n_bins
        used = sorted({f for fs in mine for f in fs} | {s[0] for ss in route.values() for s in ss})

        def deal(it):
            held: dict[int, list] = {}
            size = 0

            def out():
                for u, parts in held.items():
                    yield pa.RecordBatch.from_pydict({"unit": pa.array([u], pa.int32()),
                                                      "rows": pa.array([np.concatenate(parts, axis=1).tobytes()], pa.binary())})
            for cls, col in B.chunks(it, used):
                for path, rows in _walk(route, units, col, len(cls)):
                    if rows is not None and not len(rows):
                        continue
                    for u in units[path]:
                        part = np.stack([x if rows is None else x.take(rows) for x in (cls, *[col[f] for f in mine[u]])])
                        held.setdefault(u, []).append(part)
                        size += part.size
                if size > SENT_BYTES:
                    yield from out()
                    held, size = {}, 0
            yield from out()

        def grown(it):
            unit, parts = None, []

            def out():
                k = len(mine[unit]) + 1
                rows = np.concatenate([np.frombuffer(p, np.uint8).reshape(k, -1) for p in parts], axis=1)
                counts = grow_rows(rows[0], rows[1:], deep[unit], n_bins, L)
                label, pred = np.nonzero(counts)
                return pa.RecordBatch.from_pydict({"unit": np.full(len(label), unit, np.int32), "label": label.astype(np.int32),
                                                   "prediction": pred.astype(np.int32), "n": counts[label, pred]})
            for batch in it:
                for u, p in zip(batch.column("unit").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                    if u != unit and parts:
                        yield out()
                        parts = []
                    unit = u
                    parts.append(p)
            if parts:
                yield out()
        tasks = min(len(nodes), 4 * self.spark.sparkContext.defaultParallelism)
        dealt = self.blocks.select("cls", *[f"b{f}" for f in used]).mapInArrow(deal, "unit int, rows binary")
        t = dealt.repartitionById(tasks, dealt["unit"]).sortWithinPartitions("unit") \
            .mapInArrow(grown, "unit int, label int, prediction int, n long").toArrow()
        return [(nodes[u][0], label, pred, n) for u, label, pred, n in zip(*[c.to_pylist() for c in t.columns], strict=True)]


def _code(col: np.ndarray, cls: np.ndarray, cells: int) -> np.ndarray:
    return col.astype(np.uint16) * np.uint16(cells) + cls


def _sum(parts) -> np.ndarray:
    total = 0
    for p in parts:
        total = total + np.frombuffer(p.as_buffer(), np.int64)
    return total


def _walk(route: dict, wanted, col: dict, n: int):
    """(path, its rows) of the wanted paths; None for all rows."""
    todo: list = [(0, None)]
    while todo:
        path, rows = todo.pop()
        if path in wanted:
            yield path, rows
        for f, b, left, right in route.get(path, ()):
            high = (col[f] if rows is None else col[f].take(rows)) > b
            for kid, here in ((left, ~high if left is not None else None), (right, high)):
                if kid is not None:
                    todo.append((kid, np.flatnonzero(here) if rows is None else rows[here]))


def grow_rows(cls: np.ndarray, bins: np.ndarray, depth: int, n_bins: int, n_classes: int) -> np.ndarray:
    """Test rows by (label, prediction) of the tree of at most ``depth`` levels over these rows
    (``bins``: feature x row).  A level's nodes are counted together."""
    cells = 2 * n_classes
    size = n_bins * cells
    confusion = np.zeros((n_classes, n_classes), np.int64)

    def leaves(counts):
        pred = np.argmax(counts[:, :n_classes], axis=1)
        np.add.at(confusion.T, pred, counts[:, n_classes:])
    node, counts = np.zeros(len(cls), np.int64), np.bincount(cls, minlength=cells)[None]
    for level in range(depth + 1):
        done = np.count_nonzero(counts[:, :n_classes], axis=1) < 2 if level else np.zeros(1, bool)
        if level == depth:
            done[:] = True
        leaves(counts[done])
        if done.all():
            break
        number = np.where(done, -1, np.cumsum(~done) - 1)
        node = number[node]
        if done.any():
            keep = node >= 0
            cls, bins, node = cls[keep], bins[:, keep], node[keep]
        counts = counts[~done]
        many = len(counts)
        base = node * size + cls
        best = None
        for f in range(len(bins)):
            hist = np.bincount(base + bins[f].astype(np.int64) * cells, minlength=many * size).reshape(many, n_bins, cells)
            r = thresholds(hist, n_classes) | {"f": np.full(many, f)}
            if best is None:
                best = r
            else:
                better = r["valid"] & (~best["valid"] | (r["gain"] > best["gain"]))
                best = {k: np.where(better[:, None] if v.ndim == 2 else better, r[k], v) for k, v in best.items()}
        split = best["valid"] & (best["gain"] > 0)
        leaves(counts[~split])
        left = np.where(split, 2 * (np.cumsum(split) - 1), -1)
        at = left[node]
        keep = at >= 0
        if not keep.all():
            cls, bins, node, at = cls[keep], bins[:, keep], node[keep], at[keep]
        node = at + (bins[best["f"][node], np.arange(len(node))] > best["b"][node])
        kids = np.empty((2 * int(split.sum()), cells), np.int64)
        kids[0::2], kids[1::2] = best["left"][split], (counts - best["left"])[split]
        counts = kids
        if not len(counts):
            break
    return confusion
