"""Tables of binned rows as blocks of columns, and exact cut points of many numeric columns.

A block is one row: ``cls`` (a byte per example: its label, plus the number of classes for a test
row) and ``b0``, ``b1`` ... (a byte per example: the bin of one feature).  Tasks read whole columns
of the features they need, without work per example on the way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

#: Examples of a block; some kilobytes a column, so that readers and writers hold few megabytes.
BLOCK_ROWS = 8192

#: Examples that a task works on at a time: their columns stay in a core's cache.
CHUNK_ROWS = 1 << 17

#: Bytes of a Parquet row group, the most that a reader decodes at once.
GROUP_BYTES = 32 << 20

#: Classes that fit the byte of a label and the mark of a test row.
MOST_CLASSES = 127


def _cut(chunks, n_features: int):
    """(cls, bins feature x example) of any length -> record batches of one block each."""
    held, rows = [], 0

    def out(cls, bins):
        columns = [cls.tobytes(), *[bins[f].tobytes() for f in range(n_features)]]
        return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns],
                                          names=["cls", *[f"b{f}" for f in range(n_features)]])
    for chunk in chunks:
        held.append(chunk)
        rows += len(chunk[0])
        if rows >= BLOCK_ROWS:
            cls, bins = np.concatenate([c for c, _ in held]), np.concatenate([b for _, b in held], axis=1)
            whole = rows - rows % BLOCK_ROWS
            for lo in range(0, whole, BLOCK_ROWS):
                yield out(cls[lo:lo + BLOCK_ROWS], bins[:, lo:lo + BLOCK_ROWS])
            held, rows = [(cls[whole:], bins[:, whole:])], rows - whole
    if rows:
        yield out(np.concatenate([c for c, _ in held]), np.concatenate([b for _, b in held], axis=1))


def _written(blocks: DataFrame) -> DataFrame:
    path = scratch_path(blocks.sparkSession, "blocks")
    blocks.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return blocks.sparkSession.read.schema(blocks.schema).parquet(path)


def _schema(n_features: int) -> str:
    return ", ".join(["cls binary", *[f"b{f} binary" for f in range(n_features)]])


def _classes(batch, n_classes: int) -> np.ndarray:
    label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
    train = batch.column("is_train").to_numpy(zero_copy_only=False).astype(bool)
    return (label + np.where(train, 0, n_classes)).astype(np.uint8)


def of_packed(rows: DataFrame, n_features: int, n_classes: int) -> DataFrame:
    """Blocks of rows with ``is_train``, ``label`` and ``packed`` (a byte per feature), written."""
    def run(it):
        def chunks():
            for batch in it:
                bins = np.frombuffer(b"".join(batch.column("packed").to_pylist()), np.uint8).reshape(-1, n_features)
                yield _classes(batch, n_classes), np.ascontiguousarray(bins.T)
        yield from _cut(chunks(), n_features)
    known = rows.filter(F.col("is_train").isNotNull()).select("is_train", "label", "packed")
    return _written(known.mapInArrow(run, _schema(n_features)))


def _numbers(column) -> np.ndarray:
    """A column of doubles with NULL, NaN and the infinities as 0, as :func:`.prepare.impute_zero` has them."""
    x = column.to_numpy(zero_copy_only=False)
    return x if np.isfinite(x).all() else np.where(np.isfinite(x), x, 0.0)


def of_numbers(rows: DataFrame, features: list[Column], splits: list[list], n_classes: int) -> DataFrame:
    """Blocks of rows with ``is_train`` and ``label``, written; a bin is the number of inner cuts
    strictly below the value.  ``features`` are doubles, imputed with 0."""
    inner = [np.array(s[1:-1], np.float64) for s in splits]

    def run(it):
        def chunks():
            for batch in it:
                bins = np.empty((len(inner), batch.num_rows), np.uint8)
                for f, cuts in enumerate(inner):
                    bins[f] = np.searchsorted(cuts, _numbers(batch.column(f"x{f}")), "left")
                yield _classes(batch, n_classes), bins
        yield from _cut(chunks(), len(inner))
    known = rows.filter(F.col("is_train").isNotNull()).select(
        "is_train", "label", *[x.alias(f"x{f}") for f, x in enumerate(features)])
    return _written(known.mapInArrow(run, _schema(len(inner))))


def chunks(it, used: list[int]):
    """(cls, {feature: its bins}) of some ``CHUNK_ROWS`` examples each, from batches of blocks."""
    names = ["cls", *[f"b{f}" for f in used]]
    held, rows = [], 0

    def out():
        columns = [np.concatenate([h[i] for h in held]) for i in range(len(names))]
        return columns[0], dict(zip(used, columns[1:], strict=True))
    for batch in it:
        columns = [batch.column(n) for n in names]
        for i in range(batch.num_rows):
            held.append([np.frombuffer(c[i].as_buffer(), np.uint8) for c in columns])
            rows += len(held[-1][0])
            if rows >= CHUNK_ROWS:
                yield out()
                held, rows = [], 0
    if rows:
        yield out()


# ---------------------------------------------------------------- exact cut points

#: Cells that a round cuts an interval into, once equal in value and once in magnitude.
CELLS = 128

#: The first round's edges: 32 to a doubling, whatever the column.
_FIRST = np.unique(np.concatenate([s * np.ldexp(1 + np.arange(32) / 32, e) for e in range(-40, 60) for s in (-1, 1)] + [[0.0, 5e-324]]))


def _order(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, np.int64(-2 ** 63) - bits, bits)


def _double(order: np.ndarray) -> np.ndarray:
    return np.where(order < 0, np.int64(-2 ** 63) - order, order).view(np.float64)


def _edges(lo: float, hi: float, cells: int) -> np.ndarray:
    """Ascending values in (lo, hi) that part it."""
    share = np.arange(1, cells) / cells
    a, b = (int(v) for v in _order(np.array([lo, hi])))
    steps = _double(np.array([a + (b - a) * i // cells for i in range(1, cells)], np.int64))
    edges = np.unique(np.concatenate([lo * (1 - share) + hi * share, steps]))
    return edges[(edges > lo) & (edges < hi)]


def exact_splits(rows: DataFrame, features: list[Column], num_buckets: int) -> list[list]:
    """The split arrays that ``discretize.fit_splits`` gives for doubles imputed with 0, by counting.

    Tasks sort a column's values chunk by chunk and count them between edges, with the least and
    largest value of each cell; the cell that holds a wanted rank is cut again until it has one
    value.  A few passes, whatever the rows; a task hands on one row per cell that has values."""
    xs = rows.select(*[x.alias(f"x{f}") for f, x in enumerate(features)])
    found: list[dict] = [{} for _ in features]
    edges = [_FIRST for _ in features]
    cells = _count_cells(xs, edges, list(range(len(features))))
    # A feature's wanted (rank, quantile), in order.
    todo = [[(-(-j * sum(c for c, *_ in of) // num_buckets), j) for j in range(1, num_buckets)] if of else [] for of in cells]
    while True:
        for f, of in enumerate(cells):
            below, i, cut = 0, 0, {}
            for count, lo, hi in of:
                while i < len(todo[f]) and todo[f][i][0] <= below + count:
                    if lo == hi:
                        found[f][todo[f][i][1]] = lo
                    else:
                        cut.setdefault((lo, hi), []).append(todo[f][i])
                    i += 1
                below += count
            todo[f] = [x for ranks in cut.values() for x in ranks]
            each = max(CELLS, CELLS * num_buckets // max(1, len(cut)) // 2)
            edges[f] = np.unique(np.concatenate([e for lo, hi in cut for e in (_edges(lo, hi, each), [lo, hi, np.nextafter(hi, np.inf)])])) \
                if cut else np.array([])
        if not any(todo):
            break
        cells = _count_cells(xs, edges, [f for f, ranks in enumerate(todo) if ranks])
    out = []
    for f in range(len(features)):
        inner = [found[f][j] + 0.0 for j in range(1, num_buckets)] if found[f] else []
        out.append(sorted({float("-inf"), *inner, float("inf")}))
    return out


def _count_cells(xs: DataFrame, edges: list[np.ndarray], used: list[int]) -> list[list]:
    """Per column the (count, least, largest value) of the cells between edges that have values, in order."""
    def run(it):
        total = {f: (np.zeros(len(edges[f]) + 1, np.int64), np.full(len(edges[f]) + 1, np.inf), np.full(len(edges[f]) + 1, -np.inf))
                 for f in used}
        held, rows = [], 0

        def count():
            for f in used:
                x = np.sort(np.concatenate([_numbers(b.column(f"x{f}")) for b in held]))
                at = np.concatenate([[0], np.searchsorted(x, edges[f], "left"), [len(x)]])
                n, least, most = total[f]
                some = np.flatnonzero(at[1:] > at[:-1])
                n[some] += at[1:][some] - at[:-1][some]
                least[some] = np.minimum(least[some], x[at[:-1][some]])
                most[some] = np.maximum(most[some], x[at[1:][some] - 1])
        for batch in it:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                count()
                held, rows = [], 0
        if rows:
            count()
        for f in used:
            n, least, most = total[f]
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"f": np.full(len(some), f, np.int32), "cell": some.astype(np.int32), "n": n[some],
                                              "lo": least[some], "hi": most[some]})
    parts = xs.select(*[f"x{f}" for f in used]).mapInArrow(run, "f int, cell int, n long, lo double, hi double")
    t = parts.groupBy("f", "cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toArrow()
    f, cell, n, lo, hi = (t.column(c).to_numpy() for c in ("f", "cell", "n", "lo", "hi"))
    out: list[list] = [[] for _ in edges]
    for i in np.lexsort((cell, f)).tolist():
        out[f[i]].append((int(n[i]), float(lo[i]), float(hi[i])))
    return out
