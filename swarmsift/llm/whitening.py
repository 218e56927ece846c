"""Embedding whitening with eigenpairs from FEAST contour integration.

Vectors are put on an integer grid, x = floor(64 c) + 1000000, and the model is fitted on
every distinct grid vector once.  Spark makes the distinct vectors, their exact sums and
the centred covariance V; what reaches the driver is one vector and one matrix of the
vectors' length.

FEAST on V, a matrix of that length:

1. The spectrum is cut into intervals of at most ``BLOCK`` eigenvalues by bisection;
   the inertia of V - s, from a pivoted LDL^T factorization, counts the eigenvalues
   below s.
2. Per interval, a circle around it is the contour.  Quadrature over its upper half sums
   solutions of the complex shifted systems (z - V) Y = Q: a filter that keeps the
   interval's eigenvectors and damps all others.
3. Rayleigh-Ritz on the filtered, orthonormalized block gives eigenpairs; steps 2 and 3
   repeat until the residuals reach double precision.
4. The pairs found inside an interval must be as many as inertia counted there; if not, the
   block is widened and filtered again.

A second pass over the fit list measures the covariance of the whitened vectors against the
identity.  Components whose eigenvalue is below 10^-12 of the largest belong to the
covariance's null space: there is nothing to divide by, and they are left out.

Defined results: null vectors and those with null or non-finite entries are dropped; a null
vec_id stays null; repeated rows each get their rows, but count once in the fit; vectors of
another length are fitted and whitened among themselves; fewer distinct vectors than
needed give fewer components (none for one distinct vector or an empty table); entries beyond
+-2^40 are not a grid that sums exactly and fail with an error; a deviation that a long
cannot hold is null; eigenvalues that are equal to rounding share their space in any basis,
the same for all rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

GRID, OFFSET = 64.0, 1_000_000
COMPONENTS = 16
BLOCK = 8                # eigenvalues per interval
NODES = 8                # quadrature points on the upper half of a contour
ROUNDS = 40
NULL_SPACE = 1e-12       # share of the largest eigenvalue
CHUNK = 4096             # vectors multiplied at a time


# ------------------------------------------------------------------ eigenpairs of one symmetric matrix

def inertia_below(v: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of v below ``shift``: negative pivots of LDL^T of v - shift,
    with 1x1 and 2x2 pivots chosen after Bunch and Kaufman on the whole remaining block."""
    a = v - shift * np.eye(len(v))
    alpha = (1 + np.sqrt(17)) / 8
    below = 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        p = int(np.argmax(diagonal))
        apart = np.abs(np.tril(a, -1))
        i, j = np.unravel_index(int(np.argmax(apart)), apart.shape)
        if diagonal[p] >= alpha * apart[i, j]:
            if diagonal[p] == 0:  # nothing is left: eigenvalues equal to the shift
                return below
            below += int(a[p, p] < 0)
            rest = np.delete(np.arange(len(a)), p)
            a = a[np.ix_(rest, rest)] - np.outer(a[rest, p], a[rest, p]) / a[p, p]
        else:
            pivot = [int(i), int(j)]
            block = a[np.ix_(pivot, pivot)]
            below += 1 + int(block[0, 0] < 0 and np.linalg.det(block) > 0) - int(block[0, 0] > 0 and np.linalg.det(block) > 0)
            rest = np.delete(np.arange(len(a)), pivot)
            cross = a[np.ix_(rest, pivot)]
            a = a[np.ix_(rest, rest)] - cross @ np.linalg.solve(block, cross.T)
        a = (a + a.T) / 2
    return below


def intervals(v: np.ndarray, wanted: int, block: int = BLOCK) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues in it) from the top, until ``wanted`` eigenvalues are covered.

    An interval holds at most ``block`` eigenvalues, unless they cannot be told apart."""
    d = len(v)
    radius = np.abs(v).sum(axis=1) - np.abs(np.diag(v))
    top = float((np.diag(v) + radius).max())
    top += 1e-3 * abs(top) + np.finfo(float).tiny
    bottom = float((np.diag(v) - radius).min()) - 1e-3 * abs(top)
    least = 1e-10 * top  # narrower intervals are not cut
    out = []
    high, above = top, 0  # above: eigenvalues over ``high``
    while above < min(wanted, d):
        low, far = bottom, d - inertia_below(v, bottom)
        near = high  # low <= edge <= near: halve until the interval from edge to high has 1..block eigenvalues
        while far - above > block and near - low > least:
            edge = (low + near) / 2
            count = d - inertia_below(v, edge)
            if count == above:
                near = edge
            else:
                low, far = edge, count
        out.append((low, near if near < high else high, far - above))
        high, above = low, far
    return out


def feast(v: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of v with eigenvalues in (low, high), largest first."""
    d = len(v)
    centre, radius = (low + high) / 2, (high - low) / 2
    x, w = np.polynomial.legendre.leggauss(NODES)
    angle = np.pi / 2 * (1 + x)
    size = min(d, max(count + 4, 3 * count // 2))
    scale = np.abs(v).sum(axis=1).max()
    while True:
        q = np.linalg.qr(np.random.default_rng(d).standard_normal((d, size)))[0]
        before = np.inf
        for _ in range(ROUNDS):
            y = np.zeros_like(q)
            for t, weight in zip(angle, w, strict=True):
                turn = radius * np.exp(1j * t)
                y += weight / 2 * np.real(turn * np.linalg.solve((centre + turn) * np.eye(d) - v, q.astype(complex)))
            q = np.linalg.qr(y)[0]
            e, s = np.linalg.eigh(q.T @ v @ q)  # Rayleigh-Ritz
            q = q @ s
            inside = (e > low) & (e < high)
            rest = np.abs(v @ q[:, inside] - q[:, inside] * e[inside]).max(initial=0) / scale
            if inside.sum() == count and (rest <= 1e-15 * d or rest >= before / 2 and rest <= 1e-13 * d):
                by = np.argsort(-e[inside], kind="stable")
                return e[inside][by], q[:, inside][:, by]
            before = rest
        if size == d:
            raise ArithmeticError(f"found {int(inside.sum())} of {count} eigenvalues in ({low}, {high})")
        size = min(d, 2 * size)


def top_components(v: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues above the null space, falling, and their unit eigenvectors (columns)."""
    if not np.abs(v).max(initial=0):
        return np.empty(0), np.empty((len(v), 0))
    scale = float(np.abs(v).max())
    found = [feast(v / scale, *each) for each in intervals(v / scale, wanted)]
    e = np.concatenate([x for x, _ in found])
    u = np.linalg.qr(np.concatenate([y for _, y in found], axis=1))[0]  # blocks at right angles to rounding
    keep = np.flatnonzero(e > NULL_SPACE * e[0])[:wanted]
    return e[keep] * scale, u[:, keep]


# ------------------------------------------------------------------ over tables

def grid_rows(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(vec_id, x): the rows that remain, on the grid."""
    v = F.col(vec)
    fine = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * GRID) + F.lit(OFFSET).cast("long"))
    return vectors.filter(fine).select(F.col(key).cast("long").alias("vec_id"), x.alias("x"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.int64)


def _sums(it):
    total, most = None, 0
    for pdf in it:
        if len(pdf):
            x = _matrix(pdf["x"])
            most = max(most, int(np.abs(x).max()))
            if most > 1 << 40:
                raise ValueError("an entry beyond 2^40 on the grid: its sums would not be exact")
            total = x.sum(axis=0) + (0 if total is None else total)
    if total is not None:
        yield pd.DataFrame({"place": np.arange(len(total)), "value": total})


def _outer(centre, project=None):
    """Sums of products of centred vectors, one row per cell of the upper triangle."""
    def run(it):
        total = None
        for pdf in it:
            for lo in range(0, len(pdf), CHUNK):
                z = _matrix(pdf["x"].iloc[lo:lo + CHUNK]) - centre
                z = z if project is None else z @ project
                z = np.concatenate([z, np.ones((len(z), 1))], axis=1)  # the last column gives sums
                total = z.T @ z + (0 if total is None else total)
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pd.DataFrame({"i": i, "j": j, "value": total[i, j]})
    return run


def _covariance(fit: DataFrame, n: int, centre: np.ndarray, project: np.ndarray | None = None) -> np.ndarray:
    """Covariance, divisor n, of the fit list's vectors or of their projections."""
    d = len(centre) if project is None else project.shape[1]
    cells = fit.mapInPandas(_outer(centre, project), "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    out = np.zeros((d + 1, d + 1))
    for r in cells.collect():  # a cell per pair of dimensions
        out[r.i, r.j] = out[r.j, r.i] = r.value
    mean = out[d, :d] / n      # rounding of the centre only
    return out[:d, :d] / n - np.outer(mean, mean)


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whiten(rows: DataFrame, fit: DataFrame, n: int, components: int) -> DataFrame:
    """Rows of one vector length, whitened with the model fitted on ``fit``, its distinct vectors."""
    spark = rows.sparkSession
    sums = fit.mapInPandas(_sums, "place int, value long").groupBy("place").agg(F.sum("value").alias("value"))
    s = np.array([r.value for r in sorted(sums.collect())], np.int64)  # one number per dimension
    if not len(s):
        return spark.createDataFrame([], SCHEMA)
    centre = s / n
    v = _covariance(fit, n, centre)
    e, u = top_components(v, components)
    if not len(e):
        return spark.createDataFrame([], SCHEMA)
    project = u / np.sqrt(e)
    error = float(np.abs(_covariance(fit, n, centre, project) - np.eye(len(e))).max())
    explained, k = e / np.trace(v), len(e)

    def run(it):
        for pdf in it:
            for lo in range(0, len(pdf), CHUNK):
                part = pdf.iloc[lo:lo + CHUNK]
                x = _matrix(part["x"])
                away = (x - centre) * n
                wide = (np.abs(away).max(axis=1) > 2.0**62) | ((away * away).sum(axis=1) > 9.2e18)
                far = n * np.where(wide[:, None], 0, x) - np.where(wide[:, None], 0, s)
                deviation = pd.arrays.IntegerArray((far * far).sum(axis=1).repeat(k), wide.repeat(k))
                yield pd.DataFrame({
                    "vec_id": part["vec_id"].astype("Int64").array.repeat(k), "component": np.tile(np.arange(1, k + 1), len(part)),
                    "n": n, "deviation": deviation, "whitened": ((x - centre) @ project).ravel(),
                    "explained": np.tile(explained, len(part)), "identity_error": error})
    return rows.mapInPandas(run, SCHEMA)


def whiten(vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per remaining row and component."""
    rows = cut_lineage(grid_rows(vectors, key, vec).withColumn("dims", F.size("x")), "grid_rows")
    fit = cut_lineage(rows.select("dims", "x").distinct(), "grid_distinct")
    lengths = sorted((r.dims, r.n) for r in fit.groupBy("dims").agg(F.count("*").alias("n")).collect())  # a row per vector length
    out = vectors.sparkSession.createDataFrame([], SCHEMA)
    for dims, n in lengths:
        if dims:
            own = _whiten(rows.filter(F.col("dims") == dims).select("vec_id", "x"), fit.filter(F.col("dims") == dims).select("x"), n, components)
            out = own if len(lengths) == 1 else out.unionByName(own)
    return out
