"""Whitening of embeddings by eigenvectors that FEAST contour integration finds.

Executors quantise the vectors, keep each different one once, and sum exact totals and the centred covariance. The
covariance is one small matrix; its leading eigenvalues are enclosed in an interval, whose invariant subspace comes from
a quadrature of complex shifted solves around it. Rayleigh-Ritz takes the components out, and the inertia of shifted
covariances (signs of a symmetric factorisation) says how many there must be, so that none is missed. Executors then
project every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wicker.llm.common import discard, stash

COMPONENTS, SCALE = 4, 256
#: Eigenvalues below this share of the greatest are rounding, not directions.
RANK = 1e-12
#: Rows of a batch that are worked on together.
ROWS = 4096


def inertia(matrix: np.ndarray) -> int:
    """Number of positive eigenvalues of a symmetric matrix, from the pivots of its factorisation (Bunch and Parlett: 1 by 1 and 2 by 2 blocks, complete pivoting)."""
    a, positive = np.array(matrix, dtype=np.float64), 0
    while (m := len(a)) > 0:
        diagonal = np.abs(np.diagonal(a))
        r = int(np.argmax(diagonal))
        off = np.abs(a - np.diag(np.diagonal(a)))
        i, j = np.unravel_index(int(np.argmax(off)), off.shape)
        if max(diagonal[r], off[i, j]) == 0:
            return positive
        picked = [r] if diagonal[r] >= (1 + 17**0.5) / 8 * off[i, j] else [i, j]
        rest = np.setdiff1d(np.arange(m), picked)
        block, side = a[np.ix_(picked, picked)], a[np.ix_(rest, picked)]
        # A 2 by 2 pivot has a negative determinant: one eigenvalue on either side.
        positive += int(block[0, 0] > 0) if len(picked) == 1 else 1
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return positive


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of v are greater than shift."""
    return inertia(v - shift * np.eye(len(v)))


def enclosing(v: np.ndarray, wanted: int) -> tuple[float, float, int]:
    """An interval that holds at least the `wanted` greatest eigenvalues, and how many it holds, by bisection on counts. It ends in a gap where there is one; eigenvalues that agree to 1e-9 are taken together."""
    top = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-6)
    low, high = -1e-6 * top, top
    # Invariant: at least `wanted` above low, fewer above high.
    while high - low > 1e-9 * top:
        middle = (low + high) / 2
        low, high = (middle, high) if above(v, middle) >= wanted else (low, middle)
    # The last one wanted lies in (low, high]; the end goes to the middle of the gap to the next one below, if it has any.
    held = above(v, low)
    least, floor = -1e-6 * top, low
    if above(v, least) > held:
        while floor - least > 1e-9 * top:
            middle = (floor + least) / 2
            least, floor = (middle, floor) if above(v, middle) > held else (least, middle)
        return (low + floor) / 2, top, held
    return low - 1e-7 * top, top, above(v, low - 1e-7 * top)


def feast(v: np.ndarray, low: float, high: float, expected: int, nodes: int = 8, rounds: int = 40, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in (low, high), falling, and their unit eigenvectors as columns.

    Each round filters a subspace by the contour integral of (z - v)^-1 (Gauss-Legendre points on a half circle; the
    other half is its conjugate), and solves the small problem in it. It ends once `expected` Ritz pairs lie inside with
    residuals at rounding level; if too few show up, or rounds pass without that, the subspace grows, at last to all of it.
    """
    d, rng = len(v), np.random.default_rng(seed)
    x, weights = np.polynomial.legendre.leggauss(nodes)
    angle = -np.pi / 2 * (x - 1)
    centre, radius, norm = (low + high) / 2, (high - low) / 2, max(float(np.abs(v).max()), 1e-300)
    size = min(d, expected + max(4, expected // 2))
    basis = rng.standard_normal((d, size))
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for k in range(1, rounds + 1):
        filtered = np.zeros((d, basis.shape[1]))
        for a, w in zip(angle, weights, strict=True):
            turn = radius * np.exp(1j * a)
            filtered += w / 2 * (turn * np.linalg.solve((centre + turn) * np.eye(d) - v, basis.astype(complex))).real
        q = np.linalg.qr(filtered)[0]
        values, small = np.linalg.eigh(q.T @ v @ q)
        vectors = q @ small
        inside = np.flatnonzero((values > low) & (values < high))[::-1]
        if len(inside) == expected:
            e, u = values[inside], vectors[:, inside]
            worst = float(np.abs(v @ u - u * e).max()) / norm
            if best is not None and worst >= best[0] / 2 and worst < 1e-12:
                return (best if best[0] < worst else (worst, e, u))[1:]
            best = (worst, e, u)
        if (len(inside) < expected or k % 8 == 0) and basis.shape[1] < d:
            vectors = np.concatenate([vectors, rng.standard_normal((d, min(basis.shape[1], d - basis.shape[1])))], axis=1)
        basis = vectors
    if best is None:
        raise RuntimeError(f"{expected} eigenvalues lie in the interval, but the contour found other numbers")
    return best[1:]


def leading(v: np.ndarray, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues, at most `components` and only those above rounding, falling, with unit eigenvectors as columns; how many there are is checked by inertia."""
    if not len(v) or not np.abs(v).max() > 0:
        return np.zeros(0), np.zeros((len(v), 0))
    norm = float(np.abs(v).max())
    scaled = v / norm
    low, high, held = enclosing(scaled, min(components, len(v)))
    e, u = feast(scaled, low, high, held)
    if above(scaled, low) != len(e):
        raise RuntimeError("components are missing: the inertia counts more eigenvalues than were found")
    keep = np.flatnonzero(e > RANK * e[0])[:components]
    return e[keep] * norm, u[:, keep]


def sound(c: Column) -> Column:
    """The vector is there and all its entries are finite numbers."""
    return c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x: floor(256 c) of each entry as long."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("c")).where(sound(F.col("c")))
    return rows.select("vec_id", F.transform("c", lambda c: F.floor(c * F.lit(float(SCALE)))).alias("x"))


def blocks(batches: Iterator[pa.RecordBatch], column: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their lists as a matrix of longs; shorter vectors end in zeros."""
    for whole in batches:
        for lo in range(0, whole.num_rows, ROWS):
            batch = whole.slice(lo, ROWS)
            lists = batch.column(column)
            flat, sizes = np.asarray(lists.flatten(), dtype=np.int64), np.asarray(lists.value_lengths(), dtype=np.int64)
            if len(sizes) and (sizes == width).all():
                yield batch, flat.reshape(len(sizes), width)
                continue
            out = np.zeros((len(sizes), width), dtype=np.int64)
            of = np.repeat(np.arange(len(sizes)), sizes)
            out[of, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
            yield batch, out


def summed(rows: DataFrame, of, size: int) -> np.ndarray:
    """Sums over all rows of of(matrix of x) [size]: each task sends one partial array, Spark adds them entry by entry."""
    width = rows.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros(size), False
        for _, x in blocks(batches, 0, width):
            total, any_rows = total + of(x), True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["k", "value"])

    found = rows.mapInArrow(run, "k int, value double").groupBy("k").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(size)
    out[found["k"].to_numpy(dtype=np.int64)] = found["value"].to_numpy()
    return out


def exact_totals(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """n and the exact sum of each dimension, as whole numbers of any size."""
    each = fit.select(F.posexplode("x").alias("k", "x")).groupBy("k").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s"))
    sums = {r["k"]: int(r["s"]) for r in each.collect()}
    return fit.count(), [sums.get(k, 0) for k in range(width)]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exactly; null where it exceeds a long."""
    most = max(n * int(np.abs(x).max(initial=0)), max(map(abs, sums), default=0)) * 2
    if most * most * max(1, len(sums)) < 1 << 63:
        return ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    wide = ((n * x.astype(object) - np.array(sums, dtype=object)) ** 2).sum(axis=1)
    return [v if v < 1 << 63 else None for v in wide]


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row per sound row and component.

    Rows whose vector is null or holds a null or non-finite entry are dropped; repeated rows and null ids are kept and
    get rows each. Vectors shorter than the longest count as ending in zeros. Directions without variance are no
    components: fewer different vectors than needed give fewer components, a single one gives no rows, and so does an
    empty table. deviation is null where it exceeds a long. Of equal eigenvalues any basis may come out, the same for
    all rows. Other columns are not read. Only sums over all rows (one covariance matrix) reach the driver.
    """
    rows = quantised(vectors, id_col, vector_col)
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    # Shorter vectors are padded before they are told apart.
    x = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    rows = rows.withColumn("x", x)
    fit = stash(rows.select("x").distinct())
    fit.width = width
    n, sums = exact_totals(fit, width)
    mean = np.array([s / n for s in sums]) if n else np.zeros(width)
    upper = np.triu_indices(width)
    v = np.zeros((width, width))
    v[upper] = summed(fit, lambda x: ((x - mean).T @ (x - mean))[upper], len(upper[0])) / max(n, 1)
    v = v + np.triu(v, 1).T
    e, u = leading(v, components)
    k = len(e)
    to = u / np.sqrt(e) if k else u
    # Mean and covariance of the whitened fit list: its mean is zero but for rounding, which the last step takes off.
    pairs = np.triu_indices(k)
    moments = summed(fit, lambda x: (lambda w: np.r_[w.sum(axis=0), (w.T @ w)[pairs]])((x - mean) @ to), k + len(pairs[0])) / max(n, 1)
    discard(fit)
    centred = moments[k:] - np.outer(moments[:k], moments[:k])[pairs]
    error = float(np.abs(centred - np.eye(k)[pairs]).max(initial=0.0))
    share = e / np.trace(v) if k else e
    held = vectors.sparkSession.sparkContext.broadcast((mean, to, sums, share))
    of_id = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, to, sums, share = held.value
        for batch, x in blocks(batches, 1, width):
            m = len(x)
            if not m or not k:
                continue
            w, at = (x - mean) @ to, np.repeat(np.arange(m), k)
            columns = [batch.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()), pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(at)), pa.array(w.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, f"vec_id {of_id}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
