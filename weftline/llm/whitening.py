"""Embedding whitening by a randomised range finder (operator 13).

The covariance V is never formed from samples: every product with it is a pass over all
centred rows, in which each task adds up its rows' share of V times a small matrix, and
the shares are summed by entry. The range finder starts from a random matrix with
OVERSAMPLE more columns than components and repeats such passes (power iteration). After
each pass Rayleigh-Ritz turns the small projected matrix into components, whose residuals
||V u - e u|| come from the same pass. When POWER_PASSES passes leave a residual above
TOLERANCE times the largest eigenvalue, or when a component is no better separated from
those that follow than its residual, the basis is filled up to the full dimension, whose
one pass is exact to double precision.

Entries are counted on a grid: x = floor(SCALE * c) + SHIFT as a long, so that the number
of rows and the sums are exact, as are the deviations of rows. Rows are centred by their
mean before anything is multiplied.

The driver holds matrices of the dimension by the basis (of the dimension squared, if the
basis is full), and nothing that grows with the rows.

Defined cases: vectors that are null, empty or hold null or non-finite entries are
dropped, as are those with an entry beyond LARGEST in size and those that are not of the
most frequent length (of two such lengths, the longer); repeated rows count as often as they occur; a null vec_id is kept; the
components end before the first whose eigenvalue is below RANK times the largest, so a
constant table has none and gives no row, like an empty one; of an eigenvalue that occurs
several times any orthonormal components may come; a component's largest entry (the
first of equal ones) is positive; a deviation beyond a long is null. Only vec_id
and embedding are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm._graph import table, written

SCALE, SHIFT = 1024, 100_000
#: Components, further columns of the basis, passes before the basis becomes full.
COMPONENTS, OVERSAMPLE, POWER_PASSES = 8, 10, 3
#: Entries beyond this have no exact place on the grid.
LARGEST = float(1 << 40)
#: Largest residual, relative to the first eigenvalue; least eigenvalue, likewise.
TOLERANCE, RANK = 1e-13, 1e-12


class Whitening(NamedTuple):
    n: int
    sums: np.ndarray
    components: np.ndarray  # a row each
    eigenvalues: np.ndarray
    trace: float
    passes: int


def _grid(vectors: DataFrame, scale: int, shift: int) -> DataFrame:
    """(vec_id, x): usable vectors on the grid of whole numbers."""
    c = F.col("embedding").cast("array<double>")
    usable = (F.size(c) > 0) & ~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > LARGEST))
    # within `when`, so that no other row's entries are ever put on the grid
    x = F.when(usable, F.transform(c, lambda v: F.floor(v * scale).cast("long") + shift))
    return vectors.select("vec_id", x.alias("x")).where("x is not null")


def _summed(parts: DataFrame) -> np.ndarray:
    """The sums of (at, value) rows by place, as an array."""
    rows = parts.groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()
    return np.array([r.value for r in rows])


def _rows(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1)


def _pass(grid: DataFrame, mean: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, float]:
    """V times the basis, and the trace of V, both times n: one pass over all centred rows."""

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, total = np.zeros(basis.shape), 0.0
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column("x")) - mean
                out += x.T @ (x @ basis)
                total += float((x * x).sum())
        flat = np.append(out.ravel(), total)
        yield pa.record_batch({"at": np.arange(len(flat)), "value": flat})

    flat = _summed(grid.select("x").mapInArrow(share, "at long, value double"))
    return flat[:-1].reshape(basis.shape), float(flat[-1])


def _filled(basis: np.ndarray, seed: int) -> np.ndarray:
    """An orthonormal basis of the whole space that begins with the given one."""
    d, k = basis.shape
    more = np.random.default_rng(seed).standard_normal((d, d - k))
    for _ in range(2):  # twice is enough for double precision
        more -= basis @ (basis.T @ more)
        more = np.linalg.qr(more)[0]
    return np.hstack((basis, more))


def _ritz(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues (falling), components (columns) and residuals on the span of the basis."""
    small = basis.T @ image
    e, w = np.linalg.eigh((small + small.T) / 2)
    e, w = e[::-1], w[:, ::-1]
    u = basis @ w
    return e, u, np.linalg.norm(image @ w - u * e, axis=0)


def fit_whitening(grid: DataFrame, components: int = COMPONENTS, oversample: int = OVERSAMPLE, power_passes: int = POWER_PASSES, tolerance: float = TOLERANCE, seed: int = 13) -> Whitening | None:
    """The leading components of all rows (vec_id, x) of one length; None for no rows."""
    heads = grid.select(F.posexplode("x").alias("at", "value")).groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"), F.count("*").alias("n")).orderBy("at").collect()
    if not heads:
        return None
    n, sums = heads[0].n, np.array([int(r.value) for r in heads], object)
    mean, d = np.array([s / n for s in sums]), len(sums)
    k = min(components, d)
    width = min(k + oversample, d)
    basis = np.eye(d) if width == d else np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    passes = 0
    while True:
        image, total = _pass(grid, mean, basis)
        passes += 1
        e, u, left = _ritz(basis, image / n)
        full = basis.shape[1] == d
        if full or not len(e) or e[0] <= 0:
            break
        good = left[:k] <= tolerance * e[0]
        if passes > 1 and bool(good.all()) and e[k - 1] - e[min(k, len(e) - 1)] > 10 * left[:k].max():
            break
        basis = _filled(basis, seed) if passes >= power_passes else np.linalg.qr(image)[0]
    if not e[0] > 0:
        return Whitening(n, sums, np.zeros((0, d)), np.zeros(0), total / n, passes)
    k = int(min(k, (e[:k] > RANK * e[0]).sum()))
    u = u[:, :k] / np.linalg.norm(u[:, :k], axis=0)
    u *= np.sign(u[np.abs(u).argmax(0), np.arange(k)])
    return Whitening(n, sums, u.T.copy(), e[:k].copy(), total / n, passes)


def project(grid: DataFrame, fit: Whitening) -> DataFrame:
    """(vec_id, deviation, w): whitened rows, and the exact sum over dimensions of (n * x - S) ** 2."""
    mean, across = np.array([s / fit.n for s in fit.sums]), fit.components.T / np.sqrt(fit.eigenvalues)
    kind = grid.schema["vec_id"].dataType.simpleString()
    sums, n = fit.sums, fit.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch.column("x"))
            w = (x - mean) @ across
            most = max(abs(n * int(m) - int(s)) for m, s in zip([*x.min(0), *x.max(0)], [*sums, *sums], strict=True))
            if most * most * len(sums) < 1 << 62:
                by = n * x - sums.astype(np.int64)
                away = (by * by).sum(1).tolist()
            else:  # Python's whole numbers have no bound
                away = ((n * x.astype(object) - sums) ** 2).sum(1).tolist()
            away = [a if a < 1 << 63 else None for a in away]
            w = pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), w.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "deviation": pa.array(away, pa.int64()), "w": w})

    return grid.mapInArrow(run, f"vec_id {kind}, deviation long, w array<double>")


def _error(whitened: DataFrame, k: int) -> float:
    """The largest entry of the whitened rows' covariance minus the identity."""
    w: list[Column] = [F.col("w")[i] for i in range(k)]
    row = whitened.agg(*[F.covar_pop(w[i], w[j]) for i in range(k) for j in range(i, k)]).first()
    want = [float(i == j) for i in range(k) for j in range(i, k)]
    return max(abs(a - b) for a, b in zip(row, want, strict=True))


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, **options) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row a vector and component."""
    grid = _grid(vectors, scale, shift)
    sizes = grid.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    grid = grid.where(F.size("x") == (sizes.d if sizes else 0))
    fit = fit_whitening(grid, components, **options)
    k = len(fit.eigenvalues) if fit else 0
    if not k:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    whitened = written(project(grid, fit))
    error = _error(whitened, k)
    share = F.array(*[F.lit(float(e / fit.trace)) for e in fit.eigenvalues])
    each = whitened.select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened"))
    return each.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", share[F.col("i")].alias("explained"), F.lit(error).alias("identity_error"))


def op13_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_whitening": op13_whitening}
