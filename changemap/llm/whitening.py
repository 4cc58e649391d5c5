"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X stay in blocks of the shared folder. A step multiplies them by one vector
from the right and by the result from the left, in one pass: every block gives its share
of Xv and of X'u as a few sums per dimension, which Spark adds up. A left vector has an
entry a row, so it is never stored: it is X times a short vector, and both its
inner products with the earlier left vectors and its norm come out of the same pass. What the driver
holds is as long as a row, times the number of steps, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changemap.session import materialise

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
BLOCK_BYTES = 4 << 20
TOLERANCE = 1e-14  # of a residual, against the largest singular value
SEED = 11
LARGEST = 2**63 - 1
BLOCKS = "of int, ids array<{}>, x binary"


def usable(column: str):
    """Not null, not empty, without null or non-finite entries, and each within a long when scaled."""
    c = F.col(column)
    fits = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < 2.0**52))
    return c.isNotNull() & (F.size(c) > 0) & F.coalesce(fits, F.lit(False))


def _exact(a: np.ndarray, most: int) -> np.ndarray:
    """``a`` as longs, or as Python's whole numbers where results up to ``most`` do not fit."""
    return a if most <= LARGEST else a.astype(object)


def _blocks(of: int):
    """Rows ``(id, x)`` as a few long rows: ids, and the numbers of all rows in one binary."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(-1, of)
            ids, step = batch.column(0), max(1, BLOCK_BYTES // (8 * of))
            for i in range(0, len(x), step):
                part = ids.slice(i, step)
                yield pa.RecordBatch.from_arrays([
                    pa.array([of], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part),
                    pa.array([x[i:i + step].tobytes()], pa.binary()),
                ], names=["of", "ids", "x"])

    return packed


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            of = batch.column("of")[i].as_py()
            yield batch.column("ids")[i].values, np.frombuffer(batch.column("x")[i].as_buffer(), "<i8").reshape(-1, of)


def _added(blocks: DataFrame, per_block, size: int) -> np.ndarray:
    """The sum over all blocks of a vector of doubles; each task sends one, Spark adds them by position."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for _, x in _read(batches):
            total += per_block(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["at", "v"])

    sums = dict(blocks.mapInArrow(partial, "at int, v double").groupBy("at").agg(F.sum("v")).collect())
    return np.array([sums.get(i, 0.0) for i in range(size)])


@dataclass
class Fit:
    """``n`` rows with the sums ``total``; components in rows, with their eigenvalues and shares of the trace."""

    n: int
    total: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - total / n``, rounded once."""
        return _centred(x, self.n, self.total)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.eigenvalues)[:, None]).T

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of ``(n * x - total)^2`` of each row; None beyond a long."""
        d, most = _apart(x, self.n, self.total)
        sums = (_exact(d, most * most * x.shape[1]) ** 2).sum(axis=1).tolist()
        return [v if v <= LARGEST else None for v in sums]


def _apart(x: np.ndarray, n: int, total: list[int]) -> tuple[np.ndarray, int]:
    """``n * x - total`` exactly, and its largest absolute value."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, total))
    d = _exact(x, most) * n - np.array(total, dtype=object if most > LARGEST else np.int64)
    return d, int(np.abs(d).max(initial=0))


def _centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    return (_apart(x, n, total)[0] / n).astype(np.float64)


def bidiagonalise(multiply, of: int, wanted: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The largest singular values of X and their right vectors, in rows.

    ``multiply(w, before)`` gives X'Xw, the inner products of Xw with X times each row of
    ``before``, and the squared norm of Xw. New left and right vectors are made orthogonal
    to all earlier ones, twice where the first time took much away. When the
    wanted values stand, the iteration goes on from a random direction orthogonal
    to all it has seen, until that direction adds nothing to them: equal singular values,
    of which a single start sees one, are found so. At the latest it ends after ``of`` steps.
    """
    random = np.random.default_rng(seed)
    right, left = np.zeros((0, of)), np.zeros((0, of))  # v_j, and w_j with u_j = X w_j
    back = np.zeros((0, of))  # X'u_j
    alphas: list[float] = []
    betas: list[float] = []

    def fresh() -> np.ndarray:
        v = random.standard_normal(of)
        for _ in range(3):
            v -= right.T @ (right @ v)
        return v / np.linalg.norm(v)

    v, beta, since, before, largest = fresh(), 0.0, 0, None, 0.0
    while True:
        w = v - beta * left[-1] if beta else v.copy()
        for _ in range(3):
            g, inner, square = multiply(w, left)
            w, g = w - left.T @ inner, g - back.T @ inner
            square, part = square - inner @ inner, inner @ inner
            if part <= 1e-16 * max(square, 0.0):
                break
        alpha = float(np.sqrt(max(square, 0.0)))
        right = np.vstack((right, v))
        betas.append(beta)
        alphas.append(alpha)
        largest = max(largest, alpha, beta)
        scale = alpha if alpha > 1e-13 * largest else np.inf
        left, back = np.vstack((left, w / scale)), np.vstack((back, g / scale))
        r = back[-1] - alphas[-1] * v
        for _ in range(2):
            r -= right.T @ (right @ r)
        beta, k = float(np.linalg.norm(r)), len(alphas)
        b = np.diag(alphas) + np.diag(betas[1:], 1)
        p, s, q = np.linalg.svd(b)
        since += 1
        m = min(wanted, k)
        stands = k == of or (k >= wanted and (beta * np.abs(p[-1, :m]) <= TOLERANCE * s[0]).all())
        # the newest direction, too, must have settled before it may count as adding nothing
        broke = k < of and (beta <= 1e-13 * max(largest, 1e-300) or (stands and since >= min(wanted, of)))
        if k == of or (broke and stands and before is not None and np.abs(s[:m] - before).max() <= 1e-13 * s[0]):
            return s[:wanted], q[:wanted] @ right
        if broke:
            before = s[:m].copy() if stands else None
            v, beta, since = fresh(), 0.0, 0
        else:
            v = r / beta


def fit(blocks: DataFrame, of: int, components: int = COMPONENTS) -> Fit | None:
    """The whitening of all rows of ``blocks``; None without rows or without any spread."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(of, object)
        for _, x in _read(batches):
            n, total = n + len(x), total + _exact(x, len(x) * int(np.abs(x).max(initial=0))).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(of + 1), pa.int32()), pa.array([str(v) for v in [*total, n]])], names=["at", "v"])

    sums = dict(blocks.mapInArrow(partial, "at int, v string").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)"))).collect())
    n, total = int(sums.get(of, 0)), [int(sums.get(i, 0)) for i in range(of)]
    if not n:
        return None

    def multiply(w: np.ndarray, before: np.ndarray):
        both = np.vstack((before, w))

        def shares(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, total)
            u = c @ both.T
            return np.concatenate((c.T @ u[:, -1], u.T @ u[:, -1]))

        out = _added(blocks, shares, of + len(both))
        return out[:of], out[of:-1], float(out[-1])

    trace = _added(blocks, lambda x: np.array([np.square(_centred(x, n, total)).sum()]), 1)[0] / n
    if not trace > 0:
        return None
    s, vectors = bidiagonalise(multiply, of, min(components, of))
    values = s * s / n
    keep = values > 1e-12 * trace  # along the others the rows do not spread
    found = Fit(n, total, vectors[keep], values[keep], values[keep] / trace)
    k = len(found.components)

    def moments(x: np.ndarray) -> np.ndarray:
        y = found.whitened(x)
        return np.concatenate(((y.T @ y).ravel(), y.sum(axis=0)))

    out = _added(blocks, moments, k * k + k)
    mean = out[k * k:] / n
    found.identity_error = float(np.abs(out[:k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))
    return found


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable row and component: ``(id, component, n, deviation, whitened, explained, identity_error)``.

    An entry c counts as ``floor(SCALE * c) + SHIFT``. Left out: rows whose vector is null or
    empty, or holds a null, a non-finite entry or one of 2^52 or more. Vectors of
    another dimension are a table of their own. A zero vector is a vector; rows repeated
    or without an id count and come back like any other. Components along which rows do
    not spread have no rows, so a single row, or rows that are all equal, give none; nor does an
    empty table. ``deviation`` is exact, and null beyond a long. Other columns are not read.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    scaled = F.transform(F.col(vector_col), lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")) + F.lit(SHIFT).cast("long"))
    good = vectors.where(usable(vector_col)).select(F.col(id_col).alias("id"), scaled.alias("x"))
    rows = materialise(good, "scaled")
    result = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = spark.createDataFrame([], result)
    for of in sorted(r[0] for r in rows.select(F.size("x")).distinct().collect()):
        blocks = materialise(rows.where(F.size("x") == of).mapInArrow(_blocks(of), BLOCKS.format(kind)), "blocks")
        found = fit(blocks, of, components)
        if found is not None:
            out = out.union(blocks.mapInArrow(_rows(found), result))
    return out


def _rows(found: Fit):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(found.components)
        for ids, x in _read(batches):
            m = len(x) * k
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                pa.array(np.full(m, found.n), pa.int64()),
                pa.array(found.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                pa.array(found.whitened(x).ravel()), pa.array(np.tile(found.explained, len(x))), pa.array(np.full(m, found.identity_error)),
            ], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows
