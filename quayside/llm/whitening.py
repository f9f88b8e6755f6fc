"""Embedding whitening: leading eigenvectors of the covariance by LOBPCG, whose products with blocks run over all rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Scratch, batch_of
from .vectors import LONG_MAX, halves, joined, matrix, spread, task_sums, whole_vectors

SCALE, SHIFT = 64, 1_000_000
#: Directions that iterate beside those asked for, so that the last of these are well apart from what is left out.
GUARD = 8
#: A residual, over the largest eigenvalue, that is looked for, and one that is accepted where rounding stops the descent.
SOUGHT, ACCEPTED = 1e-14, 1e-11
#: Eigenvalues below this part of the largest are none.
NOTHING = 1e-11
ROUNDS = 1_000

_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_ARROW = pa.schema(
    [
        ("vec_id", pa.int64()),
        ("component", pa.int32()),
        ("n", pa.int64()),
        ("deviation", pa.int64()),
        ("whitened", pa.float64()),
        ("explained", pa.float64()),
        ("identity_error", pa.float64()),
    ]
)


def _orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what `new` adds to these; directions that add only rounding are dropped."""
    norms = np.linalg.norm(new, axis=0)
    new = new[:, norms > 0] / norms[norms > 0]
    for _ in range(3):
        for basis in bases:
            new = new - basis @ (basis.T @ new)
        if not new.shape[1]:
            return new
        u, s, _ = np.linalg.svd(new, full_matrices=False)
        new = u[:, s > 1e-10 * max(1.0, s[0])] if s[0] > 1e-10 else u[:, :0]
    return new


def leading_eigenvectors(product: Callable[[np.ndarray], np.ndarray], dim: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric positive matrix, its eigenvectors and their residuals' norms.

    `product` multiplies the matrix with a block of columns; nothing else of it is read. Each round is one product, with
    the residuals and the previous directions; Rayleigh-Ritz on iterate, residuals and directions gives the next iterate.
    The residuals that end the rounds come from a product of the iterate itself, not from the rounds' combinations.
    """
    m = min(dim, k + GUARD)
    x = np.linalg.qr(np.random.default_rng(1).normal(size=(dim, m)))[0]
    vx, p = product(x), np.zeros((dim, 0))
    proof, best, stale = False, np.inf, 0
    for _ in range(ROUNDS):
        gram = x.T @ vx
        values, turn = np.linalg.eigh((gram + gram.T) / 2)
        order = np.argsort(values)[::-1]
        values, x, vx = values[order], x @ turn[:, order], vx @ turn[:, order]
        residuals = vx - x * values
        norms = np.linalg.norm(residuals, axis=0)
        top, worst = max(values[0], 0.0), norms[:k].max()
        stale = 0 if worst < best / 2 else stale + 1
        best = min(best, worst)
        if proof and worst <= ACCEPTED * top:
            return values[:k], x[:, :k], norms[:k]
        w = _orthonormal(residuals[:, norms > SOUGHT / 10 * top], x)
        p = _orthonormal(p, x, w)
        proof = worst <= SOUGHT * top or (worst <= ACCEPTED * top and stale >= 3) or not w.shape[1] + p.shape[1]
        if proof:
            x = np.linalg.qr(x)[0]
            vx = product(x)
            continue
        more = np.concatenate([w, p], axis=1)
        basis, v = np.concatenate([x, more], axis=1), np.concatenate([vx, product(more)], axis=1)
        gram = basis.T @ v
        turn = np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1][:, :m]
        x, vx, p = basis @ turn, v @ turn, more @ turn[m:]
    raise RuntimeError(f"residuals of {best / top:.1e} of the largest eigenvalue after {ROUNDS} rounds")


def whiten(vectors: DataFrame, components: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: each vector along each leading eigenvector.

    A component c of a vector becomes the whole number floor(64 c) + 1000000. The covariance is over all rows that stay,
    centred first. whitened is the centred vector along the unit eigenvector, over the root of its eigenvalue; explained
    is that eigenvalue's part of the trace; identity_error is measured on the whitened values of all rows; deviation is
    exact. Eigenvectors have their largest entry above zero.

    Vectors that are null or hold null or non-finite components go. Shorter vectors are filled with zeros up to the
    longest. Rows that repeat, null ids and ids with several vectors stay, each a row of the fit. Eigenvalues of zero
    (fewer rows than dimensions, equal vectors) have no component, so a table of one vector, or an empty one, gives no
    rows. Scaled components beyond 2**53 are held there, and a deviation beyond a long at its largest value. Eigenvalues
    that are equal share their space in some basis. Other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "whitening")
    rows = scratch.write(whole_vectors(vectors, SCALE), "x")
    n, dim, _ = spread(rows)
    nothing = vectors.sparkSession.createDataFrame([], _OUT)
    if not n or not dim:
        scratch.drop()
        return nothing

    # Sums of what the numbers are without the shift, which centring takes away again.
    sums = task_sums(rows.select("x"), lambda b: halves(matrix(b.column(0), dim)).sum(axis=1).ravel(), "long")
    total = joined(*sums.reshape(2, dim))
    middle = np.array([(2 * int(s) + n) // (2 * n) for s in total], dtype=np.int64)
    rest = np.array([int(s) - n * int(m) for s, m in zip(total, middle, strict=True)], dtype=np.int64)
    mean = rest / n

    def centred(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        whole = matrix(column, dim) - middle
        return whole, whole - mean

    def product(block: np.ndarray) -> np.ndarray:
        def part(batch: pa.RecordBatch) -> np.ndarray:
            c = centred(batch.column(0))[1]
            return (c.T @ (c @ block)).ravel()

        return task_sums(rows.select("x"), part, "double").reshape(dim, -1) / n

    trace = task_sums(rows.select("x"), lambda b: (centred(b.column(0))[1] ** 2).sum(axis=0), "double").sum() / n
    if not trace:
        scratch.drop()
        return nothing
    values, basis, _ = leading_eigenvectors(product, dim, min(components, dim))
    there = values > NOTHING * values[0]
    values, basis = values[there], basis[:, there]
    basis = basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])])
    k, scaled = len(values), basis / np.sqrt(values)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        y = centred(batch.column(0))[1] @ scaled
        return np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])

    found = task_sums(rows.select("x"), moments, "double") / n
    error = float(np.abs(found[k:].reshape(k, k) - np.outer(found[:k], found[:k]) - np.eye(k)).max())
    explained = values / trace

    def whitened(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            whole, c = centred(batch.column(1))
            # Longs wrap: a sum that a long holds is right, whatever its terms did.
            exact, about = ((n * whole - rest) ** 2).sum(axis=1), ((c * n) ** 2).sum(axis=1)
            deviation = np.where((about > 1.5 * 2.0**63) | (exact < 0), LONG_MAX, exact)
            many = batch.num_rows
            yield batch_of(
                _ARROW,
                batch.column(0).take(pa.array(np.repeat(np.arange(many), k))),
                np.tile(np.arange(1, k + 1, dtype=np.int32), many),
                np.full(many * k, n),
                np.repeat(deviation, k),
                (c @ scaled).ravel(),
                np.tile(explained, many),
                np.full(many * k, error),
            )

    return rows.mapInArrow(whitened, _OUT)
