import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.llm.vectors import LONG_MAX
from quayside.llm.whitening import leading_eigenvectors, whiten


def brute(rows, k):
    """Ids, deviations, eigenvalues over the trace, and whitened values, with numpy on all rows."""
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = max(len(v) for _, v in rows)
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] + [1_000_000] * (dim - len(v)) for _, v in rows], dtype=object)
    n, total = len(x), x.sum(axis=0)
    away = n * x - total
    c = (away / n).astype(np.float64)
    values, basis = np.linalg.eigh(c.T @ c / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    return [i for i, _ in rows], [int(v) for v in (away**2).sum(axis=1)], values / np.trace(c.T @ c / n), c @ basis / np.sqrt(values)


def check(df, rows, k, close=1e-7):
    ids, deviation, explained, whitened = brute(rows, k)
    out = df.collect()
    assert len(out) == len(ids) * k and {r.n for r in out} == {len(ids)}
    at = {i: j for j, i in enumerate(ids)}
    got = np.full(whitened.shape, np.nan)
    for r in out:
        j = at[r.vec_id]
        got[j, r.component - 1] = r.whitened
        assert r.deviation == deviation[j] and r.explained == pytest.approx(explained[r.component - 1], rel=1e-9) and 0 <= r.identity_error < 1e-9
    signs = np.sign((got * whitened).sum(axis=0))
    assert np.abs(got * signs - whitened).max() < close


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    check(whiten(df), [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()], 32)


def test_more_dimensions_than_a_block_spans():
    rng = np.random.default_rng(3)
    c = rng.normal(size=(900, 300)) * np.linspace(3, 1, 300) ** 2
    v, passes = c.T @ c / 900, []
    values, basis, residuals = leading_eigenvectors(lambda b: passes.append(b.shape) or v @ b, 300, 32)
    want, own = np.linalg.eigh(v)
    assert np.allclose(values, want[::-1][:32], rtol=1e-12) and residuals.max() <= 1e-11 * want[-1]
    assert np.abs(np.abs(basis.T @ own[:, ::-1][:, :32]) - np.eye(32)).max() < 1e-8
    assert len(passes) < 80 and max(b[1] for b in passes) <= 80


def test_equal_eigenvalues():
    values, basis, _ = leading_eigenvectors(lambda b: np.diag([5.0] * 30 + [1.0] * 70) @ b, 100, 32)
    assert np.allclose(values, [5.0] * 30 + [1.0] * 2) and np.allclose(basis.T @ basis, np.eye(32), atol=1e-12)


def test_fewer_rows_than_dimensions(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=20).tolist()) for i in range(6)]
    check(whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), rows, 5)


def test_edges(spark):
    nan = float("nan")
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(size=4).tolist()) for i in range(40)] + [(40, rng.normal(size=3).tolist()), (41, []), (42, [0.0] * 4)]
    bad = [(50, None), (51, [nan] * 4), (52, [1.0, None, 1.0, 1.0]), (53, [float("inf"), 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, 7, "x") for r in good + bad], "vec_id long, embedding array<double>, component int, n string")
    check(whiten(df), good + bad, 4)
    twice = whiten(df.where("vec_id < 3").union(df.where("vec_id < 3").withColumn("vec_id", F.lit(None).cast("long"))))
    assert twice.count() == 6 * 2 and {r.n for r in twice.collect()} == {6}
    assert whiten(df.where("vec_id = 0")).count() == 0 and whiten(df.where("false")).count() == 0
    assert whiten(df.where("vec_id = 41")).count() == 0
    same = spark.createDataFrame([(i, [1.5, 2.5]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whiten(same).count() == 0


def test_large_numbers(spark):
    """Exact up to what a long holds; its largest value beyond."""
    rows = [(0, [1.4 * 2.0**23, 1.0]), (1, [-1.4 * 2.0**23, 3.0]), (2, [0.0, 100.0]), (3, [0.0, -7.0])]
    check(whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), rows, 2)
    far = whiten(spark.createDataFrame([(0, [1e300, 1.0]), (1, [2.0, 1.0]), (2, [2.0, 4.0])], "vec_id long, embedding array<double>"))
    assert {r.vec_id: r.deviation for r in far.collect()}[0] == LONG_MAX
