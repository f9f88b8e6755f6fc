import math

import duckdb
import numpy as np
import pytest

from quayside.llm import impact_index
from quayside.llm.exact_topk import largest_products, pieces_of
from quayside.llm.queries import OP13_SQL, op13_exact_topk


def brute(rows, every, k=10):
    ok = sorted({(i, tuple(math.floor(1024 * c) for c in v)) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)})
    best = {}
    for q, a in ok:
        for i, b in ok:
            if q % every == 0 and i != q and len(a) == len(b):
                s = sum(x * y for x, y in zip(a, b))
                best[q, i] = max(best.get((q, i), s), s)
    out = {}
    for (q, i), s in best.items():
        out.setdefault(q, []).append((-s, i))
    return sorted((q, r + 1, i, -s) for q, own in out.items() for r, (s, i) in enumerate(sorted(own)[:k]))


def got(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_whole_table(spark):
    own = got(op13_exact_topk(spark, "/root/testdata/sf0.1"))
    duckdb.sql("CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.1/embeddings.parquet'")
    assert own == sorted(duckdb.sql(f"SELECT query_id, rank, vec_id, score FROM ({OP13_SQL})").fetchall()) and len(own) == 200


@pytest.mark.parametrize("components", [1 << 18, 1000])
def test_brute_force(spark, components):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    want = brute([tuple(r) for r in df.select("vec_id", "embedding").collect()], 20)
    assert got(largest_products(df, every=20, shard_components=components, cell_queries=5)) == want


def test_edges(spark):
    nan = float("nan")
    rng = np.random.default_rng(7)
    rows = [(i, (rng.integers(-2, 3, size=6) / 8).tolist()) for i in range(0, 300, 7)]  # many ties
    rows += [(7, rows[1][1]), (7, rows[3][1]), (0, rows[5][1]), (None, rows[0][1])]  # repeated rows, ids with several vectors
    rows += [(i, [0.5, -0.5]) for i in range(1000, 1015)] + [(500, []), (600, []), (700, [0.0] * 6), (800, [1.0] * 9)]
    rows += [(900, None), (910, [nan] * 6), (920, [None] * 6), (930, [float("inf")] * 6)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, score int, rank string")
    for size in (1 << 18, 60):
        assert got(largest_products(df, every=10, shard_components=size, cell_queries=3)) == brute(rows, 10)
    assert got(largest_products(df.where("false"))) == [] and got(largest_products(df.where("vec_id = 7"))) == []


def test_an_id_with_very_many_vectors(spark):
    rng = np.random.default_rng(11)
    rows = [(1, (rng.normal(size=4) * 3).tolist()) for _ in range(200)] + [(i, rng.normal(size=4).tolist()) for i in range(2, 60)]
    assert got(largest_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20)) == brute(rows, 20)


def test_large_numbers(spark):
    rng = np.random.default_rng(12)
    rows = [(i, (rng.normal(size=4) * 2.0 ** (12 + i % 7)).tolist()) for i in range(80)]
    assert got(largest_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10)) == brute(rows, 10)
    far = largest_products(spark.createDataFrame([(0, [1e300]), (1, [-1e300]), (2, [1e300])], "vec_id long, embedding array<double>"))
    assert got(far) == [(0, 1, 2, (1 << 63) - 1), (0, 2, 1, -(1 << 63))]


def test_the_stop_is_proven():
    """Every vector of the k best is among the possible ones, and much is left unread where there are clusters."""
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(50, 64)) / 8
    x = np.floor(1024 * (centres[rng.integers(0, 50, 8000)] + rng.normal(size=(8000, 64)) / 30)).astype(np.int64)
    index, parts = impact_index.build(x), []
    for q in x[:40]:
        left, read = impact_index.possible(index, x, q, 11, None)
        scores = x @ q
        assert set(np.flatnonzero(scores >= np.sort(scores)[-11])) <= set(left)
        parts.append((read / x.size, len(left) / len(x)))
    assert np.mean(parts, axis=0)[0] < 0.8 and np.mean(parts, axis=0)[1] < 0.1


def test_queries_without_some_dimensions():
    rng = np.random.default_rng(15)
    x = rng.integers(-200, 200, size=(3000, 24))
    index = impact_index.build(x)
    for part in (0.0, 0.2, 0.6):
        q = rng.integers(-200, 200, size=24) * (rng.random(24) < part)
        ids, scores = impact_index.search(index, np.arange(3000), x, -1, q, 10)
        order = np.lexsort((np.arange(3000), -(x @ q)))[:10]
        assert (ids == order).all() and (scores == (x @ q)[order]).all()


def test_postings_hold_every_vector_once_in_each_dimension():
    x = np.random.default_rng(14).integers(-50, 50, size=(300, 5))
    index = impact_index.build(x)
    for d, a, b, high in zip(index["dims"], index["first"], index["last"], index["high"]):
        v = x[index["order"][a:b], d]
        assert (v == index["values"][a:b]).all() and abs(v).max() == high and (v.min() >= 0 or v.max() < 0)
    assert (np.sort(index["order"].reshape(5, 300), axis=1) == np.arange(300)).all()


def test_pieces_grow():
    assert [pieces_of(n, 4096, 65536) for n in (0, 1, 4096, 51282, 1_000_000, 1_000_000_000)] == [1, 1, 1, 4, 16, 15259]
