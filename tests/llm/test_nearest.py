import math

import numpy as np
from pyspark.sql import functions as F

from quayside.llm import graph_index
from quayside.llm.nearest import nearest, shard_count


def brute(rows, every, k=10):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v):
            ok.setdefault(len(v), {})[i] = v
    out = {}
    for own in ok.values():
        ids = np.array(sorted(own))
        x = np.array([own[i] for i in ids], dtype=np.float32).astype(np.float64)
        for n, i in enumerate(ids):
            if i % every == 0:
                d = np.sqrt(((x - x[n]) ** 2).sum(axis=1))
                order = [j for j in np.lexsort((ids, d)) if j != n][:k]
                out[int(i)] = [(int(ids[j]), d[j]) for j in order]
    return out


def recall(df, want):
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert got.keys() == {q for q, x in want.items() if x}
    hits = total = 0
    for q, x in want.items():
        own = got.get(q, {})
        assert sorted(own) == list(range(1, len(own) + 1)) and len(own) == len(x)
        assert [own[r] for r in sorted(own)] == sorted(own.values(), key=lambda p: (p[1], p[0]))
        far = x[-1][1] if x else 0
        hits += sum(s <= far + 1e-9 for _, s in own.values())
        total += len(x)
    return hits / max(total, 1)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    want = brute(rows, 20)
    assert recall(nearest(df, every=20), want) > 0.97
    assert recall(nearest(df, every=20, shard_vectors=300), want) > 0.97


def test_exact_scores_and_common_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 8)).astype(np.float32)
    rows = [(i, [float(c) for c in (base[0] if i % 3 == 0 else base[i % 300])]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows, 50)
    got = {}
    for r in nearest(df, every=50).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q, x in want.items():
        own = [(v, s) for _, v, s in sorted(got[q])]
        assert [v for v, _ in own] == [v for v, _ in x] and np.allclose([s for _, s in own], [s for _, s in x], rtol=0, atol=1e-12)


def test_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (100, None), (200, []), (300, [0.0, 0.0]), (400, [nan, 1.0]), (500, [None, 1.0]), (600, [float("inf"), 1.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [1.0, 1.0, 1.0]), (None, [1.0, 2.0]), (700, [2.0, 2.0, 2.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in nearest(df).collect())
    assert got == [(0, 1, 7, 1.0), (700, 1, 8, round(math.sqrt(3), 6))]
    assert nearest(df.where("false")).count() == 0
    assert nearest(df.where(F.col("vec_id") == 0)).count() == 0


def test_clusters():
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(40, 1, 24)) * 8 + rng.normal(size=(40, 150, 24)) * 0.2).reshape(-1, 24).astype(np.float32)
    x = x[rng.permutation(len(x))]
    q = x[:200]
    ids, _ = graph_index.search(x, graph_index.build(x), q, 10)
    d = ((q[:, None, :] - x[None]) ** 2).sum(-1)
    want = np.argsort(d, axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, want)]) > 0.95


def test_double_columns_and_several_lengths(spark):
    """Scores come from the original doubles; lengths that leave shards empty are no matter."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=6 if i % 10 else 3).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = dict(rows)
    for size in (12_500, 40):
        out = nearest(df, every=20, shard_vectors=size).collect()
        assert {r.query_id for r in out} == {i for i, _ in rows if i % 20 == 0}
        for r in out:
            a, b = np.array(exact[r.query_id]), np.array(exact[r.vec_id])
            assert len(a) == len(b) and r.score == np.sqrt(((a - b) ** 2).sum())


def test_shards_grow():
    n = [shard_count(x) for x in (0, 1, 12_500, 50_000, 5_000_000, 1_000_000_000)]
    assert n == [1, 1, 1, 2, 20, 4000]


def test_memory_of_many_dimensions():
    """What is gathered at a time does not grow with the batch; the nearest of a batch are right."""
    import tracemalloc

    x = np.random.default_rng(4).normal(size=(1200, 768)).astype(np.float32)
    tracemalloc.start()
    graph_index.build(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    ids, dist = graph_index._within(x, np.arange(300, 500), 7)
    d = ((x[300:500, None, :64] - x[None, 300:500, :64]) ** 2).sum(-1) + ((x[300:500, None, 64:] - x[None, 300:500, 64:]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1)[:, :7]
    assert (ids == want + 300).mean() > 0.99 and np.allclose(dist, np.take_along_axis(d, want, axis=1), rtol=1e-3)
