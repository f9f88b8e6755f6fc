import zlib

import numpy as np
from pyspark.sql import functions as F

from quayside.llm import quality
from quayside.llm.quality import FEATURES, features, fit, keep_good, quality_scores

SF = "/root/testdata/sf0.01"


def auc(score, y):
    order = np.argsort(np.argsort(score)) + 1
    return (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_scores(docs, labels)
    assert out.count() == docs.count()
    rows = out.join(labels, "doc_id").where("held_out").toPandas()
    assert auc(rows["score"].to_numpy(), rows["quality"].to_numpy()) > 0.9
    assert (rows["predicted"] == rows["quality"]).mean() > 0.9
    assert out.where("score < 0 or score > 1 or score is null").count() == 0


def test_pairs_learn_what_tables_cannot():
    rng = np.random.default_rng(1)
    x = rng.random((6000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit(x[:5000], y[:5000])
    assert {(i, j) for i, j, _ in model.pairs} >= {(0, 1)}
    assert ((model.score(x[5000:]) > 0.5) == y[5000:]).mean() > 0.9


def test_one_class_and_none():
    x = np.zeros((10, 3), dtype=np.float32)
    assert (fit(x, np.ones(10)).score(x) > 0.9).all()
    assert (fit(x[:0], np.ones(0)).score(x) == 0.5).all()


def test_features_are_finite():
    x = features([None, b"", b" ", b"a", b"\n\n", b"x" * 300000, "é ü".encode(), b"a | b | c"])
    assert x.shape == (8, len(FEATURES)) and np.isfinite(x).all()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (2, "", 5), (None, "word", 5), (4, "long " * 100000, 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(2, 1, 0), (2, 1, 0), (4, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality_scores(docs, labels).count() == 5
    assert quality_scores(docs.where("false"), labels).count() == 0
    none = quality_scores(docs, labels.where("false"))
    assert {r.score for r in none.collect()} == {0.5}
    assert keep_good(docs, labels).columns == docs.columns


def test_scores_against_loops():
    """Bin additions of a fitted model, one row and one feature at a time."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    model = fit(x[:2500], ((x[:2500, 0] > 0) ^ (x[:2500, 1] > 0)).astype(float))
    assert model.pairs
    got = model.score(x[2500:])
    for row, score in zip(x[2500:], got, strict=True):
        total = model.base
        for j in range(5):
            total += model.tables[j][sum(bool(row[j] >= e) for e in model.edges[j])]
        for i, j, table in model.pairs:
            total += table[sum(bool(row[i] >= e) for e in model.coarse[i]), sum(bool(row[j] >= e) for e in model.coarse[j])]
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-9


def test_a_boosting_round_against_all_cuts():
    """The cuts of a shallow tree gain the most of all cuts, and each leaf is its rows' step."""
    rng = np.random.default_rng(9)
    for _ in range(30):
        n = rng.integers(0, 60, 12).astype(float)
        h, g = n * 0.25, rng.normal(size=12) * np.sqrt(n + 0.1)

        def gain(a, b, c, g=g, h=h):
            one = lambda x, y: g[x:y].sum() ** 2 / (h[x:y].sum() + quality.RIDGE)
            return one(a, b) + one(b, c) - one(a, c)

        def best(a, c, n=n, gain=gain):
            cuts = [b for b in range(a + 1, c) if n[a:b].sum() >= quality.LEAST and n[b:c].sum() >= quality.LEAST and gain(a, b, c) > 1e-9]
            return max(cuts, key=lambda b: gain(a, b, c), default=None)

        first = best(0, 12)
        spans = [(0, 12)] if first is None else [(0, first), (first, 12)]
        leaves = []
        for a, c in spans:
            inner = best(a, c) if first is not None else None
            leaves += [(a, c)] if inner is None else [(a, inner), (inner, c)]
        want = np.concatenate([np.full(c - a, quality.RATE * g[a:c].sum() / (h[a:c].sum() + quality.RIDGE)) for a, c in leaves])
        assert np.allclose(quality._shallow(g, h, n), want)


def test_query_against_its_model(spark):
    """The query's scores are those of a model fitted on all labelled rows that are not held out, in order of their hash."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    place = {r.doc_id: (r.h, r.doc_id) for r in docs.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id"), 11).alias("h")).collect()}
    known = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.quality in (0, 1) and r.doc_id in texts}
    order = sorted(known, key=place.get)
    model = fit(features([texts[d] for d in order]), np.array([known[d] for d in order], dtype=float))
    ids = sorted(texts)
    want = dict(zip(ids, model.score(features([texts[d] for d in ids])), strict=True))
    for r in quality_scores(docs, labels).collect():
        assert abs(r.score - want[r.doc_id]) < 1e-12 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
