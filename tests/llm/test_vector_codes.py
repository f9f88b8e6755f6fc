import hashlib
import math

import duckdb
import numpy as np

from quayside.llm.queries import OP12_SQL, op12_vector_codes
from quayside.llm.vector_codes import Neighbours, code_digests, vector_codes
from quayside.llm.vectors import LONG_MAX


def brute(rows, parts=8, entries=16, rounds=6):
    """rows: (vec_id, embedding, label). Python's integers, every entry tried."""
    rows = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    length = -(-max((len(r[1]) for r in rows), default=0) // parts)
    x = [[math.floor(4096 * c) for c in r[1]] + [0] * (parts * length - len(r[1])) for r in rows]
    cut = lambda v, p: v[p * length : (p + 1) * length]
    order = sorted(range(len(rows)), key=lambda j: (rows[j][0] is None, rows[j][0] or 0, x[j]))[:entries]
    books = [[cut(x[j], p) for j in order] for p in range(parts)]

    def assign():
        far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
        return [[min((far(cut(v, p), e), k) for k, e in enumerate(books[p])) for p in range(parts)] for v in x]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(v, p) for v, f in zip(x, found) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    found = assign()
    error = [sum(d for d, _ in f) for f in found]
    by = {}
    for r, e in zip(rows, error):
        by[r[2]] = by.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in f), e, by[r[2]], digest) for r, f, e in zip(rows, found, error)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    own = got(op12_vector_codes(spark, "/root/testdata/sf0.01"))
    assert own == brute([tuple(r) for r in df.select("vec_id", "embedding", "label").collect()])
    duckdb.sql("CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    assert own == sorted(duckdb.sql(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({OP12_SQL})").fetchall(), key=repr)


def test_any_start_finds_the_nearest():
    rng = np.random.default_rng(1)
    entries = rng.integers(-3, 4, size=(16, 2))
    entries[9], entries[12] = entries[4], entries[4]
    x = rng.integers(-5, 6, size=(2000, 2))
    d = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    for number in (np.int64, object):
        for start in (rng.integers(0, 16, size=2000), np.full(2000, 12)):
            code, best = Neighbours(entries.astype(number)).nearest(x.astype(number), start)
            assert (code == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_edges(spark):
    nan = float("nan")
    rng = np.random.default_rng(2)
    good = [(i, (rng.integers(-3, 3, size=16) / 7).tolist(), i % 3 or None) for i in range(60)]
    good += [(3, good[3][1], None), (5, good[9][1], 2), (None, good[4][1], 1), (61, good[4][1][:5], 1), (62, [], 1), (63, [0.25] * 11, 2)]
    bad = [(70, None, 1), (71, [nan] * 16, 1), (72, [None] + [1.0] * 15, 1), (73, [-float("inf")] + [1.0] * 15, None)]
    schema = "vec_id long, embedding array<double>, label int, code int, of_label string"
    df = spark.createDataFrame([(*r, 1, "x") for r in good + bad], schema)
    assert got(code_digests(df)) == brute(good + bad)
    for few in (good[:1], good[:5], good[-2:-1]):
        assert got(code_digests(spark.createDataFrame([(*r, 1, "x") for r in few], schema))) == brute(few)
    assert got(code_digests(df.where("false"))) == []
    assert got(code_digests(df.where("vec_id >= 70"))) == []


def test_one_vector_fills_the_table(spark):
    rng = np.random.default_rng(6)
    common = rng.normal(size=8).tolist()
    rows = [(i, common if i % 3 else rng.normal(size=8).tolist(), 1) for i in range(300)]
    assert got(code_digests(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))) == brute(rows)


def test_large_numbers(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=8) * 1e5).tolist(), 0) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert got(code_digests(df)) == brute(rows)
    rows += [(i, (rng.normal(size=8) * 1e10).tolist(), 0) for i in range(40, 60)]
    out = {r.vec_id: r for r in code_digests(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    for i, code, error, total, digest in brute(rows):
        assert (out[i].code, out[i].error, out[i].label_error, out[i].codebooks_sha256) == (code, min(error, LONG_MAX), min(total, LONG_MAX), digest)


def test_other_sizes(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows, books = vector_codes(df, parts=4, entries=3, rounds=1)
    assert len(books) == 4 and {len(b) for b in books} == {3} and {len(r.code) for r in rows.collect()} == {4}
