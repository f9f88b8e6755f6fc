import numpy as np
import pytest

from quayside.llm import perfect_hash
from quayside.llm.line_dedup import drop_frequent_lines

SPACE = " \t\n\x0b\x0c\r"


def brute(rows, least):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(SPACE))
    n = {}
    for _, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            n[k] = n.get(k, 0) + 1
    out = []
    for d, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if not key(x) or n[key(x)] < least]
        out.append((d, "\n".join(kept), len(own), len(own) - len(kept)))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr)


@pytest.mark.parametrize("broadcast_bytes", [1 << 26, 0])
def test_whole_table(spark, broadcast_bytes):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows, 4)
    assert sum(x[3] for x in want) > 20
    assert got(drop_frequent_lines(docs, 4, broadcast_bytes)) == want


@pytest.mark.parametrize("broadcast_bytes", [1 << 26, 0])
def test_edges(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr("quayside.llm.line_dedup.SHARD_LINES", 3)
    rows = [(1, None), (2, ""), (3, "\n"), (4, " A \nb"), (5, "a\t\nA\nc"), (6, "\x0ba"), (7, "É"), (8, "é\n" + "long " * 40000), (8, "é\n" + "long " * 40000), (None, "a\nq")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_lines int, shard string")
    assert got(drop_frequent_lines(df, 2, broadcast_bytes)) == brute(rows, 2)
    assert got(drop_frequent_lines(df.where("false"), 2, broadcast_bytes)) == []


def test_perfect_hash():
    rng = np.random.default_rng(3)
    h1, h2 = (rng.integers(0, 2**64, 20000, dtype=np.uint64) for _ in "ab")
    h1[:500] = 7  # equal halves are told apart by the others
    sizes, words = perfect_hash.build(h1, h2)
    at = perfect_hash.slots(sizes, words, perfect_hash.directory(words), h1, h2)
    assert sorted(at.tolist()) == list(range(20000))
    with pytest.raises(ValueError):
        perfect_hash.build(h1[[1, 1]], h2[[1, 1]])
    assert perfect_hash.build(h1[:0], h2[:0])[0] == []
