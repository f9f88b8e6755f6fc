import random

import numpy as np

from pyspark.sql import functions as F

from quayside.llm import near_dedup
from quayside.llm.near_dedup import keep_one, near_duplicates

SCHEMA = "doc_id long, text string, kept boolean"
DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"


def brute(rows, percent, width):
    """Smallest reachable doc_id by comparing all pairs."""
    sets = {}
    for doc_id, text in rows:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
        if w:
            k = min(width, len(w))
            sets[doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    root = {d: d for d, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(sets.get(d, ())), top(d)) for d, _ in rows}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_against_all_pairs(spark):
    docs = spark.read.parquet(DOCUMENTS)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for percent, width in ((85, 3), (80, 5)):
        assert got(near_duplicates(docs, percent, width)) == brute(rows, percent, width)


def test_group_of_unequal_copies(spark):
    """Edits drift, so a group holds links that no single pivot shows."""
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(160):
        own = rnd.choice(rows)[1].split() if rows and rnd.random() < 0.6 else list(base)
        for _ in range(rnd.randrange(5)):
            own[rnd.randrange(len(own))] = f"e{rnd.randrange(10**6)}"
        rows.append((1000 - i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 85, 3)
    assert len({c for _, c in want.values()}) > 3
    assert got(near_duplicates(df, 85, 3)) == want


def test_edge_rows(spark):
    long = " ".join(f"x{i}" for i in range(30000))
    rows = [(1, None, True), (2, "", None), (3, " \n\t", None), (4, "one", None), (5, "ONE", None), (6, "a b c d", None), (6, "a b c d", None), (7, long, None), (8, long + " y", None), (None, "a b c d", None)]
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA), 85, 3)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    found = sorted(((r.doc_id or -1), r.n_shingles, r.component_id, r.kept) for r in out.collect())
    assert found == [(-1, 2, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 2, 6, True), (6, 2, 6, True), (7, 29998, 7, True), (8, 29999, 7, False)]


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keep_one(spark):
    rows = [(3, "a b c d e f", True), (1, "A b c d e f", False), (2, "g h", None)]
    out = keep_one(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "kept"]
    assert sorted(r.doc_id for r in out.collect()) == [1, 2]


def test_keep_one_of_ids_with_several_texts(spark):
    """No text goes that has no near copy, whatever its id; of equal rows one stays, the same one in each run."""
    a, b, c = "a b c d e f g", "totally different words than all the others here", "the third text is unlike these two as well"
    rows = [(1, a, True), (1, b, False), (2, a, True), (3, c, True), (3, c, False), (3, c, True), (4, None, True), (4, "", False), (4, b, None), (None, a, True), (None, a, True)]
    for df in (spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)):
        out = keep_one(df.withColumnRenamed("kept", "_key0").withColumn("id", F.lit(1)))
        assert out.columns == ["doc_id", "text", "_key0", "id"]
        got = sorted(((r.doc_id, r.text or "") for r in out.collect()), key=repr)
        # The second id's text is nowhere else under a single text, so it stays; the first id's copy of it goes.
        assert got == sorted([(1, b), (2, a), (3, c), (4, ""), (None, a), (None, a)], key=repr)
    same = [{r._key0 for r in keep_one(spark.createDataFrame(x, SCHEMA).withColumnRenamed("kept", "_key0")).where("doc_id = 3").collect()} for x in (rows, rows[::-1])]
    assert same[0] == same[1] and len(same[0]) == 1


def test_one_text_under_many_ids_stays_linear(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same words again and again").alias("text"))
    assert near_duplicates(df).agg(F.sum(F.col("kept").cast("int"))).first()[0] == 1


def matrix_brute(texts, percent, width):
    """Components of all pairs: shared shingles counted as a product of matrices."""
    sets = [{tuple(w[i : i + width]) for i in range(len(w) - width + 1)} for w in (t.split() for t in texts)]
    places, n = {}, np.array([len(s) for s in sets])
    for s in sets:
        for x in s:
            places[x] = places.get(x, 0) + 1
    shared = {x: k for k, x in enumerate(x for x, c in places.items() if c > 1)}
    m = np.zeros((len(texts), len(shared)), dtype=np.float32)
    for i, s in enumerate(sets):
        m[i, [shared[x] for x in s if x in shared]] = 1
    both = m @ m.T
    linked = (100 * both >= percent * (n[:, None] + n[None, :] - both)) | np.eye(len(texts), dtype=bool)
    label = np.arange(len(texts))
    while True:
        least = np.where(linked, label[None, :], len(texts)).min(axis=1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def test_large_groups_stay_linear(spark, monkeypatch):
    """5,000 near copies in many components and 5,000 exact ones: what any step hands to components grows with members."""
    seen = []
    inner = near_dedup.components
    monkeypatch.setattr(near_dedup, "components", lambda edges, scratch, name: seen.append((name, edges.count())) or inner(edges, scratch, name))
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(300)}" for _ in range(60)]
    texts = []
    for _ in range(5000):
        own = rnd.choice(texts).split() if texts and rnd.random() < 0.3 else list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 4])):
            own[rnd.randrange(len(own))] = f"e{rnd.randrange(3000)}"
        texts.append(" ".join(own))
    rows = [*enumerate(texts), *((10_000 + i, "one text that very many documents hold word by word") for i in range(5000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = matrix_brute(texts, 85, 3)
    assert 20 < len(set(want)) < 4000
    found = {r.doc_id: r.component_id for r in near_duplicates(df, 85, 3).collect()}
    assert [found[i] for i in range(5000)] == want.tolist()
    assert {found[10_000 + i] for i in range(5000)} == {10_000}
    assert max(n for _, n in seen) <= 2 * 5000, seen
