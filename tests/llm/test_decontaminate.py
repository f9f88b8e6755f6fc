import re

from quayside.llm.decontaminate import contaminated_documents, drop_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=10):
    windows = []
    for item_id, text in items:
        w = words(text)
        n = min(size, len(w))
        windows += [(str(item_id), tuple(w[i : i + n])) for i in range(len(w) - n + 1)] if n else []
    by, out = {}, {}
    for item_id, w in windows:
        by.setdefault(w, set()).add(item_id)
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in by}:
            for p in range(len(w) - n + 1):
                if ids := by.get(tuple(w[p : p + n])):
                    hit |= set(range(p, p + n))
                    found |= ids
        out[doc_id] = (len(w), len(hit), sorted(found))
    return out


def got(df):
    return {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in df.collect()}


def test_whole_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute([tuple(r) for r in docs.collect()], [tuple(r) for r in bench.select("item_id", "text").collect()])
    assert any(x[1] for x in want.values())
    assert got(contaminated_documents(docs, bench)) == want
    # A filter so small that everything passes changes nothing.
    assert got(contaminated_documents(docs, bench, filter_bits=64)) == want


def test_edges(spark):
    item = "one two three four five six seven eight nine ten eleven"
    items = [("a", item, 1), ("b", "Short item", 2), ("c", "short ITEM!", 3), ("d", "", 4), ("e", None, 5), ("f", "é", 6), ("g", "x x x x x x x x x x x", 7)]
    docs = [(1, item.upper()), (2, "nothing here"), (3, None), (4, ""), (5, "a short, item; short"), (6, "É é"), (7, " ".join(["x"] * 40)), (8, "y " * 50000 + item), (9, item[4:]), (10, "two three four five six seven eight nine ten")]
    df = spark.createDataFrame([(*d, 0, "z") for d in docs], "doc_id long, text string, row long, words string")
    bench = spark.createDataFrame(items, "item_id string, text string, hash long")
    assert got(contaminated_documents(df, bench)) == brute(docs, [x[:2] for x in items])
    assert sorted(r.doc_id for r in drop_contaminated(df, bench).collect()) == [2, 3, 4, 10]
    twice = contaminated_documents(df.union(df), bench)
    assert twice.count() == 2 * len(docs)
    none = bench.where("false")
    assert {r.n_hit for r in contaminated_documents(df, none).collect()} == {0}
    assert contaminated_documents(df.where("false"), bench).count() == 0


def test_other_texts_of_an_id_stay(spark):
    """Null and repeated ids are judged text by text; an item without an id still hits."""
    item = "one two three four five six seven eight nine ten eleven"
    df = spark.createDataFrame([(None, item), (None, "clean words"), (1, item), (1, "clean too"), (1, None)], "doc_id long, text string")
    bench = spark.createDataFrame([("a", item)], "item_id string, text string")
    assert sorted((r.text or "") for r in drop_contaminated(df, bench).collect()) == ["", "clean too", "clean words"]
    nameless = spark.createDataFrame([(None, item)], "item_id string, text string")
    hit = {r.text_hash: (r.n_hit, r.n_items, r.contaminated) for r in contaminated_documents(df, nameless).where("n_hit > 0").collect()}
    assert set(hit.values()) == {(11, 0, True)}
