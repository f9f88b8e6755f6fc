import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quayside.llm.mixing import mix
from quayside.llm.quality import quality_scores
from quayside.llm.queries import MIX_TARGETS
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_near_dedup import brute as groups

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, columns = docs, docs.columns
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or docs.columns == columns
        out.append((before, docs))
    texts = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}

    before, after = out[0]
    good = {r.doc_id for r in quality_scores(before, labels).where("predicted = 1").collect()}
    assert set(texts(after)) == good and 0 < len(good) < before.count()

    before, after = (texts(x) for x in out[1])
    want = groups(list(before.items()), 80, 5)
    assert set(after) == {d for d in before if want[d][1] == d} and len(after) < len(before)

    before, after = (texts(x) for x in out[2])
    found = leaks(list(before.items()), [tuple(r) for r in bench.select("item_id", "text").collect()])
    assert set(after) == {d for d in before if not found[d][1]} and len(after) < len(before)

    before, after = out[3]
    assert set(texts(after)) == {r.doc_id for r in mix(before, MIX_TARGETS, corpus_pipeline.MIX_BUDGET).where("sampled").collect()}

    before, after = out[4]
    library, at, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for d, t in sorted(texts(before).items()):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in after.collect()) == want

    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_edges(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing names and an empty table go through every stage."""
    good = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").collect()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    long = " ".join(f"word{i} and some more text." for i in range(40_000))
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in good]
    rows += [(1000, None, None, None, None), (1001, "", "en", "a", 0), (None, good[0].text, "en", "a", 1), (None, None, None, None, None), (1002, long, "en", "a", len(long)), (1002, long, "en", "a", len(long)), (1003, f"{good[1].text} {item} {item}", "en", "a", 1)]
    names = ["score", "bad_id", "bad_hash", "kept", "component_id", "text_hash", "row", "hash", "weight", "_source", "tokens", "start", "n_tokens"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        assert stage(spark, docs.where("false"), SF).count() == 0
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or (after.columns == columns and after.where("kept <> 'x'").isEmpty() and after.count() <= docs.count())
        if k == 1:
            assert after.where("doc_id = 1002").count() <= 1 and after.where("doc_id is null").count() == docs.where("doc_id is null").count()
        if k == 2:
            assert after.where("doc_id = 1003").isEmpty()
        docs = docs if k == 0 and after.where("doc_id = 1003").isEmpty() else after
    assert docs.count() > 0 and docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
