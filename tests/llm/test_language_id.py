import random

import numpy as np
from pyspark.sql import functions as F

from quayside.llm import language_id
from quayside.llm.common import Scratch
from quayside.llm.language_id import BUCKETS, DIMENSIONS, SIZES, LanguageModel, buckets, fit, predict_languages


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = predict_languages(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").toPandas()
    assert len(rows) == docs.count()
    own = rows[rows["held_out"]]
    assert (own["lang_pred"] == own["lang"]).mean() > 0.97
    kept = own[~own["rejected"]]
    assert len(kept) > 0.9 * len(own) and (kept["lang_pred"] == kept["lang"]).mean() > 0.98
    assert rows["score"].between(0, 1).all()


def test_subwords():
    flat, bounds = buckets([b"ab", b"", None, b"AB", b"abc d"])
    n = np.diff(bounds).tolist()
    # " ab" "ab " " ab " ; " ab" "abc" "bc " " abc" "abc " " d " ; an inner blank ends a word
    assert n == [3, 0, 0, 3, 6]
    assert flat[:3].tolist() == flat[3:6].tolist()


def test_edges(spark):
    rows = [(i, w * 5, lang) for i in range(60) for w, lang in (("the house ", "en"), ("das haus ", "de"))][:100]
    rows += [(200, None, "en"), (201, "", "en"), (202, "12 34 !", "en"), (203, "the", None), (204, "the house " * 30000, "en"), (None, "das haus", "de")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    out = predict_languages(df)
    by = {r.doc_id: r for r in out.collect()}
    assert [by[i].lang_pred for i in (200, 201, 202, 203, 204, None)] == ["und", "und", "und", "en", "en", "de"]
    assert out.count() == len(rows)
    assert predict_languages(df.where("false")).count() == 0
    assert {r.lang_pred for r in predict_languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def naive_buckets(text):
    """Runs of three and four bytes inside a word and its bordering blanks, one after the other."""
    blank = b" \t\n\x0b\x0c\r"
    t = b" " + bytes(0x20 if c in blank else c + 32 if 65 <= c <= 90 else c for c in text or b"") + b" "
    out = []
    for n in SIZES:
        for i in range(len(t) - n + 1):
            gram = t[i : i + n]
            if 0x20 not in gram[1:-1]:
                code = (int.from_bytes(gram, "little") * 0x9E3779B97F4A7C15 + n) % 2**64
                out.append(((code ^ code >> 31) * 0xBF58476D1CE4E5B9) % 2**64 >> 48)
    return sorted(out)


def test_buckets_and_scores_against_loops():
    rnd = random.Random(4)
    texts = ["".join(rnd.choices(["a", "B", "é", " ", "\n", "the", "-"], k=rnd.randrange(40))).encode() for _ in range(200)] + [None, b"", b" "]
    flat, bounds = buckets(texts)
    own = [sorted(flat[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert own == [naive_buckets(t) for t in texts]
    rng = np.random.default_rng(3)
    model = LanguageModel(["a", "b", "c"], rng.normal(size=(BUCKETS, 3)).astype(np.float32), 0.5)
    for t, p in zip(own, model.probabilities(flat, bounds), strict=True):
        z = [sum(float(model.scores[k, c]) for k in t) / len(t) if t else 0.0 for c in range(3)]
        e = np.exp(np.array(z) - max(z))
        assert np.allclose(p, e / e.sum(), atol=1e-6)


def test_a_step_against_one_text_at_a_time(monkeypatch):
    """The fitted scores are those of the same descent written text by text."""
    monkeypatch.setattr(language_id, "EPOCHS", 2)
    rng = np.random.default_rng(7)
    rows = [np.unique(np.random.default_rng(i).integers(0, 50, 12), return_counts=True) for i in range(30)]
    rows = [(b, n.astype(float)) for b, n in rows]
    y = np.arange(30) % 2
    got = fit(["x", "y"], rows, y)
    order = rng.permutation(30)
    train, aside = order[:24], order[24:]
    emb, w = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)), np.zeros((DIMENSIONS, 2))
    for epoch in range(2):
        rate = language_id.RATE * (1 - epoch / 2)
        for batch in np.array_split(rng.permutation(train), -(-len(train) // language_id.BATCH)):
            dw, de = np.zeros_like(w), np.zeros_like(emb)
            for i in batch:
                b, n = rows[i]
                mean = sum(c * emb[k] for k, c in zip(b, n, strict=True)) / n.sum()
                e = np.exp(mean @ w - (mean @ w).max())
                off = (e / e.sum() - np.eye(2)[y[i]]) / len(batch)
                dw += np.outer(mean, off)
                for k, c in zip(b, n, strict=True):
                    de[k] += c / n.sum() * (w @ off)
            w, emb = w - rate * dw, emb - rate * de
    raw = emb @ w
    scale = np.abs(raw).max() / np.abs(got.scores).max()  # the temperature
    assert np.allclose(raw / scale, got.scores, atol=1e-5) and len(aside) == 6


def test_ties_and_repeated_rows(spark):
    """Equal texts get one result each time; where languages tie, the first by name is taken."""
    rows = [(1, "same words here", "bb"), (1, "same words here", "bb"), (2, "same words here", "aa"), (3, "same words here", None)] * 3
    out = predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(out) == len(rows) and len({(r.lang_pred, r.score) for r in out}) == 1
    flat, bounds = buckets([b"some text"])
    p = LanguageModel(["aa", "bb"], np.zeros((BUCKETS, 2), dtype=np.float32), 0.5).probabilities(flat, bounds)
    assert p[0].tolist() == [0.5, 0.5] and p.argmax(axis=1).tolist() == [0]


def test_sample_is_bounded(spark):
    """One doc_id with very many texts, and a language far over its share, are learned from within the bounds."""
    rows = [(7, f"one of many texts {i}", "en") for i in range(400)] + [(100 + i, f"wieder ein text {i}", "de") for i in range(400)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    scratch = Scratch(spark, "test-sample")
    got = language_id._training_sample(known, 20, 1000, 10**6, scratch).collect()
    assert 10 <= sum(r.lang == "de" for r in got) <= 20 and sum(r.lang == "en" for r in got) <= 1
    few = language_id._training_sample(known, 20, 1000, 100, Scratch(spark, "test-few")).collect()
    assert sum(r["size"] for r in few) <= 100
