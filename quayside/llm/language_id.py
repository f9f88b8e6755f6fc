"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

Subwords are runs of three and four bytes inside a word and its bordering blanks. The classifier is linear over the
average, so after training every bucket keeps its scores for the languages and a text's scores are their mean.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _LOW, LOWER, SPACED, Packed, Scratch, batch_of, crc_mod, pieces, sized_broadcast

BUCKETS, DIMENSIONS = 1 << 16, 16
SIZES = (3, 4)
#: Documents that the model learns from, at most: of each language, and in all; those with the smallest hash of doc_id.
TRAIN_PER_LANGUAGE, TRAIN_DOCUMENTS = 1_000, 8_000
#: Distinct buckets of all texts together that it learns from, at most: what the driver holds does not grow with texts.
TRAIN_BUCKETS = 8_000_000
EPOCHS, BATCH, RATE = 20, 64, 20.0
#: Share of the texts kept that may be wrong where the model is sure enough; the rest are marked as rejected.
ERROR_KEPT = 0.01

_BLANKED = bytes(0x20 if not SPACED[c] else LOWER[c] for c in range(256))


def buckets(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords, flat in order of text, and each text's bounds in them."""
    packed = Packed(texts, _BLANKED)
    end = packed.first[-1]
    view = np.ndarray((end,), dtype="<u8", buffer=packed.bytes, strides=(1,))
    blank = packed.buf[: end + 8] == 0x20
    found, at = [], []
    for n in SIZES:
        ok = ~blank[1 : end - n + 2] if n > 2 else np.ones(max(0, end - n + 1), dtype=bool)
        for k in range(2, n - 1):
            ok = ok & ~blank[k : k + len(ok)]
        own = np.flatnonzero(ok)
        code = (view[own] & _LOW[n]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
        found.append(((code ^ (code >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64))
        at.append(own)
    where = [np.searchsorted(x, packed.first - 1) for x in at]  # a text's subwords may begin at the blank before it
    bounds = np.concatenate([[0], np.cumsum(sum(np.diff(w) for w in where))])
    flat = np.empty(bounds[-1], dtype=np.int64)
    begin = bounds[:-1].copy()
    for x, w in zip(found, where, strict=True):
        n = np.diff(w)
        own = x[w[0] : w[-1]]
        flat[np.repeat(begin - w[:-1], n) + np.arange(w[0], w[-1])] = own
        begin += n
    return flat, bounds


@dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # [buckets, languages], divided by the temperature
    threshold: float

    def probabilities(self, flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = np.diff(bounds)
        z = np.zeros((len(n), len(self.languages)))
        full = np.flatnonzero(n)
        if len(full):
            for c in range(z.shape[1]):
                z[full, c] = np.add.reduceat(self.scores[:, c][flat], bounds[:-1][full]) / n[full]
        return softmax(z)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _means(embedding: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return np.stack([(n / max(n.sum(), 1)) @ embedding[b] for b, n in rows]) if rows else np.empty((0, embedding.shape[1]))


def fit(languages: list[str], rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 7) -> LanguageModel:
    """rows: (distinct buckets, counts) of each text. A fifth of them is kept aside to calibrate."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    cut = max(1, len(y) - len(y) // 5)
    train, aside = order[:cut], order[cut:]
    embedding = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    weights = np.zeros((DIMENSIONS, len(languages)))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for batch in np.array_split(rng.permutation(train), -(-len(train) // BATCH)):
            own = [rows[i] for i in batch]
            mean = _means(embedding, own)
            p = softmax(mean @ weights)
            p[np.arange(len(batch)), y[batch]] -= 1
            p /= len(batch)
            back = p @ weights.T
            weights -= rate * mean.T @ p
            for (b, n), g in zip(own, back, strict=True):
                embedding[b] -= (rate / max(n.sum(), 1)) * n[:, None] * g
    z = _means(embedding, [rows[i] for i in aside]) @ weights
    temperature, threshold = 1.0, 0.0
    if len(aside):
        own = np.arange(len(aside))
        grid = np.geomspace(0.05, 20, 121)
        temperature = float(grid[np.argmin([-np.log(np.maximum(softmax(z / t)[own, y[aside]], 1e-12)).mean() for t in grid])])
        p = softmax(z / temperature)
        top, right = p.max(axis=1), p.argmax(axis=1) == y[aside]
        by = np.argsort(-top, kind="stable")
        wrong = np.cumsum(~right[by]) / np.arange(1, len(by) + 1)
        fine = np.flatnonzero(wrong <= ERROR_KEPT)
        threshold = float(top[by[fine[-1]]]) if len(fine) else 1.0
    return LanguageModel(languages, (embedding @ weights / temperature).astype(np.float32), threshold)


def _training_rows(batches):
    schema = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("size", pa.int64()), ("buckets", pa.binary()), ("counts", pa.binary())])
    for batch, texts in pieces(batches, "text"):
        flat, bounds = buckets(texts)
        both = [np.unique(flat[a:b], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield batch_of(schema, batch.column(0), batch.column(1), [len(x) for x, _ in both], [x.astype("<u2").tobytes() for x, _ in both], [n.astype("<f4").tobytes() for _, n in both])


def _training_sample(known: DataFrame, per_language: int, documents: int, total: int, scratch: Scratch) -> DataFrame:
    """(lang, n, size, buckets, counts) of at most `documents` texts and `total` distinct buckets of texts, in hash order.

    Where a language has far more documents than are wanted, a bound on the hash of doc_id leaves about twice as many,
    so that no task ever holds a language; the rest is exact. Several texts of one doc_id count as their smallest.
    """
    sizes = scratch.write(known.groupBy("lang").agg(F.count("*").alias("n_rows")), "languages")
    share = F.least(F.lit(1.0), F.lit(2.0 * per_language) / F.col("n_rows"))
    low = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53)) <= share
    near = known.join(sized_broadcast(sizes, sizes.count(), 64), "lang").where(low)
    ids = scratch.write(near.groupBy("lang", "doc_id").agg(F.count("*").alias("copies")), "near-ids")
    # The languages' groups are bounded by the share, whatever their sizes.
    order = Window.partitionBy("lang").orderBy(F.shiftrightunsigned(F.xxhash64("doc_id"), 11), "doc_id")
    ids = ids.withColumn("n", F.row_number().over(order).cast("long")).where(F.col("n") <= per_language).orderBy("n", "lang").limit(documents)
    chosen = known.join(F.broadcast(ids.select("lang", "doc_id", "n")), ["lang", "doc_id"])  # bounded by `documents`
    texts = chosen.groupBy("lang", "doc_id", "n").agg(F.min("text").alias("text"))
    rows = scratch.write(texts.select("lang", "n", "text").mapInArrow(_training_rows, "lang string, n long, size long, buckets binary, counts binary"), "rows")
    held = F.sum("size").over(Window.orderBy("n", "lang").rowsBetween(Window.unboundedPreceding, 0))  # over at most `documents` rows
    places = rows.select("n", "lang", held.alias("held")).where(F.col("held") <= total).select("n", "lang")
    return rows.join(F.broadcast(places), ["n", "lang"]).select("lang", "n", "size", "buckets", "counts")


def _predictions(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches):
        model = shared.value
        for batch, texts in pieces(batches, "text"):
            letters = batch.column(2).to_numpy(zero_copy_only=False)
            if not model.languages:
                n = batch.num_rows
                yield batch_of(schema, batch.column(0), ["und"] * n, np.zeros(n), np.ones(n, dtype=bool))
                continue
            p = model.probabilities(*buckets(texts))
            top = p.max(axis=1)
            best = p.argmax(axis=1)
            names = [model.languages[k] if has else "und" for k, has in zip(best, letters, strict=True)]
            yield batch_of(schema, batch.column(0), names, np.where(letters, top, 0.0), ~letters | (top < model.threshold))

    return run


def predict_languages(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE, documents: int = TRAIN_DOCUMENTS, total: int = TRAIN_BUCKETS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected.

    Learned from text and non-null lang of documents whose crc32(doc_id as text) mod 5 is not 0, at most
    `per_language` of each language and `documents` in all, as long as their distinct buckets add up to `total` or
    less. score is the calibrated probability of lang_pred. rejected marks texts whose score is under the threshold
    that keeps errors among the others near 1 %.
    Null texts and texts without a letter are `und`, score 0 and rejected; with nothing to learn from, all are; an
    empty table gives no rows. Texts of any length are read whole. Repeated rows each get a row, all with one result;
    in learning they count once. Equal probabilities go to the first language by name. Only doc_id, text and lang are
    read, so other columns may have any name.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "language-id")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    known = source.where(letters & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    sample = _training_sample(known, per_language, documents, total, scratch).toArrow()
    scratch.drop()
    sample = sample.sort_by([("lang", "ascending"), ("n", "ascending")])
    names = sample.column("lang").to_pylist()
    languages = sorted(set(names))
    model = LanguageModel([], np.zeros((BUCKETS, 0)), 1.0)
    if names:
        read = lambda name, kind, to: [np.frombuffer(x.as_buffer(), kind).astype(to) for chunk in sample.column(name).chunks for x in chunk]
        rows = list(zip(read("buckets", "<u2", np.int64), read("counts", "<f4", np.float64), strict=True))
        model = fit(languages, rows, np.array([languages.index(x) for x in names]))
    out = source.select("doc_id", "text", letters.alias("letters")).mapInArrow(_predictions(spark.sparkContext.broadcast(model)), "doc_id long, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
