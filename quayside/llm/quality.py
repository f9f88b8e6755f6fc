"""Quality scores by a generalised additive model with pairwise interactions.

Shallow trees, boosted feature by feature in turn, add up to one lookup table per feature and per chosen pair of
features. A score is the sum of the tables' values at a document's bins.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACED, Packed, Scratch, batch_of, crc_mod, pieces, shingles, sized_broadcast

#: Labelled rows that the model is fitted on, at most; those with the smallest hash of doc_id.
TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 64, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, RIDGE, LEAST = 240, 80, 0.1, 2.0, 20

FEATURES = ["bytes", "words", "word_bytes", "longest_word", "upper", "digits", "periods", "commas", "punctuation", "symbols", "bars", "space", "lines", "beyond_ascii", "distinct_words", "top_word", "repeated_next", "short_words", "distinct_triples", "words_a_line", "word_ends_in_symbol"]

_KINDS = np.zeros(256, dtype=np.int64)
for _kind, _bytes in enumerate(([*range(0x41, 0x5B)], [*range(0x30, 0x3A)], b".", b",", b"!?;:'\"()-", b"#$%&*@^~+=<>[]{}\\/_`", b"|", b" \t\r\x0b\x0c", b"\n", [*range(0x80, 0x100)]), start=1):
    _KINDS[list(_bytes)] = _kind
_SYMBOL = _KINDS == 6


def features(texts: list[bytes | None]) -> np.ndarray:
    """[texts, FEATURES] of whole texts; shares of an empty text are 0."""
    packed = Packed(texts, None)
    kinds = _KINDS[packed.buf]
    lowered = Packed(texts, LOWER)
    starts, ends, first = lowered.words(SPACED)
    h = lowered.hashes(starts, ends)
    lens = ends - starts
    odd_end = _SYMBOL[packed.buf[ends - 1]] if len(ends) else np.empty(0, dtype=bool)
    out = np.zeros((len(texts), len(FEATURES)), dtype=np.float32)
    for i, n_bytes in enumerate(packed.lens):
        if not n_bytes:
            continue
        a, b = first[i], first[i + 1]
        n = np.bincount(kinds[packed.first[i] : packed.first[i] + n_bytes], minlength=11)
        row = out[i]
        row[0] = np.log1p(n_bytes)
        row[4:14] = n[1:11] / n_bytes
        w = b - a
        if not w:
            continue
        words, size = h[a:b], lens[a:b]
        _, counts = np.unique(words, return_counts=True)
        row[1], row[2], row[3] = np.log1p(w), size.mean(), np.log1p(size.max())
        row[14], row[15] = len(counts) / w, counts.max() / w
        row[16] = (words[1:] == words[:-1]).sum() / w
        row[17] = (size <= 3).mean()
        row[18] = len(np.unique(shingles(words, 3))) / max(1, w - 2)
        row[19], row[20] = np.log1p(w / (n[9] + 1)), odd_end[a:b].mean()
    return out


def _best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and number of bins to the left; 0 if no split pays."""
    cg, ch, cn = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    G, H, N = g.sum(), h.sum(), n.sum()
    gain = cg**2 / (ch + RIDGE) + (G - cg) ** 2 / (H - ch + RIDGE) - G**2 / (H + RIDGE)
    gain = np.where((cn >= LEAST) & (N - cn >= LEAST), gain, -1.0)
    if not len(gain) or gain.max() <= 1e-9:
        return 0.0, 0
    return float(gain.max()), int(gain.argmax()) + 1


def _shallow(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A tree of depth two over a feature's bins, as the step it adds to the feature's table."""
    out = np.zeros(len(g))

    def leaf(a: int, b: int) -> None:
        out[a:b] = RATE * g[a:b].sum() / (h[a:b].sum() + RIDGE)

    _, cut = _best_split(g, h, n)
    if not cut:
        leaf(0, len(g))
        return out
    for a, b in ((0, cut), (cut, len(g))):
        _, inner = _best_split(g[a:b], h[a:b], n[a:b])
        leaf(a, a + inner)
        leaf(a + inner, b)
    return out


def _shallow_pair(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A tree that splits one feature and then the other on either side, whichever order gains more."""
    best, out = -1.0, np.zeros_like(g)
    for turn in (False, True):
        gg, hh, nn = (x.T if turn else x for x in (g, h, n))
        gain, cut = _best_split(gg.sum(1), hh.sum(1), nn.sum(1))
        step, halves = np.zeros_like(gg), ((0, cut), (cut, len(gg))) if cut else ((0, len(gg)),)
        for a, b in halves:
            more, inner = _best_split(gg[a:b].sum(0), hh[a:b].sum(0), nn[a:b].sum(0))
            gain += more
            for c, d in ((0, inner), (inner, gg.shape[1])) if inner else ((0, gg.shape[1]),):
                step[a:b, c:d] = RATE * gg[a:b, c:d].sum() / (hh[a:b, c:d].sum() + RIDGE)
        if gain > best:
            best, out = gain, step.T if turn else step
    return out


@dataclass
class AdditiveModel:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, j], side="right")]
        for i, j, values in self.pairs:
            total += values[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _loss(f: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, f) - y * f)) if len(y) else 0.0


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Fits on rows in a random order; the last fifth decides when to stop. One class only: a constant score."""
    if not len(y):
        return AdditiveModel()
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(base=float(np.log(share / (1 - share))))
    if y.min() == y.max():
        return model
    cut = len(y) - len(y) // 5
    cuts = lambda n: [np.unique(np.quantile(x[:cut, j], np.arange(1, n) / n)).astype(np.float32) for j in range(x.shape[1])]
    model.edges, model.coarse = cuts(BINS), cuts(PAIR_BINS)
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    f = np.full(len(y), model.base)

    def grads():
        p = 1 / (1 + np.exp(-f[:cut]))
        return y[:cut] - p, p * (1 - p)

    counts = [np.bincount(b[:cut], minlength=len(t)) for b, t in zip(bins, model.tables, strict=True)]
    best, kept, waited = _loss(f[cut:], y[cut:]), [t.copy() for t in model.tables], 0
    for _ in range(ROUNDS):
        for j, (b, t) in enumerate(zip(bins, model.tables, strict=True)):
            g, h = grads()
            step = _shallow(np.bincount(b[:cut], g, len(t)), np.bincount(b[:cut], h, len(t)), counts[j])
            t += step
            f += step[b]
        now = _loss(f[cut:], y[cut:])
        waited = 0 if now < best - 1e-5 else waited + 1
        if now < best:
            best, kept = now, [t.copy() for t in model.tables]
        if waited >= 20:
            break
    model.tables = kept
    f = model.base + sum(t[b] for t, b in zip(kept, bins, strict=True))

    # Pairs whose joint bins explain most of what is left.
    small = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]
    width = [len(e) + 1 for e in model.coarse]
    g, h = grads()
    gains = []
    for i, j in itertools.combinations(range(x.shape[1]), 2):
        cell = small[i][:cut] * width[j] + small[j][:cut]
        n = width[i] * width[j]
        gains.append((float((np.bincount(cell, g, n) ** 2 / (np.bincount(cell, h, n) + RIDGE)).sum()), i, j))
    chosen = [(i, j, np.zeros((width[i], width[j]))) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    cells = [small[i] * width[j] + small[j] for i, j, _ in chosen]
    best, model.pairs, waited = _loss(f[cut:], y[cut:]), [], 0
    for _ in range(PAIR_ROUNDS):
        for (_, _, t), cell in zip(chosen, cells, strict=True):
            g, h = grads()
            hist = lambda v, cell=cell, t=t: np.bincount(cell[:cut], v, t.size).reshape(t.shape)
            step = _shallow_pair(hist(g), hist(h), hist(None))
            t += step
            f += step.ravel()[cell]
        now = _loss(f[cut:], y[cut:])
        waited = 0 if now < best - 1e-5 else waited + 1
        if now < best:
            best, model.pairs = now, [(i, j, t.copy()) for i, j, t in chosen]
        if waited >= 10:
            break
    return model


def _feature_rows(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("x", pa.list_(pa.float32()))])
    for batch, texts in pieces(batches, "text"):
        x = features(texts)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float32()))
        yield batch_of(schema, batch.column(0), batch.column(1), lists)


def _score_rows(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
            yield batch_of(schema, batch.column(0), batch.column(1), shared.value.score(x))

    return run


def _training_sample(labelled: DataFrame, train_rows: int, scratch: Scratch) -> DataFrame:
    """The labelled rows with the smallest hash of doc_id.

    A bound on that hash leaves about twice as many to be sorted, however many rows are labelled. Only if the bound
    should leave too few, as where one doc_id has most rows, all are sorted.
    """
    labelled = scratch.write(labelled, "labelled")
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    n = labelled.count()
    low = labelled.where(place <= min(1.0, 2.0 * train_rows / max(n, 1)))
    near = low if low.count() >= min(n, train_rows) else labelled
    return near.orderBy(place, "doc_id", "text_hash").limit(train_rows)


def quality_scores(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: doc_id, text_hash, held_out, score, predicted.

    Fitted on rows of `labels` with quality 0 or 1 whose crc32(doc_id as text) mod 3 is not 1, at most
    `train_rows` of them, those with the smallest hash of doc_id; labels that contradict each other count by
    their majority, as many of each as 1. held_out marks the remainder 1. Features come from whole texts of any length; a null text counts
    as empty. With no labels at all every score is 0.5; without documents there are no rows. Repeated rows get equal
    scores. A null doc_id is scored, never learned from. Other columns, clashing names included, are not read.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "quality")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    rows = scratch.write(source.mapInArrow(_feature_rows, "doc_id long, text_hash long, x array<float>"), "features")
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)")
    known = known.where(~held_out).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    train = _training_sample(rows.join(known, "doc_id"), train_rows, scratch).select("x", "quality").toPandas()
    x = np.stack(train["x"].to_numpy()).astype(np.float32) if len(train) else np.empty((0, len(FEATURES)), dtype=np.float32)
    model = spark.sparkContext.broadcast(fit(x, train["quality"].to_numpy(dtype=np.float64)))
    scratch.drop_but("features")
    scored = rows.mapInArrow(_score_rows(model), "doc_id long, text_hash long, score double")
    return scored.select("doc_id", "text_hash", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model does not reject (score 0.5 or more), in their own columns.

    Rows go by doc_id and text, so rows that repeat stay or go together, and other texts of a doc_id, null ones
    included, are judged by themselves. Without labels all stay; an empty table stays empty; texts of any length are
    read whole; columns named like those of the scores stay as they are.
    """
    scratch = Scratch(docs.sparkSession, "keep-good")
    bad = quality_scores(docs, labels, scratch=scratch).where("predicted = 0").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    bad = scratch.write(bad, "bad")
    scratch.drop_but("bad")
    bad = sized_broadcast(bad, bad.count(), 24)
    same = docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["bad_hash"])
    return docs.join(bad, same, "left_anti")
