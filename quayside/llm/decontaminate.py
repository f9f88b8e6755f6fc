"""Benchmark decontamination by a prefix-filtered set join.

Every item is cut into windows. A document contains a window exactly only if it holds the window's rarest
shingle, so that one shingle is the necessary prefix of the window in the global order of rarity (for full
containment a prefix of length one suffices). Documents join on prefixes alone; position and length bounds
and the exact words around the shingle decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Packed, Scratch, as_bytes, batch_of, int_lists, pieces, shingles, sized_broadcast

#: Words of a prefix shingle.
WIDTH = 3


def _words(packed: Packed):
    starts, ends, first = packed.words(ALNUM)
    return starts, ends, first, packed.hashes(starts, ends)


def _windows(size: int):
    schema = pa.schema([("item_id", pa.string()), ("words", pa.string()), ("n_words", pa.int64()), ("shingle_hashes", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, text in enumerate(as_bytes(batch.column(1))):
                packed = Packed([text])
                starts, ends, _, h = _words(packed)
                n = min(size, len(h))
                if not n:
                    continue
                words = [packed.bytes[a:b].decode("utf-8", "replace") for a, b in zip(starts, ends, strict=True)]
                k = min(WIDTH, n)
                grams = shingles(h, k)
                at = range(len(words) - n + 1)
                flat = np.concatenate([grams[p : p + n - k + 1] for p in at])
                yield batch_of(schema, [ids[i]] * len(at), [" ".join(words[p : p + n]) for p in at], [n] * len(at), int_lists(flat, np.arange(len(at) + 1) * (n - k + 1)))

    return run


class _Filter:
    """A Bloom filter of fixed size over 64-bit hashes; what passes wrongly is refused by the join behind it."""

    def __init__(self, hashes: DataFrame, bits: int):
        self.mask = np.uint64(bits - 1)
        h = F.col("hash")
        slot = F.explode(F.array(F.pmod(h, F.lit(bits)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(bits)))).alias("slot")
        words = hashes.select(slot).select(F.floor(F.col("slot") / 64).alias("at"), F.expr("shiftleft(1L, cast(slot % 64 AS int))").alias("bit"))
        # At most bits / 64 rows come back, however many hashes there are.
        table = np.zeros(bits // 64, dtype=np.int64)
        for r in words.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect():
            table[r["at"]] = r["bits"]
        self.table = table.view(np.uint8)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), dtype=bool)
        for x in (h & self.mask, (h >> np.uint64(32)) & self.mask):
            out &= (self.table[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
        return out


def _passing(packed: Packed, widths: list[int], passes):
    """(words' begins, ends, first word of each text, [(width, positions, hashes)]) of shingles that pass."""
    starts, ends, first, h = _words(packed)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found = []
    for k in widths:
        grams = shingles(h, k)
        at = np.flatnonzero(passes(grams))
        at = at[doc[at] == doc[at + k - 1]] if len(at) else at
        found.append((k, at, grams[at]))
    return starts, ends, first, doc, found


def _counts(widths: list[int], shared):
    schema = pa.schema([("hash", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for _, texts in pieces(batches, "text"):
            for _, _, h in _passing(Packed(texts), widths, shared.value)[-1]:
                values, n = np.unique(h, return_counts=True)
                yield batch_of(schema, values.view(np.int64), n)

    return run


CANDIDATES = "row long, doc_id long, text_hash long, n_words long, hash long, at long, before long, context string"


def _candidates(widths: list[int], size: int, shared):
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("hash", pa.int64()), ("at", pa.int64()), ("before", pa.int64()), ("context", pa.string())])

    def run(batches):
        for batch, texts in pieces(batches, "text"):
            packed = Packed(texts)
            starts, ends, first, doc, found = _passing(packed, widths, shared.value)
            n = np.diff(first)
            where, hashes, own, before, context = [np.flatnonzero(n >= 0)], [], [], [], []
            blank = len(n)
            for k, at, h in found:
                d = doc[at]
                lo, hi = np.maximum(first[d], at - (size - k)), np.minimum(first[d + 1], at + size)
                where.append(d)
                hashes += h.view(np.int64).tolist()
                own += (at - first[d]).tolist()
                before += (at - lo).tolist()
                context += [b" ".join(packed.bytes[a:b] for a, b in zip(starts[x:y], ends[x:y], strict=True)).decode("utf-8", "replace") for x, y in zip(lo, hi, strict=True)]
            d = np.concatenate(where)
            none = [None] * blank  # a row for each document, whether or not it has candidates
            yield batch_of(schema, *[batch.column(i).take(pa.array(d)) for i in range(3)], n[d], none + hashes, none + own, none + before, none + context)

    return run


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, size: int = 10, filter_bits: int = 1 << 24, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, n_hit, n_items, items (their ids), contaminated.

    Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. Windows are `size`
    consecutive words of an item; a shorter item is one window. Every document word inside any occurrence of
    a window is hit. Null and empty texts have no words; items without words are ignored; equal items are all
    reported, those without an id only by their hits; repeated document rows each get their row; a text of any length
    is one row's work; an empty benchmark hits nothing, an empty table gives no rows. Only doc_id, text and item_id,
    text are read, so other columns never clash.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "decontaminate")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    own = items.mapInArrow(_windows(size), "item_id string, words string, n_words long, shingle_hashes array<long>")
    windows = scratch.write(own.groupBy("words", "n_words").agg(F.any_value("shingle_hashes").alias("shingle_hashes"), F.collect_set("item_id").alias("item_ids")), "windows")
    widths = sorted({min(WIDTH, r[0]) for r in windows.select("n_words").distinct().collect()})  # at most `size` rows
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")

    # Rarity: how often each shingle of the benchmark occurs in all documents. None at all: no occurrence.
    placed = windows.select("words", F.posexplode("shingle_hashes").alias("offset", "hash"))
    everything = spark.sparkContext.broadcast(_Filter(placed.select("hash").distinct(), filter_bits))
    counted = source.select("text").mapInArrow(_counts(widths, everything), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    prefixes = placed.join(counted, "hash").groupBy("words").agg(F.min(F.struct("n", "hash", "offset")).alias("prefix"))
    prefixes = windows.join(prefixes, "words").select("words", F.col("n_words").alias("length"), "item_ids", "prefix.hash", F.col("prefix.offset").cast("long").alias("offset"))
    prefixes = scratch.write(prefixes, "prefixes")

    rare = spark.sparkContext.broadcast(_Filter(prefixes.select("hash").distinct(), filter_bits))
    scratch.drop_but("prefixes")
    rows = source.mapInArrow(_candidates(widths, size, rare), CANDIDATES)
    # Documents without candidates take a key of their own, so that no null key gathers them in one task.
    rows = rows.withColumn("key", F.coalesce("hash", F.xxhash64("row")))
    joined = rows.join(prefixes.withColumnRenamed("hash", "key"), "key", "left")
    begin = F.col("at") - F.col("offset")
    inside = (begin >= 0) & (F.col("before") >= F.col("offset")) & (begin + F.col("length") <= F.col("n_words"))
    here = F.array_join(F.slice(F.split("context", " "), F.greatest(F.col("before") - F.col("offset"), F.lit(0)).cast("int") + 1, F.col("length").cast("int")), " ")
    hit = F.col("hash").isNotNull() & inside & (here == F.col("words"))
    spans = F.collect_set(F.when(hit, F.struct(begin.alias("begin"), (begin + F.col("length")).alias("end"))))
    docs_hit = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("text_hash").alias("text_hash"), F.max("n_words").alias("n_words"), F.sort_array(spans).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(hit, F.col("item_ids")))))).alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["end"], x["begin"]))).alias("n"), F.greatest(s["end"], x["end"]).alias("end")),
        lambda s: s["n"],
    )
    out = docs_hit.select("doc_id", "text_hash", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items")
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The documents that hold no window of the benchmark, in their own columns.

    A row goes by its doc_id and text, so another text of its doc_id, a null one included, stays; rows that repeat go
    or stay together. With an empty benchmark all stay; null and empty texts always do; an empty table stays empty;
    texts of any length are read whole; other columns may have any name.
    """
    scratch = Scratch(docs.sparkSession, "drop-contaminated")
    bad = contaminated_documents(docs, benchmark, size, scratch=scratch).where("contaminated").select(F.col("doc_id").alias("__bad_id"), F.col("text_hash").alias("__bad_hash"))
    bad = scratch.write(bad.distinct(), "bad")
    scratch.drop_but("bad")
    bad = sized_broadcast(bad, bad.count(), 24)
    same = docs["doc_id"].cast("long").eqNullSafe(bad["__bad_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["__bad_hash"])
    return docs.join(bad, same, "left_anti")
