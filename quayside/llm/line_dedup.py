"""Line deduplication against a sharded minimal perfect hash of all distinct lines.

Each shard holds, for its lines, the perfect hash and two flat arrays in slot order: fingerprints and document
counts. Documents probe those arrays; lines themselves are never joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import perfect_hash
from .common import Packed, Scratch, batch_of, file_system, mix, pieces, sized_broadcast

#: Distinct lines in a shard, about; what one task builds at a time.
SHARD_LINES = 1_000_000
#: An index up to this size is read whole by each worker; a larger one stays in its shards and probes travel to them.
BROADCAST_BYTES = 64 << 20
#: Probes of a shard that one task answers, about; a shard with more of them, as of a very frequent line, is copied.
TASK_PROBES = 2_000_000

INDEX = "shard long, n_lines long, level_sizes array<long>, words binary, ranks binary, fingerprints binary, counts binary, count_bytes int"
INDEX_ARROW = pa.schema([("shard", pa.int64()), ("n_lines", pa.int64()), ("level_sizes", pa.list_(pa.int64())), ("words", pa.binary()), ("ranks", pa.binary()), ("fingerprints", pa.binary()), ("counts", pa.binary()), ("count_bytes", pa.int32())])

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Lines:
    """The lines of several texts: hashes of their keys, and the first line of each text (and the count)."""

    def __init__(self, texts: list[bytes | None]):
        packed = Packed(texts)
        ends = np.flatnonzero(packed.buf[: packed.first[-1]] == 10)
        starts, ends = ends[:-1] + 1, ends[1:]
        solid = np.flatnonzero(~_SPACE[packed.buf])
        lo, hi = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
        self.keyed = lo < hi  # lines with something besides white space
        solid = np.append(solid, 0)
        a, b = np.where(self.keyed, solid[lo], starts), np.where(self.keyed, solid[hi - 1] + 1, starts)
        self.h1, self.h2 = packed.hashes(a, b, 1), packed.hashes(a, b, 2)
        self.first = np.searchsorted(starts, packed.first)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def distinct(self) -> np.ndarray:
        """One line of each key of each text."""
        at = np.flatnonzero(self.keyed)
        order = at[np.lexsort((self.h2[at], self.h1[at], self.doc[at]))]
        if not len(order):
            return order
        d, x, y = self.doc[order], self.h1[order], self.h2[order]
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        return order[new]


def _tally(batches):
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64())])
    for _, texts in pieces(batches, "text", 4 << 20):
        lines = Lines(texts)
        at = lines.distinct()
        pairs = np.stack([lines.h1[at], lines.h2[at]], axis=1) if len(at) else np.empty((0, 2), dtype=np.uint64)
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        pairs = pairs[order]
        new = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)])) if len(pairs) else np.empty(0, dtype=np.int64)
        n = np.diff(np.append(new, len(pairs)))
        yield batch_of(schema, pairs[new, 0].view(np.int64), pairs[new, 1].view(np.int64), n)


def _fingerprint(h2: np.ndarray) -> np.ndarray:
    return (mix(h2) >> np.uint64(32)).astype(np.uint32)


def _shard_rows(batches):
    """Builds a shard from its run of rows; rows come sorted by shard."""

    def built(shard: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(parts)
        h1, h2, n = rows[:, 0].copy().view(np.uint64), rows[:, 1].copy().view(np.uint64), rows[:, 2]
        sizes, words = perfect_hash.build(h1, h2)
        ranks = perfect_hash.directory(words)
        at = perfect_hash.slots(sizes, words, ranks, h1, h2)
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if n.max() <= np.iinfo(k).max)
        prints, counts = np.zeros(len(n), dtype=np.uint32), np.zeros(len(n), dtype=kind)
        prints[at], counts[at] = _fingerprint(h2), n
        return batch_of(INDEX_ARROW, [shard], [len(n)], [sizes], [words.tobytes()], [ranks.tobytes()], [prints.tobytes()], [counts.tobytes()], [counts.itemsize])

    shard, parts = None, []
    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
        cut = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
        for part in np.split(rows, cut):
            if not len(part):
                continue
            if parts and part[0, 0] != shard:
                yield built(shard, parts)
                parts = []
            shard = int(part[0, 0])
            parts.append(part[:, 1:])
    if parts:
        yield built(shard, parts)


class Shard:
    """A shard's arrays, as read back."""

    def __init__(self, row):
        self.sizes = list(row["level_sizes"])
        self.words, self.ranks = np.frombuffer(row["words"], "<u8"), np.frombuffer(row["ranks"], np.uint32)
        self.prints = np.frombuffer(row["fingerprints"], np.uint32)
        self.n = np.frombuffer(row["counts"], np.dtype(f"<u{row['count_bytes']}"))

    def counts(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Documents with each line; 0 for lines that the index does not hold."""
        at = perfect_hash.slots(self.sizes, self.words, self.ranks, h1, h2)
        ok = at >= 0
        ok[ok] = self.prints[at[ok]] == _fingerprint(h2[ok])
        out = np.zeros(len(h1), dtype=np.int64)
        out[ok] = self.n[at[ok]]
        return out


def _rewritten(texts: list[bytes | None], lines: Lines, drop: np.ndarray):
    kept, n = [], np.diff(lines.first)
    dropped = np.add.reduceat(drop.astype(np.int64), lines.first[:-1]) if len(texts) else n
    for i, t in enumerate(texts):
        if dropped[i]:
            own = drop[lines.first[i] : lines.first[i + 1]]
            t = b"\n".join(x for x, d in zip(t.split(b"\n"), own, strict=True) if not d)
        kept.append((t or b"").decode("utf-8", "replace"))
    return kept, n, dropped


def _out_schema(id_type):
    return pa.schema([("doc_id", id_type), ("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])


_read: dict[str, dict[int, Shard]] = {}


def _shards_at(folder: str) -> dict[int, Shard]:
    """The worker's own copy of an index table in the shared folder; one at a time."""
    if folder not in _read:
        _read.clear()
        store, name = file_system(folder)
        names = [f.path for f in store.get_file_info(fs.FileSelector(name)) if f.path.endswith(".parquet")]
        rows = [r for x in sorted(names) for r in pq.read_table(x, filesystem=store).to_pylist()]
        _read[folder] = {r["shard"]: Shard(r) for r in rows}
    return _read[folder]


def _rewrite_here(folder: str, n_shards: int, min_documents: int):
    schema = _out_schema(pa.int64())

    def run(batches):
        held = _shards_at(folder)
        for batch, texts in pieces(batches, "text", 4 << 20):
            lines = Lines(texts)
            where = (lines.h1 % np.uint64(n_shards)).astype(np.int64)
            drop = np.zeros(len(lines.h1), dtype=bool)
            order = np.flatnonzero(lines.keyed)
            order = order[np.argsort(where[order], kind="stable")]
            for part in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
                if len(part):
                    drop[part] = held[int(where[part[0]])].counts(lines.h1[part], lines.h2[part]) >= min_documents
            yield batch_of(schema, batch.column(0), *_rewritten(texts, lines, drop))

    return run


def _probes(n_shards: int):
    schema = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def run(batches):
        for batch, texts in pieces(batches, "text", 4 << 20):
            lines = Lines(texts)
            at = lines.distinct()
            yield batch_of(schema, (lines.h1[at] % np.uint64(n_shards)).astype(np.int64), batch.column(0).take(pa.array(lines.doc[at])), lines.h1[at].view(np.int64), lines.h2[at].view(np.int64))

    return run


def _probe_shards(min_documents: int):
    """Rows come sorted: a shard's arrays, then its probes in Arrow batches of any number."""
    schema = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64())])

    def run(batches):
        shard = None
        for batch in batches:
            is_index = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
            cuts = [0, *np.flatnonzero(is_index).tolist(), len(is_index)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b and is_index[a]:
                    shard, a = Shard(batch.column(4)[a].as_py()), a + 1
                if a < b:
                    part = batch.slice(a, b - a)
                    h1, h2 = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
                    hit = np.flatnonzero(shard.counts(h1.view(np.uint64), h2.view(np.uint64)) >= min_documents)
                    yield batch_of(schema, part.column(1).take(pa.array(hit)), h1[hit])

    return run


def _rewrite_flagged(batches):
    schema = _out_schema(pa.int64())
    for batch, texts in pieces(batches, "text", 4 << 20):
        lines = Lines(texts)
        flagged = batch.column(2)
        flat = flagged.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        n = np.array([len(x) if x.is_valid else 0 for x in flagged])
        # A flagged line counts for its own document only.
        own = np.repeat(np.arange(len(n)), n).astype(np.uint64)
        drop = np.isin(mix(lines.h1 ^ mix(lines.doc.astype(np.uint64))), mix(flat ^ mix(own))) & lines.keyed
        yield batch_of(schema, batch.column(0), *_rewritten(texts, lines, drop))


def line_index(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """The sharded index over all distinct lines of all documents, the probes that each shard will get, and the number of shards."""
    tally = docs.select("text").mapInArrow(_tally, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    tally = scratch.write(tally, "tally")
    n_shards = max(1, -(-tally.count() // SHARD_LINES))
    # The remainder of the unsigned value, as numpy takes it.
    shard = F.pmod(F.pmod(F.shiftrightunsigned("h1", 1), F.lit(n_shards)) * 2 + F.col("h1").bitwiseAND(F.lit(1)), F.lit(n_shards))
    rows = tally.select(shard.alias("shard"), "h1", "h2", "n")
    probes = scratch.write(rows.groupBy("shard").agg(F.sum("n").alias("probes")), "probes")
    # A shard's number is its partition, so that each task builds one.
    rows = rows.repartitionById(n_shards, F.col("shard").cast("int")).sortWithinPartitions("shard")
    index = scratch.write(rows.mapInArrow(_shard_rows, INDEX), "index")
    scratch.drop("tally")
    return index, probes, n_shards


def drop_frequent_lines(docs: DataFrame, min_documents: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: doc_id, text without the lines found in `min_documents` documents or more, n_lines, n_dropped.

    Texts are split at \\n; a null or empty text is one empty line; a text of any length is one row's work. A line's
    key is the line without ASCII white space at its ends, A-Z lower-cased; lines with an empty key stay. Repeats within
    a document count once, every row is a document, repeated rows too. Kept lines are unchanged, joined by \\n. Only
    doc_id and text are read, so other columns may have any name. An empty table gives no rows.

    The index never passes through the driver: workers read a small one from the shared folder; the probes of a larger
    one go to its shards, as many copies of each as its probes need, so a line of all documents loads no single task.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index, sizes, n_shards = line_index(source, scratch)
    size = index.agg(F.sum(F.length("words") + F.length("ranks") + F.length("fingerprints") + F.length("counts"))).first()[0] or 0
    out = "doc_id long, text string, n_lines long, n_dropped long"
    if size <= broadcast_bytes:
        scratch.drop_but("index")
        return source.mapInArrow(_rewrite_here(scratch.qualified("index"), n_shards, min_documents), out)
    copies = F.ceil(F.col("probes") / TASK_PROBES)
    first = F.coalesce(F.sum(copies).over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a shard
    places = scratch.write(sizes.select("shard", copies.alias("copies"), first.alias("first")), "places")
    n_places = places.agg(F.sum("copies")).first()[0] or 1
    places = sized_broadcast(places, n_shards, 24)
    probes = source.mapInArrow(_probes(n_shards), "shard long, doc_id long, h1 long, h2 long").join(places, "shard")
    probes = probes.select((F.col("first") + F.pmod(F.xxhash64("doc_id", "h1"), "copies")).cast("int").alias("place"), "doc_id", "h1", "h2", F.lit(None).cast(index.schema).alias("arrays"))
    none = F.lit(None).cast("long")
    held = index.join(places, "shard").select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)).alias("place"), F.struct(*index.columns).alias("arrays"))
    held = held.select(F.col("place").cast("int").alias("place"), none.alias("doc_id"), none.alias("h1"), none.alias("h2"), "arrays")
    routed = held.unionByName(probes).repartitionById(n_places, "place").sortWithinPartitions("place", F.col("arrays").isNull())
    hits = routed.select("place", "doc_id", "h1", "h2", "arrays").mapInArrow(_probe_shards(min_documents), "doc_id long, h1 long")
    flagged = scratch.write(hits.groupBy("doc_id").agg(F.collect_set("h1").alias("flagged")), "flagged")
    scratch.drop_but("flagged")
    joined = source.join(flagged, source["doc_id"].eqNullSafe(flagged["doc_id"]), "left").select(source["doc_id"], "text", "flagged")
    return joined.mapInArrow(_rewrite_flagged, out)
