"""MinHash near-duplicate groups with tensored banding.

Two small collections of partial keys are computed per document, `m` in each, every partial key from
`rows` minhashes. Table (i, j) is keyed by partial key i of the first collection with j of the second, so
2 * m * rows minhashes serve m * m tables of 2 * rows minhashes. Candidates are verified on full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, Packed, Scratch, batch_of, int_lists, mix, pieces, shingles, sized_broadcast
from .components import components

#: Shingles that a block of contested documents holds, about.
BLOCK_SHINGLES = 500_000
#: Table keys that a task forms at a time, about.
KEYS_A_TASK = 1_000_000


def document_sets(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, flat, and each text's bounds in them."""
    packed = Packed(texts)
    starts, ends, first = packed.words(SPACED)
    h = packed.hashes(starts, ends)
    sets = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = b - a
        sets.append(np.unique(shingles(h[a:b], min(width, n))) if n else h[:0])
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    return (np.concatenate(sets) if sets else h[:0]), bounds


def _minhashes(flat: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """[count, documents with shingles]; bounds must have no empty rows."""
    a = mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    b = mix(a) | np.uint64(1)
    out = np.empty((count, len(bounds) - 1), dtype=np.uint64)
    for i in range(count):
        out[i] = np.minimum.reduceat((flat ^ a[i]) * b[i], bounds[:-1])
    return out


def _signatures(id_type: pa.DataType, width: int, m: int, rows: int):
    """Partial keys have 63 bits of hash; the lowest bit says which collection they belong to."""
    schema = pa.schema([("doc_id", id_type), ("n_shingles", pa.int64()), ("set_sum", pa.int64()), ("set_xor", pa.int64()), ("parts", pa.list_(pa.int64()))])

    def run(batches):
        for batch, texts in pieces(batches, "text"):
            flat, bounds = document_sets(texts, width)
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            parts = np.zeros((2 * m, len(n)), dtype=np.uint64)
            sums, xors = np.zeros(len(n), dtype=np.uint64), np.zeros(len(n), dtype=np.uint64)
            if len(full):
                at = bounds[:-1][full]
                sums[full] = np.add.reduceat(mix(flat), at)
                xors[full] = np.bitwise_xor.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), at)
                hashes = _minhashes(flat, np.append(at, len(flat)), 2 * m * rows)
                for t in range(2 * m):
                    h = np.full(len(full), np.uint64(t + 1), dtype=np.uint64)
                    for r in range(rows):
                        h = mix(h * np.uint64(0x9E3779B97F4A7C15) ^ hashes[t * rows + r])
                    parts[t, full] = h >> np.uint64(1) << np.uint64(1) | np.uint64(t >= m)
            per = np.arange(len(n) + 1) * 2 * m
            yield batch_of(schema, batch.column(0), n, sums.view(np.int64), xors.view(np.int64), int_lists(np.ascontiguousarray(parts.T).ravel(), per))

    return run


def _sets(id_type: pa.DataType, width: int):
    schema = pa.schema([("doc_id", id_type), ("shingle_set", pa.list_(pa.int64()))])

    def run(batches):
        for batch, texts in pieces(batches, "text"):
            flat, bounds = document_sets(texts, width)
            yield batch_of(schema, batch.column(0), int_lists(flat, bounds))

    return run


def _block_links(percent: int):
    """Links between components of two blocks, one for every two that they join."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        label, right = table.column("label").to_numpy(), table.column("right").to_numpy(zero_copy_only=False).astype(bool)
        lists = table.column("shingle_set").combine_chunks()
        n = np.diff(lists.offsets.to_numpy())
        values, flat = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        begin = np.concatenate([[0], np.cumsum(n)])
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        held = np.zeros(len(values), dtype=bool)
        sides = [np.flatnonzero(~right), np.flatnonzero(right)]
        if table.column("pair").chunk(0)[0].as_py()["within"]:
            sides[1] = sides[0]
        # The commonest component needs no probes of its own: what differs from it probes both sides.
        names, counts = np.unique(label, return_counts=True)
        main = names[counts.argmax()]
        for one, two in (sides, sides[::-1]) if sides[0] is not sides[1] else (sides,):
            if not len(two):
                continue
            two = two[np.argsort(n[two], kind="stable")]
            ends = np.cumsum(n[two])
            begins = np.append(0, ends[:-1])
            row = np.repeat(begin[two] - begins, n[two]) + np.arange(ends[-1])
            other, sizes = flat[row], n[two]
            present = np.zeros(len(values), dtype=bool)
            present[other] = True
            for i in one[label[one] != main]:
                own = flat[begin[i] : begin[i + 1]]
                # |A & B| is at most what A shares with the whole block, and links need percent / (100 + percent) * (|A| + |B|).
                most = int(present[own].sum())
                lo, hi = np.searchsorted(sizes, -(-percent * n[i] // 100)), np.searchsorted(sizes, min(100 * n[i] // percent, (100 + percent) * most // percent - n[i]), side="right")
                if most * 100 < percent * n[i] or lo >= hi:
                    continue
                held[own] = True
                both = np.add.reduceat(held[other[begins[lo] : ends[hi - 1]]].astype(np.int64), begins[lo:hi] - begins[lo])
                held[own] = False
                for j in two[lo:hi][100 * both >= percent * (n[i] + sizes[lo:hi] - both)]:
                    p, q = top(int(label[i])), top(int(label[j]))
                    if p != q:
                        root[max(p, q)] = min(p, q)
        return pa.table([pa.array(list(root), pa.int64()), pa.array(list(root.values()), pa.int64())], schema=schema)

    return run


def collection_size(percent: int, rows: int, miss: float = 2e-4) -> int:
    """The fewest partial keys in a collection with which two documents at the threshold miss all tables this rarely."""
    m = 1
    while 1 - (1 - (1 - (percent / 100) ** rows) ** m) ** 2 > miss:
        m += 1
    return m


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, rows: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept.

    Documents are linked when 100 * |A & B| >= percent * |A | B| for their sets of `width`-word shingles
    (fewer words: the whole sequence is one). Words are split at ASCII white space, A-Z lower-cased.

    1. Equal sets collapse to their smallest doc_id.
    2. Two documents share a table if they share a partial key in both collections; so only partial keys that some
       other document has as well are combined into table keys.
    3. A document is tested against the smallest doc_id that it shares a bucket with: one candidate a document.
    4. A bucket whose documents are still in several components offers one candidate for each of them, against
       its least component; candidates of the same two components are one. This goes on while it joins components.
    5. What is in buckets of several components even then is compared exhaustively within each cluster of such
       components, in blocks of bounded size: only documents outside a cluster's largest component are probes, sizes
       too unlike are skipped, and a block pair returns at most one link for every two components it joins.

    Two documents at the threshold meet in a bucket with a probability of 0.9998 at least: 10 partial keys in each
    collection at 85 percent, 13 at 80. Whatever shares a bucket and is linked ends in one component.
    Null or empty texts have no shingles and stay alone; texts of any length are one row's work. Repeated doc_ids share
    one component, whatever their texts, and each keeps its row. A null doc_id is its own row with null component_id
    and kept true. An empty table gives no rows. Other columns, clashing names included, are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "near-dedup")
    m = collection_size(percent, rows)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = scratch.write(source.mapInArrow(_signatures(pa.int64(), width, m, rows), "doc_id long, n_shingles long, set_sum long, set_xor long, parts array<long>"), "signatures")
    known = sig.where("n_shingles > 0 and doc_id is not null")
    same = ["n_shingles", "set_sum", "set_xor"]
    copies = scratch.write(known.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last").drop("last"), "copies")
    member = known.join(sized_broadcast(copies, copies.count(), 32), same, "left").withColumn("rep", F.coalesce("rep", "doc_id"))

    parts = scratch.write(member.where("doc_id = rep").select("doc_id", "parts"), "reps")
    buckets = scratch.write(_buckets(parts, m, scratch), "buckets")
    sets = _sets_of(source, buckets.select("doc_id").distinct(), width, scratch)
    first = buckets.groupBy(F.col("doc_id").alias("a")).agg(F.min("least").alias("b")).where("b < a")
    links = scratch.write(_linked(first, sets, percent), "links")
    # A doc_id that comes with several texts ties their classes together.
    several = member.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("doc_id")
    tied = scratch.write(member.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct(), "tied")
    labels = components(links.union(tied), scratch, "first")
    labels = _joined_up(buckets.select("key", "doc_id"), labels, sets, percent, scratch)

    labels = scratch.write(labels.toDF("rep", "component_id"), "final")
    scratch.drop_but("signatures", "copies", "final")
    member = member.select("doc_id", "rep").join(labels, "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component_id", "rep")).alias("component_id"))
    lone = F.when(F.col("doc_id").isNotNull(), F.col("doc_id"))
    out = sig.select("doc_id", "n_shingles").join(member, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", lone).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _buckets(parts: DataFrame, m: int, scratch: Scratch) -> DataFrame:
    """(key, doc_id, least): tables' buckets of more than one document, and the smallest doc_id in them."""
    one = parts.select("doc_id", F.explode("parts").alias("part"))
    live = one.groupBy("part").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("part")
    held = scratch.write(one.join(live, "part").groupBy("doc_id").agg(F.collect_set("part").alias("parts")), "live")
    # Rows are short here and become many: m * m keys each, at most.
    n = max(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), held.count() * m * m // KEYS_A_TASK)
    second = lambda x: F.pmod(x, F.lit(2)) == 1
    both = F.transform(F.filter("parts", lambda x: ~second(x)), lambda x: F.transform(F.filter("parts", second), lambda y: F.xxhash64(x, y)))
    keys = held.repartition(n).select("doc_id", F.explode(F.flatten(both)).alias("key"))
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least < last").select("key", "least")
    return keys.join(shared, "key").select("key", "doc_id", "least")


def _sets_of(source: DataFrame, ids: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(doc_id, shingle_set) of the documents named, each different set of a doc_id once."""
    ids = scratch.write(ids, "ids")
    wanted = source.where("text is not null").join(sized_broadcast(ids, ids.count(), 16), "doc_id", "left_semi")
    found = wanted.mapInArrow(_sets(pa.int64(), width), "doc_id long, shingle_set array<long>").where(F.size("shingle_set") > 0)
    found = scratch.write(found, "all-sets")
    again = scratch.write(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    n = again.count()
    if not n:
        return found
    again = sized_broadcast(again, n, 16)
    return scratch.write(found.join(again, "doc_id", "left_anti").union(found.join(again, "doc_id", "left_semi").distinct()), "sets")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, ...), those whose full sets are similar enough."""
    a = sets.select(F.col("doc_id").alias("a"), F.col("shingle_set").alias("set_a"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("shingle_set").alias("set_b"))
    na, nb = F.size("set_a"), F.size("set_b")
    both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    fits = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    return pairs.join(a, "a").join(b, "b").where(fits).where(100 * both >= percent * (na + nb - both)).select(*pairs.columns)


def _joined_up(buckets: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """labels (id, component) with all links found between components that share a bucket."""
    k = 0
    while True:
        small = sized_broadcast(labels, labels.count(), 16).toDF("doc_id", "component")
        named = buckets.join(small, "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("label"))
        named = scratch.write(named, f"named-{k}")
        open_ = named.groupBy("key").agg(F.min("label").alias("lead"), F.max("label").alias("last")).where("lead < last").select("key", "lead")
        open_ = scratch.write(open_, f"open-{k}")
        n = open_.count()
        if not n:
            return labels
        buckets = scratch.write(named.join(sized_broadcast(open_, n, 16), "key"), f"buckets-{k}")
        scratch.drop(f"named-{k}", f"open-{k}", f"buckets-{k - 1}")
        asked, found = _one_round(buckets, sets, percent, scratch, k)
        joined = found.count()
        if joined:
            labels = _renamed(labels, components(found, scratch, f"round-{k}"), scratch, f"labels-{k}")
        # Once few candidates join anything, the rest is left to the comparison in blocks.
        if 20 * joined < asked:
            break
        buckets = buckets.select("key", "doc_id")
        k += 1
    small = sized_broadcast(labels, labels.count(), 16).toDF("doc_id", "component")
    named = scratch.write(buckets.select("key", "doc_id").join(small, "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("label")), "named")
    links = scratch.write(_contested_links(named, sets, percent, scratch), "block-links")
    return _renamed(labels, components(links, scratch, "blocks"), scratch, "labels")


def _one_round(buckets: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, k: int) -> tuple[int, DataFrame]:
    """The number of candidates, and the links that they give between components (a, b)."""
    draw = F.xxhash64(F.lit(k), "doc_id")
    chosen = buckets.groupBy("key", "label").agg(F.min_by("doc_id", draw).alias("doc_id"), F.min("lead").alias("lead"))
    leads = chosen.where("label = lead").select("key", F.col("doc_id").alias("b"))
    met = chosen.where("label <> lead").join(leads, "key").groupBy("label", "lead").agg(F.min_by(F.struct(F.col("doc_id").alias("a"), "b"), F.xxhash64(F.lit(k), "doc_id", "b")).alias("pair"))
    met = scratch.write(met.select("pair.a", "pair.b", "label", "lead"), f"asked-{k}")
    found = _linked(met, sets, percent).select(F.col("label").alias("a"), F.col("lead").alias("b")).distinct()
    return met.count(), scratch.write(found, f"joined-{k}")


def _renamed(labels: DataFrame, found: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """labels with each component replaced by the one that it joined; components that had no row get one."""
    found = sized_broadcast(found, found.count(), 16)
    old = labels.join(found.toDF("component", "now"), "component", "left").select("id", F.coalesce("now", "component").alias("component"))
    new = found.toDF("id", "component").join(labels.select("id"), "id", "left_anti")
    return scratch.write(old.unionByName(new), name)


def _contested_links(named: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links between components that share a bucket, found in blocks."""
    lead = named.groupBy("key").agg(F.min("label").alias("lead"), F.max("label").alias("last")).where("lead < last").select("key", "lead")
    open_ = scratch.write(named.join(lead, "key"), "open")
    clusters = components(open_.groupBy(F.col("label").alias("a"), F.col("lead").alias("b")).agg(F.lit(1)), scratch, "clusters")
    members = scratch.write(open_.groupBy("doc_id", "label").agg(F.lit(1)).select("doc_id", "label"), "open-members")
    members = members.join(sized_broadcast(clusters, clusters.count(), 16).toDF("label", "cluster"), "label")
    members = scratch.write(members, "members")
    largest = members.groupBy("cluster", "label").count().groupBy("cluster").agg(F.max_by("label", "count").alias("main"))
    largest = scratch.write(largest, "largest")
    # Two linked sizes differ by less than a band, so only equal and neighbouring bands are compared.
    band = F.floor(F.log(F.size("shingle_set")) / F.log(F.lit(100.5 / percent))).cast("int")
    rows = members.join(sized_broadcast(largest, largest.count(), 16), "cluster").join(sets, "doc_id")
    rows = scratch.write(rows.select("cluster", "doc_id", "label", (F.col("label") == F.col("main")).alias("main"), "shingle_set", band.alias("band")), "contested")
    place = ["cluster", "band", "main"]
    sizes = scratch.write(rows.groupBy(*place).agg(F.ceil(F.sum(F.size("shingle_set")) / BLOCK_SHINGLES).alias("n_blocks")), "sizes")
    rows = scratch.write(rows.join(sized_broadcast(sizes, sizes.count(), 32), place).withColumn("block", F.pmod(F.xxhash64("doc_id"), "n_blocks")), "blocked")
    blocks = sizes.select(*place, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))
    other = blocks.toDF("cluster", "band_r", "main_r", "block_r")
    later = "band_r = band + 1 or (band_r = band and (not main or main_r) and (main <> main_r or block_r >= block))"
    pairs = blocks.join(other, "cluster").where("not (main and main_r)").where(later)
    pairs = scratch.write(pairs.withColumn("within", F.expr("band_r = band and main_r = main and block_r = block")), "block-pairs")
    pair = F.struct("cluster", "band", "main", "block", "band_r", "main_r", "block_r", "within").alias("pair")
    left = rows.join(pairs, [*place, "block"]).select(pair, "label", "shingle_set", F.lit(False).alias("right"))
    theirs = rows.select("cluster", F.col("band").alias("band_r"), F.col("main").alias("main_r"), F.col("block").alias("block_r"), "label", "shingle_set")
    right = theirs.join(pairs.where("not within"), ["cluster", "band_r", "main_r", "block_r"]).select(pair, "label", "shingle_set", F.lit(True).alias("right"))
    return left.unionByName(right).groupBy("pair").applyInArrow(_block_links(percent), "a long, b long")


def keep_one(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """The documents with one of each near-duplicate group, the smallest doc_id, in their own columns.

    A doc_id with several texts is several documents, each judged by its own text; beside equal texts under other ids they
    come last, by the hash of their text. Of rows with one doc_id and one text one stays, that of the smallest hash of all
    its columns (maps aside). Rows with a null doc_id stay, as do null and empty texts, which are one text here. Texts of
    any length are compared whole; an empty table stays empty; other columns may have any name.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    key = next(n for n in (f"_key{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    rows = _keyed(docs, key, scratch)
    inner = Scratch(docs.sparkSession, "near-dedup")
    found = near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), percent, width, scratch=inner)
    found = scratch.write(found.select("doc_id", "kept"), "found")
    inner.drop()
    # Usually far fewer than the documents, so that texts need not move.
    out = scratch.write(found.where("not kept").select("doc_id").distinct(), "out")
    left = rows.join(sized_broadcast(out, out.count(), 16), rows[key] == out["doc_id"], "left_anti")
    again = scratch.write(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    scratch.drop_but("out", "again", "several", "placed")
    n = again.count()
    if not n:
        return left.drop(key)
    again = sized_broadcast(again, n, 16)
    same = left[key] == again["doc_id"]
    hashed = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind])
    one = left.join(again, same, "left_semi").groupBy(key).agg(F.min_by(F.struct(*docs.columns), hashed).alias("row")).select("row.*")
    return left.join(again, same, "left_anti").drop(key).unionByName(one)


def _keyed(docs: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """docs with a number for each (doc_id, text): the doc_id itself, but beyond all of them where an id has several texts."""
    own, text = F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit("")))
    texts = docs.select(own.alias("id"), text.alias("hash")).where("id is not null")
    several = scratch.write(texts.groupBy("id").agg(F.min("hash").alias("lo"), F.max("hash").alias("hi")).where("lo < hi").select("id"), "several")
    n = several.count()
    if not n:
        return docs.withColumn(key, own)
    top = texts.agg(F.max("id")).first()[0]
    # In the order of (doc_id, hash), so that a run that repeats gives the same numbers.
    placed = texts.join(sized_broadcast(several, n, 24), "id", "left_semi").distinct().orderBy("id", "hash")
    placed = scratch.write(placed.withColumn("number", F.monotonically_increasing_id() + F.lit(top + 1)), "placed")
    same = (docs["doc_id"].cast("long") == placed["id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == placed["hash"])
    both = docs.join(sized_broadcast(placed, placed.count(), 32), same, "left")
    return both.select(*[docs[c] for c in docs.columns], F.coalesce(placed["number"], docs["doc_id"].cast("long")).alias(key))
