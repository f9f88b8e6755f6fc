"""Approximate nearest neighbours: one small-world graph per shard of vectors, results of all shards merged."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph_index
from .common import Scratch, batch_of

#: Distinct vectors in a shard, about: at least, and where the table is large.
SHARD_VECTORS, MOST_SHARD_VECTORS = 12_500, 250_000
#: Queries that are searched at a time.
QUERY_BLOCK = 256

INDEX = "dim long, shard long, ids binary, vectors binary, layer_sizes array<long>, links array<binary>"
_INDEX_ARROW = pa.schema([("dim", pa.int64()), ("shard", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("layer_sizes", pa.list_(pa.int64())), ("links", pa.list_(pa.binary()))])
_FOUND = pa.schema([("query_id", pa.int64()), ("rep", pa.int64()), ("score", pa.float64())])


def _build(batches):
    """Rows come sorted by (dim, shard)."""

    def built(dim: int, shard: int, parts: list) -> pa.RecordBatch:
        ids, x = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.random.default_rng(shard + 1).permutation(np.argsort(ids))
        ids, x = ids[order], np.ascontiguousarray(x[order])
        layers = graph_index.build(x.astype(np.float32))
        return batch_of(_INDEX_ARROW, [dim], [shard], [ids.tobytes()], [x.tobytes()], [[len(a) for a in layers]], [[a.astype(np.int32).tobytes() for a in layers]])

    key, parts = None, []
    for batch in batches:
        dims, shards, ids = (batch.column(i).to_numpy() for i in range(3))
        both = np.stack([dims, shards], axis=1)
        for part in np.split(np.arange(len(ids)), np.flatnonzero((both[1:] != both[:-1]).any(axis=1)) + 1):
            if not len(part):
                continue
            own = (int(dims[part[0]]), int(shards[part[0]]))
            if parts and own != key:
                yield built(*key, parts)
                parts = []
            key = own
            x = batch.column(3).slice(part[0], len(part)).flatten().to_numpy(zero_copy_only=False)
            parts.append((ids[part], x.reshape(len(part), own[0]).astype(np.float64)))
    if parts:
        yield built(*key, parts)


def _search(k: int):
    """A shard's arrays come first, then blocks of queries. Graphs are walked in single precision, scores are exact."""

    def run(batches):
        at_hand = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["arrays"] is not None:
                    a, at_hand = row["arrays"], (row["dim"], row["shard"])
                    ids, own = np.frombuffer(a["ids"], np.int64), np.frombuffer(a["vectors"], np.float64).reshape(-1, row["dim"])
                    x = own.astype(np.float32)
                    layers = [np.frombuffer(b, np.int32).reshape(n, -1).astype(np.int64) for n, b in zip(a["layer_sizes"], a["links"], strict=True)]
                    continue
                if at_hand != (row["dim"], row["shard"]):  # no vector of this length fell into this shard
                    continue
                queries = np.array([r["vec_id"] for r in row["block"]], dtype=np.int64)
                q = np.array([r["embedding"] for r in row["block"]], dtype=np.float64)
                found, _ = graph_index.search(x, layers, q.astype(np.float32), k)
                i, j = np.nonzero(found >= 0)
                at = found[i, j]
                yield batch_of(_FOUND, queries[i], ids[at], np.sqrt(((own[at] - q[i]) ** 2).sum(axis=1)))

    return run


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) once each, without vectors null, empty, zero or with null or non-finite components."""
    good = F.forall("embedding", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good & F.exists("embedding", lambda v: v != 0)).distinct()


def shard_count(n: int, least: int = SHARD_VECTORS, most: int = MOST_SHARD_VECTORS) -> int:
    """Shards of n vectors: both their number and their size grow with the root of n, until a shard is as large as a task builds well."""
    size = min(max(least, most), max(least, math.isqrt(least * n)))
    return max(1, -(-n // size))


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vector whose id is divisible by `every`.

    Equal vectors are one node of the graph; its k + 1 smallest ids stand for all, as no more can be among the k
    nearest. score is the Euclidean distance of the original vectors in double precision; equal ones go by the smaller
    vec_id. A query's own id is never a result. Vectors that are null, empty or zero, or hold null or non-finite
    components, and those without an id, take no part. Vectors of different lengths never meet. Rows that repeat count
    once. Shards come from a hash of the vector, so each holds a fair share of any cluster; each is one task's work, and
    blocks of queries go to all of them. Other columns are not read. An empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession, "nearest")
    valid = scratch.write(valid_vectors(vectors), "valid")
    same = Window.partitionBy("embedding").orderBy("vec_id")
    # The limit on ranks holds before the shuffle too, so a vector that fills the table sends k + 1 rows from each task.
    ranked = scratch.write(valid.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1), "firsts")
    ranked = scratch.write(ranked.withColumn("rep", F.first("vec_id").over(same)), "ranked")
    nodes = ranked.where("n = 1").select(F.size("embedding").cast("long").alias("dim"), "vec_id", "embedding")
    n_shards = shard_count(nodes.count(), shard_vectors)
    sharded = nodes.select("dim", F.pmod(F.xxhash64("embedding"), F.lit(n_shards)).alias("shard"), "vec_id", "embedding")
    # A shard's number is its partition, so that no task builds two while another has none.
    index = sharded.repartitionById(n_shards, F.col("shard").cast("int")).sortWithinPartitions("dim", "shard").mapInArrow(_build, INDEX)
    index = scratch.write(index, "index")

    scratch.drop("firsts")
    queries = valid.where(F.col("vec_id") % every == 0).select(F.size("embedding").cast("long").alias("dim"), "vec_id", "embedding")
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    blocks = queries.groupBy("dim", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("number")).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("block"))
    asked = blocks.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))).alias("shard"), F.lit(None).cast(index.schema).alias("arrays"), "block")
    held = index.select("dim", "shard", F.struct(*index.columns).alias("arrays"), F.lit(None).cast(blocks.schema["block"].dataType).alias("block"))
    routed = held.unionByName(asked).repartitionById(n_shards, F.col("shard").cast("int")).sortWithinPartitions("dim", "shard", F.col("arrays").isNull())
    found = routed.mapInArrow(_search(k + 1), "query_id long, rep long, score double")
    by = Window.partitionBy("query_id").orderBy("score", "rep")
    best = found.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k + 1).drop("n")
    ids = best.join(ranked.select("rep", "vec_id"), "rep").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return ids.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
