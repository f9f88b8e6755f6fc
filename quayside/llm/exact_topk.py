"""Exact top-k search by inner product: impact-ordered postings by shard, queries in cells of a shard and some queries."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import impact_index
from .common import Scratch, batch_of
from .vectors import matrix, whole_vectors

SCALE = 1024
#: Components in a shard, about: at least, and where the table is large.
SHARD_COMPONENTS, MOST_SHARD_COMPONENTS = 1 << 18, 1 << 22
#: Queries in a cell, about, in the same way.
CELL_QUERIES, MOST_CELL_QUERIES = 128, 4096

#: The index's arrays and their types; the values have that of the vectors.
_PARTS = {"order": np.int32, "values": None, "dims": np.int64, "first": np.int64, "last": np.int64, "high": np.int64, "lengths": np.int64}
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def pieces_of(n: int, least: int, most: int) -> int:
    """Pieces of n: their number and size grow with the root of n, until a piece is as large as it may be."""
    return max(1, -(-n // min(max(least, most), max(least, math.isqrt(least * n)))))


def _narrow(x: np.ndarray) -> np.ndarray:
    most = max(int(x.max()), -int(x.min())) if x.size else 0
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def _build(batches):
    """Rows come sorted by (dim, shard, vec_id). A row holds a shard's ids, vectors and postings."""
    held: tuple | None = None

    def built(dim: int, shard: int, parts: list) -> pa.RecordBatch:
        ids, x = (np.concatenate(p) for p in zip(*parts, strict=True))
        index = impact_index.build(x)
        narrow = _narrow(x)
        index["values"] = index["values"].astype(narrow.dtype)
        arrays = [ids.tobytes(), narrow.tobytes(), narrow.dtype.str, *[index[k].tobytes() for k in _PARTS]]
        kinds = [pa.binary(), pa.binary(), pa.string(), *[pa.binary()] * len(_PARTS)]
        return pa.RecordBatch.from_arrays([pa.array([dim]), pa.array([shard]), *[pa.array([a], type=t) for a, t in zip(arrays, kinds, strict=True)]], names=["dim", "shard", "ids", "x", "kind", *_PARTS])

    for batch in batches:
        dims, shards, ids = (batch.column(i).to_numpy() for i in range(3))
        changes = np.flatnonzero((dims[1:] != dims[:-1]) | (shards[1:] != shards[:-1])) + 1
        for part in np.split(np.arange(len(ids)), changes) if len(ids) else ():
            key = (int(dims[part[0]]), int(shards[part[0]]))
            if held and held[0] != key:
                yield built(*held[0], held[1])
                held = None
            held = held or (key, [])
            held[1].append((ids[part], matrix(batch.column(3).slice(part[0], len(part)), key[0])))
    if held:
        yield built(*held[0], held[1])


INDEX = ", ".join(["dim long, shard long, ids binary, x binary, kind string", *[f"{p} binary" for p in _PARTS]])


def _search(k: int):
    """A shard's arrays come first, then its queries."""

    def run(batches):
        key = None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                own = (row["dim"], row["cell"])
                if (a := row["arrays"]) is not None:
                    key, ids = own, np.frombuffer(a["ids"], np.int64)
                    x = np.frombuffer(a["x"], np.dtype(a["kind"])).reshape(len(ids), row["dim"])
                    index = {p: np.frombuffer(a[p], kind or x.dtype) for p, kind in _PARTS.items()}
                elif key == own:  # else no vector of this length fell into this shard
                    found, scores = impact_index.search(index, ids, x, row["query_id"], np.array(row["q"], dtype=np.int64), k)
                    out.append((np.full(len(found), row["query_id"]), found, scores))
            if out:
                yield batch_of(_FOUND, *[np.concatenate(c) for c in zip(*out, strict=True)])

    return run


def largest_products(vectors: DataFrame, every: int = 100, k: int = 10, shard_components: int = SHARD_COMPONENTS, cell_queries: int = CELL_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors of the largest inner product with each vector whose id is divisible by `every`.

    A component c becomes the whole number floor(1024 c); scores are exact, equal ones go by the smaller vec_id. Vectors
    that are null or hold null or non-finite components take no part, nor do those without an id; zero and empty ones do.
    Vectors of different lengths never meet. A query's own id is never a result. Rows that repeat count once; of several
    vectors under one id, as query or as candidate, the best counts. Scaled components beyond 2**53 and scores beyond a long
    are held there. Other columns are not read. An empty table gives no rows.

    Shards come from a hash of the id, so that each holds a fair share of any vector that repeats. A cell is a shard and
    some of the queries, and one task's work.
    """
    scratch = Scratch(vectors.sparkSession, "products")
    valid = whole_vectors(vectors, SCALE).where(F.col("vec_id").isNotNull()).distinct()
    valid = scratch.write(valid.select(F.size("x").cast("long").alias("dim"), "vec_id", "x"), "valid")
    components, n_queries = valid.agg(F.sum(F.greatest("dim", F.lit(1))), F.count_if(F.col("vec_id") % every == 0)).first()
    n_shards = pieces_of(components or 0, shard_components, max(shard_components, MOST_SHARD_COMPONENTS))
    n_groups = pieces_of(n_queries, cell_queries, max(cell_queries, MOST_CELL_QUERIES))

    sharded = valid.select("dim", F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).alias("shard"), "vec_id", "x")
    built = sharded.repartitionById(n_shards, F.col("shard").cast("int")).sortWithinPartitions("dim", "shard", "vec_id")
    index = scratch.write(built.mapInArrow(_build, INDEX), "index")

    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = valid.where(F.col("vec_id") % every == 0).withColumn("part", F.pmod(F.xxhash64("vec_id", "x"), F.lit(n_groups)))
    asked = asked.withColumn("shard", numbers(n_shards)).select("dim", (F.col("shard") * n_groups + F.col("part")).alias("cell"), F.lit(None).cast(index.schema).alias("arrays"), F.col("vec_id").alias("query_id"), F.col("x").alias("q"))
    held = index.withColumn("part", numbers(n_groups)).select("dim", (F.col("shard") * n_groups + F.col("part")).alias("cell"), F.struct(*index.columns).alias("arrays"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("array<long>").alias("q"))
    routed = held.unionByName(asked).repartitionById(n_shards * n_groups, F.col("cell").cast("int")).sortWithinPartitions("dim", "cell", F.col("arrays").isNull())
    found = routed.mapInArrow(_search(k), "query_id long, vec_id long, score long").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
