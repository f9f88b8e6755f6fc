"""Helpers shared by the operators of this subpackage: scratch tables and byte-level text kernels."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.plans.shared import shared_folder

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_LONG_WORD = 256
#: Only some C libraries have it.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of its store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """In a task: the store of a qualified path, and the name in it. Schemes are those that Arrow reads: file, hdfs, s3 (also as s3a), gs, abfs."""
    path = re.sub("^s3[an]:", "s3:", path)
    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor never loses them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        # Bounds what one Arrow batch holds, whatever the length of single rows.
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def qualified(self, name: str) -> str:
        return qualified(self.spark, f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes these tables, or all."""
        for name in names or ("",):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop_but(self, *names: str) -> None:
        """Deletes all tables but these, which a result still reads."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        store = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if store.exists(root):
            for x in store.listStatus(root):
                if x.getPath().getName() not in names:
                    store.delete(x.getPath(), True)


def sized_broadcast(df: DataFrame, rows: int, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """Hints a broadcast only where the counted rows stay under the limit; else Spark shuffles."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int):
    """crc32 of the value as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def byte_table(separators) -> np.ndarray:
    """True for the bytes that belong to words."""
    out = np.ones(256, dtype=bool)
    out[list(separators)] = False
    return out


#: Words are runs of anything but ASCII white space.
SPACED = byte_table([0x20, *range(0x09, 0x0E)])
#: Words are runs of ASCII letters, digits and anything beyond ASCII.
ALNUM = byte_table([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


class Packed:
    """Several texts in one byte buffer, a new line around each."""

    def __init__(self, texts: list[bytes | None], translation: bytes | None = LOWER):
        joined = b"\n".join([b"", *[t or b"" for t in texts], b""]) + b"\n" * 8
        self.bytes = joined.translate(translation) if translation else joined
        self.buf = np.frombuffer(self.bytes, dtype=np.uint8)
        lens = np.fromiter((len(t or b"") for t in texts), dtype=np.int64, count=len(texts))
        self.first = np.concatenate([[0], np.cumsum(lens + 1)]) + 1  # where each text begins, and the end
        self.lens = lens

    def words(self, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of each word, and the number of the first word of each text (and the count)."""
        m = is_word[self.buf]
        edge = np.flatnonzero(m[1:] != m[:-1]) + 1
        starts, ends = edge[0::2], edge[1::2]
        return starts, ends, np.searchsorted(starts, self.first)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each span's bytes."""
        n = ends - starts
        view = np.ndarray((len(self.buf) - 7,), dtype="<u8", buffer=self.bytes, strides=(1,))
        h = mix((n.astype(np.uint64) + np.uint64(seed)) * _GOLD)
        h = mix(h ^ (view[starts] & _LOW[np.minimum(n, 8)])) if len(starts) else h
        left, at = np.flatnonzero(n > 8), 8
        while len(left) and at < _LONG_WORD:
            h[left] = mix(h[left] * _GOLD ^ (view[starts[left] + at] & _LOW[np.minimum(n[left] - at, 8)]))
            at += 8
            left = left[n[left] > at]
        for i in left:  # very long words, each once
            h[i] = xxhash.xxh64_intdigest(self.bytes[starts[i] : ends[i]], seed)
        return h


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive items of h, in order."""
    m = len(h) - k + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(m, np.uint64(k), dtype=np.uint64)
    for j in range(k):
        out = out * _M1 + h[j : j + m]
        out ^= out >> np.uint64(29)
    return mix(out)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return (column if pa.types.is_binary(column.type) else column.cast(kind)).to_pylist()


def give_back() -> None:
    """Returns to the system what Arrow and the C library hold and nothing uses."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str, size: int = 1 << 20, rows: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Cuts batches into runs of at most `rows` rows with about `size` bytes of text; one longer text makes a run by itself."""
    for batch in batches:
        texts = as_bytes(batch.column(batch.schema.get_field_index(text)))
        begin, held = 0, 0
        for i, t in enumerate(texts):
            held += len(t or b"")
            if held >= size or i + 1 - begin >= rows or i == len(texts) - 1:
                yield batch.slice(begin, i + 1 - begin), texts[begin : i + 1]
                begin, held = i + 1, 0
        # Workers live on from stage to stage, and would keep what the largest batch of any of them took.
        del batch, texts
        give_back()


def int_lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """An Arrow list column of int64 from flat values and row bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, pa.int64()))


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def clash_free(df: DataFrame, *names: str) -> DataFrame:
    """Drops extra columns whose names an operator adds itself."""
    return df.drop(*[c for c in df.columns if c in names])
