"""Token ids in directly addressable codes, written to files in ascending doc_id order and read back.

An id is cut into chunks of eight bits. Level k holds chunk k of the ids that have one, a bitmap that says which go on
to level k + 1, and a rank directory of the bitmap, so that any token is found by one rank per level and no block is
decoded. Files are not compressed: `TokenReader` reads one token by a few bytes at known offsets. A file is one segment
of whole documents; a table names the files that count, in order:

    magic "QDAC0001", then as little-endian 64-bit numbers: documents, tokens, levels
    per document: has_id and doc_id (64 bits each); documents + 1 token bounds (64 bits)
    per level: chunks, words (64 bits each); the chunks, filled up to eight bytes; the bitmap's words;
    ones before each block of eight words (64 bits each)
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, batch_of, file_system, pieces, qualified
from .encode import encoder

MAGIC = b"QDAC0001"
#: A segment is closed once it holds so many tokens; documents are never cut.
SEGMENT_TOKENS = 1_000_000
_BLOCK = 8  # words in a block of the rank directory

#: Bytes of text that a worker encodes at a time.
ENCODED_BYTES = 1 << 19
#: Bytes of text in a partition of the range shuffle, about.
TASK_BYTES = 64 << 20
#: Characters of a text that order rows of one doc_id among partitions; inside a partition whole texts do.
PREFIX = 64

FILES = "part long, segment long, n_documents long, n_tokens long, path string, n_bytes long"
_FILES_ARROW = pa.schema([("part", pa.int64()), ("segment", pa.int64()), ("n_documents", pa.int64()), ("n_tokens", pa.int64()), ("path", pa.string()), ("n_bytes", pa.int64())])


def _fill(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 8)


def pack(has_id: np.ndarray, doc_ids: np.ndarray, bounds: np.ndarray, ids: np.ndarray) -> bytes:
    levels, left = [], ids.astype(np.uint32)
    while True:
        goes_on = left >= 256
        bits = np.packbits(goes_on, bitorder="little").tobytes()
        words = np.frombuffer(_fill(bits), "<u8")
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1][::_BLOCK] if len(words) else np.empty(0)
        levels.append(np.array([len(left), len(words)], "<u8").tobytes() + _fill(left.astype(np.uint8).tobytes()) + words.tobytes() + before.astype("<u8").tobytes())
        if not goes_on.any():
            break
        left = left[goes_on] >> np.uint32(8)
    head = np.array([len(doc_ids), len(ids), len(levels)], "<u8").tobytes()
    return b"".join([MAGIC, head, has_id.astype("<i8").tobytes(), doc_ids.astype("<i8").tobytes(), bounds.astype("<u8").tobytes(), *levels])


class TokenFile:
    """Reads a file image without copying it."""

    def __init__(self, image: bytes):
        if image[:8] != MAGIC:
            raise ValueError("not a token file")
        words = np.frombuffer(image, "<u8")
        self.n_documents, self.n_tokens, n_levels = (int(x) for x in words[1:4])
        at = 4
        self.has_id = words[at : at + self.n_documents].astype(bool)
        at += self.n_documents
        self.doc_ids = words[at : at + self.n_documents].view("<i8")
        at += self.n_documents
        self.bounds = words[at : at + self.n_documents + 1].view("<i8")
        at += self.n_documents + 1
        self.levels = []
        for _ in range(n_levels):
            n, n_words = int(words[at]), int(words[at + 1])
            at += 2
            chunks = np.frombuffer(image, np.uint8, n, at * 8)
            at += -(-n // 8)
            bits = words[at : at + n_words]
            at += n_words
            blocks = -(-n_words // _BLOCK)
            self.levels.append((chunks, bits, words[at : at + blocks]))
            at += blocks

    def token(self, i: int) -> int:
        """Token i alone: one rank on each level that it reaches."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, before) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            word, bit = divmod(i, 64)
            own = int(bits[word])
            if not own >> bit & 1:
                break
            block = word // _BLOCK
            i = int(before[block]) + int(np.bitwise_count(bits[block * _BLOCK : word]).sum()) + (own & ((1 << bit) - 1)).bit_count()
        return value

    def ids(self) -> np.ndarray:
        """All ids of the segment."""
        out = np.zeros(self.n_tokens, dtype=np.uint32)
        own = np.arange(self.n_tokens)
        for level, (chunks, bits, _) in enumerate(self.levels):
            out[own] |= chunks.astype(np.uint32) << np.uint32(8 * level)
            own = own[np.unpackbits(bits.view(np.uint8), bitorder="little", count=len(own)).astype(bool)]
        return out

    def document(self, k: int) -> np.ndarray:
        """The ids of document k of the segment, each by direct access."""
        return np.array([self.token(i) for i in range(self.bounds[k], self.bounds[k + 1])], dtype=np.uint32)


class TokenReader:
    """One token or document of a file by its offsets; neither the codes nor the directories are read whole."""

    def __init__(self, path: str):
        store, name = file_system(path)
        self.file = store.open_input_file(name)
        if self._bytes(0, 8) != MAGIC:
            raise ValueError("not a token file")
        self.n_documents, self.n_tokens, n_levels = (int(x) for x in self._words(1, 3))
        self._bounds = 4 + 2 * self.n_documents
        at = self._bounds + self.n_documents + 1
        self.levels = []  # (word at which chunks, bitmap and ranks begin)
        for _ in range(n_levels):
            n, n_words = (int(x) for x in self._words(at, 2))
            chunks = at + 2
            bits = chunks - -n // 8
            self.levels.append((chunks, bits, bits + n_words))
            at = bits + n_words - -n_words // _BLOCK

    def _bytes(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def _words(self, at: int, n: int) -> np.ndarray:
        return np.frombuffer(self._bytes(at * 8, n * 8), "<u8")

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            value |= self._bytes(chunks * 8 + i, 1)[0] << (8 * level)
            word, bit = divmod(i, 64)
            block = word // _BLOCK
            held = self._words(bits + block * _BLOCK, word - block * _BLOCK + 1)
            own = int(held[-1])
            if not own >> bit & 1:
                break
            i = int(self._words(ranks + block, 1)[0]) + int(np.bitwise_count(held[:-1]).sum()) + (own & ((1 << bit) - 1)).bit_count()
        return value

    def document(self, k: int) -> list[int]:
        a, b = (int(x) for x in self._words(self._bounds + k, 2))
        return [self.token(i) for i in range(a, b)]

    def close(self) -> None:
        self.file.close()


def _segments(path: str, end_id: int, segment_tokens: int, folder: str):
    def run(batches):
        own, context = encoder(path), TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        held, tokens, segment = [], 0, 0
        store, name = file_system(folder)
        store.create_dir(name, recursive=True)

        def closed():
            has_id, doc_ids, ids, n = (np.concatenate(x) for x in zip(*held, strict=True))
            image = pack(has_id, doc_ids, np.concatenate([[0], np.cumsum(n)]), ids)
            # An attempt that is lost or repeated leaves a file that the table does not name.
            file = f"tokens-{part:06d}-{segment:06d}-{attempt}.qdac"
            with store.open_output_stream(f"{name}/{file}") as out:
                out.write(image)
            return batch_of(_FILES_ARROW, [part], [segment], [len(n)], [len(ids)], [f"{folder}/{file}"], [len(image)])

        for batch, texts in pieces(batches, "text", ENCODED_BYTES):
            flat, bounds = own.encode(texts)
            n = np.diff(bounds) + 1
            ids = np.insert(flat, bounds[1:], end_id)
            column = batch.column(0)
            held.append((column.is_valid().to_numpy(zero_copy_only=False), column.fill_null(0).to_numpy(), ids, n))
            tokens += len(ids)
            if tokens >= segment_tokens:
                yield closed()
                held, tokens, segment = [], 0, segment + 1
        if held:
            yield closed()

    return run


def write_token_files(docs: DataFrame, target: str, path: str, end_id: int = 2, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Encodes whole texts and writes files under `target`; returns the table of files, in order of (part, segment).

    One range shuffle puts documents in ascending doc_id order: null first, those of one doc_id by text. Its partitions
    follow the bytes of text, and rows of one doc_id are dealt by the first characters of their texts, so no doc_id
    makes a task of its own; only rows that repeat whole stay together, and pass through a task one segment at a time.
    `target` is a folder that all executors reach. Null texts count as empty; `end_id` follows every document.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_bytes = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // TASK_BYTES))
    ordered = source.repartitionByRange(n, F.col("doc_id"), F.substring("text", 1, PREFIX)).sortWithinPartitions("doc_id", "text")
    target = qualified(spark, target)
    files = ordered.mapInArrow(_segments(path, end_id, segment_tokens, f"{target}/data"), FILES)
    files.write.mode("overwrite").parquet(f"{target}/files")
    return spark.read.schema(files.schema).parquet(f"{target}/files")


def _read(batches):
    schema = pa.schema([("part", pa.int64()), ("segment", pa.int64()), ("doc_id", pa.int64()), ("begin", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for part, segment, path in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            store, name = file_system(path)
            with store.open_input_file(name) as held:
                file = TokenFile(held.read())
            ids, bounds, n = file.ids().astype("<u4"), file.bounds, file.n_documents
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            doc_ids = pa.array(file.doc_ids, mask=~file.has_id)
            yield batch_of(schema, [part] * n, [segment] * n, doc_ids, bounds[:-1], np.diff(bounds), crc)


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files."""
    n = max(1, files.count())
    rows = files.select("part", "segment", "path").repartition(n, "part", "segment").mapInArrow(_read, "part long, segment long, doc_id long, begin long, n_tokens long, ids_crc32 long")
    sizes = files.select("part", "segment", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row per partition of the range shuffle meets here, whatever the number of documents.
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_part"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", "segment", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("before_segment")).join(before, "part")
    start = F.col("before_part") + F.col("before_segment") + F.col("begin")
    return rows.join(offsets, ["part", "segment"]).select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Writes token files to the shared folder and returns each document's place in them, as read back from them.

    One row per row of docs: doc_id, start, n_tokens (with the end id), ids_crc32. Null and empty texts have the end id
    alone; a null doc_id comes first; repeated rows follow each other, each with its own ids; a text of any length is
    in one segment. An empty table has no files and gives no rows. Other columns, clashing names included, are not read.
    """
    scratch = Scratch(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, f"{scratch.root}/files", path, end_id))
