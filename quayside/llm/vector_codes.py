"""Vector code compression: codebooks of vector parts, whose nearest entries are found by exponion search in whole numbers."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sized_broadcast
from .vectors import LONG_MAX, halves, held_long, joined, matrix, spread, task_sums, whole_vectors

SCALE = 4096


def squared(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    d = x - entry
    return (d * d).sum(axis=-1)


class Neighbours:
    """Entries of one codebook, and for each the list of all by distance from it, nearest first."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = squared(entries[:, None, :], entries[None, :, :])
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of each row, ties to the lower index, and the squared distance.

        An entry no farther from x than the start entry, u away, is at most 2u from that entry. So of the start entry's
        list only what lies within 2u is scanned: squared distances up to 4 u^2, equal ones too.
        """
        code, best = start.astype(np.int64), np.zeros(len(x), dtype=x.dtype)
        for a in np.unique(start):
            own = np.flatnonzero(start == a)
            u = squared(x[own], self.entries[a])
            reach = np.searchsorted(self.apart[a], 4 * u, side="right")
            far = np.argsort(-reach, kind="stable")
            own, reach = own[far], reach[far]
            best[own] = u[far]
            for t, j in enumerate(self.order[a]):
                own = own[: np.searchsorted(-reach[: len(own)], -t, side="left")]  # those whose list goes beyond t
                if not len(own):
                    break
                if j != a:
                    d = squared(x[own], self.entries[j])
                    better = (d < best[own]) | ((d == best[own]) & (j < code[own]))
                    code[own[better]], best[own[better]] = j, d[better]
        return code, best


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, label: str = "label") -> tuple[DataFrame, list]:
    """(vec_id, label, x, code, error) for each vector, and the codebooks as lists of whole numbers by part and entry.

    code holds a byte for each part, error the squared distances summed. A round assigns all parts and moves the entries;
    its table, with the codes that the next one starts from, is written to the shared folder. Parts of a cluster are summed
    within tasks, so a common vector costs no more than any other. Equal parts go to equal entries.
    """
    scratch = Scratch(vectors.sparkSession, "codes")
    start = F.unhex(F.lit("00" * parts))
    rows = scratch.write(whole_vectors(vectors, SCALE, label).withColumn("code", start), "round-0")
    n, dim, largest = spread(rows)
    length = -(-dim // parts)
    # Four times a squared distance has to fit a long, and so has the sum over all parts; beyond that Python's integers take over.
    number = np.int64 if max(16, 4 * parts) * length * (largest + 1) ** 2 <= LONG_MAX else object
    schema = rows.schema

    def split(column: pa.Array) -> np.ndarray:
        return matrix(column, parts * length).reshape(len(column), parts, length)

    def assigned(codebooks: list, with_error: bool):
        out = schema.add("error", "long") if with_error else schema

        def run(batches):
            books = [Neighbours(np.array(b, dtype=number).reshape(len(b), length)) for b in codebooks]
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = split(batch.column(2)).astype(number)
                old = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, parts)
                found = [book.nearest(x[:, p], old[:, p]) for p, book in enumerate(books)]
                new = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
                error = [pa.array(held_long(sum(f[1] for f in found)))] if with_error else []
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([c.tobytes() for c in new]), *error], names=out.names)

        return run, out

    def part_sums(count: int):
        def of(batch: pa.RecordBatch) -> np.ndarray:
            x, code = halves(split(batch.column(0)).transpose(1, 0, 2)), np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, parts)
            out = np.zeros((parts, count, 1 + 2 * length), dtype=np.int64)
            for p in range(parts):
                order = np.argsort(code[:, p], kind="stable")
                used, first, many = np.unique(code[order, p], return_index=True, return_counts=True)
                out[p, used, 0] = many
                out[p, used, 1:] = np.concatenate([np.add.reduceat(half[p][order], first, axis=0) for half in x], axis=1)
            return out.ravel()

        return of

    if not n:
        return rows.withColumn("error", F.lit(0).cast("long")), []
    firsts = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    whole = [np.pad(np.array(r.x, dtype=object), (0, parts * length - len(r.x))) for r in firsts]
    codebooks = [[list(w[p * length : (p + 1) * length]) for w in whole] for p in range(parts)]
    for r in range(1, rounds + 1):
        run, out = assigned(codebooks, with_error=False)
        rows = scratch.write(rows.mapInArrow(run, out), f"round-{r}")
        scratch.drop(f"round-{r - 1}")
        sums = task_sums(rows.select("x", "code"), part_sums(len(firsts)), "long").reshape(parts, len(firsts), -1)
        for p in range(parts):
            for e in np.flatnonzero(sums[p, :, 0]):
                low, high = sums[p, e, 1:].reshape(2, length)
                codebooks[p][e] = [int(s) // int(sums[p, e, 0]) for s in joined(low, high)]
    run, out = assigned(codebooks, with_error=True)
    rows = scratch.write(rows.mapInArrow(run, out), "coded")
    scratch.drop_but("coded")
    return rows, codebooks


def code_digests(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of 8 parts, 16 entries and 6 rounds.

    Vectors that are null or hold null or non-finite components go. Shorter vectors, and a length that the parts do not
    divide, are filled up with zeros, which no distance sees. The first codebooks are the vectors of the smallest ids, null
    ids last, an id's several vectors by their components; a table of fewer rows has as many entries. Rows that repeat
    count each. Scaled components beyond 2**53 are held there, an error or sum of errors beyond a long at its largest
    value. Labels that are null are one label. An empty table gives no rows. Other columns are not read.
    """
    rows, codebooks = vector_codes(vectors)
    digest = hashlib.sha256(",".join(str(c) for book in codebooks for entry in book for c in entry).encode()).hexdigest()
    scratch = Scratch(vectors.sparkSession, "code-labels")
    own = rows.groupBy(F.col("label").alias("of_label")).agg(F.coalesce(F.try_sum("error"), F.lit(LONG_MAX)).alias("label_error"))
    own = scratch.write(own, "own")
    coded = rows.join(sized_broadcast(own, own.count(), 64), F.col("label").eqNullSafe(F.col("of_label")))
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
