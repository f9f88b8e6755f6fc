"""Token counts of sections: each document is encoded once, and its tokens' spans are joined to the sections' spans.

A token that crosses a border goes where the rule says:

    "most"   to the section with most of its bytes, the earlier one if equal
    "first"  to the section of its first byte
    "last"   to the section of its last byte
    "split"  to each in the share of its bytes
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, pieces
from .encode import encoder

RULES = ("most", "first", "last", "split")
#: What no section covers.
OUTSIDE = "(outside)"
Spans = list[tuple[str, int, int]]
OUT = "doc_id long, section string, n_tokens double, n_crossing long, n_bytes long"


def line_sections(text: str) -> Spans:
    """Sections of a plain document, by line: its first line, rows of tables, licence lines and the rest."""
    out, at = [], 0
    for i, line in enumerate(text.split("\n")):
        lowered = line.lower()
        kind = "table" if "|" in line else "licence" if "licensed under" in lowered or "all rights reserved" in lowered else "body" if i else "first_line"
        out.append((kind, at, at + len(line)))
        at += len(line) + 1
    return out


def _owners(text: bytes, spans: Spans) -> tuple[np.ndarray, list[str]]:
    """Byte borders of stretches with one owner, and the owners; a character belongs to the first span over it."""
    chars = None if text.isascii() else np.append(np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80), len(text))
    n = len(text) if chars is None else len(chars) - 1
    borders, names, at = [0], [], 0
    for name, a, b in sorted(spans, key=lambda s: (s[1], s[2], s[0])):
        a, b = min(max(a, at), n), min(b, n)
        if a >= b:
            continue
        if a > at:
            names.append(OUTSIDE)
            borders.append(a)
        names.append(name)
        borders.append(b)
        at = b
    if at < n:
        names.append(OUTSIDE)
        borders.append(n)
    edges = np.array(borders, dtype=np.int64)
    return (edges if chars is None else chars[edges]), names


def attribute(text: bytes, token_bytes: np.ndarray, spans: Spans, rule: str) -> list[tuple[str, float, int, int]]:
    """(section, tokens, crossing tokens, bytes) of one document, sections in order of appearance."""
    edges, names = _owners(text, spans)
    ends = np.cumsum(token_bytes)
    starts = ends - token_bytes
    lo = np.searchsorted(edges, starts, side="right") - 1
    hi = np.searchsorted(edges, ends, side="left") - 1
    crossing = hi > lo
    tokens = np.zeros(len(names))
    if rule in ("first", "last") or not crossing.any():
        np.add.at(tokens, hi if rule == "last" else lo, 1)
    else:
        np.add.at(tokens, lo[~crossing], 1)
        own = np.flatnonzero(crossing)
        n = hi[own] - lo[own] + 1
        token = np.repeat(own, n)
        stretch = np.repeat(lo[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        over = np.minimum(ends[token], edges[stretch + 1]) - np.maximum(starts[token], edges[stretch])
        if rule == "split":
            np.add.at(tokens, stretch, over / token_bytes[token])
        else:
            order = np.lexsort((stretch, -over, token))
            np.add.at(tokens, stretch[order[np.concatenate([[0], np.cumsum(n)[:-1]])]], 1)
    crossed = np.zeros(len(names), dtype=np.int64)
    np.add.at(crossed, lo[crossing], 1)
    np.add.at(crossed, hi[crossing], 1)
    out: dict[str, list] = {}
    for name, t, c, b in zip(names, tokens, crossed, np.diff(edges), strict=True):
        sums = out.setdefault(name, [0.0, 0, 0])
        sums[0] += float(t)
        sums[1] += int(c)
        sums[2] += int(b)
    return [(k, *v) for k, v in out.items()] or [(OUTSIDE, 0.0, 0, 0)]


def _rows(path: str, rule: str, sectioner: Callable[[str], Spans] | None):
    schema = pa.schema([("doc_id", pa.int64()), ("section", pa.string()), ("n_tokens", pa.float64()), ("n_crossing", pa.int64()), ("n_bytes", pa.int64())])

    def run(batches):
        own = encoder(path)
        if not own.by_piece:
            raise ValueError("token spans need a byte-level vocabulary")
        for batch, texts in pieces(batches, "text"):
            ids, bounds = own.encode(texts)
            size = own.id_bytes[ids]
            given = None if sectioner else batch.column(2).to_pylist()
            where, rows = [], []
            for i, t in enumerate(texts):
                t = t or b""
                spans = sectioner(t.decode("utf-8", "replace")) if sectioner else [(s["section"], s["start"], s["end"]) for s in given[i] or ()]
                found = attribute(t, size[bounds[i] : bounds[i + 1]], spans, rule)
                rows += found
                where += [i] * len(found)
            yield batch_of(schema, batch.column(0).take(pa.array(where, pa.int64())), *zip(*rows, strict=True))

    return run


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text and the document's spans from a table (doc_id, section, start, end), for section_tokens."""
    own = spans.where("section is not null and start is not null and end is not null").groupBy("doc_id").agg(F.collect_list(F.struct("section", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))).alias("spans"))
    return docs.select("doc_id", "text").join(own, "doc_id", "left")


def section_tokens(docs: DataFrame, path: str, rule: str = "most", sectioner: Callable[[str], Spans] | None = None) -> DataFrame:
    """Per document and section: n_tokens, n_crossing (tokens that cross its border), n_bytes.

    Sections are spans of characters, given by `sectioner` or in an array column `spans` (see with_spans). Spans may
    repeat, overlap or reach beyond the text: a character belongs to the span that begins first. What no span covers
    is `(outside)`. Each document's n_tokens sum to its number of tokens, under every rule. A null or empty text has
    one row, `(outside)` with 0 tokens. Repeated rows give repeated results; an empty table gives no rows; a text of any
    length is one row's work. Where a token's bytes fall on two sections alike, it goes to the one that begins first. Other
    columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    columns = [F.col("doc_id").cast("long").alias("doc_id"), "text", *([] if sectioner else ["spans"])]
    return docs.select(*columns).mapInArrow(_rows(path, rule, sectioner), OUT)
