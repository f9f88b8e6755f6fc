"""Substring deduplication by sliding spans of sentences.

Every sentence begins a run, the shortest one of `min_sentences` sentences or more that has `min_words` words, and ends
another by the same minimums. Any longer run is the union of such runs inside it, so they stand for all runs wherever
its copies end their sentences alike. They are hashed and joined over all documents; the sentences of each repeated run go wherever it is not its first occurrence.
A sentence of more than LONGEST words is cut further by its words, so that a passage inside it is cut alike wherever it
begins and ends; other sentences go whole or stay whole.

A run that ends at a sentence holds the one that begins where it does. So the runs that sentences begin are joined
first, and the others only for documents that share one of those with some other document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, Packed, Scratch, batch_of, mix, pieces, sized_broadcast

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Ids of documents that share runs are sent to all tasks up to this size.
BROADCAST_BYTES = 32 << 20
#: A sentence of more words than this is a stretch that is cut further, and more words of it count as several sentences.
LONGEST = 25
#: One pair of neighbouring words in so many, by its hash, is cut between.
CUT_EVERY = 8
#: Where no cut is so near on either side, the least hash within this distance cuts: text that repeats one phrase.
CUT_REACH = 12
OUT = "doc_id long, text string, n_sentences long, n_removed long"


def _word_cuts(h: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """True for words that begin a piece: those in begins, and others by hashes of words near them alone."""
    n = len(h)
    pair = np.zeros(n, dtype=np.uint64)
    pair[1:] = mix(h[:-1] * np.uint64(_BASES[0]) + h[1:])
    out = begins | (pair % np.uint64(CUT_EVERY) == 0)
    near = np.concatenate([[0], np.cumsum(out)])
    at = np.arange(CUT_REACH, n - CUT_REACH)
    at = at[near[at + CUT_REACH + 1] == near[at - CUT_REACH]]
    least = np.ones(len(at), dtype=bool)
    for d in range(-CUT_REACH, CUT_REACH + 1):
        least &= pair[at] <= pair[at + d]
    out[at[least]] = True
    return out


def _lengths(begins: np.ndarray) -> np.ndarray:
    """For each word, how many words what it is part of has; begins marks first words."""
    at = np.flatnonzero(begins)
    n = np.diff(np.append(at, len(begins)))
    return np.repeat(n, n)


def _minimal(words: np.ndarray, first_word: np.ndarray, sentence: np.ndarray, min_sentences: int, min_words: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First words and ends of the shortest runs from and to each piece, of min_words words and min_sentences sentences,
    and the number of the former, which come first.

    words holds each piece's first word, and the end; sentence numbers each piece's sentence. A run has words of so many
    sentences, or more words than so many of the longest but one have.
    """
    n, more = len(words) - 1, min_sentences - 1
    doc = np.searchsorted(first_word, words[:-1], side="right") - 1
    bounds = np.searchsorted(words, first_word)
    enough = np.maximum(np.searchsorted(words, words[:-1] + min_words), np.searchsorted(sentence, sentence + more) + 1)
    end = np.minimum(enough, np.searchsorted(words, words[:-1] + max(min_words, LONGEST * more + 1)))
    enough = np.minimum(np.searchsorted(words, words[1:] - min_words, side="right"), np.searchsorted(sentence, sentence - more, side="right")) - 1
    begin = np.maximum(enough, np.searchsorted(words, words[1:] - max(min_words, LONGEST * more + 1), side="right") - 1)
    a = np.flatnonzero(end <= bounds[1:][doc])
    b = np.flatnonzero(begin >= bounds[:-1][doc])
    b = b[end[begin[b]] != b + 1]  # else the run that begins there is the same
    return words[np.append(a, begin[b])], words[np.append(end[a], b + 1)], len(a)


class Runs:
    """Sentences, their pieces and runs of several texts; a run has a first piece and an end. A sentence is one piece unless it is long."""

    def __init__(self, texts: list[bytes | None], min_sentences: int, min_words: int):
        packed = Packed(texts)
        starts, ends, first_word = packed.words(SPACED)
        n = len(starts)
        h = packed.hashes(starts, ends)
        leads = np.zeros(n, dtype=bool)
        leads[first_word[:-1][first_word[:-1] < first_word[1:]]] = True
        marked, broken = leads.copy(), np.zeros(n, dtype=bool)
        if n > 1:
            newlines = np.concatenate([[0], np.cumsum(packed.buf == 10)])
            marked[1:] |= np.isin(packed.buf[ends[:-1] - 1], [ord(c) for c in ".!?"])
            broken[1:] = newlines[starts[1:]] > newlines[ends[:-1]]
        begins = marked | broken
        cut = _word_cuts(h, marked)
        # Once with new lines and once without, as a copy may be wrapped elsewhere.
        leading, ending, union = [], [], begins.copy()
        for own in (begins, marked):
            cuts = own | (cut & (_lengths(own) > LONGEST))
            union |= cuts
            at = np.flatnonzero(cuts)
            x, y, k = _minimal(np.append(at, n), first_word, np.cumsum(own)[at], min_sentences, min_words)
            leading.append(x[:k] * (n + 1) + y[:k])
            ending.append(x[k:] * (n + 1) + y[k:])
        leading = np.unique(np.concatenate(leading))
        a, b = np.divmod(np.append(leading, np.setdiff1d(np.concatenate(ending), leading)), n + 1)
        self.n_leading = len(leading)
        words = np.append(np.flatnonzero(union), n)  # the first word of each piece, and the end
        self.first = np.searchsorted(words[:-1], first_word)  # the first piece of each text, and the count
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.begin = starts[words[:-1]] - packed.first[:-1][self.doc] if n else np.empty(0, dtype=np.int64)  # bytes into the text
        self.sentence = np.cumsum(begins)[words[:-1]] - 1
        self.long = _lengths(begins)[words[:-1]] > LONGEST
        self.n_sentences = np.diff(np.searchsorted(np.flatnonzero(begins), first_word))
        self.runs, self.end = np.searchsorted(words, a), np.searchsorted(words, b)
        self.h1, self.h2 = (self._spans(mix(h + np.uint64(k)), base, a, b) for k, base in enumerate(_BASES))

    @staticmethod
    def _spans(h: np.ndarray, base: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Polynomial hashes of h[a:b], by differences of prefix sums."""
        n = len(h)
        power = np.cumprod(np.append(np.uint64(1), np.full(n, np.uint64(base), dtype=np.uint64)))
        back = np.cumprod(np.append(np.uint64(1), np.full(n, np.uint64(pow(base, -1, 1 << 64)), dtype=np.uint64)))
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * power[:n], dtype=np.uint64)])
        return mix((sums[b] - sums[a]) * back[a] + mix((b - a).astype(np.uint64)))

    def repeated_inside(self, among: int | None = None) -> np.ndarray:
        """Of the first runs, or all: those that occur earlier in the same text."""
        runs, h1, h2 = self.runs[:among], self.h1[:among], self.h2[:among]
        doc = self.doc[runs]
        order = np.lexsort((runs, h2, h1, doc))
        again = np.zeros(len(order), dtype=bool)
        if len(order) > 1:
            x, y = order[1:], order[:-1]
            again[x] = (doc[x] == doc[y]) & (h1[x] == h1[y]) & (h2[x] == h2[y])
        return again

    def gone(self, drop: np.ndarray) -> np.ndarray:
        """Pieces that lie in any of the runs marked; those of a sentence that is not long only if all of them do."""
        turn = np.zeros(len(self.doc) + 1, dtype=np.int64)
        np.add.at(turn, self.runs[drop], 1)
        np.add.at(turn, self.end[drop], -1)
        inside = np.cumsum(turn)[:-1] > 0
        stays = np.bincount(self.sentence, ~inside)[self.sentence] > 0 if len(inside) else inside
        return inside & (self.long | ~stays)


def _spans(min_sentences: int, min_words: int, all_runs: bool):
    """Runs once for each document; not `all_runs`: only those that sentences begin."""
    schema = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def run(batches):
        for batch, texts in pieces(batches, "text"):
            runs = Runs(texts, min_sentences, min_words)
            own = np.flatnonzero(~runs.repeated_inside() if all_runs else ~runs.repeated_inside(runs.n_leading))
            yield batch_of(schema, batch.column(0).take(pa.array(runs.doc[runs.runs[own]])), runs.h1[own].view(np.int64), runs.h2[own].view(np.int64))

    return run


def _rewrite(min_sentences: int, min_words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_sentences", pa.int64()), ("n_removed", pa.int64())])

    def run(batches):
        for batch, texts in pieces(batches, "text"):
            runs = Runs(texts, min_sentences, min_words)
            flagged = batch.column(2)
            n = np.array([len(x) if x.is_valid else 0 for x in flagged], dtype=np.int64)
            theirs = flagged.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            tagged = mix(theirs ^ mix(np.repeat(np.arange(len(n)), n).astype(np.uint64)))
            drop = runs.repeated_inside() | np.isin(mix(runs.h1 ^ mix(runs.doc[runs.runs].astype(np.uint64))), tagged)
            gone = runs.gone(drop)
            kept, touched = [], np.unique(runs.sentence[gone], return_index=True)[1]
            removed = np.bincount(runs.doc[gone][touched], minlength=len(texts))
            for i, t in enumerate(texts):
                a, b = runs.first[i], runs.first[i + 1]
                if removed[i]:
                    cuts = [*runs.begin[a:b], len(t)]
                    t = t[: cuts[0]] + b"".join(t[x:y] for x, y, g in zip(cuts[:-1], cuts[1:], gone[a:b], strict=True) if not g)
                kept.append((t or b"").decode("utf-8", "replace"))
            yield batch_of(schema, batch.column(0), kept, runs.n_sentences, removed)

    return run


def drop_repeated_spans(docs: DataFrame, min_sentences: int = 2, min_words: int = 20) -> DataFrame:
    """Per document: doc_id, text without repeated spans, n_sentences, n_removed.

    A sentence ends at a word's final . ! or ? before white space, at a new line, or with the text; it takes along the
    white space after it. Runs are of consecutive sentences, compared by their words, A-Z lower-cased, with and without
    the new lines as ends. The first occurrence of a run is the one in the smallest doc_id, and there the foremost.
    Sentences in any run that occurs before go; others stay byte for byte. A sentence of more than 25 words is cut
    between words by the words' hashes; its pieces go by themselves, and more than 25 words of it count as several
    sentences. n_removed counts sentences that go, or lose pieces.

    Null texts count as empty. Rows of one doc_id are one document: they lose what repeats inside each of them, not what
    they share. A row with a null doc_id loses what repeats inside it only. An empty table gives no rows; a text of any
    length is one row's work; where rows tie, the smaller doc_id is first. Other columns are not read, so they may have
    any name.
    """
    scratch = Scratch(docs.sparkSession, "span-dedup")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    runs_of = lambda texts, all_runs: texts.where("doc_id is not null").mapInArrow(_spans(min_sentences, min_words, all_runs), "doc_id long, h1 long, h2 long")
    hits, firsts = _repeats(runs_of(source, False), scratch, "leading")
    ids = scratch.write(hits.select("doc_id").union(firsts).distinct(), "sharing")
    sharing = source.join(sized_broadcast(ids, ids.count(), 16, BROADCAST_BYTES), "doc_id", "left_semi")
    hits, _ = _repeats(runs_of(sharing, True), scratch, "all")
    flagged = scratch.write(hits.groupBy("doc_id").agg(F.collect_set("h1").alias("flagged")), "flagged")
    scratch.drop_but("flagged")
    return source.join(flagged, "doc_id", "left").select("doc_id", "text", "flagged").mapInArrow(_rewrite(min_sentences, min_words), OUT)


def _repeats(spans: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h1) of runs that occur in a document before, and the ids of the first documents of such runs.

    Runs meet their first document in a join whose partitions Spark splits where one run is in very many documents.
    """
    repeated = spans.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc")
    repeated = scratch.write(repeated.select("h1", "h2", "first_doc"), f"{name}-repeated")
    return spans.join(repeated, ["h1", "h2"]).where("doc_id > first_doc").select("doc_id", "h1"), repeated.select(F.col("first_doc").alias("doc_id"))
