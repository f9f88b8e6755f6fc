"""Runs of sentences against a brute force that tries runs of all lengths, and passages at any place."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from quayside.llm import span_dedup
from quayside.llm.common import SPACED, Packed
from quayside.llm.span_dedup import Runs, _word_cuts, drop_repeated_spans

WS = " \t\n\x0b\x0c\r"


def words_of(text):
    """(words with the white space after them, begins by marks, begins by marks or new lines, cuts by the words' hashes)."""
    parts = re.findall(rf"[^{WS}]+[{WS}]*", text)
    words = [p.rstrip(WS) for p in parts]
    marked = [k == 0 or words[k - 1][-1] in ".!?" for k in range(len(parts))]
    begins = [m or "\n" in parts[k - 1][len(words[k - 1]) :] for k, m in enumerate(marked)]
    packed = Packed([text.encode()])
    cuts = _word_cuts(packed.hashes(*packed.words(SPACED)[:2]), np.array(marked, dtype=bool)).tolist() if parts else []
    return parts, words, marked, begins, cuts


def numbered(begins):
    return list(itertools.accumulate(begins))


def brute(rows, least, words, longest=25, every=True):
    """(text, sentences, removed) by doc_id, with and without new lines as ends; from every run of at least the minimums, or
    from the shortest ones that begin, and that end, at each piece."""
    low = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x)
    seen, out = {}, {}
    for doc_id, text in sorted(rows):
        parts, own, marked, begins, cuts = words_of(text or "")
        own, runs = [low(w) for w in own], set()
        for starts in (begins, marked):
            sentence = numbered(starts)
            size, own_runs = Counter(sentence), set()
            at = [k for k in range(len(own)) if starts[k] or (cuts[k] and size[sentence[k]] > longest)] + [len(own)]
            for s, e in itertools.combinations(range(len(at)), 2):
                a, b = at[s], at[e]
                if b - a >= words and (sentence[b - 1] - sentence[a] >= least - 1 or b - a > longest * (least - 1)):
                    own_runs.add((a, b))
            first, last = {}, {}
            for a, b in own_runs:
                first[a], last[b] = min(b, first.get(a, b)), max(a, last.get(b, a))
            runs |= own_runs if every else set(first.items()) | {(a, b) for b, a in last.items()}
        gone, here = set(), set()
        for a, b in sorted(runs):
            key = tuple(own[a:b])
            if key in here or seen.get(key, doc_id) < doc_id:
                gone |= set(range(a, b))
            here.add(key)
            seen.setdefault(key, doc_id)
        sentence = numbered(begins)
        size, left = Counter(sentence), Counter(sentence[k] for k in range(len(own)) if k not in gone)
        gone = {k for k in gone if size[sentence[k]] > longest or not left[sentence[k]]}
        head = re.match(rf"[{WS}]*", text or "")[0]
        out[doc_id] = (head + "".join(x for k, x in enumerate(parts) if k not in gone), len(size), len({sentence[k] for k in gone}))
    return out


def got(df):
    return {r.doc_id: (r.text, r.n_sentences, r.n_removed) for r in df.collect()}


@pytest.mark.parametrize("limit", [1 << 25, -1])
def test_whole_table(spark, monkeypatch, limit):
    """All documents of up to 400 words against every run, and no text that is left in fragments but of long sentences."""
    monkeypatch.setattr(span_dedup, "BROADCAST_BYTES", limit)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("size(split(text, ' ')) < 400")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows, 2, 20)
    assert sum(x[2] for x in want.values()) > 30
    assert got(drop_repeated_spans(docs)) == want


def test_sentences_stay_whole(spark):
    """Whatever runs repeat, a sentence of 25 words or fewer goes whole or stays whole; counts are of sentences."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    runs = Runs([(r.text or "").encode() for r in docs], 2, 20)
    gone = runs.gone(np.random.default_rng(1).random(len(runs.runs)) < 0.3)
    left, all_ = np.bincount(runs.sentence, ~gone), np.bincount(runs.sentence)
    torn = (left > 0) & (left < all_)
    assert gone.sum() > 5000 and torn.sum() > 20 and np.isin(np.flatnonzero(torn), runs.sentence[runs.long]).all()
    want = {}
    for r in docs:
        want[r.doc_id] = sum(words_of(r.text or "")[3])
    assert {r.doc_id: r.n_sentences for r in drop_repeated_spans(spark.createDataFrame(docs)).collect()} == want


def test_random(spark):
    """Where all texts end their sentences alike, the shortest runs stand for all; else they are the rule."""
    rnd = random.Random(8)
    alike = ["a b c. ", "A B c.\n", "d e. ", "f. ", "g! h? ", "i.j k. ", "l m n o p q. ", " "]
    for every, parts in ((True, alike), (False, [*alike, "d e ", "\n", "i.j ", "k l m n o p q r s t u v w x y z ", "1 2 3 4 5 6 7\n"])):
        rows = [(i, "".join(rnd.choices(parts, k=rnd.randrange(25)))) for i in range(150)]
        df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_removed int")
        for least, words in ((2, 6), (3, 9), (2, 20)):
            assert got(drop_repeated_spans(df, least, words)) == brute(rows, least, words, every=every)


def test_one_long_sentence(spark):
    passage = " ".join(f"w{i}" for i in range(55))
    df = spark.createDataFrame([(1, f"First. {passage}."), (2, f"Other here.\n{passage}.\nTail.")], "doc_id long, text string")
    assert got(drop_repeated_spans(df))[2][0] == "Other here.\nTail."


def test_edges(spark):
    passage = "One two three four five six. Seven eight nine ten eleven. Twelve thirteen fourteen fifteen sixteen seventeen. Eighteen nineteen twenty. "
    rows = [(1, "Own words here. " + passage + "And more."), (2, None), (3, ""), (4, "  lead.\n" + passage.upper() + "tail stays"), (5, passage * 2), (6, " ".join(f"x{i}" for i in range(100000)) + ". " + passage), (7, "short. short. short. short.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = got(drop_repeated_spans(df))
    assert out[1][0] == rows[0][1] and out[2][0] == "" and out[7][2] == 0
    assert out[4][0] == "  lead.\ntail stays" and out[5][0] == "" and out[6][0] == rows[5][1][:-len(passage)]
    nulls = spark.createDataFrame([(None, passage), (None, passage), (9, passage), (9, passage)], "doc_id long, text string")
    assert [r.n_removed for r in drop_repeated_spans(nulls).collect()] == [0, 0, 0, 0]
    assert drop_repeated_spans(df.where("false")).count() == 0


def test_short_last_sentences(spark):
    passage = " ".join(f"w{i}" for i in range(18)) + ". " + " ".join(f"v{i}" for i in range(15)) + ". Short one. And another. "
    df = spark.createDataFrame([(1, passage + "Own end of the first."), (2, "Lead of the second. " + passage + "Its end."), (3, passage)], "doc_id long, text string")
    out = got(drop_repeated_spans(df))
    assert out[1][2] == 0 and out[2][0] == "Lead of the second. Its end." and out[3][0] == ""


def test_unequal_lead_ins(spark):
    passage = " ".join(f"w{i}" for i in range(300))
    phrase = "0 1 " * 150
    rows = [(1, f"{passage} and on."), (2, f"As X said {passage} x y z."), (3, f"One. Or {passage}"), (4, " ".join(f"l{i}" for i in range(40)) + f" {passage} " + " ".join(f"t{i}" for i in range(40)))]
    rows += [(11, f"a {phrase} b"), (12, f"c d e f g {phrase} h i.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = got(drop_repeated_spans(df))
    own = set(passage.split())
    assert out[1][2] == 0
    for k in (2, 3, 4):
        words = out[k][0].split()
        assert len([w for w in words if w in own]) < 40
        assert [w for w in words if w not in own] == [w for w in rows[k - 1][1].split() if w not in own]
    assert len(out[12][0].split()) < 50 and out[12][0].startswith("c d e f g ") and out[12][0].endswith(" h i.")


def test_lines_broken_elsewhere(spark):
    words = [f"w{i}" + "." * (i % 12 == 11) for i in range(120)]
    rows = [(k, f"Start{k}.\n" + "".join(w + ("\n" if i % n == n - 1 else " ") for i, w in enumerate(words)) + f"End{k}.") for k, n in ((1, 7), (2, 9), (3, 500))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = got(drop_repeated_spans(df))
    assert out[1][2] == 0 and out[2][0] == "Start2.\nEnd2." and out[3][0] == "Start3.\nEnd3."
