import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quayside.llm.token_counts import OUTSIDE, RULES, attribute, line_sections, section_tokens, with_spans
from quayside.llm.token_files import TokenFile, TokenReader, pack, read_token_files, token_output, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_codes_round_trip():
    rng = np.random.default_rng(4)
    for ids in (np.array([], dtype=np.uint32), np.array([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1], dtype=np.uint32), rng.integers(0, 50257, 5000).astype(np.uint32), np.full(700, 3, dtype=np.uint32)):
        file = TokenFile(pack(np.array([True, False]), np.array([7, 0]), np.array([0, len(ids) // 2, len(ids)]), ids))
        assert (file.ids() == ids).all()
        assert [file.token(i) for i in range(len(ids))] == ids.tolist()
        assert (file.document(1) == ids[len(ids) // 2 :]).all()
        with pytest.raises(IndexError):
            file.token(len(ids))
    with pytest.raises(ValueError):
        TokenFile(b"x" * 64)


def places(rows, library):
    out, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return sorted(out, key=repr)


def test_whole_table(spark, library):
    docs = spark.read.parquet(DOCUMENTS)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in token_output(docs, PATH).collect()), key=repr) == places(rows, library)


def test_edges(spark, library, tmp_path):
    rows = [(5, "five"), (None, "none"), (1, None), (3, ""), (3, "twice"), (3, "twice"), (-4, "long words " * 30000), (2**40, "x<|endoftext|>")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, start int, part int")
    assert sorted((tuple(r) for r in token_output(df, PATH).collect()), key=repr) == places(rows, library)
    assert token_output(df.where("false"), PATH).count() == 0
    images = write_token_files(df, str(tmp_path / "files"), PATH, segment_tokens=10)
    assert images.count() > 1 and images.agg({"n_documents": "sum"}).first()[0] == len(rows)


def test_files_by_offset(spark, library, tmp_path):
    """Any token of a file by its offset, without reading the file; orphans of lost attempts do not count."""
    docs = spark.read.parquet(DOCUMENTS)
    files = write_token_files(docs, str(tmp_path / "files"), PATH, segment_tokens=20_000)
    rows = files.collect()
    assert len(rows) > 3 and len(list((tmp_path / "files" / "data").iterdir())) == len(rows)
    rnd = random.Random(3)
    for r in rnd.sample(rows, 3):
        name = r.path.removeprefix("file:")
        whole, reader = TokenFile(open(name, "rb").read()), TokenReader(r.path)
        ids = whole.ids()
        assert len(ids) == r.n_tokens == reader.n_tokens
        for i in [0, r.n_tokens - 1, *rnd.sample(range(r.n_tokens), 50)]:
            assert reader.token(i) == ids[i] == whole.token(i)
        assert reader.document(r.n_documents - 1) == ids[whole.bounds[-2] :].tolist()
        with pytest.raises(IndexError):
            reader.token(r.n_tokens)
        reader.close()
    (tmp_path / "files" / "data" / "tokens-000000-000000-999.qdac").write_bytes(b"x" * 64)
    assert read_token_files(files).count() == docs.count()


def test_many_rows_of_one_id(spark, library):
    """Rows of one doc_id are spread by their texts and keep their order."""
    rows = [(7 if i % 3 else None, f"{chr(97 + i % 26)} text {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in token_output(df, PATH).collect()), key=repr) == places(rows, library)


def brute(text, spans, rule, library):
    """Byte by byte."""
    own = []
    for i, c in enumerate(text):
        name = next((n for n, a, b in sorted(spans, key=lambda s: (s[1], s[2], s[0])) if a <= i < b), OUTSIDE)
        own += [name] * len(c.encode())
    ids = library.encode(text, add_special_tokens=False).ids
    out, at = {}, 0
    for i in ids:
        n = len(library.id_to_token(i))
        names = own[at : at + n]
        # A stretch is a run of bytes with one owner; the same name may come again later.
        if rule == "first":
            shares = {names[0]: 1.0}
        elif rule == "last":
            shares = {names[-1]: 1.0}
        elif rule == "split":
            shares = {x: names.count(x) / n for x in names}
        else:
            runs = []
            for x in names:
                runs = [*runs[:-1], (x, runs[-1][1] + 1)] if runs and runs[-1][0] == x else [*runs, (x, 1)]
            shares = {max(runs, key=lambda r: r[1])[0]: 1.0}
        for k, v in shares.items():
            out[k] = out.get(k, 0) + v
        at += n
    return out


@pytest.mark.parametrize("rule", RULES)
def test_against_bytes(rule, library):
    rnd = random.Random(2)
    for _ in range(200):
        text = "".join(rnd.choices(["the", " word", "é", "日本", "😀", "\n", "|", "stand", " 12"], k=rnd.randrange(12)))
        spans, at = [], 0
        for k in range(rnd.randrange(5)):
            a = at + rnd.randrange(4)
            at = a + rnd.randrange(1, 6)
            spans.append((f"s{k}", a, at))
        ids = library.encode(text, add_special_tokens=False).ids
        got = {n: t for n, t, _, _ in attribute(text.encode(), np.array([len(library.id_to_token(i)) for i in ids], dtype=np.int64), spans, rule) if t}
        want = brute(text, spans, rule, library)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got), (text, spans)


def test_sections_of_documents(spark, library):
    docs = spark.read.parquet(DOCUMENTS)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {}
    for r in section_tokens(docs, PATH, "most", line_sections).collect():
        got.setdefault(r.doc_id, {})[r.section] = r.n_tokens
    for d, t in texts.items():
        assert {k: v for k, v in got[d].items() if v} == brute(t or "", line_sections(t or ""), "most", library)
    assert section_tokens(docs.where("false"), PATH, "most", line_sections).count() == 0


def test_given_spans(spark):
    docs = spark.createDataFrame([(1, "alpha beta", 1), (2, None, 1), (3, "", 1), (4, "no spans", 1), (None, "x", 1)], "doc_id long, text string, n_tokens int")
    spans = spark.createDataFrame([(1, "a", 0, 5), (1, "a", 0, 5), (1, "b", 3, 99), (1, None, 0, 1), (9, "z", 0, 1)], "doc_id long, section string, start int, end int")
    rows = sorted(((r.doc_id or 0, r.section, r.n_tokens) for r in section_tokens(with_spans(docs, spans), PATH).collect()))
    assert [x[:2] for x in rows] == [(0, OUTSIDE), (1, "a"), (1, "b"), (2, OUTSIDE), (3, OUTSIDE), (4, OUTSIDE)]
    assert section_tokens(with_spans(docs.where("false"), spans), PATH).count() == 0
    with pytest.raises(ValueError):
        section_tokens(docs, PATH, "nearest")
