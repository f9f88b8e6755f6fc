import random

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from quayside.llm.encode import Encoder, is_doubtful, pre_tokens
from quayside.llm.common import Packed


@pytest.fixture(scope="module")
def pair():
    path = public_tokenizers.path("byte_bpe_50k.json")
    return Encoder(path), Tokenizer.from_file(path)


def same(pair, texts):
    own, library = pair
    ids, bounds = own.encode([None if t is None else t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_cases(pair):
    same(pair, [None, "", " ", "  ", "\n", "a", "a ", " a", "a  b", "a \n b", "a\n\nb", "don't", "don''t", "I'll've 'em 'sA 's", " 's", "x'", "'", "''", "'re'", "'r", "12ab3 4", "a b", "é ü  ñ", "日本 語x", "😀😀 a", "\x1c\x1da", "<|endoftext|> a", "a<|endoftext|>", "Ⅷ ²x", "ǅ", "á", "　x", "tab\t\tx", "end  ", "end\t"])


def test_random_mixtures(pair):
    rnd = random.Random(11)
    parts = ["a", "B", "the", "'", "'s", "'ll", "ve", " ", "  ", "\n", "\t", ".", "!?", "7", "42", "é", "ß", " ", "日", "😀", " ", "_", "<|", "x" * 300, "²", "ͅ"]
    same(pair, ["".join(rnd.choices(parts, k=rnd.randrange(30))) for _ in range(3000)])


def test_documents(pair, spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    same(pair, texts)
    assert (pair[0].id_bytes[pair[0].encode([t.encode() for t in texts])[0]].sum()) == sum(len(t.encode()) for t in texts)


def test_new_letters_and_equal_hashes(pair, monkeypatch):
    """Letters that not all Unicode versions know go through the library; so does a batch whose pieces clash."""
    same(pair, ["a\u08b6b 1", "x\U0001e922y", "new \u0378 one", "\U0001f600\U0001f600 ok"])
    assert is_doubtful("a\u08b6b".encode()) and not is_doubtful("\U0001f600 é 日本".encode())
    monkeypatch.setattr(Packed, "hashes", lambda self, starts, ends, seed=0: (ends - starts).astype(np.uint64))
    own = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    same((own, pair[1]), ["one two six", "ten"])


def test_new_pieces_are_joined(monkeypatch):
    """Pieces that begin with a blank reach the library many at a time; if ids do not end with them, one by one."""
    rnd, asked = random.Random(5), []
    words = ["".join(rnd.choices("abcdeéhijklmß日", k=rnd.randrange(1, 9))) + rnd.choice(["", "", "", "'s", "."]) for _ in range(3000)]
    texts = [" ".join(words[k : k + 50]) for k in range(0, 3000, 50)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = Encoder(path), Tokenizer.from_file(path)
    direct = own._direct
    monkeypatch.setattr(own, "_direct", lambda texts: asked.append(len(texts)) or direct(texts))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for at in (0, 20, 40, 0):  # kept pieces grow, and are then known
        same((own, library), texts[at : at + 20])
    assert own.kept == len(own.keys) > 2000 and sum(asked) < own.kept * 2 // 3
    own._clear()
    own.id_bytes = own.id_bytes + 1
    assert own.lengths([t.encode() for t in texts]).tolist() == [len(x) for x in want]


def test_pieces_cover_the_text():
    packed = Packed(["ab  c\n".encode(), b"", "é".encode()], None)
    starts, ends, first = pre_tokens(packed)
    assert [packed.bytes[a:b] for a, b in zip(starts, ends)] == [b"ab", b" ", b" c", b"\n", "é".encode()]
    assert first.tolist() == [0, 4, 4, 5]


def test_pieces_whose_hashes_share_a_place(pair, monkeypatch):
    """Numbers of pieces are found where many hashes end alike, while the table grows, and after it was cleared."""
    hashes = Packed.hashes
    monkeypatch.setattr(Packed, "hashes", lambda self, starts, ends, seed=0: hashes(self, starts, ends, seed) << np.uint64(8))
    own = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for at in (0, 3000, 0):
        same((own, pair[1]), [" ".join(f"w{i}" for i in range(at + k, at + k + 100)) for k in range(0, 3000, 100)])
    assert own.keys.tolist() == own.hashes[: own.kept].tolist() and len(own.table) > own.kept > 6000
    assert (own._numbers(own.keys) == np.arange(own.kept)).all() and (own._numbers(own.keys + np.uint64(1)) == -1).all()
    monkeypatch.setattr("quayside.llm.encode.KEPT_PIECES", own.kept + 5)
    same((own, pair[1]), [" ".join("v" + "abcdefghij"[i // 10] + "abcdefghij"[i % 10] for i in range(50)), "w1 w2"])
    assert own.kept < 100


def test_kept_pieces_are_small(pair):
    """A worker that lives on keeps few bytes a piece; ids of large vocabularies are kept whole."""
    own = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    same((own, pair[1]), ["the first few words"])
    assert own.flat.itemsize == 2 and sum(a.itemsize for a in (own.hashes, own.at, own.raw_at, own.n, own.raw_n)) <= 32
    own._direct = lambda texts: [[70_000 + len(t)] for t in texts]
    assert own.encode([b"zqx"])[0].tolist() == [70_003] and own.flat.itemsize == 4
    assert own.encode(["the first few words".encode()])[0].tolist() == pair[1].encode("the first few words", add_special_tokens=False).ids
