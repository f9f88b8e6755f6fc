"""Whole texts to token ids, each distinct piece of text encoded once by the tokenizers library.

A byte-level BPE never merges across its pre-tokens, so a text's ids are its pre-tokens' ids in order. Pre-tokens are
cut here with numpy over code points; their ids come from the library and are kept by hash of the piece. The bytes of a
piece are compared with the kept ones; should two pieces have one hash, or should a text have code points on which
Unicode versions differ, the library encodes whole texts.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np

from .common import _LOW, Packed, byte_table

#: Pieces that a worker keeps, at most; then it begins anew. Workers live on, and hold about 60 bytes a piece between stages too.
KEPT_PIECES = 600_000
#: Places of the table of pieces at first; it is doubled as they grow, so that a quarter of it at least is free.
TABLE_PLACES = 1 << 12
#: New pieces that are one text to the library.
JOINED_PIECES = 500
#: Bytes with which no white space begins.
_NO_WHITE = byte_table([*range(0x09, 0x0E), 0x20, 0xC2, 0xE1, 0xE2, 0xE3])
_OTHER, _LETTER, _NUMBER, _SPACE, _EDGE = range(5)
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: np.ndarray | None = None
_doubtful: np.ndarray | None = None
_encoders: dict[str, Encoder] = {}


def _class_table() -> np.ndarray:
    global _classes
    if _classes is None:
        first = {"L": _LETTER, "N": _NUMBER}
        _classes = np.array([first.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)], dtype=np.uint8)
        _classes[_WHITE] = _SPACE
    return _classes


def _doubtful_table() -> np.ndarray:
    """Code points that Unicode versions class differently, or may: letters and numbers newer than 3.2, and unassigned ones."""
    global _doubtful
    if _doubtful is None:
        old, now = unicodedata.ucd_3_2_0.category, unicodedata.category
        named = lambda x: x[0] if x[0] in "LN" else ""
        _doubtful = np.array([now(c) == "Cn" or named(now(c)) != named(old(c)) for c in map(chr, range(0x110000))], dtype=bool)
    return _doubtful


def is_doubtful(text: bytes) -> bool:
    """Whether the cuts of a text may depend on the Unicode version; such texts go through the library whole."""
    if text.isascii():
        return False
    return bool(_doubtful_table()[np.frombuffer(text.decode("utf-8").encode("utf-32-le"), dtype="<u4")].any())


def _words_at(raw: bytes | bytearray) -> np.ndarray:
    """The eight bytes from each byte on; raw ends in eight bytes of filling."""
    return np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))


def _same_bytes(a: bytes, at_a: np.ndarray, b: bytes | bytearray, at_b: np.ndarray, n: np.ndarray) -> bool:
    """Whether all spans of n bytes at at_a in a and at at_b in b are equal."""
    x, y = _words_at(a), _words_at(b)
    if ((x[at_a] ^ y[at_b]) & _LOW[np.minimum(n, 8)]).any():
        return False
    left, at = np.flatnonzero(n > 8), 8
    while len(left):
        mask = _LOW[np.minimum(n[left] - at, 8)]
        if ((x[at_a[left] + at] ^ y[at_b[left] + at]) & mask).any():
            return False
        at += 8
        left = left[n[left] > at]
    return True


def pre_tokens(packed: Packed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end bytes of the pre-tokens, and the number of the first one of each text (and the count).

    Cuts as the usual byte-level pattern does: contractions after an apostrophe; runs of letters, of numbers, of
    anything else, each with one blank before it; white space, its last character left to what follows.
    """
    cp = np.frombuffer(packed.bytes.decode("utf-8").encode("utf-32-le"), dtype="<u4")
    off = np.concatenate([[0], np.cumsum(1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000), dtype=np.int64)])
    cls = _class_table()[cp]
    edges = np.searchsorted(off, packed.first - 1)
    cls[edges] = _EDGE
    cls[edges[-1] :] = _EDGE
    begins = np.concatenate([[True], cls[1:] != cls[:-1]])
    runs = np.flatnonzero(begins)
    ends = np.append(runs[1:], len(cls))
    space = (cls[runs] == _SPACE) & (ends < len(cls))
    a, b = runs[space], ends[space]
    inner = cls[b] != _EDGE
    a, b = a[inner], b[inner]
    begins[b[b - a > 1] - 1] = True
    begins[b[cp[b - 1] == 0x20]] = False
    lone = runs[(cls[runs] == _OTHER) & (ends - runs == 1)]
    lone = lone[(cp[lone] == 0x27) & begins[lone] & (cls[lone + 1] == _LETTER)]
    if len(lone):
        x, y = cp[lone + 1], cp[lone + 2]
        two = np.isin(x, [ord(c) for c in "stmd"])
        three = ((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l")))
        for at, n in ((lone[two], 2), (lone[three & ~two], 3)):
            begins[at + 1] = False
            begins[(at + n)[cls[at + n] == _LETTER]] = True
    starts = np.flatnonzero(begins)
    stops = np.append(starts[1:], len(cls))
    real = cls[starts] != _EDGE
    starts, stops = starts[real], stops[real]
    return off[starts], off[stops], np.searchsorted(starts, edges)


def _added(array: np.ndarray, n: int, new: np.ndarray) -> np.ndarray:
    """array with new from place n on; it grows by half at least, so that adding little by little copies little, and its unused end is never touched."""
    if n + len(new) > len(array):
        array, old = np.empty(n + max(len(new), n // 2), dtype=array.dtype), array
        array[:n] = old[:n]
    array[n : n + len(new)] = new
    return array


class Encoder:
    """Encodes like Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.added = [x["content"].encode() for x in spec.get("added_tokens", [])]
        size = self.tokenizer.get_vocab_size()
        #: Bytes of text that each id stands for (byte-level vocabularies write a byte as one character).
        self.id_bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], dtype=np.int64)
        self._clear()

    def _clear(self) -> None:
        #: Hashes of `kept` pieces; the number of each stands in table at its hash's place, or at the next free one.
        self.kept, self.hashes, self.table = 0, np.empty(0, dtype=np.uint64), np.full(TABLE_PLACES, -1, dtype=np.int32)
        #: Of each piece: where its ids begin in flat, how many there are, where its bytes begin in raw, how many there are.
        self.ids_kept, self.flat, self.raw = 0, np.empty(0, dtype=np.uint16), bytearray(8)
        self.at, self.raw_at = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.n, self.raw_n = np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int32)

    @property
    def keys(self) -> np.ndarray:
        return self.hashes[: self.kept]

    def _numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of the kept piece with each hash, -1 where there is none."""
        last = len(self.table) - 1
        place = (keys & np.uint64(last)).astype(np.int64)
        out = self.table[place]
        left = np.flatnonzero(out >= 0)
        left = left[self.hashes[out[left]] != keys[left]]
        while len(left):
            place[left] = (place[left] + 1) & last
            out[left] = own = self.table[place[left]]
            left = left[(own >= 0) & (self.hashes[own] != keys[left])]
        return out

    def _enter(self, keys: np.ndarray) -> None:
        """Numbers new hashes, all different, from `kept` on."""
        left = np.arange(self.kept, self.kept + len(keys))
        self.hashes, self.kept = _added(self.hashes, self.kept, keys), self.kept + len(keys)
        if 4 * self.kept > 3 * len(self.table):
            self.table, left = np.full(1 << (2 * self.kept - 1).bit_length(), -1, dtype=np.int32), np.arange(self.kept)
        last = len(self.table) - 1
        place = (self.hashes[left] & np.uint64(last)).astype(np.int64)
        while len(left):
            free = self.table[place] < 0
            self.table[place[free]] = left[free]
            lost = self.table[place] != left
            left, place = left[lost], (place[lost] + 1) & last

    def _direct(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _direct_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, flat, and how many each text has."""
        ids = self._direct(texts)
        return np.array([i for x in ids for i in x], dtype=np.uint32), np.array([len(x) for x in ids], dtype=np.int64)

    def _joined(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As _direct_flat, for pieces that each begin with a blank and have no other white space.

        However they are joined, they are cut apart at their blanks; so hundreds of them are one text to the library, and
        the bytes that ids stand for tell whose they are. Should ids not end where pieces do, pieces go one by one.
        """
        whole, size = b"".join(spans), np.array([len(x) for x in spans], dtype=np.int64)
        if not any(x in whole for x in self.added):
            flat, _ = self._direct_flat([b"".join(spans[k : k + JOINED_PIECES]).decode("utf-8") for k in range(0, len(spans), JOINED_PIECES)])
            ends, stops = np.cumsum(self.id_bytes[flat]), np.cumsum(size)
            last = np.searchsorted(ends, stops)
            if len(ends) and ends[-1] == stops[-1] and (ends[last] == stops).all():
                return flat, np.diff(last, prepend=-1)
        return self._direct_flat([x.decode("utf-8") for x in spans])

    def _places(self, packed: Packed, starts: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
        """Where each piece's ids are kept; None if a piece has the hash of another, which its bytes tell."""
        keys, sizes = packed.hashes(starts, ends, 3), ends - starts
        where = self._numbers(keys)
        missing = np.flatnonzero(where < 0)
        if len(missing):
            new, first = np.unique(keys[missing], return_index=True)
            if self.kept + len(new) > KEPT_PIECES:
                self._clear()
                missing = np.arange(len(keys))
                new, first = np.unique(keys, return_index=True)
            begin, size = starts[missing[first]], sizes[missing[first]]
            apart = (packed.buf[begin] == 0x20) & (size > 1) & _NO_WHITE[packed.buf[begin + 1]]
            order = np.argsort(~apart, kind="stable")
            begin, size, joined = begin[order], size[order], int(apart.sum())
            spans = [packed.bytes[a : a + b] for a, b in zip(begin.tolist(), size.tolist(), strict=True)]
            flat, n = self._joined(spans[:joined]) if joined else self._direct_flat([])
            rest = self._direct_flat([x.decode("utf-8") for x in spans[joined:]])
            flat, n = np.concatenate([flat, rest[0]]), np.concatenate([n, rest[1]])
            if self.flat.dtype == np.uint16 and flat.max(initial=0) > 0xFFFF:
                self.flat = self.flat.astype(np.uint32)
            self.at = _added(self.at, self.kept, self.ids_kept + np.cumsum(n) - n)
            self.raw_at = _added(self.raw_at, self.kept, len(self.raw) - 8 + np.cumsum(size) - size)
            self.n, self.raw_n, self.flat = _added(self.n, self.kept, n), _added(self.raw_n, self.kept, size), _added(self.flat, self.ids_kept, flat)
            self.raw[-8:] = b"".join([*spans, b"\0" * 8])
            self.ids_kept += len(flat)
            self._enter(new[order])
            where[missing] = self._numbers(keys[missing])
        if (self.raw_n[where] != sizes).any() or not _same_bytes(packed.bytes, starts, self.raw, self.raw_at[where], sizes):
            return None
        return where

    def _pieces(self, texts: list[bytes | None]) -> tuple[list[bytes], dict[int, list[int]], np.ndarray | None, np.ndarray]:
        """Texts as UTF-8, the ids of those that go whole, where the ids of the others' pieces are kept (None: nowhere), and each text's first piece."""
        texts = [t or b"" for t in texts]
        try:
            b"\n".join(texts).decode("utf-8")
        except UnicodeDecodeError:
            texts = [t.decode("utf-8", "replace").encode() for t in texts]
        apart = lambda t: not self.by_piece or any(x in t for x in self.added) or is_doubtful(t)
        whole = [i for i, t in enumerate(texts) if apart(t)] if apart(b"\n".join(texts)) else []
        direct = dict(zip(whole, self._direct([texts[i].decode("utf-8") for i in whole]), strict=True)) if whole else {}
        packed = Packed([b"" if i in direct else t for i, t in enumerate(texts)], None)
        starts, ends, first = pre_tokens(packed)
        return texts, direct, self._places(packed, starts, ends) if len(starts) else np.empty(0, dtype=np.int64), first

    def lengths(self, texts: list[bytes | None]) -> np.ndarray:
        """How many ids each text has, as `encode` gives them; the ids themselves are not laid out."""
        texts, direct, where, first = self._pieces(texts)
        if where is None:
            return np.array([len(x) for x in self._direct([t.decode("utf-8") for t in texts])], dtype=np.int64)
        out = np.diff(np.concatenate([[0], np.cumsum(self.n[where])])[first])
        for i, ids in direct.items():
            out[i] = len(ids)
        return out

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, flat, and each text's bounds in them. Bytes that are no UTF-8 are replaced."""
        texts, direct, where, first = self._pieces(texts)
        if where is None:
            parts = [np.array(x, dtype=np.uint32) for x in self._direct([t.decode("utf-8") for t in texts])]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        n, at = self.n[where], self.at[where]
        begin = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(at - begin[:-1], n) + np.arange(begin[-1])].astype(np.uint32) if len(n) else np.empty(0, dtype=np.uint32)
        bounds = begin[first]
        if direct:
            parts = [np.array(direct[i], dtype=np.uint32) if i in direct else ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, bounds


def encoder(path: str) -> Encoder:
    """The worker's own encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
