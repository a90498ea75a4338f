"""Token ids of whole texts by a public byte-level vocabulary, with a memory of the pieces between blanks."""

from __future__ import annotations

import itertools
import json
import os
import re

import numpy as np

from lodequarry.llm import shared


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: A piece that opens with the blank before it, holds no other blank and neither begins nor ends with white space otherwise.
_SOLID = re.compile(r" \S([^ ]*\S)?", re.DOTALL)
_TOGETHER = 60
# What a byte says of its character: sure not to be white space (as its first byte), the same in ASCII, a blank, a line's end, a letter or digit of ASCII, another visible sign of ASCII.
_SOME, _PLAIN, _BLANK, _LINE, _LETTER, _SIGN = 1, 2, 4, 8, 16, 32
_BYTES = np.zeros(256, np.uint8)
_BYTES[33:127] = _SOME | _PLAIN | _SIGN
_BYTES[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]] = _SOME | _PLAIN | _LETTER
_BYTES[[32, 10]] = _BLANK, _LINE
_BYTES[0xC3:0xF5] = _SOME
_BYTES[0xE1:0xE4] = 0  # white space beyond ASCII begins with 0xC2 or one of these
# The splitting for which texts may be cut before a blank.
_SPLITTING = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: Bytes that a remembered piece takes beside its letters and ids: a string, a place in a dictionary, two numbers.
_OVERHEAD = 190


class _Memory(dict):
    """Piece -> number; a new piece gets the next number and waits to be encoded."""

    def __init__(self) -> None:
        super().__init__()
        self.waiting: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.waiting.append(piece)
        return n


class TextEncoder:
    """Encodes as the tokenizers library does, without special tokens, piece by piece.

    The vocabulary's splitting pattern (a blank, if any, before letters, digits or other signs; white space but its last blank) tells where a text
    may be cut; equal pieces need the library once only. Cuts are made where bytes are enough to be sure: before a blank that opens white space or
    ends it, before a line's end that opens it, behind a line's end alone, and before a sign that follows a letter or digit.
    New pieces are handed to the library some dozens at a time, one behind the other as in a text; tokens that open with
    a blank tell where each begins. `most` bounds the bytes remembered between calls; beyond it only the pieces that came
    most often stay, up to half of it. A vocabulary that splits otherwise is given whole texts.
    """

    def __init__(self, vocabulary: str, most: int = 192 << 20) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(vocabulary)
        self.lib.encode_special_tokens = True
        self.most = most
        with open(vocabulary, encoding="utf-8") as f:
            said = json.load(f)
        split = said.get("pre_tokenizer") or {}
        added = [t["content"] for t in said.get("added_tokens") or [] if not t.get("special")]  # found in a text before it is split
        self.by_pieces = not said.get("normalizer") and not added and all(split.get(k) == v for k, v in _SPLITTING.items())
        self.opens = np.zeros(self.lib.get_vocab_size(), bool)
        self.opens[[i for t, i in self.lib.get_vocab().items() if t.startswith("Ġ")]] = True  # fixed value: the vocabulary's sign for a blank
        self._forget()

    def _forget(self) -> None:
        self.memory = _Memory()
        self.start = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint16 if len(self.opens) <= 1 << 16 else np.uint32)
        self.hits = np.zeros(1 << 16, np.int64)
        self.used = self.held = 0
        self.memory[None] = 0  # stands for nothing

    def _shrink(self) -> None:
        """Keep the pieces that came most often, twice at least, up to half of the bytes allowed."""
        pieces = list(self.memory)
        hits, start, size, ids = self.hits[: len(pieces)], self.start, self.size, self.ids
        order = np.argsort(-hits, kind="stable")
        order = order[(hits[order] > 1) & (order > 0)]
        room = np.cumsum(np.fromiter((len(pieces[k]) for k in order.tolist()), np.int64, len(order)) + _OVERHEAD + size[order] * ids.itemsize)
        order = order[room <= self.most // 2]
        self._forget()
        self.memory.update(zip([pieces[k] for k in order.tolist()], range(1, len(order) + 1)))
        total = np.concatenate(([0], np.cumsum(size[order])))
        flat = ids[np.repeat(start[order] - total[:-1], size[order]) + np.arange(total[-1])]
        self._grow()
        self._store(np.arange(1, len(order) + 1), flat, size[order])
        self.held = int(room[len(order) - 1]) if len(order) else 0

    def _grow(self) -> None:
        while len(self.memory) > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
            self.hits = np.concatenate([self.hits, np.zeros(len(self.hits), np.int64)])

    def _store(self, numbers: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        while self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.size[numbers] = size
        self.start[numbers] = self.used + np.cumsum(size) - size
        self.ids[self.used : self.used + len(flat)] = flat
        self.held += flat.size * self.ids.itemsize
        self.used += len(flat)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        part = [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, part), np.int64, len(part))
        return np.fromiter(itertools.chain.from_iterable(part), np.int64, int(count.sum())), count

    def _learn(self) -> None:
        new = self.memory.waiting
        first = len(self.memory) - len(new)
        self._grow()
        self.held += sum(map(len, new)) + _OVERHEAD * len(new)
        solid = np.fromiter((_SOLID.fullmatch(p) is not None for p in new), bool, len(new))
        whole, joint = np.flatnonzero(~solid), np.flatnonzero(solid)
        for at in range(0, len(whole), 10_000):
            which = whole[at : at + 10_000]
            self._store(first + which, *self._encoded([new[k] for k in which]))
        for at in range(0, len(joint), 10_000):
            which = joint[at : at + 10_000]
            parts = [new[k] for k in which]
            flat, _ = self._encoded(["".join(parts[k : k + _TOGETHER]) for k in range(0, len(parts), _TOGETHER)])
            begin = np.flatnonzero(self.opens[flat])
            if len(begin) != len(parts):  # a vocabulary that merges otherwise: piece by piece
                self._store(first + which, *self._encoded(parts))
            else:
                self._store(first + which, flat, np.diff(np.append(begin, len(flat))))
        self.memory.waiting = []

    @staticmethod
    def _cut(texts):
        """All pieces of the texts (an Arrow array without nulls), and the first of each text."""
        import pyarrow as pa

        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        if off[0] == off[-1]:
            return pa.array([], pa.large_string()), np.zeros(len(off), np.int64)
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]]
        at = off - off[0]
        kind = _BYTES.take(raw)
        before, after = np.zeros_like(kind), np.zeros_like(kind)
        before[1:], after[:-1] = kind[:-1], kind[1:]
        after[at[1:][at[1:] > 0] - 1] = 0
        accented = np.zeros(len(raw), bool)  # behind a letter of Latin-1: all that open with 0xC3 but the signs of multiplication and division
        accented[2:] = (raw[:-2] == 0xC3) & ((raw[1:-1] & 0xDF) != 0x97)
        cut = (kind & _BLANK > 0) & ((after & _SOME) | (before & _PLAIN) > 0)
        cut |= (kind & _LINE > 0) & (before & _PLAIN > 0)
        cut |= (kind & _SIGN > 0) & ((before & _LETTER > 0) | accented)
        cut[2:] |= (kind[2:] & _SOME > 0) & (kind[1:-1] & _LINE > 0) & (kind[:-2] & _PLAIN > 0)
        cut[at[:-1][at[:-1] < len(raw)]] = True
        begin = np.flatnonzero(cut)
        return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(raw)) + off[0]), texts.buffers()[2]), np.searchsorted(begin, at)

    def encode(self, texts, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (an Arrow string array) behind one another and how many each has; `end` follows each text. Null: empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        if not self.by_pieces:
            flat, count = self._encoded(texts.to_pylist())
            return self._ended(flat.astype(self.ids.dtype), count, end)
        pieces, edge = self._cut(texts)
        coded = pieces.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # pyarrow's own lists of strings take eight times as long
        which = np.fromiter(map(self.memory.__getitem__, words), np.int64, len(words)).take(coded.indices.to_numpy())
        if self.memory.waiting:
            self._learn()
        self.hits[: len(self.memory)] += np.bincount(which, minlength=len(self.memory))
        size = self.size[which]
        total = np.concatenate(([0], np.cumsum(size)))
        flat = self.ids[np.repeat(self.start[which] - total[:-1], size) + np.arange(total[-1])]
        if self.held > self.most:
            self._shrink()
        return self._ended(flat, np.diff(total[edge]), end)

    @staticmethod
    def _ended(flat: np.ndarray, count: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        if end is None:
            return flat, count
        out = np.full(len(flat) + len(count), end, flat.dtype)
        text = np.ones(len(out), bool)
        text[np.cumsum(count + 1) - 1] = False
        out[text] = flat
        return out, count + 1


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(vocabulary: str, most: int = 192 << 20) -> TextEncoder:
    """This worker's encoder; kept from task to task, until an operator that needs none runs here."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = TextEncoder(vocabulary)
    _ENCODERS[vocabulary].most = most
    return _ENCODERS[vocabulary]


shared.HELD.append(_ENCODERS.clear)
