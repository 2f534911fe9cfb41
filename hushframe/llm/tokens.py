"""Encoding whole texts with a tokenizer file, one distinct white-space piece at a time.

Both tokenizers used here split a text before merging, and never merge across a single blank or line feed between two
visible characters.  A text is therefore cut at such places (and before a full stop or comma that follows a letter and
ends a piece), each distinct piece is merged once by the tokenizer's own model, and the ids are put together again;
texts with white space or control characters that may matter are encoded whole.  The ids are those of
``Tokenizer.encode(text, add_special_tokens=False)``; the strings of special tokens in a text are ordinary text.

Pieces are cut and looked up for many texts at once: a piece of at most 16 bytes is its own key, in two words.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import regex

#: Characters that send a text to the tokenizer as a whole: controls, other white space, marks that could combine.
IRREGULAR = regex.compile(r"[\p{C}\p{Z}\s\p{M}]")
#: Distinct pieces that a worker remembers; beyond that the rarer half is encoded anew when it comes up again.
MEMORY = 500_000
#: How the two vocabularies split a text before merging. Fixed values.
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The visible letter that byte-level vocabularies write for each byte."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
_ODD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: What stays of an eight-byte word if only its first bytes count.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ALPHA = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])


class KeyTable:
    """Numbers of keys of three words, found and added many at a time; slots in a row hold keys that meet."""

    def __init__(self, most: int):
        bits = max(6, (2 * most - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros((3, 1 << bits), np.uint64)
        self.number = np.full(1 << bits, -1, np.int64)
        self.used = 0

    def _slots(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = key[0] * _ODD ^ (key[1] + key[2] * _ODD) * _STEP
            x = (x ^ (x >> np.uint64(29))) * _ODD
        return (x >> self.shift).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The number of each key (3 rows), or -1."""
        out = np.full(key.shape[1], -1, np.int64)
        slot, todo = self._slots(key), np.arange(key.shape[1])
        while len(todo):
            number = self.number[slot]
            same = (self.keys[0][slot] == key[0][todo]) & (self.keys[1][slot] == key[1][todo]) & (self.keys[2][slot] == key[2][todo]) & (number >= 0)
            out[todo[same]] = number[same]
            on = ~same & (number >= 0)
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return out

    def add(self, key: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        self.used += key.shape[1]
        if 4 * self.used > 3 * len(self.number):  # a search ends at a free slot
            full = self.number >= 0
            old = self.keys[:, full], self.number[full]
            self.__init__(self.used)
            self.add(*old)
            self.used += key.shape[1]
        slot, todo = self._slots(key), np.arange(key.shape[1])
        while len(todo):
            free = np.flatnonzero(self.number[slot] < 0)
            own, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.number[own] = numbers[todo[won]]
            self.keys[:, own] = key[:, todo[won]]
            on = np.ones(len(todo), bool)
            on[won] = False
            todo, slot = todo[on], (slot[on] + 1) & self.mask


class PieceEncoder:
    """Ids of texts; ``blank_matters``: a leading blank is part of the piece (byte-level vocabularies)."""

    def __init__(self, path: str, blank_matters: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.blank = blank_matters
        self.split = regex.compile(BYTE_SPLIT if blank_matters else WORD_SPLIT)
        self.merged: dict[str, list[int]] = {}
        self._clear()

    def _clear(self) -> None:
        self.table = KeyTable(MEMORY)
        self.long: dict[tuple[bytes, int], int] = {}
        self.n = 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.key = np.zeros((3, 1 << 14), np.uint64)
        self.start, self.size, self.hits = (np.zeros(1 << 14, np.int64) for _ in range(3))
        self.whole = np.zeros(1 << 14, bool)

    def _ids(self, piece: str, led: bool) -> list[int] | None:
        """The ids of a piece, or None if texts that hold it have to be encoded whole; ``led``: a blank comes before it."""
        plain = piece.isascii()
        if piece != "\n" and (not plain or not piece.isprintable()) and IRREGULAR.search(piece):
            return None
        if self.blank:
            text = " " + piece if led else piece
        else:  # normalising may make letters or marks, which decide the split, of what it was
            text = piece.lower() if plain else self.tokenizer.normalizer.normalize_str(piece)
        if (piece if self.blank else text).isalpha():
            return self._tokens(text)
        out: list[int] = []
        for part in self.split.findall(text):
            if (got := self.merged.get(part)) is None:
                got = self.merged[part] = self._tokens(part)
            out += got
        return out

    def _tokens(self, part: str) -> list[int]:
        return [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(_LETTERS))]

    def _learn(self, pieces: list[tuple[bytes, int]], keys: np.ndarray) -> np.ndarray:
        """Numbers for pieces not known yet; keys has their words."""
        got = [self._ids(raw.decode(), not kind) for raw, kind in pieces]
        base, top = self.n, self.n + len(got)
        sizes = np.fromiter((len(x or ()) for x in got), np.int64, len(got))
        ids = np.fromiter((i for x in got for i in x or ()), np.uint32, int(sizes.sum()))
        for name, need in (("flat", self.used + len(ids)), *((k, top) for k in ("start", "size", "whole", "hits", "key"))):
            if need > (old := getattr(self, name)).shape[-1]:
                more = np.zeros((*old.shape[:-1], max(need - old.shape[-1], old.shape[-1])), old.dtype)
                setattr(self, name, np.concatenate([old, more], axis=-1))
        self.size[base:top], self.start[base:top] = sizes, self.used + np.cumsum(sizes) - sizes
        self.whole[base:top] = [x is None for x in got]
        self.hits[base:top] = 0
        self.key[:, base:top] = keys
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.n = top
        if len(self.merged) > MEMORY // 4:
            self.merged.clear()
        return np.arange(base, top)

    def _forget(self) -> None:
        """Of too many pieces keep those that came up most, half of the memory at most."""
        if self.n <= MEMORY:
            return
        hits = self.hits[: self.n]
        kept = np.sort(np.argsort(-hits, kind="stable")[: MEMORY // 2])
        kept = kept[hits[kept] > 1]
        key, size, start, whole, hits, flat = self.key[:, kept], self.size[kept], self.start[kept], self.whole[kept], hits[kept] // 2, self.flat
        new = np.full(self.n, -1, np.int64)
        new[kept] = np.arange(len(kept))
        long = {k: int(new[v]) for k, v in self.long.items() if new[v] >= 0}
        self._clear()
        self.n, self.key, self.size, self.whole, self.hits, self.long = len(kept), key, size, whole, hits, long
        self.start = np.cumsum(size) - size
        self.used = int(size.sum())
        self.flat = flat[np.repeat(start - self.start, size) + np.arange(self.used)]
        short = key[2] > 0
        self.table.add(key[:, short], np.flatnonzero(short))

    def _numbers(self, data: bytes, buf: np.ndarray, start: np.ndarray, length: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The number of each piece; unseen ones are learned."""
        words = np.ndarray((len(buf) - 7,), "<u8", data, strides=(1,))
        short = length <= 16
        key = np.zeros((3, len(start)), np.uint64)
        key[0] = words[start] & _FIRST[np.minimum(length, 8)]
        two = np.flatnonzero((length > 8) & short)
        key[1][two] = words[start[two] + length[two] - 8]
        key[2] = np.where(short, 2 * length + kind, 0)
        numbers = np.full(len(start), -1, np.int64)
        at = np.flatnonzero(short)
        numbers[at] = self.table.find(key[:, at])
        raw = lambda i: (data[start[i] : start[i] + length[i]], int(kind[i]))
        fresh = at[numbers[at] < 0]
        if len(fresh):
            order = fresh[np.lexsort(key[:, fresh])]
            own = key[:, order]
            first = np.ones(len(order), bool)
            first[1:] = (own[:, 1:] != own[:, :-1]).any(axis=0)
            one = order[first]
            new = self._learn([raw(i) for i in one.tolist()], key[:, one])
            self.table.add(key[:, one], new)
            numbers[order] = new[np.cumsum(first) - 1]
        rest = np.flatnonzero(~short).tolist()
        if rest:
            pieces = [raw(i) for i in rest]
            unseen = list(dict.fromkeys(p for p in pieces if p not in self.long))
            if unseen:
                self.long.update(zip(unseen, self._learn(unseen, np.zeros((3, len(unseen)), np.uint64)).tolist(), strict=True))
            numbers[rest] = [self.long[p] for p in pieces]
        return numbers

    def __call__(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each followed by ``end``, and the number of ids of each."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        raw = [t.encode() for t in texts]
        stops = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1) - 1
        data = b"\0".join(raw) + b"\0" * 24  # room for words of eight bytes
        buf = np.frombuffer(data, np.uint8)
        cuts = np.flatnonzero(buf[: stops[-1] + 1] < 33)
        value = buf[cuts].astype(np.int64)
        last = np.searchsorted(cuts, stops)
        many = np.diff(last, prepend=-1)  # pieces of each text, empty ones too
        owner = np.repeat(np.arange(len(texts)), many)
        before = np.concatenate([[0], value[:-1]])
        opening = np.zeros(len(cuts), bool)
        opening[last - many + 1] = True
        value[last] = 0
        begin = np.concatenate([[0], cuts[:-1] + 1])
        length = cuts - begin
        closing = np.zeros(len(cuts), bool)
        closing[last] = True
        if self.blank:
            odd = ~closing & (value != 32) & (value != 10) | (length == 0) & ~opening
        else:  # white space does not count
            odd = ~closing & (value != 32) & ((value < 9) | (value > 13))
        odd = np.bincount(owner[odd], minlength=len(texts)) > 0

        line = (before == 10) & ~opening if self.blank else np.zeros(len(cuts), bool)
        full = length > 0
        tail = (length > 1) & np.isin(buf[np.maximum(cuts - 1, 0)], (44, 46)) & _ALPHA[buf[np.maximum(cuts - 2, 0)]]
        units = line.astype(np.int64) + full + tail
        upto = np.cumsum(units)
        total = int(upto[-1])
        start, size, kind = np.empty(total, np.int64), np.ones(total, np.int64), np.ones(total, np.int64)
        at = upto - units
        start[at[line]] = begin[line] - 1
        core = (at + line)[full]
        start[core], size[core] = begin[full], (length - tail)[full]
        kind[core] = (opening | line)[full] if self.blank else 0
        start[upto[tail] - 1] = cuts[tail] - 1

        numbers = self._numbers(data, buf, start, size, kind)
        self.hits[: self.n] += np.bincount(numbers, minlength=self.n)
        first, n_ids = self.start[numbers], self.size[numbers]
        ids_upto = np.concatenate([[0], np.cumsum(n_ids)])
        ids = self.flat[np.repeat(first - ids_upto[:-1], n_ids) + np.arange(ids_upto[-1])]
        unit_upto = upto[last]
        unit_from = np.concatenate([[0], unit_upto[:-1]])
        bad = np.concatenate([[0], np.cumsum(self.whole[numbers])])
        odd |= bad[unit_upto] > bad[unit_from]
        self._forget()
        ends = ids_upto[unit_upto]
        own = ends - ids_upto[unit_from]
        lengths = own + 1
        whole = {int(i): self.tokenizer.encode_batch_fast([texts[i]], add_special_tokens=False)[0].ids if texts[i] else [] for i in np.flatnonzero(odd)}
        for i, x in whole.items():
            lengths[i] = len(x) + 1
        at = np.cumsum(lengths)
        out = np.empty(int(at[-1]), np.uint32)
        out[at - 1] = end
        if not whole:
            keep = np.ones(len(out), bool)
            keep[at - 1] = False
            out[keep] = ids
        else:
            for i in range(len(texts)):
                out[at[i] - lengths[i] : at[i] - 1] = whole[i] if i in whole else ids[ends[i] - own[i] : ends[i]]
        return out, lengths


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, blank_matters: bool) -> PieceEncoder:
    """The encoder of this worker process for a tokenizer file."""
    key = (path, blank_matters)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(*key)
    return _ENCODERS[key]


def runs(texts: list[str], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of at most about ``most`` characters; a longer text is a range of its own."""
    a, chars = 0, 0
    for i, t in enumerate(texts):
        if i > a and chars + len(t) > most:
            yield a, i
            a, chars = i, 0
        chars += len(t)
    if a < len(texts):
        yield a, len(texts)
