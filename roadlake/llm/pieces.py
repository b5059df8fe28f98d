"""Pre-token pieces of byte-level BPE texts: BPE never merges across them.

Whole Arrow batches of texts are cut at once, on arrays of character classes, by the rules of the
vocabulary's own pattern: runs of letters, of digits or of other signs, each with the one space before it;
white space but for that; contractions after an apostrophe. Texts with characters past LATIN_END or with
special strings go through the tokenizer's own splitter, so that Unicode tables cannot differ.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex

from roadlake.llm import words as W
from roadlake.llm.base import ragged, utf8

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: First character that the arrays leave to the tokenizer, and the least lead byte of such.
LATIN_END, _LEAD_END = 0x240, 0xC9
_BEYOND = re.compile(f"[{chr(LATIN_END)}-\U0010ffff]")
_LETTER, _DIGIT, _OTHER, _SPACE = range(4)


def _classes() -> np.ndarray:
    kinds = [(regex.compile(p), k) for p, k in ((r"\p{L}", _LETTER), (r"\p{N}", _DIGIT), (r"\s", _SPACE))]
    return np.array([next((k for p, k in kinds if p.fullmatch(chr(c))), _OTHER) for c in range(LATIN_END)], np.uint8)


_CLASS = _classes()


def boundaries(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte starts of all pieces of texts of Latin characters, in order; each text begins one."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    code = data.astype(np.uint16)
    lead = np.flatnonzero(data >= 0xC0)
    code[lead] = (code[lead] & 0x1F) << 6 | (code[lead + 1] & 0x3F)
    kind = _CLASS[np.minimum(code, LATIN_END - 1)]
    kind[lead + 1] = kind[lead]
    first = np.zeros(n + 1, bool)
    first[off] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    run = start.copy()
    # White space before something else: its last character stands alone, or goes with what follows if a space.
    after = np.flatnonzero(run & ~first[:n] & (kind != _SPACE))
    after = after[kind[after - 1] == _SPACE]
    start[after - 1 - ((data[after - 1] & 0xC0) == 0x80)] = True
    start[after[data[after - 1] == 32]] = False
    # Contractions: a lone apostrophe that begins a piece, and one or two letters.
    at = np.flatnonzero((data == 39) & start)
    follows = lambda k: (at + k < n) & ~first[np.minimum(at + k, n)]
    at = at[follows(1)]
    at = at[run[at + 1] & (kind[at + 1] == _LETTER)]
    one = data[at + 1]
    two = np.where(follows(2), data[np.minimum(at + 2, n - 1)], 0)
    size = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 1, 0)
    size[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))] = 2
    at, size = at[size > 0], size[size > 0]
    start[at + 1] = False
    rest = at + 1 + size
    rest = rest[rest < n]
    start[rest] = True  # what stands there begins a piece in any case
    return np.flatnonzero(start)


class Splitter:
    """Splits texts the way the tokenizer file does; ``specials`` (text -> id) come out as themselves."""

    def __init__(self, path: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self._find = regex.compile(public_tokenizers.PATTERN).findall
        self.specials = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self._special = re.compile("(" + "|".join(sorted(map(re.escape, self.specials), key=len, reverse=True)) + ")") if self.specials else None

    def segments(self, text: str) -> list[str]:
        """The text cut at special strings, which stand alone."""
        if self._special is None or not any(s in text for s in self.specials):
            return [text]
        return [s for s in self._special.split(text) if s]

    def pieces(self, text: str) -> list[str]:
        out: list[str] = []
        for segment in self.segments(text):
            if segment in self.specials:
                out.append(segment)
            elif _BEYOND.search(segment):
                out.extend(segment[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(segment))
            else:
                out.extend(self._find(segment))
        return out


class Pieces:
    """Pieces as one stretch of UTF-8 bytes; as a sequence, their strings."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off

    def __len__(self) -> int:
        return len(self.off) - 1

    def __iter__(self) -> Iterator[str]:
        raw = self.data.tobytes()
        return (raw[a:b].decode() for a, b in zip(self.off[:-1].tolist(), self.off[1:].tolist(), strict=True))

    def take(self, at: np.ndarray) -> Pieces:
        size = np.diff(self.off)[at]
        return Pieces(self.data[ragged(self.off[at], size)], np.append(0, np.cumsum(size)))

    def spaced_words(self) -> np.ndarray:
        """Which pieces are one space and Latin letters: side by side in a text they are cut as they are alone."""
        first, n = self.off[:-1], len(self.data)
        wrong = self.data >= _LEAD_END
        lead = np.flatnonzero((self.data >= 0xC0) & ~wrong)
        code = self.data.astype(np.uint16)
        code[lead] = (code[lead] & 0x1F) << 6 | (code[np.minimum(lead + 1, n - 1)] & 0x3F)
        kind = _CLASS[np.minimum(code, LATIN_END - 1)]
        kind[lead + 1] = kind[lead]
        wrong |= kind != _LETTER
        wrong[first] = self.data[first] != 32
        return (np.add.reduceat(wrong, first, dtype=np.int64) == 0) & (np.diff(self.off) > 1)


class Lexicon:
    """Numbers of distinct pieces, kept between batches; ``learn`` is told of the new ones.

    Pieces are told apart by 64 bits of hash, in a table with open places. Beyond ``most`` pieces the
    memory starts anew.
    """

    def __init__(self, splitter: Splitter, most: int):
        self.splitter, self.most = splitter, most
        self._empty()

    def _empty(self) -> None:
        """Hashes (0: an open place) and the number of each: 12 bytes a place, two to eight places a piece."""
        self._size, self._bits = 0, 16
        self._keys, self._places = np.zeros(1 << self._bits, np.uint64), np.zeros(1 << self._bits, np.int32)

    def __len__(self) -> int:
        return self._size

    def cut(self, column: pa.Array, forget, learn) -> tuple[np.ndarray, np.ndarray]:
        """The piece numbers of all texts of a column, and the first piece of each (with the end)."""
        if len(self) > self.most:
            self._empty()
            forget()
        data, off = utf8(column)
        odd = np.zeros(len(column), bool)
        odd[np.searchsorted(off, np.flatnonzero(data >= _LEAD_END), "right") - 1] = True
        raw = data.tobytes()
        for s in self.splitter.specials:
            odd[[int(np.searchsorted(off, m.start(), "right")) - 1 for m in re.finditer(re.escape(s.encode()), raw)]] = True
        if odd.any():
            return self._slowly(column, learn)
        starts = boundaries(data, off)
        return self._numbers(Pieces(data, np.append(starts, len(data))), learn), np.searchsorted(starts, off)

    def _slowly(self, column: pa.Array, learn) -> tuple[np.ndarray, np.ndarray]:
        """Text by text, by the tokenizer's own splitter."""
        split = [self.splitter.pieces(t) if t else [] for t in column.to_pylist()]
        flat = [p.encode() for s in split for p in s]
        off = np.append(0, np.cumsum([len(p) for p in flat])).astype(np.int64)
        pieces = Pieces(np.frombuffer(b"".join(flat), np.uint8), off)
        return self._numbers(pieces, learn), np.append(0, np.cumsum([len(s) for s in split])).astype(np.int64)

    def _numbers(self, pieces: Pieces, learn) -> np.ndarray:
        """The numbers of pieces, new ones among them learned."""
        hashes = np.maximum(W.Sums(W._BYTE[pieces.data], 0).hash(pieces.off[:-1], pieces.off[1:]), np.uint64(1))
        at, known = self._find(hashes)
        if known.all():
            return self._places[at]
        out = np.zeros(len(hashes), np.int32)
        out[known] = self._places[at[known]]
        unknown = np.flatnonzero(~known)
        new, where, back = np.unique(hashes[unknown], return_index=True, return_inverse=True)
        learn(pieces.take(unknown[where]))
        numbers = np.arange(self._size, self._size + len(new), dtype=np.int32)
        out[unknown] = numbers[back]
        self._size += len(new)
        self._add(new, numbers)
        return out

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each hash, or the open place where the search for it ends; and whether it is there."""
        at = (hashes >> np.uint64(64 - self._bits)).view(np.int64)
        found = self._keys.take(at)
        known = found == hashes
        going = np.flatnonzero(~known & (found != 0))
        while len(going):
            on = at[going] = (at[going] + 1) & (len(self._keys) - 1)
            found = self._keys[on]
            known[going] = same = found == hashes[going]
            going = going[~same & (found != 0)]
        return at, known

    def _add(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Puts distinct hashes that are not in the table into it."""
        if 2 * self._size > len(self._keys):
            old = np.flatnonzero(self._keys)
            hashes, numbers = np.append(self._keys[old], hashes), np.append(self._places[old], numbers)
            while 2 * self._size > 1 << self._bits:
                self._bits += 2
            self._keys, self._places = np.zeros(1 << self._bits, np.uint64), np.zeros(1 << self._bits, np.int32)
        while len(hashes):
            at, _ = self._find(hashes)
            self._keys[at] = hashes  # of several that want a place the last one has it
            won = self._keys[at] == hashes
            self._places[at[won]] = numbers[won]
            hashes, numbers = hashes[~won], numbers[~won]


class Growing:
    """An array that is appended to in place."""

    def __init__(self, dtype):
        self._room, self.size = np.zeros(1024, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self._room):
            room = np.zeros(max(need, 2 * len(self._room)), self._room.dtype)
            room[: self.size] = self._room[: self.size]
            self._room = room
        self._room[self.size : need] = values
        self.size = need

    @property
    def values(self) -> np.ndarray:
        return self._room[: self.size]
