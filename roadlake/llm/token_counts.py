"""Exact token counts of every prefix by dynamic programming over a byte-level BPE vocabulary.

The tokens of a prefix are the tokens of a shorter prefix and one last token. A sequence of tokens is what
BPE yields if each adjacent pair is, so the last token of a prefix is the vocabulary entry that ends it and
fits the last token of what comes before. One pass over a piece thus gives the count of all its prefixes;
BPE never merges across pieces, so a text needs the counts at its piece ends and the tables of its pieces.
Truncation and budget questions are answered from those, without encoding again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlake.llm.base import column, steps
from roadlake.llm.pieces import Growing, Lexicon, Pieces, Splitter

LIMIT = 1024
#: Pieces whose count, and pairs of tokens whose fit, a worker remembers; beyond it the memory starts anew.
REMEMBERED = 300_000
_CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")  # fixed values: the pattern's own


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else 256 and up."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixCounter:
    def __init__(self, path: str):
        self.splitter = Splitter(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        plain = lambda t: bytes(letters[c] for c in t)
        specials = set(self.splitter.specials)
        self._tokens = {plain(t) for t in model["vocab"] if t not in specials}
        self._rank = {tuple(map(plain, m.split(" ") if isinstance(m, str) else m)): i for i, m in enumerate(model["merges"])}
        # Lengths of the tokens of three bytes or more that end alike, longest first; shorter ones are always tried.
        tails: dict[bytes, set[int]] = {}
        for token in self._tokens:
            if len(token) > 2:
                tails.setdefault(token[-3:], set()).add(len(token))
        self._tails = {tail: (*sorted(sizes, reverse=True), 2, 1) for tail, sizes in tails.items()}
        self._fits: dict[tuple[bytes, bytes], bool] = {}
        self._lexicon = Lexicon(self.splitter, REMEMBERED)
        self._forget()

    def _forget(self) -> None:
        self._counts = Growing(np.int64)

    def _learn(self, pieces: Pieces) -> None:
        self._counts.extend(np.array([self.count_piece(p) for p in pieces], np.int64))

    def count_all(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text of a column."""
        numbers, first = self._lexicon.cut(column, self._forget, self._learn)
        sums = np.append(0, np.cumsum(self._counts.values[numbers]))
        return sums[first[1:]] - sums[first[:-1]]

    def _merged(self, raw: bytes) -> list[bytes]:
        """BPE of a short string: used on two tokens at a time only."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best = min(((self._rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1)))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, left: bytes, right: bytes) -> bool:
        """Whether BPE leaves the two tokens as they are; an empty left asks for a token of its own."""
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= REMEMBERED:
                self._fits.clear()
            known = self._fits[key] = self._merged(left + right) == ([left, right] if left else [right])
        return known

    def table(self, piece: str) -> list[int]:
        """Token counts of all byte prefixes of one piece, from the empty one."""
        raw = piece.encode()
        n, tokens, tails, fits = len(raw), self._tokens, self._tails, self._fits
        last, count = [b""] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            for size in tails.get(raw[max(0, end - 3) : end], (2, 1)):
                start = end - size
                token = raw[start:end] if start >= 0 else b""
                if token in tokens:
                    key = (last[start], token)
                    ok = fits.get(key)
                    if ok is None:
                        ok = self.fits(*key)
                    if ok:
                        last[end], count[end] = token, count[start] + 1
                        break
            else:
                raise ValueError(f"no token ends {piece!r} at byte {end}")
        return count

    def count_piece(self, piece: str) -> int:
        return 1 if piece in self.splitter.specials else self.table(piece)[-1]

    def count(self, text: str | None) -> int:
        return sum(map(self.count_piece, self.splitter.pieces(text))) if text else 0

    def boundaries(self, text: str | None) -> tuple[list[int], list[int]]:
        """Character ends of all pieces and the tokens up to each."""
        ends, counts, at, n = [], [], 0, 0
        for p in self.splitter.pieces(text or ""):
            at, n = at + len(p), n + self.count_piece(p)
            ends.append(at)
            counts.append(n)
        return ends, counts

    def count_prefix(self, text: str, ends: list[int], counts: list[int], chars: int) -> int:
        """Exact tokens of ``text[:chars]`` alone, from the stored boundaries and one piece's table.

        A prefix ends inside one piece; its own split differs from the text's only in a trailing run of
        white space (one piece), in a cut contraction (an apostrophe and letters) and in a cut special
        string (plain text, counted by pieces from the special string before it).
        """
        from bisect import bisect_left

        chars = min(chars, len(text))
        if chars <= 0:
            return 0
        k = bisect_left(ends, chars)
        start = ends[k - 1] if k else 0
        piece = text[start : ends[k]]
        if piece in self.splitter.specials and chars == ends[k]:
            return counts[k]
        tail = chars
        while tail and text[tail - 1].isspace() and text[tail - 1] not in "\x1c\x1d\x1e\x1f":
            tail -= 1
        if tail < chars:
            return self.count_prefix(text, ends, counts, tail) + self.count_piece(text[tail:chars])
        cut = text[start:chars]
        before = counts[k - 1] if k else 0
        if piece in self.splitter.specials:  # a cut one is plain text, and joins what stands before it
            begin = k
            while begin and text[ends[begin - 2] if begin > 1 else 0 : ends[begin - 1]] not in self.splitter.specials:
                begin -= 1
            return (counts[begin - 1] if begin else 0) + self.count(text[ends[begin - 1] if begin else 0 : chars])
        if piece in _CONTRACTIONS and len(cut) < len(piece):
            return before + self.count(cut)
        return before + self.table(piece)[len(cut.encode())]


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The worker's counter for a vocabulary file; tables are kept between batches."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in steps(batches):
            n = pa.array(c.count_all(column(batch, "text")))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").cast(pa.int64()), column(batch, "n_bytes").cast(pa.int64()), n], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens and over_limit; null texts are empty."""
    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = sized.mapInArrow(_counts(path), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def _tables(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in steps(batches):
            rows = [c.boundaries(t) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id").cast(pa.int64()), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], names=["doc_id", "ends", "counts"]
            )

    return run


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ends, counts: character ends of the pieces of each text and the exact tokens up to each."""
    return docs.select("doc_id", "text").mapInArrow(_tables(path), "doc_id long, ends array<int>, counts array<int>")


def fitting_chars(prefixes: DataFrame, budget: int) -> DataFrame:
    """doc_id, chars: the longest prefix that ends with a piece and takes ``budget`` tokens at most."""
    within = F.size(F.filter("counts", lambda c: c <= budget))
    return prefixes.select("doc_id", F.when(within > 0, F.element_at("ends", within)).otherwise(0).alias("chars"))
