"""Rows and order statistics as compact state of streaming processors."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd

#: Values of a page; one that has twice as many is cut in two.
PAGE = 256


class Rows:
    """Rows as a matrix of 64-bit words: time, id, and readings as doubles (missing: NaN)."""

    def __init__(self, columns: Sequence[str], words: np.ndarray):
        self.columns, self.words = list(columns), words

    @staticmethod
    def of(columns: Sequence[str], pdf: pd.DataFrame) -> Rows:
        words = np.empty((len(pdf), 2 + len(columns)), np.int64)
        words[:, 0], words[:, 1] = pdf["us"], pdf["rid"]
        words[:, 2:] = np.ascontiguousarray(pdf[list(columns)].to_numpy(np.float64)).view(np.int64)
        return Rows(columns, words)

    @staticmethod
    def packed(columns: Sequence[str], part: bytes) -> Rows:
        """Packed rows as they stand."""
        return Rows(columns, np.frombuffer(bytes(part), np.int64).reshape(-1, 2 + len(columns)))

    @staticmethod
    def unpack(columns: Sequence[str], parts: Sequence[bytes]) -> Rows:
        """Packed rows in the order of time and id."""
        words = np.frombuffer(b"".join(bytes(p) for p in parts), np.int64).reshape(-1, 2 + len(columns))
        return Rows(columns, words[np.lexsort((words[:, 1], words[:, 0]))])

    @property
    def us(self) -> np.ndarray:
        return self.words[:, 0]

    @property
    def values(self) -> np.ndarray:
        return np.ascontiguousarray(self.words[:, 2:]).view(np.float64)

    def where(self, mask: np.ndarray) -> Rows:
        return Rows(self.columns, self.words[mask])

    def by_slot(self, slot_us: int) -> dict[int, bytes]:
        slots = self.us // slot_us
        return {int(s): self.words[slots == s].tobytes() for s in np.unique(slots)}

    def frame(self) -> pd.DataFrame:
        d, values = pd.DataFrame({"us": self.us, "rid": self.words[:, 1]}), self.values
        return d.assign(**{c: values[:, i] for i, c in enumerate(self.columns)})


class OrderedPages:
    """A multiset of numbers in ascending pages, of which only those that are touched get loaded.

    ``directory`` holds (least value, count, number) of every page.  Inserting, removing and the
    median touch a page or two each, whatever the multiset holds.
    """

    def __init__(self, directory: Sequence[Sequence], load: Callable[[int], bytes]):
        self.lows, self.counts, self.ids = ([d[i] for d in directory] for i in range(3))
        self.load, self.pages, self.gone = load, {}, set()
        self.next_id = max(self.ids, default=-1) + 1

    def _page(self, i: int) -> list[float]:
        number = self.ids[i]
        if number not in self.pages:
            self.pages[number] = np.frombuffer(bytes(self.load(number))).tolist()
        return self.pages[number]

    def insert(self, value: float) -> None:
        if not self.ids:
            self._add(0, [value])
            return
        i = max(bisect_right(self.lows, value) - 1, 0)
        page = self._page(i)
        insort(page, value)
        self.lows[i], self.counts[i] = page[0], len(page)
        if len(page) >= 2 * PAGE:
            rest = page[PAGE:]
            del page[PAGE:]
            self.counts[i] = PAGE
            self._add(i + 1, rest)

    def _add(self, i: int, page: list[float]) -> None:
        self.lows.insert(i, page[0])
        self.counts.insert(i, len(page))
        self.ids.insert(i, self.next_id)
        self.pages[self.next_id] = page
        self.next_id += 1

    def remove(self, value: float) -> None:
        """Take out one occurrence; the last page that begins at or below a value holds its last one."""
        i = bisect_right(self.lows, value) - 1
        page = self._page(i)
        del page[bisect_right(page, value) - 1]
        if page:
            self.lows[i], self.counts[i] = page[0], len(page)
        else:
            self.gone.add(self.ids[i])
            self.pages.pop(self.ids[i])
            del self.lows[i], self.counts[i], self.ids[i]

    def median(self) -> float:
        n = sum(self.counts)
        return (self._at((n - 1) // 2) + self._at(n // 2)) / 2 if n else float("nan")

    def _at(self, rank: int) -> float:
        for i, c in enumerate(self.counts):
            if rank < c:
                return self._page(i)[rank]
            rank -= c
        raise IndexError(rank)

    @property
    def directory(self) -> list[tuple[float, int, int]]:
        return list(zip(self.lows, self.counts, self.ids, strict=True))
