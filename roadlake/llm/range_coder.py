"""Adaptive context-mixing range coder for token ids.

Ids are coded in blocks that are reset and checksummed independently. A block lists its distinct ids and
codes their ranks. Three predictors are mixed for each rank: order 0 (counts of the block so far, taken
anew when its length doubles), order 1 and order 2 (the id that last followed the previous one or two).
The mixture is a weighted sum: the order-1 and order-2 guesses get a share of the probability by how
often guesses confirmed as many times in a row came true in this block, order 0 gets the rest. A range
coder of 64 bits with 32-bit output follows the mixture.

Many blocks are coded side by side, one numpy lane each; a lane's bytes do not depend on its neighbours.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 12
#: Lanes side by side, and table cells (lanes times ids) at most.
LANES, CELLS = 2048, 1 << 21
# All of the model fits 32 bits: probabilities add up to _TOTAL, cumulative counts to 1 << _SCALE, and what
# the guesses leave to order 0 is enough for the rarest id of a block (8,192 counts at most).
_BITS, _SCALE = 16, 15
_TOTAL = (1 << _BITS) - 1
_SHARE = 7 << 13
_CONTEXTS = 1 << 11
_RUNS = 16
#: The coder puts out 32 bits when its range has less than that left.
_WORD, _MASK, _LEAST = np.uint64(32), np.uint64(2**32 - 1), np.uint64(2**32)
_HEAD = struct.Struct("<IIII")
#: Steps at which the counts are taken anew: this one and those twice as far each.
_FIRST = 128
#: Lanes whose guesses are found together, and steps whose shares are reckoned together (they divide _FIRST).
_TOGETHER, _CHUNK = 4, 32
#: Ids below this are ranked in a list of all.
_LISTED = 1 << 18


def _cdf(counts: np.ndarray) -> np.ndarray:
    """Where the share of each id of a lane begins (low 16 bits) and ends, of 1 << _SCALE."""
    out = np.empty(counts.shape, np.uint32)
    for i in range(0, len(counts), 32):  # what fits a cache
        part = counts[i : i + 32]
        cum = np.zeros((len(part), part.shape[1] + 1), np.int32)
        np.cumsum(part, axis=1, out=cum[:, 1:])
        share = (cum * float(1 << _SCALE) / cum[:, -1:]).astype(np.int32).view(np.uint32)  # exact: all is below 2**53
        np.bitwise_or(share[:, :-1], share[:, 1:] << np.uint32(16), out=out[i : i + 32])
    return out


class _Mixture:
    """The model of all lanes for the decoder, step by step; arrays of both guesses hold order 1 of all lanes, then order 2."""

    def __init__(self, sizes: np.ndarray):
        n = self.lanes = len(sizes)
        self.width = int(sizes.max())
        lane = np.arange(n, dtype=np.int64)
        self.l0, self.both = lane * self.width, np.append(lane, lane) * self.width
        # What followed a context last (12 bits), and how often in a row it did (4 bits): contexts of order 1, then 2.
        self.next = np.zeros(n * (self.width + _CONTEXTS), np.uint16)
        self.at = np.append(self.l0, n * self.width + lane * _CONTEXTS)
        self.rates = np.repeat(np.array([1 << 11, 1 << 12], np.int32), n * _RUNS)
        self.rate_at = np.arange(2 * n, dtype=np.int64) * _RUNS
        self.longer = np.minimum(np.arange(_RUNS) + 1, _RUNS - 1).astype(np.int32)
        self.p, self.context = np.zeros(n, np.int32), np.zeros(2 * n, np.int32)
        self.counts = (np.arange(self.width) < sizes[:, None]).astype(np.int32)
        self.since: list[np.ndarray] = []
        self.t, self.due = 0, _FIRST
        self._recount()

    def _tally(self) -> None:
        """Adds the ids seen since the last time to the counts."""
        if self.since:
            seen = (np.array(self.since).T + self.l0[:, None]).ravel()
            self.counts += np.bincount(seen, minlength=self.counts.size).reshape(self.counts.shape).astype(np.int32)
            self.since = []

    def _recount(self) -> None:
        """Shares by the counts, and ids by cumulative count, lane after lane."""
        self._tally()
        self.cdf = _cdf(self.counts).ravel()
        self.sums = self.counts.sum(axis=1, dtype=np.int32)
        ids = np.tile(np.arange(self.width, dtype=np.uint16), self.lanes)
        self.slots = np.repeat(ids, self.counts.ravel())
        self.slot_at = np.cumsum(self.sums, dtype=np.int64) - self.sums

    def guess(self) -> None:
        """Both guesses and the shares m1, m2, m0 of the three orders."""
        n = self.lanes
        self.i = self.at + self.context
        known = self.next.take(self.i, mode="clip").astype(np.int32)
        self.g, self.k = known >> 4, known & 15
        self.j = self.rate_at + self.k
        self.w = self.rates.take(self.j, mode="clip")
        self.m2 = (self.w[n:] * _SHARE) >> 15
        self.m1 = (self.w[:n] * (_SHARE - self.m2)) >> 15
        self.m0 = _TOTAL - self.m1 - self.m2

    def learn(self, x: np.ndarray, hit: np.ndarray) -> None:
        """Takes in the ids of a step and which of both guesses they confirm."""
        n = self.lanes
        # Rates of 15 bits move a sixteenth of the way.
        self.rates[self.j] = self.w - (self.w >> 4) + hit * np.int32(2047)
        held = self.longer.take(self.k, mode="clip") * hit
        held[:n] += x << 4
        held[n:] += x << 4
        self.next[self.i] = held
        self.context[:n] = x
        self.context[n:] = (self.p * 0x2F0B + x) & (_CONTEXTS - 1)
        self.p = x
        self.since.append(x)
        self.t += 1
        if len(self.since) == 4 * _FIRST:
            self._tally()
        if self.t == self.due:
            self._recount()
            self.due *= 2


class _Range:
    """The interval of each lane: 64 bits, of which 32 go out at a time."""

    def __init__(self, n: int):
        self.low, self.span = np.zeros(n, np.uint64), np.full(n, 2**64 - 1, np.uint64)

    def narrow(self, start: np.ndarray, width: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Narrows all lanes; returns the lanes that put out (or take in) a word, and the words put out.

        A short range that straddles a word boundary is cut at it, which costs a bit or two now and then.
        """
        self.low += start.astype(np.uint64, copy=False) * unit
        self.span = width.astype(np.uint64, copy=False) * unit
        go = (self.span < _LEAST).nonzero()[0]
        low, span = self.low.take(go), self.span.take(go)
        cut = (((low + span) ^ low) >= _LEAST).nonzero()[0]
        if len(cut):
            span[cut] = (np.uint64(0) - low[cut]) & _MASK
        self.span[go] = span << _WORD
        self.low[go] = low << _WORD
        return go, low >> _WORD


def _groups(sizes: list[int]) -> list[list[int]]:
    """Consecutive blocks to code side by side."""
    out: list[list[int]] = []
    widest = 0
    for i, s in enumerate(sizes):
        if not out or len(out[-1]) >= LANES or max(widest, s) * (len(out[-1]) + 1) > CELLS:
            out.append([])
            widest = 0
        widest = max(widest, s)
        out[-1].append(i)
    return out


def _ranks(blocks: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each block its distinct ids, ascending, and the place of each of its ids among them."""
    place = np.zeros(_LISTED, np.int32)
    for block in blocks:
        ids = np.sort(block)
        if ids[-1] >= _LISTED:
            yield np.unique(block, return_inverse=True)
            continue
        ids = ids[np.append(True, ids[1:] != ids[:-1])]
        place[ids] = np.arange(len(ids), dtype=np.int32)
        yield ids, place.take(block)


def _pack(ids: np.ndarray) -> bytes:
    """Ascending ids by their distances: a byte each, 255 and more in 32 bits after all of these."""
    gaps = ids.astype(np.uint32)
    gaps[1:] -= gaps[:-1].copy()
    wide = gaps[gaps >= 255]
    return np.minimum(gaps, 255).astype(np.uint8).tobytes() + wide.astype("<u4").tobytes()


def _unpack(raw: bytes, n: int) -> np.ndarray:
    gaps = np.frombuffer(raw, np.uint8, n).astype(np.uint32)
    gaps[gaps == 255] = np.frombuffer(raw, "<u4", -1, n) if len(raw) > n else 0
    return np.cumsum(gaps, dtype=np.uint32)


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """The bytes of each block of ids (unsigned 32-bit integers, at least one and BLOCK at most)."""
    parts = list(_ranks(blocks))
    out: list[bytes] = [b""] * len(blocks)
    for group in _groups([len(a) for a, _ in parts]):
        coded = _encode_lanes([parts[i][1] for i in group], np.array([len(parts[i][0]) for i in group]))
        for i, code in zip(group, coded, strict=True):
            ids = blocks[i].astype("<u4")
            head = _pack(parts[i][0])
            out[i] = _HEAD.pack(len(ids), len(parts[i][0]), len(head), zlib.crc32(ids.tobytes())) + head + code
    return out


def _trails(context: np.ndarray, x: np.ndarray) -> np.ndarray:
    """What the model knows of a context at each step, for all steps of some lanes at once.

    The encoder has all ids at hand: sorted by context and step, the id before is the guess. Bits 0 to 3 are
    the run of confirmed guesses, bit 4 is set if the guess is the id, bit 5 if it is less.
    """
    lanes, steps = x.shape
    key = context << np.uint32(16) | np.arange(steps, dtype=np.uint32)
    key.sort(axis=1)
    head = np.ones((lanes, steps), bool)
    np.greater_equal(key[:, 1:] ^ key[:, :-1], 1 << 16, out=head[:, 1:])
    head = head.ravel()
    at = (key & np.uint32(0xFFFF)).astype(np.int64)
    at += np.arange(0, x.size, steps)[:, None]
    at = at.ravel()
    xs = x.ravel().take(at)
    guess = np.zeros_like(xs)
    np.multiply(xs[:-1], ~head[1:], out=guess[1:])
    hit = guess == xs
    s = np.arange(1, x.size + 1, dtype=np.int32)
    broken = (s - hit) * (head | ~hit)  # the step before a run of hits
    run = np.minimum(s - np.maximum.accumulate(broken), _RUNS - 1).astype(np.uint8)
    known = hit.view(np.uint8) << 4 | (guess < xs).view(np.uint8) << 5
    known[1:] |= run[:-1] * ~head[1:]
    out = np.empty(x.size, np.uint8)
    out[at] = known
    return out.reshape(lanes, steps)


def _encode_lanes(ranks: list[np.ndarray], sizes: np.ndarray) -> list[bytes]:
    """Steps the lanes as ``_Mixture`` does, with the guesses of all steps found beforehand."""
    lengths = np.array([len(r) for r in ranks])
    n, steps, width = len(ranks), int(lengths.max()), int(sizes.max())
    # Two steps before the first; rows a cache line longer than a power of two, or they fall on each other.
    x = np.zeros((n, steps + 2 + 16), np.int32)[:, : steps + 2]
    for i, r in enumerate(ranks):
        x[i, 2 : len(r) + 2] = r
    trails = np.empty((2 * n, steps + 64), np.uint8)[:, :steps]  # order 1 of all lanes, then order 2
    for i in range(0, n, _TOGETHER):
        k = slice(i, i + _TOGETHER)
        now, p, pp = x[k, 2:], x[k, 1:-1].astype(np.uint32), x[k, :-2].astype(np.uint32)
        trails[:n][k] = _trails(p, now)
        trails[n:][k] = _trails((pp * np.uint32(0x2F0B) + p) & np.uint32(_CONTEXTS - 1), now)
    x = x[:, 2:]
    counts = (np.arange(width) < sizes[:, None]).astype(np.int32)
    lane = np.arange(n, dtype=np.int64)[:, None] * width
    rates = np.repeat(np.array([1 << 11, 1 << 12], np.int32), n * _RUNS)
    rate_at = np.arange(2 * n, dtype=np.int64) * _RUNS
    coder = _Range(n)
    lows, n_words, tallied = np.zeros(n, np.uint64), np.zeros(n, np.int64), 0
    gone: list[np.ndarray] = []  # lanes that put out a word, in order of steps, and the words
    words: list[np.ndarray] = []
    ending = {int(t): np.flatnonzero(lengths == t) for t in np.unique(lengths)}
    for begin in range(0, steps, _CHUNK):
        if begin & (begin - 1) == 0 and (begin >= _FIRST or not begin):
            seen = (x[:, begin // 2 if begin > _FIRST else 0 : begin] + lane).ravel()
            counts += np.bincount(seen, minlength=counts.size).reshape(counts.shape).astype(np.int32)
            cdf = _cdf(counts).ravel()
        end = min(begin + _CHUNK, steps)
        known = np.ascontiguousarray(trails[:, begin:end].T)
        at, step_up = rate_at + (known & 15), (known >> 4 & 1) * np.int32(2047)
        w = np.empty(known.shape, np.int32)
        for t in range(end - begin):
            now = rates.take(at[t], out=w[t], mode="clip")
            rates[at[t]] = now - (now >> 4) + step_up[t]
        m2 = (w[:, n:] * _SHARE) >> 15
        m1 = (w[:, :n] * (_SHARE - m2)) >> 15
        m0 = _TOTAL - m1 - m2
        held = np.ascontiguousarray(cdf.take(x[:, begin:end] + lane).T)
        low = (m0 * (held & 0xFFFF).view(np.int32)) >> _SCALE
        size = ((m0 * (held >> 16).view(np.int32)) >> _SCALE) - low
        low += m1 * (known[:, :n] >> 5) + m2 * (known[:, n:] >> 5)
        size += m1 * (known[:, :n] >> 4 & 1) + m2 * (known[:, n:] >> 4 & 1)
        low, size = low.astype(np.uint64), size.astype(np.uint64)
        lanes, puts = [], []
        for t in range(end - begin):
            go, out = coder.narrow(low[t], size[t], coder.span >> np.uint64(_BITS))
            lanes.append(go)
            puts.append(out)
            if (done := ending.get(begin + t + 1)) is not None:
                n_words += np.bincount(np.concatenate([*gone[tallied:], *lanes]), minlength=n)
                gone.append(np.concatenate(lanes).astype(np.uint16))
                words.append(np.concatenate(puts).astype(np.uint32))
                tallied, lanes, puts = len(gone), [], []
                lows[done], lengths[done] = coder.low[done], n_words[done]
        if lanes:
            gone.append(np.concatenate(lanes).astype(np.uint16))
            words.append(np.concatenate(puts).astype(np.uint32))
    order = np.concatenate(gone)
    first = np.append(0, np.cumsum(np.bincount(order, minlength=n)))
    flat = np.concatenate(words)[np.argsort(order, kind="stable")].astype(">u4")
    last = lows.astype(">u8")
    return [flat[first[i] : first[i] + lengths[i]].tobytes() + last[i : i + 1].tobytes() for i in range(n)]


def decode(blobs: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; raises ValueError where a checksum does not hold."""
    heads = [_HEAD.unpack_from(b) for b in blobs]
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blobs)
    for group in _groups([h[1] for h in heads]):
        codes = [blobs[i][_HEAD.size + heads[i][2] :] for i in group]
        ranks = _decode_lanes(codes, np.array([heads[i][0] for i in group]), np.array([heads[i][1] for i in group]))
        for k, i in enumerate(group):
            packed = blobs[i][_HEAD.size : _HEAD.size + heads[i][2]]
            ids = _unpack(packed, heads[i][1])[ranks[: heads[i][0], k]]
            if zlib.crc32(ids.astype("<u4").tobytes()) != heads[i][3]:
                raise ValueError("a block of token ids is damaged")
            out[i] = ids
    return out


def _decode_lanes(codes: list[bytes], lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    n, steps = len(codes), int(lengths.max())
    have = [len(c) // 4 for c in codes]
    # Lanes that ended before the longest go on reading: room for that, at most a word for a step.
    room = max(h + steps - int(m) for h, m in zip(have, lengths, strict=True)) + 4
    words = np.zeros((n, room), np.uint64)
    for i, c in enumerate(codes):
        words[i, : have[i]] = np.frombuffer(c, ">u4", have[i])
    code = words[:, 0] << _WORD | words[:, 1]
    words = words.ravel()
    at = np.arange(n, dtype=np.int64) * room + 2
    model, coder = _Mixture(sizes), _Range(n)
    out = np.zeros((steps, n), np.int32)
    for t in range(steps):
        model.guess()
        unit = coder.span >> np.uint64(_BITS)
        v = np.minimum((code - coder.low) // unit, np.uint64(_TOTAL - 1)).astype(np.int32)
        m0, m1, m2 = model.m0, model.m1, model.m2
        g1, g2 = model.g[:n], model.g[n:]
        # Where the intervals of both guesses begin and end. The guesses' own shares begin with the lower guess.
        share = model.cdf.take(model.both + model.g, mode="clip")
        start, end = (share & 0xFFFF).view(np.int32).reshape(2, n), (share >> 16).view(np.int32).reshape(2, n)
        start, end = (start * m0) >> _SCALE, (end * m0) >> _SCALE
        before1, before2 = m2 * (g2 < g1), m1 * (g1 < g2)
        start[0] += before1
        start[1] += before2
        same = g1 == g2
        end[0] += before1 + m1 + m2 * same
        end[1] += before2 + m2 + m1 * same
        past = v >= end
        inside = (v >= start) & ~past
        u = v - m1 * past[0] - m2 * past[1]
        slot = ((np.minimum(u + 1, m0) << _SCALE) - 1) // m0  # beyond m0 only where a guess is hit
        x = model.slots.take(model.slot_at + (((slot + 1) * model.sums - 1) >> _SCALE), mode="clip").astype(np.int32)
        np.copyto(x, g2, where=inside[1])
        np.copyto(x, g1, where=inside[0])
        out[t] = x
        hit = model.g.reshape(2, n) == x
        share = model.cdf.take(model.l0 + x, mode="clip")
        low = ((share & 0xFFFF).view(np.int32) * m0) >> _SCALE
        size = (((share >> 16).view(np.int32) * m0) >> _SCALE) - low
        low += m1 * (g1 < x) + m2 * (g2 < x)
        size += m1 * hit[0] + m2 * hit[1]
        model.learn(x, hit.ravel())
        go, _ = coder.narrow(low, size, unit)
        place = at.take(go)
        code[go] = code.take(go) << _WORD | words.take(place)
        at[go] = place + 1
    return out
