"""SimHash near-dedup by tiled exact comparison.

Fingerprints are 64 bits over 4-word shingles. Equal fingerprints are one class first, so copies cost
nothing further. The distinct fingerprints are cut into tiles of one population count each; a pair of
tiles is compared by numpy exclusive-or and bit counts only where the counts differ by the radius at
most, and inside a pair only stretches whose half-word counts allow it. Each comparison returns a spanning forest of
the links it finds, never all pairs; connected components join the forests.

``near_copies`` runs the comparison at a radius wide enough for a similarity of word shingles and decides
exactly between the texts that its candidates join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlake.llm import words as W
from roadlake.llm.base import column, materialize, ragged, steps, utf8
from roadlake.llm.components import components

RADIUS, SHINGLE = 4, 4
#: Fingerprints of one tile at most (128 KB).
TILE = 16384


def _fingerprints(shingle: int):
    hashed = xxhash.xxh64_intdigest

    def one(text: str | None) -> int:
        if not text:
            return 0
        words = text.encode().lower().split()  # bytes: A-Z and the six separators only
        if not words:
            return 0
        if len(words) <= shingle:
            return hashed(b" ".join(words), 42)
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - shingle + 1]
        ends = ends[shingle - 1 :]
        codes = np.fromiter((hashed(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
        votes = np.zeros(64, np.int64)
        for at in range(0, len(codes), 1 << 15):
            part = codes[at : at + (1 << 15)]
            votes += np.unpackbits(part.byteswap().view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        return int.from_bytes(np.packbits(2 * votes > len(codes)).tobytes(), "big")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            prints = np.array([one(t) for t in column(batch, "text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").cast(pa.int64()), column(batch, "row_key").cast(pa.int64()), pa.array(prints)], names=["doc_id", "row_key", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row_key, fp): one row per input row; null and wordless texts have fp 0."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("row_key")).mapInArrow(_fingerprints(shingle), "doc_id long, row_key long, fp long")


def _by_half(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A tile in order of the population count of its upper halves, and those counts."""
    half = np.bitwise_count(fps >> np.uint64(32)).astype(np.int64)
    order = np.argsort(half, kind="stable")
    return fps[order], half[order]


def forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles (within one, if ``b`` is None), as pairs of
    fingerprints. All fingerprints of a tile have one population count, so the counts of the upper
    halves alone bound the distance; strips of rows meet only the slice of ``b`` within that bound.
    Memory is a strip times a slice."""
    a, ha = _by_half(a)
    same = b is None
    b, hb = (a, ha) if same else _by_half(b)
    both = a if same else np.concatenate([a, b])
    off = 0 if same else len(a)
    # |upper difference| + |lower difference| <= radius, and the lower one is gap - the upper one
    gap = int(np.bitwise_count(b[0])) - int(np.bitwise_count(a[0]))
    reach = [d for d in range(-radius, radius + 1) if abs(d) + abs(gap - d) <= radius]
    label = np.arange(len(both))
    out_x, out_y = [], []
    for h in np.unique(ha) if reach else ():
        lo, hi = np.searchsorted(ha, [h, h + 1])
        c0, c1 = np.searchsorted(hb, [h + reach[0], h + reach[-1] + 1])
        strip = max(1, (1 << 20) // max(1, int(c1 - c0)))
        for at in range(lo, hi if c1 > c0 else lo, strip):
            near = np.bitwise_count(a[at : min(at + strip, hi), None] ^ b[None, c0:c1]) <= radius
            x, y = np.nonzero(near)
            x, y = x + at, y + c0
            if same:
                x, y = x[x < y], y[x < y]
            y = y + off
            while len(x):
                lx, ly = label[x], label[y]
                open_ = lx != ly
                x, y, lx, ly = x[open_], y[open_], lx[open_], ly[open_]
                if not len(x):
                    break
                top, low = np.maximum(lx, ly), np.minimum(lx, ly)
                pick = np.unique(top, return_index=True)[1]  # one hook for each root
                out_x.append(x[pick])
                out_y.append(y[pick])
                label[top[pick]] = low[pick]
                while not np.array_equal(up := label[label], label):
                    label = up
    if not out_x:
        return both[:0], both[:0]
    return both[np.concatenate(out_x)], both[np.concatenate(out_y)]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = column(batch, "left").to_pylist(), column(batch, "right").to_pylist()
            for p, q in zip(left, right, strict=True):
                a, b = (None if z is None else np.frombuffer(z, ">u8").astype(np.uint64) for z in (p, q))
                x, y = forest(a, b, radius)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (tile, fp) rows to one row of bytes for each tile."""
    held: list[np.ndarray] = []
    at = None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.concatenate(held).view(np.uint64).astype(">u8").tobytes()], pa.binary())], names=["tile", "fps"])

    for batch in batches:
        tiles = column(batch, "tile").to_numpy(zero_copy_only=False)
        fps = column(batch, "fp").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(tiles)) + 1
        for t, part in zip(tiles[np.append(0, cuts)] if len(tiles) else [], np.split(fps, cuts), strict=False):
            if at is not None and t != at:
                yield row()
                held = []
            at = int(t)
            held.append(part)
    if held:
        yield row()


def link(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between distinct values of ``fp`` that differ in at most ``radius`` bits; together
    they connect exactly what all such pairs connect."""
    width = max(12, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fps = materialize(prints.select("fp").distinct().withColumn("ones", F.bit_count("fp")), "simhash-distinct")
    # At most 65 rows, whatever the number of documents.
    sizes = materialize(fps.groupBy("ones").agg(F.ceil(F.count("*") / tile).alias("parts")), "simhash-sizes")
    cut = fps.join(F.broadcast(sizes), "ones").select((F.col("ones") * F.lit(1 << 32) + F.pmod(F.xxhash64("fp"), F.col("parts"))).alias("tile"), "fp")
    packed = cut.repartition(width, "tile").sortWithinPartitions("tile", "fp").mapInArrow(_pack, "tile long, fps binary")
    packed = materialize(packed.withColumn("ones", F.shiftright("tile", 32)), "simhash-tiles")
    reach = F.explode(F.sequence(F.col("ones"), F.col("ones") + radius))
    near = packed.select("tile", reach.alias("ones")).join(packed.select(F.col("tile").alias("other"), "ones"), "ones").filter("tile <= other").select("tile", "other")
    paired = near.join(packed.select("tile", F.col("fps").alias("left")), "tile").join(packed.select(F.col("tile").alias("other"), F.col("fps").alias("right")), "other")
    paired = paired.select("tile", "other", "left", F.when(F.col("tile") != F.col("other"), F.col("right")).alias("right"))
    return materialize(paired.repartition(width, "tile", "other").select("left", "right").mapInArrow(_compare(radius), "a long, b long"), "simhash-links")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """One row per input row: doc_id, row_key, fingerprint (16 hex digits) and component_id, the smallest
    doc_id that links reach (itself included). Null and wordless texts have fingerprint zero and link like
    any other. A row without doc_id links too; component_id is null only where no doc_id is reached.
    """
    prints = materialize(fingerprints(docs, shingle), "simhash-prints")
    groups = components(link(prints, radius, tile))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    placed = classes.join(groups.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = placed.select("fp", "component").join(least, "component").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "row_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies: the tiled comparison at a radius wide enough for a similarity of word shingles.

_ENTRY = np.dtype([("fp", "<u8"), ("fp2", "<u8"), ("node", "<i8"), ("comp", "<i8"), ("n", "<i8")])
#: Entries of one tile of near copies at most (1.3 MB).
NEAR_TILE = 32768
#: Shingles of one part of a circle (2 MB), and what a set counts besides its own, so that a part has 1,024 sets at most.
PART, NODE_WEIGHT = 1 << 18, 1 << 8


def reach(similarity: float, spread: float = 3.3) -> tuple[int, int]:
    """How many of the first 64 and of all 128 bits may differ for sets of this Jaccard similarity.

    A bit differs with probability angle / pi; at ``spread`` standard deviations above the mean up to
    two in a thousand pairs of exactly this similarity are lost, and fewer of a higher one.
    """
    p = np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi
    half, full = (int(bits * p + spread * np.sqrt(bits * p * (1 - p))) for bits in (64, 128))
    return half, full


def _shingles(batch: pa.RecordBatch, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, how many of them, and a hash of all its words."""
    data, off = utf8(column(batch, "text"))
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends, first = W.find(data, off)
    w = W.hashes(data, starts, ends)
    n_words = np.diff(first)
    count = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    row = np.repeat(np.arange(len(count)), count)
    at = ragged(first[:-1], count)
    codes = W.Sums(w, 1).hash(at, np.minimum(at + shingle, first[row + 1]))
    order = np.lexsort((codes, row))
    codes, row = codes[order], row[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])
    whole = W.Sums(W.mix(w ^ np.uint64(0xA0761D6478BD642F)), 2).hash(first[:-1], first[1:])
    return codes[new], np.bincount(row[new], minlength=len(count)), whole


def _votes(codes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The 64-bit fingerprint of each row's codes."""
    row = np.repeat(np.arange(len(count)), count)
    votes = np.zeros((len(count), 64), np.int64)
    for at in range(0, len(codes), 1 << 16):
        part, rows = codes[at : at + (1 << 16)], row[at : at + (1 << 16)]
        head = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        votes[rows[head]] += np.add.reduceat(np.unpackbits(part.byteswap().view(np.uint8)).reshape(-1, 64), head, axis=0, dtype=np.int64)
    return np.packbits(2 * votes > count[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _wide_prints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            codes, count, whole = _shingles(batch, shingle)
            one, two = _votes(codes, count), _votes(W.mix(codes ^ np.uint64(0x8EBC6AF09C88C6E3)), count)
            arrays = [pa.array(x.view(np.int64)) for x in (whole, count, one, two)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").cast(pa.int64()), column(batch, "row_key").cast(pa.int64()), *arrays], names=["doc_id", "row_key", "node", "n", "fp", "fp2"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            codes, count, whole = _shingles(batch, shingle)
            ends = np.cumsum(count)
            held = [codes[b - n : b].tobytes() for b, n in zip(ends.tolist(), count.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.array(count), pa.array(held, pa.binary())], names=["node", "n", "codes"])

    return run


def _pack_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (tile, ones) to one row of bytes for each tile."""
    held: list[np.ndarray] = []
    at = None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["tile", "entries"])

    for batch in batches:
        tiles = column(batch, "tile").to_numpy(zero_copy_only=False)
        rows = np.zeros(len(tiles), _ENTRY)
        for name in _ENTRY.names:
            rows[name] = column(batch, name).to_numpy(zero_copy_only=False).view(_ENTRY[name])
        cuts = np.flatnonzero(np.diff(tiles)) + 1
        for t, part in zip(tiles[np.append(0, cuts)] if len(tiles) else [], np.split(rows, cuts), strict=False):
            if at is not None and t != at:
                yield row()
                held = []
            at = int(t)
            held.append(part)
    if held:
        yield row()


def candidates(a: np.ndarray, b: np.ndarray | None, similarity: float, every: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes of two tiles (within one, if ``b`` is None) that lie within reach, are of like sizes and of
    different components: a spanning forest of them, or every one. Tiles are in order of population counts."""
    half, full = reach(similarity)
    same = b is None
    b = a if same else b
    off = 0 if same else len(a)
    both = a if same else np.concatenate([a, b])
    label = np.unique(both["comp"], return_inverse=True)[1]
    ha, hb = (np.bitwise_count(z["fp"]).astype(np.int64) for z in (a, b))
    fa, fb = np.ascontiguousarray(a["fp"]), np.ascontiguousarray(b["fp"])
    at = 0
    while at < len(a):
        c0 = max(int(np.searchsorted(hb, ha[at] - half)), at + 1 if same else 0)
        to = min(len(a), at + max(1, (1 << 20) // max(1, len(b) - c0)))
        c1 = int(np.searchsorted(hb, ha[to - 1] + half, "right"))
        d = np.bitwise_count(fa[at:to, None] ^ fb[None, c0:c1])
        x, y = np.nonzero(d <= half)
        d = d[x, y].astype(np.int64)
        x, y = x + at, y + c0
        at = to
        open_ = label[x] != label[y + off]  # first: in a group of copies this leaves next to nothing
        x, y, d = x[open_], y[open_], d[open_]
        keep = d + np.bitwise_count(a["fp2"][x] ^ b["fp2"][y]) <= full
        m, n = a["n"][x], b["n"][y]
        keep &= (np.minimum(m, n) >= similarity * np.maximum(m, n) - 1e-9) & ((x < y) if same else True)
        x, y = x[keep], y[keep] + off
        if every:
            if len(x):
                yield both["node"][x], both["node"][y]
            continue
        while len(x):
            lx, ly = label[x], label[y]
            top, low = np.maximum(lx, ly), np.minimum(lx, ly)
            roots, pick = np.unique(top, return_index=True)  # one hook for each root
            yield both["node"][x[pick]], both["node"][y[pick]]
            up = np.arange(len(both))
            up[roots] = low[pick]
            while not np.array_equal(further := up[up], up):
                up = further
            label = up[label]
            open_ = label[x] != label[y]
            x, y = x[open_], y[open_]


def _candidates(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, q in zip(column(batch, "left").to_pylist(), column(batch, "right").to_pylist(), strict=True):
                a, b = (None if z is None else np.frombuffer(z, _ENTRY) for z in (p, q))
                for x, y in candidates(a, b, similarity, False):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return run


def _sweep(nodes: DataFrame, similarity: float, tile: int) -> DataFrame:
    """A spanning forest, task by task, of the candidates (a, b) among nodes (node, comp, n, fp, fp2) of different components.

    Sets of a similarity have sizes of at least that ratio, so tiles are cut from size classes that grow by it,
    and a class meets itself and the next.
    """
    width = max(12, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    step = float(np.log(1 / similarity)) * (1 + 1e-9)
    sized = nodes.withColumns({"class": F.floor(F.log(F.greatest("n", F.lit(1))) / step).cast("int"), "ones": F.bit_count("fp")})
    # One row for each size class, about a hundred for the longest text that a row can hold.
    parts = materialize(sized.groupBy("class").agg(F.ceil(F.count("*") / tile).alias("parts")), "near-sizes")
    cut = sized.join(F.broadcast(parts), "class").withColumn("tile", F.col("class") * F.lit(1 << 32) + F.pmod(F.xxhash64("node"), F.col("parts")))
    packed = cut.select("tile", "ones", *_ENTRY.names).repartition(width, "tile").sortWithinPartitions("tile", "ones").mapInArrow(_pack_entries, "tile long, entries binary")
    packed = materialize(packed.withColumn("class", F.shiftright("tile", 32)), "near-tiles")
    met = packed.select("tile", F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("class"))
    met = met.join(packed.select(F.col("tile").alias("other"), "class"), "class").filter("tile <= other").select("tile", "other")
    paired = met.join(packed.select("tile", F.col("entries").alias("left")), "tile").join(packed.select(F.col("tile").alias("other"), F.col("entries").alias("right")), "other")
    paired = paired.select("tile", "other", "left", F.when(F.col("tile") != F.col("other"), F.col("right")).alias("right"))
    found = paired.repartition(width, "tile", "other").select("left", "right").mapInArrow(_candidates(similarity), "a long, b long")
    return materialize(found, "near-candidates")


def linked(sets: list[np.ndarray], comps: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as places, of the pairs of sets that have the similarity and are of different components.

    A set is held against those of like size that are not joined to it yet, all at once, by marking its
    codes: memory is that of the sets.
    """
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    size = size[order]
    ids = np.unique(np.concatenate([sets[i] for i in order] or [np.zeros(0, np.int64)]), return_inverse=True)[1]
    first = np.append(0, np.cumsum(size))
    label = np.unique(comps[order], return_inverse=True)[1]
    marked = np.zeros(int(ids.max()) + 1 if len(ids) else 0, bool)
    last = np.searchsorted(size, size / similarity + 1e-9, "right")
    x, y = [], []
    for i in range(len(order)):
        near = i + 1 + np.flatnonzero(label[i + 1 : last[i]] != label[i])
        if not len(near):
            continue
        if 2 * len(near) > near[-1] - near[0]:  # most of a stretch: all of it
            near = np.arange(near[0], near[-1] + 1)
            at = slice(first[near[0]], first[near[-1] + 1])
        else:
            at = ragged(first[near], size[near])
        own = ids[first[i] : first[i + 1]]
        marked[own] = True
        begin = np.cumsum(size[near]) - size[near]
        shared = np.add.reduceat(marked[ids[at]], begin, dtype=np.int64)
        marked[own] = False
        hit = near[(shared >= (size[i] + size[near] - shared) * similarity - 1e-9) & (label[near] != label[i])]
        if len(hit):
            roots, pick = np.unique(label[hit], return_index=True)
            x += [i] * len(roots)
            y += hit[pick].tolist()
            label[np.isin(label, roots)] = label[i]
    return order[x], order[y]


def _meet(similarity: float):
    """Rows sorted by (circle, i, j) to the links that each such meeting finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets, nodes, comps = None, [], [], []

        def links() -> list[tuple[int, int]]:
            x, y = linked(sets, np.array(comps), similarity) if len(sets) > 1 else ((), ())
            return [(min(nodes[p], nodes[q]), max(nodes[p], nodes[q])) for p, q in zip(x, y, strict=True)]

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            found = []
            for *meeting, node, comp, codes in zip(*(column(batch, c).to_pylist() for c in ("circle", "i", "j", "node", "comp", "codes")), strict=True):
                if meeting != at:
                    found += links()
                    at, sets, nodes, comps = meeting, [], [], []
                sets.append(np.frombuffer(codes, np.int64))
                nodes.append(node)
                comps.append(comp)
            yield batch_of(found)
        yield batch_of(links())

    return run


def _met(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that the meetings of ``rows`` (circle, meetings, node, comp, codes) find."""
    width = max(12, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("meeting", F.explode("meetings")).select("circle", "meeting.*", "node", "comp", "codes")
    rows = rows.repartition(width, "circle", "i", "j").sortWithinPartitions("circle", "i", "j")
    return materialize(rows.mapInArrow(_meet(similarity), "a long, b long"), "near-links")


def _parts(weight: F.Column, part: int) -> F.Column:
    return F.ceil(F.coalesce(F.sum(weight), F.lit(0)) / part).cast("int")


def _dealt(parts: F.Column) -> F.Column:
    return F.pmod(F.xxhash64("node"), F.greatest(parts, F.lit(1))).cast("int")


def _meetings(upto: F.Column, meeting) -> F.Column:
    """One meeting (i, j) for each whole number below ``upto``."""
    whole = F.when(upto > 0, F.sequence(F.lit(0), upto - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(whole, lambda k: F.struct(*(c.alias(n) for c, n in zip(meeting(k), "ij", strict=True))))


def _confirmed(pairs: DataFrame, keyed: DataFrame, spoken: DataFrame, similarity: float, shingle: int, part: int = PART) -> DataFrame:
    """Links that join all nodes of a circle whose shingle sets have the similarity; a circle is what ``pairs`` join.
    ``spoken`` names one row (doc_id, row_key) for each node.

    The sets of a circle meet in one task, and a spanning forest of their links comes out. A circle of more than
    ``part`` is cut into parts, and each part meets the next. Where that are three parts or more, those outside the
    circle's main component then meet each other and all of it, part by part; a large group of copies is one
    component by then. No pairs are written, and a task holds two parts.
    """
    circles = materialize(components(pairs).select("node", F.col("component").alias("circle")), "near-circles")
    asked = circles.select("node").join(spoken, "node").select("row.*").alias("r")
    texts = keyed.alias("t").join(asked, F.col("t.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("t.row_key") == F.col("r.row_key")), "left_semi")
    sets = texts.dropDuplicates(["row_key"]).select("text").mapInArrow(_sets(shingle), "node long, n long, codes binary")
    sets = materialize(sets.join(circles, "node").withColumn("weight", F.col("n") + NODE_WEIGHT), "near-sets")
    # Few rows: each stands for a whole part at least.
    cut = materialize(sets.groupBy("circle").agg(_parts(F.col("weight"), part).alias("parts")).filter("parts > 1"), "near-parts")
    dealt = sets.join(F.broadcast(cut), "circle", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", _dealt(F.col("parts")))
    low, high = F.greatest(F.col("part") - 1, F.lit(0)), F.least("part", F.greatest(F.col("parts") - 2, F.lit(0)))
    chain = _meetings(high - low + 1, lambda k: (low + k, low + k + 1))
    links = _met(dealt.select("circle", chain.alias("meetings"), "node", F.col("node").alias("comp"), "codes"), similarity)
    if cut.filter("parts > 2").isEmpty():
        return links
    joined = components(links).select("node", F.col("component").alias("comp"))
    large = sets.join(F.broadcast(cut.filter("parts > 2").select("circle")), "circle").join(joined, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    large = materialize(large, "near-large")
    main = large.groupBy("circle", "comp").agg(F.sum("weight").alias("weight")).groupBy("circle").agg(F.max(F.struct("weight", "comp"))["comp"].alias("main"))
    large = large.join(F.broadcast(materialize(main, "near-main")), "circle").withColumn("stray", F.col("comp") != F.col("main"))
    sides = large.groupBy("circle").agg(*(_parts(F.when(F.col("stray") == s, F.col("weight")), part).alias(n) for s, n in ((True, "strays"), (False, "others"))))
    large = large.join(F.broadcast(materialize(sides.filter("strays > 0"), "near-sides")), "circle")
    own = _dealt(F.when(F.col("stray"), F.col("strays")).otherwise(F.col("others")))
    stray = _meetings(F.col("strays") + F.col("others"), lambda k: (F.least(own, k), F.greatest(own, k)))
    other = _meetings(F.col("strays"), lambda k: (k, F.col("strays") + own))
    return links.unionByName(_met(large.select("circle", F.when(F.col("stray"), stray).otherwise(other).alias("meetings"), "node", "comp", "codes"), similarity))


def near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, tile: int = NEAR_TILE, part: int = PART) -> DataFrame:
    """One row per input row: doc_id, row_key, node, component and component_id, the groups that links join.

    Texts are linked where the Jaccard similarity of their sets of word shingles (A-Z lower-cased) reaches
    ``similarity``; fewer than ``shingle`` words are one shingle. Texts of the same words are one node, and so are
    all null and wordless texts. Tiles of 128-bit fingerprints give the candidates (see ``reach``), of which
    a spanning forest is kept. It joins the nodes to circles; within a circle exact set intersections decide, whether
    or not two sets are candidates (see ``_confirmed``). The number of rows written follows the nodes'.
    ``component_id`` is the smallest doc_id of the group, null where none of its rows has one.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("row_key"))
    prints = materialize(keyed.mapInArrow(_wide_prints(shingle), "doc_id long, row_key long, node long, n long, fp long, fp2 long"), "near-prints")
    nodes = prints.groupBy("node").agg(F.min(F.struct("doc_id", "row_key")).alias("row"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("fp2").alias("fp2"))
    nodes = materialize(nodes, "near-nodes")
    spoken = nodes.select("node", "row")
    entries = nodes.select("node", F.col("node").alias("comp"), "n", "fp", "fp2")
    groups = components(_confirmed(_sweep(entries, similarity, tile).distinct(), keyed, spoken, similarity, shingle, part))
    placed = nodes.select("node", "least").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = placed.select("node", "component").join(least, "component")
    return prints.select("doc_id", "row_key", "node").join(by_node, "node").select("doc_id", "row_key", "node", "component", "component_id")
