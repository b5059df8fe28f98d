"""Whitening, fingerprints and the Merkle manifest against plain walks."""

import hashlib
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from parity import compare, duck
from pyspark.sql import functions as F

from roadlake.llm import fingerprints, merkle, queries, ranges, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, id string, w int, length string"


# -- whitening


def plain_whitening(rows):
    """{length: (rows, n, deviations, eigenvalues, trace)} of the rows that take part, in whole numbers."""
    out = {}
    for ident, v in rows:
        if v and all(c is not None and math.isfinite(c) for c in v):
            out.setdefault(len(v), []).append((ident, [math.floor(Fraction(float(c)) * 1024) + 100_000 for c in v]))
    for dims, part in out.items():
        n, xs = len(part), [x for _, x in part]
        s = [sum(c) for c in zip(*xs, strict=True)]
        cov = [[float(Fraction(n * sum(x[i] * x[j] for x in xs) - s[i] * s[j], n * n)) for j in range(dims)] for i in range(dims)]
        out[dims] = ([k for k, _ in part], n, sorted(sum((n * c - t) ** 2 for c, t in zip(x, s, strict=True)) for x in xs), np.linalg.eigvalsh(cov)[::-1], sum(cov[i][i] for i in range(dims)))
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(np.float32(c)) for c in r.normal(size=12) * np.linspace(0.1, 3, 12)], "x", 1, "y") for i in range(150)]
    rows += [(500 + i, [float(np.float32(c)) for c in r.normal(size=3) * 1e6], "x", 1, "y") for i in range(9)]
    rows += [rows[0], rows[1], (None, rows[2][1], None, None, None), (900, None, "x", 1, "y"), (901, [], "x", 1, "y"), (902, [1.0, None] * 6, "x", 1, "y")]
    rows += [(903, [float("nan")] + [0.0] * 11, "x", 1, "y"), (904, [float("inf")] + [0.0] * 11, "x", 1, "y"), (905, [0.0] * 12, "x", 1, "y"), (906, [2.5], "x", 1, "y")]
    return spark.createDataFrame(rows, VECTORS).repartition(6)


def test_bit_planes_give_exact_products():
    r = np.random.default_rng(3)
    for rows, dims, top in ((1, 1, 1), (64, 4, 2), (777, 5, 1 << 14), (130, 3, 1 << 46)):
        y = r.integers(0, top, (rows, dims))
        want = y.astype(object).T @ y.astype(object)
        assert (np.triu(whitening.scatter(whitening.bit_planes(y))) == np.triu(want)).all()


def test_whitening_matches_whole_numbers(vectors):
    got = [r.asDict() for r in whitening.whiten(vectors).collect()]
    want = plain_whitening([(r["vec_id"], r["embedding"]) for r in vectors.collect()])
    assert {r["length"] for r in got} == set(want)
    for dims, (ids, n, deviations, e, trace) in want.items():
        part = [r for r in got if r["length"] == dims]
        k = min(8, dims)
        assert len(part) == k * len(ids) and {r["n"] for r in part} == {n}
        assert sorted(r["vec_id"] or -1 for r in part if r["component"] == 1) == sorted(i or -1 for i in ids)
        assert sorted(int(r["deviation_text"]) for r in part if r["component"] == 1) == deviations
        assert all(r["deviation"] == (int(r["deviation_text"]) if int(r["deviation_text"]) < 1 << 63 else None) for r in part)
        assert len({r["identity_error"] for r in part}) == 1 and part[0]["identity_error"] < 1e-4
        for c in range(k):
            column = [r for r in part if r["component"] == c + 1]
            assert len({r["explained"] for r in column}) == 1
            if n > 1:
                assert column[0]["explained"] == pytest.approx(e[c] / trace, rel=1e-6, abs=1e-12)
                w = np.array([r["whitened"] for r in column])
                assert abs(w.mean()) < 1e-9 and w.var() == pytest.approx(1, abs=1e-6)
            else:
                assert column[0]["whitened"] is None and column[0]["explained"] == 0


def test_whitened_values_lie_on_one_axis(spark):
    """The rows' values are the centred vectors on the eigenvectors, the same for all rows."""
    d = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    x = {r["vec_id"]: np.floor(np.array(r["embedding"], float) * 1024) + 100_000 for r in d.collect()}
    a = np.array([x[i] for i in sorted(x)])
    e, v = np.linalg.eigh(np.cov(a.T, bias=True))
    got = {(r["vec_id"], r["component"]): r["whitened"] for r in queries.op11_whitening(spark, SMALL).collect()}
    for c in range(8):
        plain = (a - a.mean(axis=0)) @ v[:, -1 - c] / math.sqrt(e[-1 - c])
        own = np.array([got[i, c + 1] for i in sorted(x)])
        assert min(np.abs(own - plain).max(), np.abs(own + plain).max()) < 1e-6


def test_constant_columns_and_large_deviations(spark):
    rows = [(i, [float(i), 7.0, float(i)], "x", 1, "y") for i in range(40)]
    part = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(part) == 120 and all((r["whitened"] is None) == (r["component"] > 1) for r in part) and all(r["identity_error"] < 1e-9 for r in part)
    wide = whitening.whiten(spark.createDataFrame([(i, [1e9 * i, -3e38], "x", 1, "y") for i in range(30)], VECTORS)).collect()
    assert all(r["deviation"] is None and int(r["deviation_text"]) >= 1 << 63 for r in wide)
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []


def test_deviations_in_halves():
    r = np.random.default_rng(8)
    for n, top in ((3, 10), (51_300, 1 << 12), (1 << 20, 1 << 29), (1 << 36, 1 << 40)):
        y, rest = r.integers(-top, top, (20, 7)), np.array([int(v) for v in r.integers(0, n, 7)], object)
        d = y.astype(object) * n - rest
        assert whitening._deviations(y, n, rest) == (d * d).sum(axis=1).tolist()


# -- fingerprints


def plain_sketch(text):
    """(limit, codes) as the docstring says, from the words."""
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text)]
    codes = set()
    for i in range(max(1, len(words) - 4) if words else 0):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(w.to_bytes(8, "little"), h)
        codes.add(h >> 1)
    codes = sorted(codes)
    limit = max(int(fingerprints.FRACTION * fingerprints.TOP), codes[63] if len(codes) >= 64 else fingerprints.TOP)
    kept = [c for c in codes if c <= limit]
    return (fingerprints.TOP if len(kept) == len(codes) else limit), kept


def plain_likeness(a, b):
    limit = min(a[0], b[0])
    x, y = {c for c in a[1] if c <= limit}, {c for c in b[1] if c <= limit}
    return len(x & y) / len(x | y) if x | y else 1.0


def shingles(text):
    w = WORD.findall(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("range_bytes", [fingerprints.RANGE_BYTES, 5000])
@pytest.mark.parametrize("name", ["awkward", "crowd", "documents", "nothing"])
def test_fingerprints_match_brute_force(request, name, range_bytes):
    df = request.getfixturevalue(name)
    rows = [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
    tie = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(t.encode(), 42))
    named = sorted([r for r in rows if r[0] is not None], key=lambda r: (-r[0], tie(r[1]), r[1]))
    want = []
    for i, (d, t) in enumerate(named):
        after = named[(i + 1) % len(named)][1]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        a, b, c = plain_sketch(t), plain_sketch(edited), plain_sketch(after)
        want.append((d, len(t), edited, a, b, plain_likeness(a, b), plain_likeness(a, c)))
    for d, t in [r for r in rows if r[0] is None]:
        edited = t[: len(t) - len(t) // 3]
        a, b = plain_sketch(t), plain_sketch(edited)
        want.append((d, len(t), edited, a, b, plain_likeness(a, b), None))
    plain = lambda s: (s["limit"], list(s["codes"]))
    got = [(r["doc_id"], r["n_chars"], r["edited"], plain(r["sketch"]), plain(r["edited_sketch"]), r["near_edited"], r["near_next"]) for r in fingerprints.fingerprint_edits(df, range_bytes).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:6], r[6] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_fingerprints_estimate_likeness(spark, documents):
    """Near the true Jaccard similarity of shingles; exact for short texts, 1 for equal ones only where so."""
    got = fingerprints.fingerprint_edits(documents).collect()
    error = [abs(r["near_edited"] - len(a & b) / len(a | b)) if a | b else 0 for r in got for a, b in [(shingles(r["text"]), shingles(r["edited"]))]]
    assert np.mean(error) < 0.05 and max(error) < 0.25
    assert all(e == 0 for e, r in zip(error, got, strict=True) if len(shingles(r["text"])) < 60 and len(shingles(r["edited"])) < 60)
    short = "one two three four five six seven"
    long = " ".join(f"w{i}" for i in range(5000))
    d = spark.createDataFrame([(short, short + " eight"), (long, long + " " + short), ("", " "), ("", "one")], "a string, b string")
    d = fingerprints.compared(fingerprints.with_sketch(fingerprints.with_sketch(d, "a", "x"), "b", "y"), "x", "y", "j", "ab", "ba")
    rows = d.select("j", "ab", "ba").collect()
    assert [tuple(r) for r in rows[2:]] == [(1.0, 1.0, 1.0), (0.0, 0.0, 0.0)] and rows[0]["j"] == 0.75
    assert rows[1]["ab"] == 1.0 and rows[1]["ba"] > 0.97


def test_sketches_merge(spark):
    """The merged sketch is that of both texts' shingles together, up to its limit; containment holds there."""
    texts = [" ".join(f"a{i}" for i in range(n)) for n in (4000, 300, 20, 0)] + [" ".join(f"b{i}" for i in range(900))]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    d = fingerprints.with_sketch(d, "t", "s")
    pairs = d.selectExpr("i", "s x").crossJoin(d.selectExpr("i j", "s y")).withColumn("m", fingerprints.merged("x", "y"))
    for r in pairs.collect():
        a, b = plain_sketch(texts[r["i"]]), plain_sketch(texts[r["j"]])
        limit = min(a[0], b[0])
        assert (r["m"]["limit"], list(r["m"]["codes"])) == (limit, sorted(c for c in {*a[1], *b[1]} if c <= limit))


def test_fingerprint_query(spark):
    got = queries.op12_fingerprints(spark, SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    prints = {}
    for r in got:
        assert prints.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"] and re.fullmatch(r"[0-9a-f]{16}:([0-9a-f]{16})*", r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and r["n_chars"] == len(texts[r["doc_id"]] or "")
    assert len(got) == len(texts)


# -- Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(leaves):
    """Levels of a tree from its leaves up."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        run = levels[-1]
        levels.append([sha(*run[i : i + 2]) for i in range(0, len(run), 2)])
    return levels


def plain_path(levels, at):
    path = []
    for run in levels[:-1]:
        other = at ^ 1
        path.append((run[other] if other < len(run) else "", other < at))
        at //= 2
    return path


def plain_manifest(rows):
    """Every row's result, from trees held whole."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r, sha(*map(field, (r[0], r[3], r[2], r[4], r[1])))))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for name in names:
        groups[name].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = {name: plain_tree([h for _, h in groups[name]]) for name in names}
    top = plain_tree([trees[name][-1][0] for name in names])
    out = []
    for g, name in enumerate(names):
        for at, (r, h) in enumerate(groups[name]):
            path = plain_path(trees[name], at) + plain_path(top, g)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            x = sha(*map(field, (r[0], r[3], r[2], r[4] + 1, r[1]))) if bad else h
            for other, left in path:
                x = sha(other, x) if left else sha(x, other)
            out.append((r[0], h, trees[name][-1][0], top[-1][0], sha(*[o for o, _ in path]), x, x == top[-1][0]))
    return out


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
KEY = lambda r: tuple((x is not None, x or 0) for x in r)


@pytest.mark.parametrize("name", ["awkward", "crowd", "documents", "nothing"])
def test_manifest_matches_whole_trees(request, name):
    df = request.getfixturevalue(name)
    rows = [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = [tuple(r) for r in merkle.document_manifest(df, merkle.contract_tampering()).select(*NAMES).collect()]
    assert sorted(got, key=KEY) == sorted(plain_manifest(rows) if rows else [], key=KEY)


def test_manifest_of_several_tiers(spark):
    """Groups of one leaf, of a whole block, of one more than that, and of three tiers; names that sort bytewise."""
    sizes = {None: 1, "": 2, "a": 256, "A": 257, "é": 3, "zz": 70_000, "z": 513}
    rows, at = [], 0
    for name, n in sizes.items():
        rows += [(at + i, "t", name, None, None if i % 3 else i) for i in range(n)]
        at += n
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(8)
    got = sorted((tuple(r) for r in merkle.document_manifest(df, merkle.contract_tampering()).select(*NAMES).collect()), key=KEY)
    assert got == sorted(plain_manifest(rows), key=KEY)


def test_rows_without_id_and_many_groups(spark):
    rows = [(None if i % 2 else i, f"t{i % 50}", f"lang{i % 700}", None, i % 5) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = sorted((tuple(r) for r in merkle.document_manifest(df, merkle.contract_tampering()).select(*NAMES).collect()), key=KEY)
    assert got == sorted(plain_manifest(rows), key=KEY)


def test_manifest_query_matches_sql(spark):
    fn, sql = queries.QUERIES["op13_merkle"]
    assert ": ok" in compare(spark, "op13_merkle", fn, sql, SMALL, duck(SMALL))


def test_ranges(spark):
    d = spark.createDataFrame([(i,) for i in [5, 5, 5, 9, 100, -3, 2**40, None]], "v long")
    ends = ranges.upper_ends(d, "v", F.lit(1), 2)
    assert ends[-1] == 2**40 and ends == sorted(set(ends))
    got = d.select("v", ranges.range_of(F.col("v"), ends).alias("r")).where("v is not null").collect()
    assert all(r["r"] == sum(e < r["v"] for e in ends) for r in got)
    assert ranges.upper_ends(d.where("v is null"), "v", F.lit(1), 2) == []
