"""Operators that find repeats, against plain walks."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from parity import compare, duck
from pyspark.sql import functions as F

from roadlake.llm import components, contamination, line_dedup, queries, simhash, substrings, suffixes
from roadlake.llm import words as W
from roadlake.llm.base import utf8

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def repeats(rows, window=50):
    """Which words of each row a window covers that also starts in a smaller document."""
    first = {}
    split = [WORD.findall(t or "") for _, t in rows]
    for (d, _), w in zip(rows, split, strict=True):
        if d is not None:
            for p in range(len(w) - window + 1):
                k = tuple(w[p : p + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[p : p + window])] < d:
                gone[p : p + window] = [True] * window
        out.append((w, gone))
    return out


@pytest.mark.parametrize("name", ["awkward", "crowd", "documents", "nothing"])
def test_substrings_match_brute_force(request, name):
    df = request.getfixturevalue(name)
    rows = rows_of(df)
    want = sorted((d, len(w), sum(g), " ".join(x for x, y in zip(w, g, strict=True) if not y)) for (d, _), (w, g) in zip(rows, repeats(rows), strict=True) if d is not None)
    got = sorted(tuple(r) for r in substrings.remove_substrings(df).collect() if r["doc_id"] is not None)
    assert got == want
    left = [r for r in substrings.remove_substrings(df).collect() if r["doc_id"] is None]
    assert all(r["n_removed"] == 0 for r in left)


@pytest.mark.parametrize("name", ["awkward", "crowd", "documents", "nothing"])
def test_suffixes_find_all_repeats(request, name):
    df = request.getfixturevalue(name)
    rows = rows_of(df)
    want = {(d, xxhash.xxh64_intdigest((t or "").encode(), 42), i) for (d, t), (_, g) in zip(rows, repeats(rows), strict=True) for i, x in enumerate(g) if x}
    got = {(r["doc_id"], r["row_key"] & (2**64 - 1), i) for r in suffixes.repeated_spans(df).collect() for i in range(r["start"], r["end"])}
    assert got == want


def test_suffix_groups_that_are_cut(awkward, documents):
    """Groups cut into pieces lose nothing."""
    for df in (awkward, documents):
        assert marked(suffixes.repeated_spans(df, group=2)) == marked(suffixes.repeated_spans(df))


def test_hot_groups_that_are_cut(crowd):
    """A passage and copies that most documents share are found whole, however finely their groups are cut."""
    rows = rows_of(crowd)
    want = {(d, i) for (d, _), (_, g) in zip(rows, repeats(rows), strict=True) for i, x in enumerate(g) if x}
    assert marked(suffixes.repeated_spans(crowd, group=8)) == want


@pytest.mark.parametrize("group", [1, suffixes.GROUP])
def test_words_whose_hashes_begin_alike(spark, group):
    """Two texts that differ in one word, of which the first 32 bits of the hashes agree, share no passage."""
    data, off = utf8(pa.array(["n222336 n230046"]))
    starts, ends, _ = W.find(data, off)
    one, two = W.hashes(data, starts, ends) >> np.uint64(32)
    assert one == two
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words[:30], w, *words[31:]]) for w in ("n222336", "n230046")]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert suffixes.repeated_spans(df, group=group).collect() == [] and all(r["n_removed"] == 0 for r in substrings.remove_substrings(df).collect())


def marked(spans):
    return {(r["doc_id"], i) for r in spans.collect() for i in range(r["start"], r["end"])}


def test_large_groups_lose_no_passage(around_phrase):
    rows = rows_of(around_phrase)
    want = {(d, i) for (d, _), (_, g) in zip(rows, repeats(rows), strict=True) for i, x in enumerate(g) if x}
    assert want and marked(suffixes.repeated_spans(around_phrase, group=8)) == want


def test_suffixes_find_staggered_quotes(staggered):
    rows = rows_of(staggered)
    want = {(d, i) for (d, _), (_, g) in zip(rows, repeats(rows), strict=True) for i, x in enumerate(g) if x}
    for group in (4, suffixes.GROUP):
        assert marked(suffixes.repeated_spans(staggered, group=group)) == want


def print_of(text):
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    codes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


@pytest.mark.parametrize("name", ["awkward", "crowd", "documents", "nothing"])
def test_simhash_matches_brute_force(request, name):
    df = request.getfixturevalue(name)
    rows = rows_of(df)
    prints = [print_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    want = sorted((str(d), f"{p:016x}", min((x for x in least[find(i)] if x is not None), default=None)) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True)))
    got = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df, tile=16).collect())
    assert got == want


def test_forest_connects_what_all_pairs_connect():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 6, dtype=np.uint64)
    flips = np.array([[np.uint64(1) << np.uint64(i) for i in rng.choice(64, 2)] for _ in range(400)])
    fps = np.unique(centres[rng.integers(0, 6, 400)] ^ flips[:, 0] ^ flips[:, 1])
    ones = np.bitwise_count(fps)
    for x in np.unique(ones):
        for y in np.unique(ones[ones >= x]):
            a, b = fps[ones == x], fps[ones == y] if y != x else None
            left, right = simhash.forest(a, b, 4)
            assert (np.bitwise_count(left ^ right) <= 4).all()
            nodes = a if b is None else np.concatenate([a, b])
            pairs = {(int(u), int(v)) for u in a for v in (a if b is None else b) if u != v and int(u ^ v).bit_count() <= 4}
            assert groups(nodes.tolist(), pairs) == groups(nodes.tolist(), set(zip(left.tolist(), right.tolist(), strict=True)))


def groups(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    out = defaultdict(set)
    for n in nodes:
        out[find(n)].add(n)
    return {frozenset(x) for x in out.values()}


def jaccard_groups(rows, similarity=0.8, k=5):
    """Component of every row: links where the sets of k-word shingles are that similar; equal words are one text."""
    split = [tuple(WORD.findall(lower(t or ""))) for _, t in rows]
    texts = {w: i for i, w in enumerate(dict.fromkeys(split))}
    sets = [{w[i : i + k] for i in range(max(1, len(w) - k + 1))} if w else set() for w in texts]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    pairs = {(i, j) for held in holders.values() for i in held for j in held if i < j}
    linked = {(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9}
    place = {n: g for g in groups(range(len(sets)), linked) for n in g}
    return [place[texts[w]] for w in split]


def edited_copies(n, distinct=40):
    """Texts of many lengths with copies that a few words tell apart, at similarities on both sides of 0.8."""
    rows, r = [], np.random.default_rng(11)
    for i in range(n):
        base = [f"w{i % distinct}x{j}" for j in range(6 + 9 * (i % distinct))]
        for j in r.choice(len(base), min(len(base), int(r.integers(0, 2 + len(base) // 30))), replace=False):
            base[j] = f"n{i}x{j}"
        rows.append((n - i, " ".join(base), "en", "a", 0))
    return rows


@pytest.mark.parametrize("name", ["awkward", "crowd", "documents", "nothing", "edited"])
@pytest.mark.parametrize("tile", [50, simhash.NEAR_TILE])
def test_near_copies_match_brute_force(spark, request, name, tile):
    df = spark.createDataFrame(edited_copies(400), "doc_id long, text string, lang string, source string, n_chars long") if name == "edited" else request.getfixturevalue(name)
    rows = rows_of(df)
    members = defaultdict(list)
    place = jaccard_groups(rows)
    for g, (d, _) in zip(place, rows, strict=True):
        members[g].append(d)
    want = sorted((str(d), min((x for x in members[g] if x is not None), default=None)) for g, (d, _) in zip(place, rows, strict=True))
    got = simhash.near_copies(df, tile=tile).collect()
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in got) == want
    if name in ("crowd", "edited"):
        assert any(len({t for g, (_, t) in zip(place, rows, strict=True) if g == one}) > 1 for one in members)


def test_candidates_of_two_tiles_are_those_of_all_pairs():
    r = np.random.default_rng(5)
    rows = np.zeros(600, simhash._ENTRY)
    centres = r.integers(0, 2**63, (12, 2), dtype=np.uint64)
    noise = np.bitwise_and.reduce(r.integers(0, 2**64, (3, 600, 2), dtype=np.uint64))
    pick = r.integers(0, 12, 600)
    rows["fp"], rows["fp2"] = (centres[pick] ^ noise).T
    rows["node"] = np.arange(600)
    rows["comp"], rows["n"] = rows["node"] // 2, 100 + pick * 3 + r.integers(0, 3, 600)
    half, full = simhash.reach(0.8)
    parts = [z[np.argsort(np.bitwise_count(z["fp"]), kind="stable")] for z in (rows[:350], rows[350:])]
    for a, b in ((parts[0], parts[1]), (parts[0], None)):
        other, want = a if b is None else b, set()
        for x in a:
            for y in other:
                d = int(np.bitwise_count(x["fp"] ^ y["fp"]))
                like = min(x["n"], y["n"]) >= 0.8 * max(x["n"], y["n"])
                if x["comp"] != y["comp"] and like and d <= half and d + int(np.bitwise_count(x["fp2"] ^ y["fp2"])) <= full:
                    want.add((min(x["node"], y["node"]), max(x["node"], y["node"])))
        spread = lambda every: {(int(min(p, q)), int(max(p, q))) for u, v in simhash.candidates(a, b, 0.8, every) for p, q in zip(u, v, strict=True)}  # noqa: B023, E731
        assert want and spread(True) == want and spread(False) <= want
        held = {(2 * i, 2 * i + 1) for i in range(300)}
        nodes = range(600)
        assert groups(nodes, spread(False) | held) == groups(nodes, want | held)


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(1000, 1200)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(path + star + [(5, 5), (160, 100)], "a long, b long")).collect())
    assert got == {i: 100 for i in range(100, 161)} | {7: 7} | {i: 7 for i in range(1000, 1200)}
    assert not components.components(spark.createDataFrame([], "a long, b long")).collect()


@pytest.mark.parametrize("name", ["awkward", "crowd", "documents", "nothing"])
def test_lines_match_brute_force(request, name):
    df = request.getfixturevalue(name)
    rows = rows_of(df)
    strip = "".join(map(chr, [32, *range(9, 14)]))
    key = lambda s: lower(s.strip(strip))
    holders = defaultdict(set)
    for d, t in rows:
        for s in (t or "").split("\n") if d is not None else ():
            holders[key(s)].add(d)
    want = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [s for s in lines if d is None or not (len(key(s)) >= 40 and len(holders[key(s)]) >= 5 and d < max(holders[key(s)]))]
        want.append((str(d), len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = [(str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.dedup_lines(df, bits=1 << 17).collect()]
    assert sorted(got) == sorted(want)


def test_full_filters_change_nothing(documents):
    """With filters far too small every line is suspected, and the result is the same."""
    a = sorted(map(tuple, line_dedup.dedup_lines(documents, bits=1 << 16, min_chars=1, min_docs=2).collect()))
    b = sorted(map(tuple, line_dedup.dedup_lines(documents, bits=1 << 22, min_chars=1, min_docs=2).collect()))
    assert a == b


def test_filters_grow_with_the_lines(spark, documents, nothing):
    """Filters have bits for every line that may count, so that few lines are suspected at any size."""
    assert line_dedup.filter_bits(nothing) == 1 << 20
    rows = [(i, "\n".join(f"a line of its own with the number {i * 500 + j:09d} and so on" for j in range(500)), "en", "a", 0) for i in range(600)]
    many = spark.createDataFrame(rows, nothing.schema).repartition(5)
    bits = line_dedup.filter_bits(many)
    assert 8 * 300_000 <= bits <= 32 * 300_000
    packed = line_dedup.repeat_filter(many, bits)
    shared = spark.sparkContext.broadcast(packed)
    suspected = many.withColumn("row_key", F.xxhash64("text")).mapInArrow(line_dedup._suspects(shared, bits, 40), "doc_id long, row_key long, line int, key string").count()
    assert suspected <= 0.05 * 300_000
    assert line_dedup.repeated_lines(many).count() == 0


def test_short_items_are_found_inside_documents(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "same same"), (2, "One, two THREE"), (3, "two"), (4, "ame same same"), (5, None), (None, "Straße école"), (2, "one two three")], "item_id long, text string")
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    want = set()
    for d, t in rows_of(awkward):
        for r in items.collect():
            w = words(r["text"])
            if 2 <= len(w) < 5 and f" {' '.join(w)} " in f" {' '.join(words(t))} ":
                want.add((d, r["item_id"], 1, 1))
    whole = {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in contamination.find(awkward, items).collect()}
    got = [(r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in contamination.find(awkward, items, short=2).select("doc_id", "item_id", "n_shingles", "n_found").distinct().collect()]
    assert len(want - whole) >= 2 and set(got) == want | whole and len(got) == len(set(got))
    assert contamination.find(nothing, items, short=1).count() == 0 == contamination.find(awkward, items.limit(0), short=1).count()


def test_contamination_matches_brute_force(spark, awkward, documents, nothing):
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    long = awkward.filter("doc_id = 31").first()["text"]
    words = long.split()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "One"), (4, "ONE, two... three!"), (5, long), (5, long), (6, " ".join(words[:30]) + " zz " + " ".join(words[31:])), (None, long), (7, "?!")], "item_id long, text string")
    for docs, items in ((awkward, odd), (documents, benchmark), (awkward, odd.limit(0)), (nothing, odd)):
        shingles = {}
        for kind, df, col in (("d", docs, "doc_id"), ("i", items, "item_id")):
            for r in df.select(col, "text").distinct().collect():
                w = [x for x in re.findall(r"[^\W_]+", (r["text"] or "").lower())]
                if w:
                    shingles[kind, r[0], r["text"]] = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
        want = {(d[1], i[1], len(shingles[i]), len(shingles[i] & s)) for d, s in shingles.items() if d[0] == "d" for i in shingles if i[0] == "i" and len(shingles[i] & s) >= 0.8 * len(shingles[i])}
        got = {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in contamination.find(docs, items).collect()}
        assert got == want


@pytest.mark.parametrize("name", [n for n, q in queries.QUERIES.items() if q[1]])
def test_queries_match_sql(spark, name):
    assert ": ok" in (verdict := compare(spark, name, *queries.QUERIES[name], SMALL, duck(SMALL))), verdict


def test_word_stretches_hash_by_content():
    texts = ["a bb  ccc\td", "x a bb ccc d", ""]
    raw = "".join(texts).encode()
    off = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    starts, ends, first = W.find(np.frombuffer(raw, np.uint8), off)
    assert [raw[a:b] for a, b in zip(starts, ends, strict=True)] == b"a bb ccc d x a bb ccc d".split() and first.tolist() == [0, 4, 9, 9]
    h = W.hashes(np.frombuffer(raw, np.uint8), starts, ends)
    assert (h[:4] == h[5:]).all() and len(set(h.tolist())) == 5
    s = W.Sums(h, 1)
    assert s.hash(np.array([0]), np.array([4])) == s.hash(np.array([5]), np.array([9])) != s.hash(np.array([4]), np.array([8]))


def test_digest_columns(spark):
    row = queries.op3_substring_dedup(spark, SMALL).orderBy("doc_id").first()
    text = spark.read.parquet(f"{SMALL}/documents.parquet").filter(f"doc_id = {row['doc_id']}").first()["text"]
    assert row["kept_sha256"] == hashlib.sha256(" ".join(WORD.findall(text)).encode()).hexdigest()


def test_confirmed_links_follow_the_nodes(spark):
    """Every pair of a group of near copies is a candidate: the links that are kept join it, but are no pairs of all with all."""
    words = [f"w{i}" for i in range(100)]
    df = spark.createDataFrame([(i, " ".join([*words, f"own{i}"])) for i in range(60)], "doc_id long, text string")
    keyed = df.select("doc_id", "text", F.xxhash64("text").alias("row_key"))
    nodes = keyed.repartition(1).mapInArrow(simhash._wide_prints(5), "doc_id long, row_key long, node long, n long, fp long, fp2 long")
    nodes = nodes.select("node", F.struct("doc_id", "row_key").alias("row")).cache()
    names = sorted(r.node for r in nodes.collect())
    pairs = spark.createDataFrame([(a, b) for i, a in enumerate(names) for b in names[i + 1 :]], "a long, b long").coalesce(1)
    links = simhash._confirmed(pairs, keyed, nodes, 0.8, 5)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(names) - 1 <= links.count() <= min(tasks * (len(names) - 1), len(names) * (len(names) - 1) // 4)
    groups = [tuple(r) for r in components.components(links).collect()]
    assert sorted(g[0] for g in groups) == names and {g[1] for g in groups} == {names[0]}


@pytest.mark.parametrize("cut", [{}, {"part": 5000}])
def test_groups_about_the_limit_write_no_pairs(spark, monkeypatch, cut):
    """Texts with one edit of their own are alike, those with three are not, and all are candidates: no table has a row for
    every pair, and the groups are those of all pairs also where the texts are cut into many parts."""
    rows = []
    for i in range(150):
        words = [f"w{j}" for j in range(120)]
        for j in (7 + i % 50, 62 + i % 27, 95 + i % 19)[: 1 + 2 * (i % 2)]:
            words[j] = f"own{i}x{j}"
        rows.append((i, " ".join(words)))
    written = []
    write = simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, label: written.append(write(df, label)) or written[-1])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), **cut).collect()}
    place = jaccard_groups(rows)
    assert len(set(place)) == 76 and {i: min(j for j in got if place[j] == place[i]) for i in got} == got
    assert max(df.count() for df in written) <= 2 * len(rows)


def test_links_within_a_meeting_are_those_of_all_pairs():
    r = np.random.default_rng(3)
    base = r.integers(-(2**63), 2**63 - 1, (5, 60))
    sets = [np.unique(np.append(r.permutation(base[i % 5])[: r.integers(0, 61)], r.integers(0, 9, r.integers(0, 9)))) for i in range(200)]
    sets = [s[:0] if i % 40 == 0 else s for i, s in enumerate(sets)]
    comps = np.arange(200) // 2
    alike = [(i, j) for i in range(200) for j in range(i) if len(a := np.intersect1d(sets[i], sets[j])) and len(a) >= 0.8 * (len(sets[i]) + len(sets[j]) - len(a)) - 1e-9]
    x, y = simhash.linked(sets, comps, 0.8)
    held = {(2 * i, 2 * i + 1) for i in range(100)}
    found = set(zip(x.tolist(), y.tolist(), strict=True))
    assert found <= set(alike) | {(j, i) for i, j in alike} and 10 < len(found) < 100
    assert groups(range(200), found | held) == groups(range(200), set(alike) | held)
