"""Token counts, token files, the range coder, mixing and the language labeller."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from roadlake.llm import language_crf as L
from roadlake.llm import mixing, neighbours, pieces, range_coder, token_counts, token_files

PATH = P.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["awkward", "crowd", "documents", "nothing"])
def test_counts_are_the_library_s(request, name):
    df = request.getfixturevalue(name)
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), n := len(ids_of(r["text"])), n > 1024) for r in df.select("doc_id", "text").collect())
    assert sorted((str(r[0]), *r[1:]) for r in token_counts.count_tokens(df, PATH).collect()) == want


def test_every_prefix_has_its_exact_count():
    c, r = token_counts.PrefixCounter(PATH), random.Random(4)
    texts = ["don't  we'll 've   \n\n it's <|endoftext|> end!!  ", "naïve Straße ÉCOLE 東京 🙂 ÀB  \t\n x", "a\n\n\nb   c\r\n d'", "they'r 'll'l x'v"]
    texts += ["".join(r.choice(["the", "ing", " ", "  ", "\n", "'s", "'r", "é", "12", "!", "<|endo", "ther"]) for _ in range(40)) for _ in range(25)]
    for t in texts:
        ends, counts = c.boundaries(t)
        for n in range(len(t) + 1):
            assert c.count_prefix(t, ends, counts, n) == len(ids_of(t[:n])), (t, n)


def test_budget_questions(documents):
    rows = {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").limit(30).collect()}
    prefixes = token_counts.prefix_counts(documents.limit(30), PATH)
    for r in token_counts.fitting_chars(prefixes, 100).collect():
        text = rows[r["doc_id"]]
        assert len(ids_of(text[: r["chars"]])) <= 100
        assert r["chars"] == len(text) or len(ids_of(text)) > 100


@pytest.mark.parametrize("name", ["awkward", "crowd", "documents", "nothing"])
def test_token_files_hold_the_library_s_ids(request, name):
    df = request.getfixturevalue(name)
    rows = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in df.select("doc_id", "text").collect())
    got = token_files.documents_of(token_files.write(df)).orderBy("start").collect()
    assert [r["doc_id"] if r["doc_id"] is not None else None for r in got] == [d if known else None for known, d, _ in rows]
    crc = Counter((d if known else None, len(i := [*ids_of(t), 0]), zlib.crc32(np.array(i, "<u4").tobytes())) for known, d, t in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == crc
    assert [r["start"] for r in got] == np.append(0, np.cumsum([r["n_tokens"] for r in got]))[:-1].tolist()


def test_documents_run_over_blocks(spark, monkeypatch):
    """Long and short texts in one shard, with blocks in several groups of lanes."""
    monkeypatch.setattr(range_coder, "BLOCK", 64)
    monkeypatch.setattr(range_coder, "LANES", 3)
    rows = [(i, "word " * n) for i, n in enumerate([0, 1, 63, 64, 65, 1000, 2, 0, 127, 128])]
    batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    monkeypatch.setattr("pyspark.TaskContext.get", staticmethod(lambda: type("T", (), {"partitionId": staticmethod(lambda: 0)})))
    blocks = list(token_files._blocks(PATH, 0)(iter([batch.slice(0, 4), batch.slice(4)])))
    out = pa.Table.from_batches(list(token_files._read(iter(blocks)))).sort_by("first").to_pylist()
    assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out] == [(d, len(i := [*ids_of(t), 0]), zlib.crc32(np.array(i, "<u4").tobytes())) for d, t in rows]


def test_coder_round_trip_and_damage():
    r = np.random.default_rng(1)
    blocks = [r.integers(0, 50257, k, dtype=np.uint32) for k in (1, 2, 5, 300, 1000)]
    blocks += [np.zeros(700, np.uint32), (r.zipf(1.3, 5000) % 50000).astype(np.uint32), np.arange(3000, dtype=np.uint32) % 7 + 2**31, np.arange(600, dtype=np.uint32)]
    coded = range_coder.encode(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, range_coder.decode(coded), strict=True))
    # A block does not depend on its neighbours.
    assert [range_coder.encode([b])[0] for b in blocks] == coded
    assert all(np.array_equal(range_coder.decode([c])[0], b) for b, c in zip(blocks, coded, strict=True))
    assert len(coded[5]) < 60 and len(coded[7]) < 400
    with pytest.raises(ValueError):
        range_coder.decode([coded[4][:-40] + bytes([coded[4][-40] ^ 255]) + coded[4][-39:]])
    assert range_coder.encode([]) == [] == range_coder.decode([])


def level_by_hand(sizes, weights=(5, 2, 1), cap=3.0):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(full.values())
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > cap * sizes[s]]
        if not over:
            return full | share
        full |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("name", ["awkward", "crowd", "documents", "nothing"])
def test_mixing(request, name):
    df = request.getfixturevalue(name)
    got = mixing.mix(df).collect()
    assert len(got) == df.count()
    sizes = Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
    goal = level_by_hand(sizes) if got else {}
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    if name == "documents":
        assert sum(taken.values()) == pytest.approx(sum(sizes.values()), rel=0.1)
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    emitted = Counter((r["doc_id"], r["source"], r["text"]) for r in mixing.emit(df).collect())
    copies = Counter()
    texts = {(r["doc_id"], r["source"], r["k"]): r["text"] for r in df.select("doc_id", "source", "text", F.xxhash64("text").alias("k")).collect()}
    for r in got:
        copies[r["doc_id"], r["source"], texts[r["doc_id"], r["source"], r["row_key"]]] += r["copies"]
    assert emitted == +copies
    assert mixing.emit(df).columns == df.columns


def test_mixing_without_words(spark):
    got = mixing.mix(spark.createDataFrame([(1, " ", "a"), (2, None, "b")], "doc_id long, text string, source string")).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2


def test_forward_backward_is_that_of_one_chain():
    r = np.random.default_rng(2)
    lengths = [1, 0, 5, 127, 128, 129, 700, 3]
    first = np.append(0, np.cumsum(lengths))
    scores, moves = r.normal(size=(first[-1], 3)) * 2, r.normal(size=(3, 3))
    got, pairs = L.forward_backward(scores, first, moves, want_pairs=True)
    want_pairs = np.zeros((3, 3))
    for a, b in zip(first, first[1:], strict=False):
        if a == b:
            continue
        e, t = np.exp(scores[a:b]), np.exp(moves)
        alpha, beta = [t.sum(axis=0) * e[0]], [np.ones(3)]
        for x in e[1:]:
            alpha.append((alpha[-1] @ t) * x / alpha[-1].sum())
        for x in e[:0:-1]:
            y = t @ (x * beta[-1])
            beta.append(y / y.sum())
        m = np.array(alpha) * np.array(beta[::-1])
        assert np.allclose(got[a:b], m / m.sum(axis=1, keepdims=True))
        for i in range(len(e) - 1):
            j = alpha[i][:, None] * t * (e[i + 1] * beta[::-1][i + 1])[None]
            want_pairs += j / j.sum()
    assert np.allclose(pairs, want_pairs)


def test_labeller_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.label(docs, L.fit(L.training_rows(docs))).alias("g").join(docs.alias("d"), "doc_id").select("held_out", "lang_pred", "score", "lang", "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 100 and np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_labeller_follows_switches_of_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(L.training_rows(docs))
    by_lang = {r["lang"]: r["text"] for r in docs.filter(L.held_out() & (F.col("n_chars") > 400)).select("lang", "text").collect()}
    parts = [by_lang[x].split()[:40] for x in ("en", "de", "fr")]
    marginal, _ = L.Labeller(model).marginals([" ".join(w for p in parts for w in p)])
    names = [model.labels[i] for i in marginal.argmax(axis=1)]
    truth = [x for x, p in zip(("en", "de", "fr"), parts, strict=True) for w in p if any(c.isalpha() for c in w)]
    assert np.mean([a == b for a, b in zip(names, truth, strict=True)]) > 0.9


def test_labeller_edges(awkward, nothing):
    model = L.fit(L.training_rows(awkward))
    rows = {r["doc_id"]: r for r in L.label(awkward, model).collect()}
    for d in (1, 7, 70):  # null, white space, digits and signs
        assert (rows[d]["lang_pred"], rows[d]["score"]) == ("und", 0.0)
    assert {r["lang_pred"] for r in rows.values()} <= {"und", "en", "fr"}
    empty = L.fit(L.training_rows(nothing))
    assert empty.labels == [] and {r["lang_pred"] for r in L.label(awkward, empty).collect()} == {"und"}
    assert not L.label(nothing, model).collect()
    kept = L.recognised(awkward, model, 0.5)
    assert kept.columns == awkward.columns and 0 < kept.count() < awkward.count()


def test_mixed_languages_are_recognised(spark, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(L.training_rows(docs))
    by_lang = {r["lang"]: r["text"] for r in docs.filter(L.held_out() & (F.col("n_chars") > 400)).select("lang", "text").collect()}
    mixed = " ".join(w for x in ("en", "de", "fr") for w in by_lang[x].split()[:40])
    assert L.Labeller(model).label([mixed])[1][0] < 0.5
    df = spark.createDataFrame([(1, mixed), (2, "123 !!"), (3, None)], "doc_id long, text string")
    assert [r["doc_id"] for r in L.recognised(df, model, 0.5).collect()] == [1]
    assert [r["doc_id"] for r in L.recognised(df, L.fit(L.training_rows(nothing)), 0.5).collect()] == [1]


def vectors(spark, n=600, dim=24):
    r = np.random.default_rng(9)
    v = r.normal(size=(n, dim)).astype(np.float32)
    v[50:90] = v[50]  # copies
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(1000, None), (1020, [0.0] * dim), (1040, [float("nan")] + [1.0] * (dim - 1)), (1060, [None] + [1.0] * (dim - 1)), (1080, [float("inf")] + [1.0] * (dim - 1)), (1100, [1.0] * 3), (None, v[3].tolist()), (7, v[7].tolist())]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("entry", F.lit(1)), v


def test_neighbours_recall_and_order(spark):
    df, v = vectors(spark)
    v = v.astype(np.float64)
    got = neighbours.search(df, F.col("id") % 20 == 0).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(found) == list(range(0, 600, 20))
    hits = 0
    for q, hit in found.items():
        scores = v @ v[q]
        want = sorted((i for i in range(len(v)) if i != q), key=lambda i: (-(v[i] * v[q]).sum(), i))[:20]
        hits += len({i for i, _ in hit} & set(want))
        assert len(hit) == 20 and all(s == pytest.approx(scores[i], abs=1e-9) for i, s in hit)
        assert hit == sorted(hit, key=lambda x: (-x[1], x[0]))
    assert hits / (20 * len(found)) >= 0.9


def test_neighbours_with_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (5, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, neighbours.search(df, F.col("id") % 20 == 0, probes=4).collect()))
    assert got == [(0, 1, 20, 1.0), (0, 2, 5, 0.0), (20, 1, 0, 1.0), (20, 2, 5, 0.0)]
    assert neighbours.search(df.limit(0), F.col("id") % 20 == 0).collect() == []


def test_neighbours_of_every_length(spark):
    """Vectors of a length that is not the most common one are searched among their own."""
    df, v = vectors(spark)
    r = np.random.default_rng(10)
    few = r.normal(size=(30, 5)).astype(np.float32)
    both = df.select("vec_id", "embedding").unionByName(spark.createDataFrame([(2000 + i, x.tolist()) for i, x in enumerate(few)], "vec_id long, embedding array<float>"))
    got = sorted(map(tuple, neighbours.search(both, F.col("id") % 20 == 0, probes=10).collect()))
    few = few.astype(np.float64)
    for q in (0, 20):
        want = sorted((i for i in range(30) if i != q), key=lambda i: (-(few[i] * few[q]).sum(), i))[:20]
        assert [(rank, i) for id_, rank, i, _ in got if id_ == 2000 + q] == [(n + 1, 2000 + i) for n, i in enumerate(want)]
    assert {id_ for id_, *_ in got} == {*range(0, 600, 20), 2000, 2020}


def test_pieces_are_encoded_once(monkeypatch):
    """A worker that has met several hundred thousand pieces still knows them all."""
    enc = token_files.Encoder(PATH)
    learned, learn = [], enc._learn
    monkeypatch.setattr(enc, "_learn", lambda pieces: learned.append(len(pieces)) or learn(pieces))
    spell = lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(4))
    texts = [" ".join(map(spell, range(at, at + 2000))) for at in range(0, 340_000, 2000)]
    first = enc.encode(pa.array(texts))
    again = enc.encode(pa.array(texts[::-1]))
    assert learned == [340_000]
    sizes = np.split(first[0], np.cumsum(first[1])[:-1])
    assert again[0].tolist() == np.concatenate(sizes[::-1]).tolist() and again[1].tolist() == first[1][::-1].tolist()
    assert sizes[7].tolist() == ids_of(texts[7])


def test_new_words_are_encoded_many_in_one_text():
    """The tokenizer is called for a thousand new words at once, not for each."""
    enc, calls = token_files.Encoder(PATH), []

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def __getattr__(self, name):
            return getattr(self.tokenizer, name)

        def encode_batch_fast(self, texts, **kwargs):
            calls.append(len(texts))
            return self.tokenizer.encode_batch_fast(texts, **kwargs)

    enc._lexicon.splitter.tokenizer = Counted(enc._lexicon.splitter.tokenizer)
    words = ["".join(chr(97 + n // 26**k % 26) for k in range(4)) + "\u00e9\u0180"[: n % 3] for n in range(20_000)]
    odd = ["don't", "we'll go", "a\u00a0b", "x\u00d7y z\u00aa", "  two", "tab\there", "12 34a", " <|endoftext|> a", "\u4e2d \u6587 abcq", " ", "", "\n\n end"]
    texts = [*(" ".join(words[i : i + 100]) for i in range(0, 20_000, 100)), *odd]
    for part in (texts[:150], texts[150:], texts):
        ids, sizes = enc.encode(pa.array(part))
        assert [a.tolist() for a in np.split(ids, np.cumsum(sizes)[:-1])] == [ids_of(t) for t in part]
    assert sum(calls) < 600


def test_lexicon_tells_pieces_apart_in_a_crowded_table(monkeypatch):
    """Hashes that all want one place of the table still have a number each."""
    spelled = []
    whole = pieces.W.Sums.hash
    monkeypatch.setattr(pieces.W.Sums, "hash", lambda *a: whole(*a) & np.uint64((1 << 40) - 1))
    lexicon = pieces.Lexicon(pieces.Splitter(PATH), 10**6)
    text = " ".join("".join(chr(97 + n // 26**k % 26) for k in range(3)) for n in range(300))
    for t in (text[:500], text, text):
        numbers, first = lexicon.cut(pa.array([t, t]), spelled.clear, spelled.extend)
        assert [spelled[i] for i in numbers] == 2 * lexicon.splitter.pieces(t) and first.tolist() == [0, len(numbers) // 2, len(numbers)]
    assert len(spelled) == len(set(spelled)) == len(lexicon)


def test_trails_are_those_of_the_step_by_step_model():
    r = np.random.default_rng(3)
    x = r.integers(0, 4, (5, 300)).astype(np.int32)
    x[1, :100] = 0
    context = r.integers(0, 9, x.shape).astype(np.uint32)
    context[1] = 0
    got = range_coder._trails(context, x)
    for lane in range(5):
        known = {}
        for t in range(300):
            guess, run = known.get(context[lane, t], (0, 0))
            now = x[lane, t]
            assert got[lane, t] == run | (guess == now) << 4 | (guess < now) << 5
            known[context[lane, t]] = (now, min(run + 1, 15) if guess == now else 0)


def test_alphabets_are_packed_whole():
    for ids in ([0], [254], [255], [0, 1, 256, 511, 766, 2**32 - 1], [7, 8, 2**31]):
        a = np.array(ids, np.uint32)
        assert range_coder._unpack(range_coder._pack(a), len(a)).tolist() == ids
