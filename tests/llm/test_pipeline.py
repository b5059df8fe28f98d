"""The pipeline's stages, one after the other, against plain walks over what each receives."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from test_copies import jaccard_groups
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from roadlake.llm import contamination, mixing, queries
from roadlake.session import materialize

SMALL = "/root/testdata/sf0.001"
TOKENIZER = Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", ["awkward", "crowd", "around_phrase", "documents", "nothing"])
def test_stages(spark, request, name):
    docs = request.getfixturevalue(name)
    at = {c: i for i, c in enumerate(docs.columns)}
    seen = {}
    for stage, fn in pipeline.STAGES[:-1]:
        before = rows_of(docs)
        out = fn(spark, docs, SMALL)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        out = materialize(out, "test-stage")
        after = seen[stage] = rows_of(out)
        assert set(after) <= set(before)
        if stage == "language":
            assert all(any(c.isalpha() for c in r[at["text"]] or "") for r in after) and all(n == before[r] for r, n in after.items())
        if stage == "near_dedup":
            rows = [(r[at["doc_id"]], r[at["text"]]) for r in before.elements()]
            place, groups = jaccard_groups(rows), defaultdict(set)
            for g, (d, _) in zip(place, rows, strict=True):
                groups[g].add(d)
            kept = [r[at["doc_id"]] for r in after.elements() if r[at["doc_id"]] is not None]
            assert sorted(kept) == sorted({min(m - {None}) for m in groups.values() if m - {None}})
            assert sum(r[at["doc_id"]] is None for r in after.elements()) == sum(m == {None} for m in groups.values())
        if stage == "decontaminate":
            hit = {(r["doc_id"]) for r in contamination.find(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
            assert {r[at["doc_id"]] for r in after} == {r[at["doc_id"]] for r in before} - hit
        if stage == "mix":
            assert after == rows_of(mixing.emit(docs))
        docs = out
    got = pipeline.STAGES[-1][1](spark, docs, SMALL).orderBy("start").collect()
    want = sorted(((r[at["doc_id"]] is not None, r[at["doc_id"]] or 0, r[at["text"]] or "") for r in rows_of(docs).elements()))
    ids = [[*TOKENIZER.encode(t, add_special_tokens=False).ids, 0] for _, _, t in want]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((d if k else None, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (k, d, _), i in zip(want, ids, strict=True))


def test_clean_documents_pass_the_first_stage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = pipeline.language(spark, docs, "").count()
    assert kept >= 0.98 * docs.filter("text rlike '[A-Za-z]'").count()


def test_run_and_registration(spark):
    import __spark_entry__ as e

    names = e.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names) and len([n for n in names if n.startswith("op")]) >= 10
    out = names["pipeline"](spark, SMALL)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0
