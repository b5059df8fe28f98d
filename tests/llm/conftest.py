"""Fixtures of the training-data operators: awkward rows of every kind, and the driver's small tables."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadlake.llm import words as W
from roadlake.llm.base import utf8

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def invented(seed: int, n_words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n_words))


def awkward_rows() -> list[tuple]:
    passage = invented(1, 70)
    base = invented(2, 300)
    near = base.split(" ")
    near[150] = "changed"
    line = "This very line is long enough to be counted as one."
    texts = [
        None, "", " \t\n ", "one", "one two three", base, base, " ".join(near),
        invented(3, 40) + " " + passage + " " + invented(4, 30), invented(5, 20) + "\n" + passage + "\n" + invented(6, 10), passage,
        invented(7, 9000), "x" * 5000, "a\x1cb c\xa0d e \x0b f", "naïve Straße ÉCOLE 東京 🙂 ÀB", "don't  we'll 've   \n\n it's <|endoftext|> end",
        f"{line}\nown {invented(8, 3)}", f"  {line.upper()}\t\nother", f"{line}\n{line}\nlast", f"first\n{line}", f"{line}\r\n\n", f"{invented(9, 5)}\n {line} ",
        "\n".join([line] * 3), "12345 67890 !!! ???", "same same same " * 60, "same same same " * 60,
    ]
    rows = [(3 * i + 1, t, ["en", "fr", None][i % 3], ["b", "a", None, "B", "é"][i % 5], 0) for i, t in enumerate(texts)]
    rows += [rows[5], rows[8]]  # repeated rows
    rows += [(4, "another text under the id of an earlier row", "en", "a", 1), (None, base, "en", "a", 1), (None, passage, None, None, 1)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    """Extra columns have names that operators use inside."""
    df = spark.createDataFrame(awkward_rows(), SCHEMA)
    return df.withColumns({"row_key": F.lit("x"), "size": F.lit(None).cast("string"), "fp": F.lit(1), "lang_pred": F.lit("q"), "spans": F.lit(0), "copies": F.lit(2)})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def crowd(spark):
    """Large groups: exact copies, near copies, a passage and a line that very many documents share."""
    passage, copied, line = invented(100, 80), invented(101, 150), "one line that stands in nearly every document of them"
    rows = []
    for i in range(240):
        own = invented(1000 + i, 30 + i % 50)
        if i % 4 == 0:
            text = copied
        elif i % 4 == 1:
            near = copied.split(" ")
            near[i // 4] = "other"
            text = " ".join(near)
        elif i % 4 == 2:
            text = f"{own} {passage} {invented(5000 + i, 20)}"
        else:
            text = f"{own}\n{line}\n{passage if i % 8 == 3 else own}"
        rows.append((1000 - i, text, "en", "hot" if i % 3 else f"s{i}", 0))
    return spark.createDataFrame(rows, SCHEMA).repartition(7)


@pytest.fixture(scope="session")
def around_phrase(spark):
    """Passages around a stock phrase that end at different places; the smallest document has the phrase only.
    The phrase is the smallest seed of many, so that it is the anchor of the windows over it."""
    found = W.Selected(*utf8(pa.array([invented(200, 20_000)])), 50, 10)
    at = int(found.anchor[found.seed.argmin()])
    phrase = " ".join(invented(200, 20_000).split(" ")[at : at + 10])
    rows = [(0, f"{invented(201, 60)} {phrase} {invented(202, 60)}", "en", "a", 0)]
    for i in range(1, 30):
        passage = f"{invented(300 + i, 25)} {phrase} {invented(400 + i, 18)}"
        rows += [(100 * c + i, f"{invented(1000 * c + i, 40)} {passage} {invented(5000 * c + i, 45)}", "en", "a", 0) for c in (1, 2, 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def staggered(spark):
    """Quotes of passages that begin and end at different places: the documents that share most on the right and
    on the left of an anchor are others than the one that shares a window."""
    rows = []
    for p in range(12):
        passage, r = invented(700 + p, 100).split(" "), random.Random(p)
        for i, (a, b) in enumerate([(50, 60), (10, 90), (45, 95), (12, 62), (25, 80)] + [(a, a + r.randint(20, 60)) for a in (r.randint(0, 60) for _ in range(25))]):
            rows.append((100 * i + p, f"{invented(9000 + 50 * p + i, 30)} {' '.join(passage[a:b])} {invented(20000 + 50 * p + i, 30)}", "en", "a", 0))
    return spark.createDataFrame(rows, SCHEMA).repartition(5)
