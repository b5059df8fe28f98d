"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame operations only.

Items fall into size classes by their number of distinct shingles (powers of two). An item's sketch is the
smallest hashes of its shingles, as many as its class needs: a document that holds the share ``contain``
of the shingles misses so few that it must hold one of the sketch. So the sketch is complete, and a
document shorter than a class allows never meets that class. Document shingles are looked up in the
sketches; what hits is verified by exact containment of the shingles themselves.

Words are runs of letters and digits, lower-cased: layout, case and punctuation do not hide an item.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlake.llm.base import materialize

SHINGLE, CONTAIN = 5, 0.8
#: Rows of the sketch index up to which it is broadcast; a larger one is joined by shuffling.
SMALL_INDEX = 200_000


def _words(text: str) -> F.Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _with_hashes(df: DataFrame, k: int) -> DataFrame:
    """Adds the hashes of all shingles of ``_words``; of all words together, where they are fewer than k."""
    part = lambda i: F.xxhash64(*[F.get(F.col("_h"), i + j) for j in range(k)])
    places = F.sequence(F.lit(0), F.greatest(F.size("_h") - k, F.lit(0)))
    shingles = F.when(F.size("_h") > 0, F.transform(places, part)).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w))).withColumn("_shingles", shingles).drop("_h")


def _exact(words: str, k: int) -> F.Column:
    """Distinct shingles as text."""
    last = F.greatest(F.size(words) - k, F.lit(0))
    spelled = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(F.col(words), i + 1, F.lit(k)), " "))
    return F.array_distinct(F.when(F.size(words) > 0, spelled).otherwise(F.array().cast("array<string>")))


def sketches(items: DataFrame, k: int = SHINGLE, contain: float = CONTAIN) -> DataFrame:
    """(item_id, item_key, n, least, code): the sketch of each item, one row per hash.

    A class of sizes [2**c, 2**(c+1)) takes the number of hashes that its largest size needs; ``least`` is
    the number of distinct shingles that any document holding the item must have.
    """
    hashed = _with_hashes(items.select("item_id", F.xxhash64("text").alias("item_key"), _words("text").alias("_words")), k)
    sized = hashed.withColumn("_codes", F.array_sort(F.array_distinct("_shingles"))).withColumn("n", F.size("_codes")).filter("n > 0")
    top = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1
    take = F.least(F.col("n"), (top - F.ceil(top * contain) + 1).cast("int"))
    least = F.ceil(F.pow(F.lit(2.0), F.floor(F.log2("n"))) * contain).cast("int")
    return sized.select("item_id", "item_key", "n", least.alias("least"), F.explode_outer(F.slice("_codes", F.lit(1), take)).alias("code"))


def find(docs: DataFrame, items: DataFrame, k: int = SHINGLE, contain: float = CONTAIN, short: int | None = None) -> DataFrame:
    """(doc_id, row_key, item_id, n_shingles, n_found, containment): each document and the items it holds.

    ``n_shingles`` is the number of distinct shingles of the item, ``n_found`` those that the document has;
    pairs with n_found >= contain * n_shingles are returned. Items of fewer than k words are one shingle of
    all of them, and are found in texts of just these words; with ``short``, those of that many words or more
    are found wherever their words follow each other. Null texts and texts without words hold
    nothing; items without words are never found. ``row_key`` (a hash of the text) tells rows of one doc_id
    apart; repeated rows are one. Other columns are not looked at; an empty table on either side gives no rows.
    """
    index = materialize(sketches(items, k, contain), "minhash-sketches")
    small = index.count() <= SMALL_INDEX
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("row_key"))
    hashed = _with_hashes(keyed.select("doc_id", "row_key", _words("text").alias("_words")), k)
    # An outer explode: for an inner one the optimiser pushes a filter on the array's size below it, and with
    # it the whole expression, to be evaluated again for every element.
    codes = hashed.select("doc_id", "row_key", F.size("_shingles").alias("_n"), F.explode_outer("_shingles").alias("code"))
    met = codes.join(F.broadcast(index) if small else index, "code").filter("_n >= least")
    pairs = materialize(met.select("doc_id", "row_key", "item_id", "item_key").distinct(), "minhash-candidates")
    found = _verified(keyed, items, pairs, k, contain)
    if short is None:
        return found
    return reduce(DataFrame.unionByName, _phrases(keyed, items, short, k), found).distinct()


def _phrases(keyed: DataFrame, items: DataFrame, least: int, k: int) -> list[DataFrame]:
    """Texts that hold the whole phrase of an item of ``least`` to k - 1 words, one table for each length."""
    phrases = items.select("item_id", _words("text").alias("_words")).filter(F.size("_words").between(least, k - 1))
    phrases = materialize(phrases.distinct(), "short-items")
    lengths = sorted(r["n"] for r in phrases.select(F.size("_words").alias("n")).distinct().collect())  # k - 1 at most
    out = []
    for n in lengths:
        index = _with_hashes(phrases.filter(F.size("_words") == n), n).select("item_id", F.array_join("_words", " ").alias("_phrase"), F.get("_shingles", F.lit(0)).alias("code"))
        index = materialize(index, "short-index")
        hashed = _with_hashes(keyed.select("doc_id", "row_key", _words("text").alias("_words")), n)
        codes = hashed.select("doc_id", "row_key", F.explode_outer("_shingles").alias("code"))
        met = codes.join(F.broadcast(index) if index.count() <= SMALL_INDEX else index, "code").select("doc_id", "row_key", "item_id", "_phrase").distinct().alias("m")
        texts = keyed.alias("t").join(met, F.col("t.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("t.row_key") == F.col("m.row_key")))
        # Words hold no space, so the phrase between spaces is a run of whole words.
        spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
        held = texts.filter(F.contains(spaced(F.array_join(_words("text"), " ")), spaced(F.col("_phrase"))))
        one = F.lit(1).cast("long")
        out.append(held.select("t.doc_id", "t.row_key", "item_id", one.alias("n_shingles"), one.alias("n_found"), F.lit(1.0).alias("containment")))
    return out


def _verified(keyed: DataFrame, items: DataFrame, pairs: DataFrame, k: int, contain: float) -> DataFrame:
    """Exact containment of the candidate pairs; a text is cut into shingles once for all its candidates."""
    spelled = items.select("item_id", F.xxhash64("text").alias("item_key"), _words("text").alias("_words"))
    spelled = spelled.select("item_id", "item_key", _exact("_words", k).alias("_item")).distinct()
    asked = pairs.alias("p").join(spelled.alias("i"), F.col("p.item_id").eqNullSafe(F.col("i.item_id")) & (F.col("p.item_key") == F.col("i.item_key")))
    asked = asked.select("doc_id", "row_key", F.col("p.item_id").alias("item_id"), "_item")
    texts = keyed.alias("t").join(asked.alias("a"), F.col("t.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("t.row_key") == F.col("a.row_key")))
    texts = texts.select("t.doc_id", "t.row_key", "item_id", "_item", _words("text").alias("_words"))
    counted = texts.select("doc_id", "row_key", "item_id", F.size("_item").cast("long").alias("n_shingles"), F.size(F.array_intersect(F.col("_item"), _exact("_words", k))).cast("long").alias("n_found"))
    # Grouped before it is filtered: a filter straight on n_found is pushed below the projections, which
    # writes the split text into the expression for each single shingle.
    best = counted.groupBy("doc_id", "row_key", "item_id", "n_shingles").agg(F.max("n_found").alias("n_found"))
    return best.filter(F.col("n_found") >= F.col("n_shingles") * contain).withColumn("containment", F.col("n_found") / F.col("n_shingles"))


#: DuckDB: exact containment of every item in every document.
SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda p: array_to_string(w[p : p + 4], ' '))) AS s FROM d WHERE len(w) > 0),
si AS (SELECT DISTINCT item_id, unnest(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda p: array_to_string(w[p : p + 4], ' '))) AS s FROM i WHERE len(w) > 0),
n AS (SELECT item_id, count(*)::BIGINT AS n_shingles FROM si GROUP BY item_id),
f AS (SELECT doc_id, item_id, count(*)::BIGINT AS n_found FROM ds JOIN si USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment FROM f JOIN n USING (item_id) WHERE n_found >= n_shingles * 0.8::DOUBLE
"""
