"""Document fingerprints: a threshold-scaled sketch of shingle hashes, in DataFrame operations only.

A text's words are runs of non-white characters; its shingles are five consecutive words (all words
together, where there are fewer). A sketch keeps every distinct shingle hash in the lowest sixteenth of the
hash range. That fraction alone would leave short texts without any hash, so the 64 smallest hashes are
kept as well, and ``limit`` says up to which hash the sketch is complete (the whole range, if nothing was
left out). Two sketches, however unequal their documents, are compared up to the lesser limit, where both
are complete; in the same way sketches merge into the sketch of both documents together.

A null text is an empty one; texts without words have an empty, complete sketch and are alike. Texts are
hashed whole, so that equal texts have equal fingerprints.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlake.llm import ranges

SHINGLE, FRACTION, FLOOR = 5, 1 / 16, 64
#: Hashes are taken as numbers of 63 bits.
TOP = (1 << 63) - 1
#: Bytes of text that one task orders.
RANGE_BYTES = 4 << 20


def with_sketch(df: DataFrame, text: str, out: str, k: int = SHINGLE, fraction: float = FRACTION, floor: int = FLOOR) -> DataFrame:
    """Adds ``out``, a struct (limit, codes): the codes ascend."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    places = F.sequence(F.lit(0), F.greatest(F.size("_w") - k, F.lit(0)))
    code = lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(F.col("_w"), i + j) for j in range(k)]), 1)
    d = df.withColumn("_w", F.transform(words, lambda w: F.xxhash64(w)))
    d = d.withColumn("_c", F.when(F.size("_w") > 0, F.transform(places, code)).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("_s", F.sort_array(F.array_distinct("_c")))
    d = d.withColumn("_l", F.greatest(F.lit(int(fraction * TOP)), F.coalesce(F.get("_s", F.lit(floor - 1)), F.lit(TOP))))
    d = d.withColumn("_k", F.filter("_s", lambda c: c <= F.col("_l")))
    limit = F.when(F.size("_k") == F.size("_s"), F.lit(TOP)).otherwise(F.col("_l"))
    return d.withColumn(out, F.struct(limit.alias("limit"), F.col("_k").alias("codes"))).drop("_w", "_c", "_s", "_l", "_k")


def _below(sketch: str | Column, limit: Column) -> Column:
    s = F.col(sketch) if isinstance(sketch, str) else sketch
    return F.filter(s["codes"], lambda c: c <= limit)


def merged(a: str, b: str) -> Column:
    """The sketch of two documents together."""
    limit = F.least(F.col(a)["limit"], F.col(b)["limit"])
    return F.struct(limit.alias("limit"), F.sort_array(F.array_union(_below(a, limit), _below(b, limit))).alias("codes"))


def compared(df: DataFrame, a: str, b: str, likeness: str, a_in_b: str, b_in_a: str) -> DataFrame:
    """Adds the estimated Jaccard similarity of two sketches, and the share of each one's shingles that the other
    holds; null where there is no second sketch."""
    limit = F.least(F.col(a)["limit"], F.col(b)["limit"])
    d = df.withColumn("_x", _below(a, limit)).withColumn("_y", _below(b, limit))
    d = d.withColumn("_both", F.size(F.array_intersect("_x", "_y"))).withColumn("_x", F.size("_x")).withColumn("_y", F.size("_y"))
    share = lambda part, whole: F.when(F.col(b).isNull(), F.lit(None).cast("double")).when(whole > 0, part / whole).otherwise(
        F.when(F.col("_x") + F.col("_y") > 0, 0.0).otherwise(1.0))
    both = F.col("_both").cast("double")
    d = d.withColumns({likeness: share(both, F.col("_x") + F.col("_y") - F.col("_both")), a_in_b: share(both, F.col("_x")), b_in_a: share(both, F.col("_y"))})
    return d.drop("_x", "_y", "_both")


def spelled(sketch: str) -> Column:
    """A sketch as text: its limit, a colon and its codes, each of 16 hex digits."""
    digits = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return F.concat(digits(F.col(sketch)["limit"]), F.lit(":"), F.array_join(F.transform(F.col(sketch)["codes"], digits), ""))


def with_next(docs: DataFrame, carried: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Adds ``next_<column>`` for each carried column: that of the next row by descending doc_id (ties by text),
    after the last the first. A row without doc_id has no next one: null.

    Rows are dealt out by ranges of doc_id. The first row of a range also goes, as a guest, to the end of
    the range before it; what follows a row is then always in its own range. One shuffle, no join.
    """
    ends = ranges.upper_ends(docs.select("doc_id", F.octet_length("text").alias("_n")), "doc_id", F.coalesce("_n", F.lit(0)) + 64, range_bytes)
    n = max(1, len(ends))
    own = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")).otherwise(F.col("_range"))
    turn = F.when(F.col("doc_id").isNull(), F.lit(2)).otherwise(F.lit(0))
    here = F.struct(own.alias("at"), turn.alias("turn"))
    guest = F.struct(((F.col("_range") + 1) % n).alias("at"), F.lit(1).alias("turn"))
    first = F.col("doc_id") == F.get(F.lit(np.array(ends or [0], np.int64)), F.col("_range"))
    d = docs.withColumn("_range", ranges.range_of(F.col("doc_id"), ends))
    d = d.withColumn("_place", F.explode(F.when(first, F.array(here, guest)).otherwise(F.array(here))))
    w = Window.partitionBy("_at").orderBy("_turn", F.desc("doc_id"), "_tie", "text")
    d = d.select(*docs.columns, F.col("_place.at").alias("_at"), F.col("_place.turn").alias("_turn"), F.xxhash64("text").alias("_tie"))
    d = d.withColumns({f"next_{c}": F.when(F.col("doc_id").isNotNull(), F.lead(c).over(w)) for c in carried})
    return d.where("_turn <> 1").drop("_at", "_turn", "_tie")


def fingerprint_edits(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Each document, its text with the last third replaced by the beginning of the next document, and how alike
    their sketches are: (doc_id, text, edited, n_chars, sketch, edited_sketch, near_edited, text_in_edited,
    edited_in_text, near_next, text_in_next, next_in_text).

    Repeated doc_ids follow one another by their texts; rows without doc_id are edited by cutting only and have
    null for the next document; of one document alone the next is itself. Other columns are not looked at.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = with_next(with_sketch(d, "text", "sketch"), ["text", "sketch"], range_bytes)
    d = d.withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    head = F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - third)
    d = d.withColumn("edited", F.concat(head, F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third))).drop("next_text")
    d = with_sketch(d, "edited", "edited_sketch")
    d = compared(d, "sketch", "edited_sketch", "near_edited", "text_in_edited", "edited_in_text")
    return compared(d, "sketch", "next_sketch", "near_next", "text_in_next", "next_in_text").drop("next_sketch")
