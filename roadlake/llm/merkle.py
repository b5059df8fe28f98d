"""Merkle dataset manifest: one digest for a table, and for every row the siblings that prove its place in it.

Rows of a group (a language) are leaves in the order of their ids; two neighbouring nodes, or a last one
alone, are hashed into their parent until one is left. The groups' roots, in the order of the groups,
likewise give the root of the table.

The levels are worked through in tiers of eight. Blocks of 256 consecutive nodes are whole subtrees, so
that windows over (group, block) never grow. A node of level l is held by the row of its first leaf, at slot
0 of 2**l rows. Per level a lead by 2**l brings the right sibling to the left one and a lag the left to the
right, masked by slot and by the length of the run; rows of first children hash the parents. The blocks'
digests are the nodes of the next tier. On the way down a lag by 2**l hands the siblings of the levels
above from a parent's row to that of its second child, until every row has its whole path.

Text is read once, for the leaves; after that only digests travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlake.llm import ranges
from roadlake.llm.base import materialize

#: Levels of one tier.
LEVELS = 8
#: Rows that one task puts in order.
RANGE_ROWS = 50_000

_PATH = "array<struct<left:string,right:string>>"


def _field(value: Column) -> Column:
    """A field of a leaf: its UTF-8 byte count, a colon and itself; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return digest(*[_field(c) for c in (doc_id, source, lang, n_chars, text)])


def placed(nodes: DataFrame, ends: list[int], order: str) -> DataFrame:
    """Adds ``pos`` and ``n``: the place of each row in its ``grp`` by ``order`` (null first, ties by ``digest``), and
    the number of rows of the group.

    Ranges are numbered on their own and offset by the rows before them, a table of one row per range. Rows without
    ``order`` are cut by their digests, so that many of them are not one range.
    """
    part = F.when(F.col(order).isNull(), F.substring("digest", 1, 2)).otherwise(F.lit(""))
    at = F.when(F.col(order).isNull(), F.lit(-1)).otherwise(ranges.range_of(F.col(order), ends))
    d = nodes.withColumns({"_range": at, "_part": part})
    by = ["grp", "_range", "_part"]
    counts = d.groupBy(*by).agg(F.count(F.lit(1)).alias("_c"))
    in_order = Window.partitionBy("grp").orderBy("_range", "_part")
    before = counts.select(*by, (F.sum("_c").over(in_order) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy("grp")).alias("n"))
    own = F.row_number().over(Window.partitionBy(*by).orderBy(order, "digest"))
    return d.withColumn("_own", own).join(before, by).withColumn("pos", F.col("_before") + F.col("_own") - 1).drop(*by[1:], "_own", "_before")


def _climb(nodes: DataFrame) -> DataFrame:
    """Adds the siblings of each node by level (``_s0``...) and ``_top``, the digest of its block at slot 0 of it."""
    w = Window.partitionBy("grp", "_block").orderBy("pos")
    d = nodes.withColumn("_block", F.shiftright("pos", LEVELS)).withColumn("_top", F.col("digest"))
    for level in range(LEVELS):
        step = 1 << level
        first, second = F.col("pos") % (2 * step) == 0, F.col("pos") % (2 * step) == step
        d = d.withColumns({"_next": F.lead("_top", step).over(w), "_last": F.lag("_top", step).over(w)})
        sibling = F.when(F.col("n") > step, F.when(first, F.col("_next")).when(second, F.col("_last")))
        d = d.withColumn(f"_s{level}", sibling)
        parent = F.when(first, digest(F.col("_top"), F.coalesce(f"_s{level}", F.lit(""))))
        d = d.withColumn("_top", F.when(F.col("n") > step, parent).when(first, F.col("_top"))).drop("_next", "_last")
    return d


def _descend(d: DataFrame) -> DataFrame:
    """Turns the siblings by level into ``path``, that of every row through its block."""
    w = Window.partitionBy("grp", "_block").orderBy("pos")
    d = d.withColumn("path", F.array().cast(_PATH))
    for level in reversed(range(LEVELS)):
        step = 1 << level
        first, second = F.col("pos") % (2 * step) == 0, F.col("pos") % (2 * step) == step
        d = d.withColumn("_above", F.lag("path", step).over(w))
        sibling = F.col(f"_s{level}")
        one = F.struct(F.when(second, sibling).alias("left"), F.when(first, sibling).alias("right"))
        above = F.when(first, F.col("path")).when(second, F.col("_above"))
        # a row that the level counts for, but without sibling, is hashed alone: it stays in the path as an empty step
        d = d.withColumn("path", F.when(F.col("n") > step, F.concat(F.array(one), above)).otherwise(above)).drop("_above", f"_s{level}")
    return d


def trees(nodes: DataFrame, largest: int) -> DataFrame:
    """Rows (grp, pos, n, digest, ...) with ``path`` and the ``root`` of their group added.

    ``largest`` is the number of nodes of the largest group; tiers go on until every group has one node.
    """
    climbed = materialize(_climb(nodes), "merkle-tier")
    heads = climbed.where(F.col("pos") % (1 << LEVELS) == 0)
    heads = heads.select("grp", F.col("_block").alias("pos"), F.ceil(F.col("n") / (1 << LEVELS)).cast("long").alias("n"), F.col("_top").alias("digest"))
    more = -(-largest // (1 << LEVELS))
    up = trees(heads, more) if more > 1 else heads.withColumn("path", F.array().cast(_PATH)).withColumn("root", F.col("digest"))
    up = up.select("grp", F.col("pos").alias("_block"), F.col("path").alias("_rest"), "root")
    d = _descend(climbed.drop("_top")).join(up, ["grp", "_block"])
    return d.withColumn("path", F.concat("path", "_rest")).drop("_block", "_rest")


def fold(digest_: str, path: str) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    blank = F.lit("")
    return F.aggregate(F.col(path), F.col(digest_), lambda h, s: digest(F.coalesce(s["left"], blank), h, F.coalesce(s["right"], blank)))


def proof(path: str) -> Column:
    """The siblings of a path, level by level, as one digest."""
    return F.sha2(F.array_join(F.transform(F.col(path), lambda s: F.coalesce(s["left"], s["right"], F.lit(""))), ""), 256)


def manifest(leaves: DataFrame, by: str, order: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Leaves (``order`` an integer, ``by``, ``digest``, others kept) with ``subroot``, ``root`` and ``path`` added.

    Groups ascend by their UTF-8 bytes, null first and told apart from empty; rows of a group by ``order``, null
    first, ties by digest. An empty table gives an empty result.
    """
    # a sign in front keeps null (nothing) and the empty text ("=") apart, and first
    d = leaves.withColumn("grp", F.coalesce(F.concat(F.lit("="), F.col(by)), F.lit("")))
    d = placed(d, ranges.upper_ends(d, order, F.lit(1), range_rows), order)
    d = materialize(d, "merkle-leaves")
    largest = d.agg(F.max("n")).first()[0] or 0
    d = trees(d, largest).drop("pos", "n")
    tops = materialize(d.groupBy("grp").agg(F.first("root").alias("digest")), "merkle-groups")
    named = placed_names(tops.withColumnRenamed("grp", "name"))
    up = trees(named, max(1, tops.count())).select(F.col("name").alias("grp"), F.col("path").alias("_rest"), F.col("root").alias("_root"))
    d = d.withColumnRenamed("root", "subroot").join(up, "grp")
    return d.withColumn("path", F.concat("path", "_rest")).withColumnRenamed("_root", "root").drop("grp", "_rest")


def placed_names(names: DataFrame) -> DataFrame:
    """``pos`` and ``n`` of groups in the order of their names; names are numbered by their first bytes, then by all."""
    d = names.withColumn("_head", F.substring(F.hex("name"), 1, 6))
    counts = d.groupBy("_head").agg(F.count(F.lit(1)).alias("_c"))
    all_in_order, everything = Window.partitionBy(F.lit(0)).orderBy("_head"), Window.partitionBy(F.lit(0))
    before = counts.select("_head", (F.sum("_c").over(all_in_order) - F.col("_c")).alias("_before"), F.sum("_c").over(everything).alias("n"))
    own = F.row_number().over(Window.partitionBy("_head").orderBy("name"))
    d = d.withColumn("_own", own).join(before, "_head")
    return d.select("name", F.lit("").alias("grp"), (F.col("_before") + F.col("_own") - 1).alias("pos"), "n", "digest")


def document_manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """The manifest of ``documents``, and what checking each row against it gives.

    (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, path): where ``tampered`` holds, n_chars
    is taken one higher when the row is checked (null stays null). Repeated rows are leaves of their own; rows without
    doc_id come first in their language. Columns beyond the five of a document are not looked at.
    """
    c = {n: F.col(n) for n in ("doc_id", "source", "lang", "n_chars", "text")}
    forged = F.when(tampered & F.col("n_chars").isNotNull(), leaf(**(c | {"n_chars": F.col("n_chars") + 1})))
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", leaf(**c).alias("digest"), forged.alias("forged"))
    d = manifest(materialize(leaves, "leaves"), "lang", "doc_id").withColumnRenamed("digest", "leaf")
    d = d.withColumn("checked", F.coalesce("forged", "leaf"))
    d = d.withColumns({"proof_sha256": proof("path"), "folded_root": fold("checked", "path")})
    d = d.withColumn("verified", F.col("folded_root") == F.col("root"))
    return d.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "path")


def contract_tampering() -> Column:
    """Rows whose id's decimal digits have an unsigned CRC-32 that 7 divides."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))


_F = "COALESCE(CAST(STRLEN(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
_LEAF = "SHA256(" + " || ".join(_F.format(c=c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
#: The reversed CRC-32 polynomial, a bit at a time: fixed value.
_BYTE = "LIST_REDUCE(LIST_PREPEND(XOR(acc, ORD(ch)::BIGINT), RANGE(8)), LAMBDA c, k: CASE WHEN c % 2 = 1 THEN XOR(c // 2, 3988292384) ELSE c // 2 END)"

SQL = f"""WITH RECURSIVE cr AS (SELECT doc_id, 4294967295::BIGINT AS acc, CAST(doc_id AS VARCHAR) AS rest FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL SELECT doc_id, {_BYTE.replace("ORD(ch)", "ORD(LEFT(rest, 1))")}, SUBSTR(rest, 2) FROM cr WHERE rest <> ''),
 bad AS (SELECT doc_id FROM cr WHERE rest = '' AND XOR(acc, 4294967295) % 7 = 0),
 lv AS (SELECT doc_id, lang, {_LEAF.replace("{n}", "n_chars")} AS leaf, CASE WHEN n_chars IS NOT NULL AND doc_id IN (SELECT doc_id FROM bad) THEN {_LEAF.replace("{n}", "(n_chars + 1)")} END AS forged FROM documents),
 rk AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, COUNT(*) OVER (PARTITION BY lang) AS n FROM lv),
 t AS (SELECT lang, 0 AS lvl, pos, n, leaf AS h FROM rk
  UNION ALL SELECT lang, MIN(lvl) + 1, pos // 2, (MIN(n) + 1) // 2, SHA256(STRING_AGG(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lang, pos // 2),
 tm AS MATERIALIZED (SELECT * FROM t),
 sr AS MATERIALIZED (SELECT lang, h AS subroot, ROW_NUMBER() OVER (ORDER BY ENCODE(lang) NULLS FIRST) - 1 AS pos, COUNT(*) OVER () AS n FROM tm WHERE n = 1),
 u AS (SELECT 0 AS lvl, pos, n, subroot AS h FROM sr UNION ALL SELECT MIN(lvl) + 1, pos // 2, (MIN(n) + 1) // 2, SHA256(STRING_AGG(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY pos // 2),
 um AS MATERIALIZED (SELECT * FROM u),
 al AS MATERIALIZED (SELECT CONCAT('=', lang) AS k, lang IS NULL AS nil, lvl, pos, n, h, 0 AS part FROM tm UNION ALL SELECT '', false, lvl, pos, n, h, 1 FROM um),
 dr AS (SELECT rk.doc_id, rk.pos, rk.n, rk.leaf, COALESCE(rk.forged, rk.leaf) AS f, rk.lang, sr.subroot, sr.pos AS spos, sr.n AS sn, (SELECT h FROM um WHERE n = 1) AS root FROM rk JOIN sr ON rk.lang IS NOT DISTINCT FROM sr.lang),
 w AS (SELECT doc_id, leaf, lang, subroot, root, f AS h, '' AS sibs, 0 AS part, 0 AS lvl, pos, n, spos, sn FROM dr
  UNION ALL SELECT w.doc_id, w.leaf, w.lang, w.subroot, w.root,
   CASE WHEN w.n = 1 THEN w.h WHEN w.pos % 2 = 1 THEN SHA256(s.h || w.h) ELSE SHA256(w.h || COALESCE(s.h, '')) END,
   CASE WHEN w.n = 1 THEN w.sibs ELSE w.sibs || COALESCE(s.h, '') END,
   CASE WHEN w.n = 1 THEN w.part + 1 ELSE w.part END, CASE WHEN w.n = 1 THEN 0 ELSE w.lvl + 1 END,
   CASE WHEN w.n = 1 THEN w.spos ELSE w.pos // 2 END, CASE WHEN w.n = 1 THEN w.sn ELSE (w.n + 1) // 2 END, w.spos, w.sn
   FROM w LEFT JOIN al s ON s.part = w.part AND s.lvl = w.lvl AND s.pos = XOR(w.pos, 1) AND s.k = CASE WHEN w.part = 0 THEN CONCAT('=', w.lang) ELSE '' END AND s.nil = (w.part = 0 AND w.lang IS NULL)
   WHERE w.part < 2)
SELECT doc_id, leaf, subroot, root, SHA256(sibs) AS proof_sha256, h AS folded_root, h = root AS verified FROM w WHERE part = 2"""
