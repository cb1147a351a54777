"""Line deduplication by overlapping three-line windows.

Every run of three consecutive lines of a text is hashed (128 bits).  Of the
windows with equal lines, wherever they stand, the first by (doc_id, line)
stays; the lines covered by any later one go.  Covered positions of
overlapping windows merge, and what is left keeps its order.

The first place of a window is a minimum, aggregated before the shuffle, so a
window that stands in a third of all documents costs a row for each task.

Cases: texts of fewer than three lines have no window and stay as they are; a
null text has no lines and stays null; very long texts are processed whole, in
time and memory linear in their length; lines are compared as they stand, blank
ones included; repeated rows of one ``doc_id`` with equal texts count as one
document, and texts that differ under one ``doc_id`` are told apart by their
hash; null ids sort first.  All columns are kept; names that clash with the
helpers' are safe, as helpers are prefixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LINES = 3


def _key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(common.NULL_ID)).alias("_doc"), F.xxhash64("text").alias("_th")]


def windows(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """(_doc, _th, _at, _h1, _h2) for each window of each text."""
    hashed = docs.where(F.col("text").contains("\n")).select(*_key(), F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))).alias("_l"))
    hashed = hashed.where(F.size("_l") >= lines)
    at = F.sequence(F.lit(0), F.size("_l") - lines)
    exploded = hashed.select(
        "_doc",
        "_th",
        F.posexplode(
            F.transform(at, lambda i: F.struct(F.xxhash64(*[F.get("_l", i + k)["a"] for k in range(lines)]).alias("x"), F.xxhash64(*[F.get("_l", i + k)["b"] for k in range(lines)]).alias("y")))
        ).alias("_at", "_w"),
    )
    return exploded.select("_doc", "_th", "_at", F.col("_w.x").alias("_h1"), F.col("_w.y").alias("_h2"))


def later_windows(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """(_doc, _th, _gone): positions at which windows start that also start earlier."""
    w = windows(docs, lines)
    first = w.groupBy("_h1", "_h2").agg(F.min(F.struct("_doc", "_th", "_at")).alias("_first"), F.max(F.struct("_doc", "_th", "_at")).alias("_last"))
    first = first.where("_first <> _last").drop("_last")
    late = w.join(first, ["_h1", "_h2"]).where(F.struct("_doc", "_th", "_at") != F.col("_first"))
    return late.groupBy("_doc", "_th").agg(F.array_sort(F.collect_set("_at")).alias("_gone"))


def dedup(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """``docs`` with the later copies of repeated windows taken out of ``text``, plus n_lines and n_removed."""
    late = later_windows(docs, lines)
    own = docs.select(*docs.columns, *_key())
    joined = own.join(late, ["_doc", "_th"], "left")
    covered = F.array_distinct(F.flatten(F.transform("_gone", lambda p: F.sequence(p, p + lines - 1))))

    def kept(x: Column) -> Column:
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), covered), lambda i: F.get(x, i)), "\n")

    # a lambda's variable holds the lines, so that a text is split once and no row carries it twice
    rest = F.get(F.transform(F.array(F.split("text", "\n", -1)), kept), F.lit(0))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(rest)
    n_lines = F.coalesce(F.length("text") - F.length(F.translate("text", "\n", "")) + 1, F.lit(0)).cast("long")
    columns = [text.alias(c) if c == "text" else F.col(c) for c in docs.columns]
    return joined.select(*columns, n_lines.alias("_n_lines"), F.coalesce(F.size(covered), F.lit(0)).cast("long").alias("_n_removed"))


def query(spark, sf_dir):
    d = dedup(common.read(spark, sf_dir, "documents"))
    return d.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.md5("text").alias("kept_md5"))


ORACLE = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, unnest(range(0, len(x) - 2)) AS pos, x FROM l WHERE len(x) >= 3),
h AS (SELECT doc_id, pos, x[pos + 1] || chr(10) || x[pos + 2] || chr(10) || x[pos + 3] AS t FROM w),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY t ORDER BY doc_id, pos) AS n FROM h),
g AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS i FROM r WHERE n > 1),
k AS (SELECT l.doc_id, len(x) AS n, unnest(x) AS line, unnest(range(0, len(x))) AS i FROM l),
f AS (SELECT k.doc_id, any_value(k.n) AS n, count(g.i) AS gone,
        coalesce(string_agg(k.line, chr(10) ORDER BY k.i) FILTER (WHERE g.i IS NULL), '') AS t
      FROM k LEFT JOIN g USING (doc_id, i) GROUP BY k.doc_id)
SELECT d.doc_id, coalesce(f.n, 0)::BIGINT AS n_lines, coalesce(f.gone, 0)::BIGINT AS n_removed, md5(f.t) AS kept_md5
FROM documents d LEFT JOIN f USING (doc_id)
"""
