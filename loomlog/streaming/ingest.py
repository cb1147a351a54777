"""Lines as a stream: matched ones to a table, the others to a dead-letter table from which new templates come.

Matching needs no state, so the stream is a plain projection.  Each micro-batch
is written under its batch id with ``overwrite`` of that id alone, so a batch
that is run again after a failure replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import match
from ..plans.catalog import Catalog
from ..sources.logs import MAX_LINE
from . import discovery

BUFFER = 2500


def matched_table(spark: SparkSession, home: str) -> DataFrame:
    return spark.read.parquet(f"{home}/matched")


def dead_letters(spark: SparkSession, home: str) -> DataFrame:
    return spark.read.parquet(f"{home}/unmatched")


def start(lines: DataFrame, catalog: Catalog, home: str, content: str = "content", on_buffer: Callable[[DataFrame], None] | None = None, buffer: int = BUFFER, once: bool = True) -> StreamingQuery:
    """Match a stream of lines into ``home``/matched and ``home``/unmatched.

    Null lines and lines of more than MAX_LINE characters are matched like
    others but never kept for discovery.  ``on_buffer`` gets the dead letters of a batch when
    there are ``buffer`` of them or more.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # written in two passes: a cached batch is far larger than its lines, and a task reads all of its part
        own = match.parse(batch, catalog, content, partial=False).where(F.size("matches") > 0).drop("partial")
        own.write.mode("overwrite").parquet(f"{home}/matched/batch={number}")
        short = batch.where(F.length(content) <= MAX_LINE)
        if len(catalog.templates) <= match.MANY:  # no fields of lines that match
            short = short.where(F.size(match.templates_column(catalog, F.col(content))) == 0)
        dead = match.unmatched(match.parse(short, catalog, content)).drop("matches")
        dead.write.mode("overwrite").parquet(f"{home}/unmatched/batch={number}")
        if on_buffer is not None:
            left = spark.read.parquet(f"{home}/unmatched/batch={number}")
            if left.limit(buffer).count() >= buffer:
                on_buffer(left)

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", f"{home}/_checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()


def rematch(lines: DataFrame, old: DataFrame, before: Catalog, after: Catalog, changed: frozenset[int], key: str = "line_id") -> DataFrame:
    """(key, template_id, trail_len) after an edit: lines of unchanged templates alone keep their rows, the others are matched anew.

    ``old`` is ``match.line_matches`` under ``before``.  A line is left alone
    only if no template was added and none of its own changed.
    """
    added = [t for t in changed if t not in before.templates]
    if added:
        return match.line_matches(match.parse(lines, after, partial=False), key)
    touched = old.where(F.col("template_id").isin([*changed])).select(key).distinct() if changed else old.limit(0).select(key)
    known = old.select(key).distinct()
    again = lines.join(touched, key, "left_semi").union(lines.join(known, key, "left_anti"))
    kept = old.join(touched, key, "left_anti").select(key, "template_id", "trail_len")
    return kept.union(match.line_matches(match.parse(again, after, partial=False), key))


def learn(spark: SparkSession, home: str, catalog: Catalog, proposer: discovery.Proposer | None = None, buffer: int = BUFFER) -> Catalog:
    """New templates from the dead letters, ``buffer`` of them at a time."""
    return discovery.run(dead_letters(spark, home), catalog, proposer, buffer)[0]
