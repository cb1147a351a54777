"""Counts, top values, samples and token weights over parsed lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..plans.catalog import Catalog
from . import graphs, match


def value_counts(values: DataFrame) -> DataFrame:
    """(node_id, value, n) of ``match.field_values``; counts are summed before the shuffle."""
    return values.groupBy("node_id", "value").agg(F.count("*").alias("n"))


def top_values(values: DataFrame, k: int = 10) -> DataFrame:
    """(node_id, rank, value, n): the k most common values of each node, ties to the one seen first.

    The window runs over counts.  Spark keeps k rows of each node per task
    before the shuffle (window group limit), so a node with very many values
    is no bottleneck.
    """
    counts = values.groupBy("node_id", "value").agg(F.count("*").alias("n"), F.min("line_id").alias("first"))
    w = Window.partitionBy("node_id").orderBy(F.desc("n"), "first", "value")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("node_id", "rank", "value", "n")


def template_counts(parsed: DataFrame) -> DataFrame:
    """(template_id, n): lines of each template."""
    return parsed.select(F.explode("matches.template_id").alias("template_id")).groupBy("template_id").agg(F.count("*").alias("n"))


def node_counts(parsed: DataFrame, catalog: Catalog) -> DataFrame:
    """(node_id, n): lines that pass each node."""
    return parsed.select(F.explode(match.trail_column(catalog)).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("n"))


def match_stats(parsed: DataFrame) -> DataFrame:
    """One row: total, matched, unmatched, percentage."""
    matched = F.count_if(F.size("matches") > 0)
    return parsed.agg(
        F.count("*").alias("total"),
        matched.alias("matched"),
        (F.count("*") - matched).alias("unmatched"),
        F.round(F.when(F.count("*") > 0, 100.0 * matched / F.count("*")).otherwise(F.lit(0.0)), 6).alias("percentage"),
    )


def tree_stats(catalog: Catalog) -> dict[str, int]:
    """Nodes, variables, templates, fields, and distinct mapped taxonomy fields."""
    own = [s for n, s in catalog.semantics.items() if n in catalog.nodes]
    return {
        "nodes": len(catalog.nodes),
        "variables": sum(n.token.is_variable for n in catalog.nodes.values()),
        "templates": len(catalog.templates),
        "fields": len({s.name for s in own if s.name}),
        "mappings": len({f for s in own for f in s.mapping}),
    }


def _ranked(parsed: DataFrame, order, k: int) -> DataFrame:
    rows = parsed.select("line_id", "content", F.explode("matches.template_id").alias("template_id"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("template_id").orderBy(*order))).where(F.col("rank") <= k)


def examples(parsed: DataFrame, k: int = 5) -> DataFrame:
    """(template_id, rank, line_id, content): the first k lines of each template."""
    return _ranked(parsed, ["line_id"], k).select("template_id", "rank", "line_id", "content")


def last_lines(parsed: DataFrame, k: int) -> DataFrame:
    """The last k lines of each template."""
    return _ranked(parsed, [F.desc("line_id")], k).select("template_id", "rank", "line_id", "content")


def sample(parsed: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """k lines of each template in an order that only the seed and the line fix."""
    return _ranked(parsed, [F.xxhash64(F.lit(seed), F.col("line_id")), "line_id"], k).select("template_id", "rank", "line_id", "content")


def _least(rows: DataFrame, order: list[str], k: int) -> DataFrame:
    """The first k rows of each template.  The rank is compared at once, so that each task keeps k rows of a template before the shuffle."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("template_id").orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def keep_lines(parsed: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Lines to go on with: k of each template (the first with fewest templates, then by seed), and all unmatched ones."""
    overlap = F.size("matches")
    rows = parsed.select("line_id", "content", overlap.alias("overlap"), F.explode("matches.template_id").alias("template_id"), F.xxhash64(F.lit(seed), F.col("line_id")).alias("_s"))
    first = _least(rows, ["overlap", "line_id"], 1).withColumn("first", F.lit(True))
    some = first
    if k > 1:  # the first may be among the others, which are then one more
        others = _least(rows, ["_s", "line_id"], k).withColumn("first", F.lit(False))
        both = first.union(others).groupBy("template_id", "line_id").agg(F.any_value("content").alias("content"), F.any_value("_s").alias("_s"), F.max("first").alias("first"))
        some = both.withColumn("rank", F.row_number().over(Window.partitionBy("template_id").orderBy(F.desc("first"), "_s", "line_id"))).where(F.col("rank") <= k)
    kept = some.select("line_id", "content").distinct()
    return kept.union(match.unmatched(parsed).select("line_id", "content"))


def overlap_pairs(parsed: DataFrame) -> DataFrame:
    """(t1, t2, n): ordered pairs of templates that share lines, from each line's own list."""
    both = F.flatten(F.transform("matches.template_id", lambda a: F.transform(F.col("matches.template_id"), lambda b: F.struct(a.alias("t1"), b.alias("t2")))))
    return parsed.where(F.size("matches") > 1).select(F.inline(both)).where("t1 < t2").groupBy("t1", "t2").agg(F.count("*").alias("n"))


def partition_shares(parsed: DataFrame) -> DataFrame:
    """(templates, n, share): lines by their set of templates."""
    sets = parsed.groupBy(F.array_join(F.array_sort("matches.template_id"), ",").alias("templates")).agg(F.count("*").alias("n"))
    total = sets.agg(F.sum("n").alias("_total"))
    return sets.join(F.broadcast(total)).select("templates", "n", F.round(F.col("n") / F.col("_total"), 6).alias("share"))  # the total is one row


def value_overlap(counts: DataFrame) -> DataFrame:
    """(n1, n2, weight): shared over all occurrences of two nodes' values, from ``value_counts``.

    A value is one row for each node that has it, so a very common value costs
    the square of the nodes (a bounded number), not of the lines.
    """
    sizes = counts.groupBy("node_id").agg(F.sum("n").alias("size"))
    by_value = counts.groupBy("value").agg(F.collect_list(F.struct("node_id", "n")).alias("own")).where(F.size("own") > 1)
    pairs = by_value.select(F.inline(F.flatten(F.transform("own", lambda a: F.transform("own", lambda b: F.struct(a["node_id"].alias("n1"), b["node_id"].alias("n2"), (a["n"] + b["n"]).alias("both")))))))
    shared = pairs.where("n1 < n2").groupBy("n1", "n2").agg(F.sum("both").alias("both"))
    a, b = sizes.toDF("n1", "s1"), sizes.toDF("n2", "s2")
    return shared.join(F.broadcast(a), "n1").join(F.broadcast(b), "n2").select("n1", "n2", F.round(F.col("both") / (F.col("s1") + F.col("s2")), 6).alias("weight"))


def token_weights(values: DataFrame, simplify: float | None = None, at_least: int = 100) -> DataFrame:
    """(node_id, token, n, weight): lines whose value has a token (whole, or one of its alphanumeric parts), over the node's lines.

    With ``simplify``, nodes with ``at_least`` tokens or more keep those whose
    weight is above it.
    """
    parts = F.filter(F.split("value", "[^0-9A-Za-z]+"), lambda t: t != "")
    tokens = F.array_distinct(F.filter(F.concat(F.array("value"), parts), lambda t: t != ""))
    kinds = graphs.cut(value_counts(values))  # lines are matched once, values split once
    counts = kinds.select("node_id", "n", F.explode(tokens).alias("token")).groupBy("node_id", "token").agg(F.sum("n").alias("n"))
    seen = kinds.groupBy("node_id").agg(F.sum("n").alias("_seen"))
    out = counts.join(F.broadcast(seen), "node_id").withColumn("weight", F.round(F.col("n") / F.col("_seen"), 6))
    if simplify is not None:
        many = counts.groupBy("node_id").agg(F.count("*").alias("_tokens"))
        out = out.join(F.broadcast(many), "node_id").where((F.col("_tokens") < at_least) | (F.col("weight") > simplify))
    return out.select("node_id", "token", "n", "weight")


def numeric_summary(values: DataFrame) -> DataFrame:
    """(node_id, n, low, high, mean) of the values that read as numbers."""
    x = scalars.parse_float(F.col("value"))
    return values.select("node_id", x.alias("x")).where("x is not null").groupBy("node_id").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean"))
