"""How well one parser agrees with another over the same lines.

Lines are reduced to their pair of template sets with a count, in one shuffle
summed on the map side; there are as many such rows as there are combinations,
not lines, and everything else is done on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..plans.catalog import Catalog, wildcard
from . import graphs, match


def combinations(lines: DataFrame, baseline: Catalog, target: Catalog, content: str = "content") -> DataFrame:
    """(b, t, n): lines by the baseline's and the target's set of templates."""
    ids = lambda c: F.array_sort(F.transform(match.matches_column(c, F.col(content)), lambda m: m["template_id"]))
    sets = match.spread(lines).select(ids(baseline).alias("b"), ids(target).alias("t"))
    return graphs.cut(sets.groupBy("b", "t").agg(F.count("*").alias("n")))  # a few rows that are read several times


def combinations_of_rows(baseline: DataFrame, target: DataFrame, key: str = "line_id") -> DataFrame:
    """The same from two tables (key, template_id); lines of one table alone have an empty set on the other side."""
    own = lambda df, name: df.groupBy(key).agg(F.array_sort(F.collect_set("template_id")).alias(name))
    empty = F.array().cast("array<int>")
    both = own(baseline, "b").join(own(target, "t"), key, "full")
    return graphs.cut(both.select(F.coalesce("b", empty).alias("b"), F.coalesce("t", empty).alias("t")).groupBy("b", "t").agg(F.count("*").alias("n")))


def _texts(spark, catalog: Catalog, name: str) -> DataFrame:
    rows = [(t, " ".join(wildcard(catalog, t).split())) for t in catalog.templates]
    return F.broadcast(spark.createDataFrame(rows, f"{name} int, {name}_text string"))  # a row for each template


def _pairs(combos: DataFrame) -> DataFrame:
    return combos.withColumn("_id", F.xxhash64("b", "t")).withColumn("bt", F.explode_outer("b")).withColumn("tt", F.explode_outer("t"))


def _mean_best(pairs: DataFrame, score) -> DataFrame:
    best = pairs.groupBy("_id", "n").agg(F.max(F.coalesce(score, F.lit(0.0))).alias("s"))
    return best.agg(F.round(F.sum(F.col("s") * F.col("n")) / F.sum("n"), 6).alias("score"))


def parser_accuracy(combos: DataFrame, baseline: Catalog, target: Catalog, soft: bool = False) -> DataFrame:
    """(score): share of lines with a pair of equal template texts; ``soft``: mean of the best edit ratio."""
    spark = combos.sparkSession
    pairs = _pairs(combos).join(_texts(spark, baseline, "bt"), "bt", "left").join(_texts(spark, target, "tt"), "tt", "left")
    exact = (F.col("bt_text") == F.col("tt_text")).cast("double")
    return _mean_best(pairs, scalars.edit_ratio(F.col("bt_text"), F.col("tt_text")) if soft else exact)


def group_accuracy(combos: DataFrame, soft: bool = False, penalise_overcapture: bool = True) -> DataFrame:
    """(score): share of lines with a pair of templates that have the same lines; ``soft``: mean of the best Jaccard of their lines.

    Penalised, a target group with lines outside the baseline's counts as 0.
    """
    pairs = _pairs(combos)
    size = lambda side, name: combos.select(F.explode(side).alias(name), "n").groupBy(name).agg(F.sum("n").alias(f"{name}_n"))
    shared = pairs.where("bt is not null and tt is not null").groupBy("bt", "tt").agg(F.sum("n").alias("both"))
    groups = shared.join(size("b", "bt"), "bt").join(size("t", "tt"), "tt")
    same = ((F.col("both") == F.col("bt_n")) & (F.col("both") == F.col("tt_n"))).cast("double")
    overlap = F.col("both") / (F.col("bt_n") + F.col("tt_n") - F.col("both"))
    if penalise_overcapture:
        overlap = F.when(F.col("both") < F.col("tt_n"), F.lit(0.0)).otherwise(overlap)
    scores = groups.select("bt", "tt", (overlap if soft else same).alias("_score"))
    return _mean_best(pairs.join(F.broadcast(scores), ["bt", "tt"], "left"), F.col("_score"))  # a row for each pair of templates


def group_accuracy_of_reference(combos: DataFrame, soft: bool = False) -> DataFrame:
    """The same over the lines that have a baseline template alone."""
    return group_accuracy(combos.where(F.size("b") > 0), soft, penalise_overcapture=False)


def _node_lines(lines: DataFrame, catalog: Catalog, content: str) -> DataFrame:
    """(nodes, n): lines by the nodes on their trail."""
    parsed = match.parse(lines.select(content), catalog, content)
    return graphs.cut(parsed.select(F.array_sort(match.trail_column(catalog)).alias("nodes")).groupBy("nodes").agg(F.count("*").alias("n")))


def schema_group_score(lines: DataFrame, baseline: Catalog, target: Catalog, soft: bool = False, penalise_overcapture: bool = True, content: str = "content") -> DataFrame:
    """(score): do both catalogs (with one tree) group the variables' lines alike; weighted by each variable's lines."""
    if baseline.nodes.keys() != target.nodes.keys() or baseline.templates != target.templates:
        raise ValueError("both catalogs must have the same tree")
    spark = lines.sparkSession
    name = lambda c, n: (c.semantics[n].attribute if n in c.semantics else None) or f"node_{n}"
    rows = [(n, name(baseline, n), name(target, n)) for n, x in baseline.nodes.items() if x.token.is_variable]
    fields = F.broadcast(spark.createDataFrame(rows, "node int, bf string, tf string"))
    sets = _node_lines(lines, baseline, content).withColumn("_id", F.xxhash64("nodes"))
    at = sets.select("_id", "n", F.explode("nodes").alias("node")).join(fields, "node")
    weight = at.groupBy("node", "bf", "tf").agg(F.sum("n").alias("weight"))
    size = lambda f: at.select("_id", "n", f).distinct().groupBy(f).agg(F.sum("n").alias(f"{f}_n"))
    both = at.select("_id", "n", "bf").distinct().join(at.select("_id", "tf").distinct(), "_id").groupBy("bf", "tf").agg(F.sum("n").alias("both"))
    scored = weight.join(size("bf"), "bf").join(size("tf"), "tf").join(both, ["bf", "tf"], "left").fillna(0, ["both"])
    same = ((F.col("both") == F.col("bf_n")) & (F.col("both") == F.col("tf_n"))).cast("double")
    overlap = F.col("both") / (F.col("bf_n") + F.col("tf_n") - F.col("both"))
    if penalise_overcapture:
        overlap = F.when(F.col("both") < F.col("tf_n"), F.lit(0.0)).otherwise(overlap)
    return scored.agg(F.round(F.sum(F.col("weight") * (overlap if soft else same)) / F.sum("weight"), 6).alias("score"))


def mapping_score(lines: DataFrame, baseline: Catalog, target: Catalog, events: tuple[str, ...] = (), content: str = "content") -> DataFrame:
    """(score): taxonomy fields that both catalogs give an attribute, over the target's, weighted by the attribute's lines."""

    def fields(c: Catalog) -> dict[str, set[str]]:
        out: dict[str, set[str]] = {}
        for s in c.semantics.values():
            if s.attribute:
                own = out.setdefault(s.attribute, set())
                for f in s.mapping:
                    e = next((e for e in sorted(events, key=len, reverse=True) if f.startswith(f"{e}.")), None)
                    own.add(f.removeprefix(f"{e}.") if e else f)
        return out

    spark, b, t = lines.sparkSession, fields(baseline), fields(target)
    rows = []
    for name, own in b.items():
        other = t.get(name, set())
        score = 1.0 if not own and not other else len(own & other) / len(other) if own and other else 0.0
        rows += [(n, name, score) for n in baseline.attribute_nodes([name])]
    scores = F.broadcast(spark.createDataFrame(rows, "node int, attribute string, score double"))  # a row for each node with an attribute
    sets = _node_lines(lines, baseline, content).withColumn("_id", F.xxhash64("nodes"))
    at = sets.select("_id", "n", F.explode("nodes").alias("node")).join(scores, "node").select("_id", "n", "attribute", "score").distinct()
    weight = at.groupBy("attribute", "score").agg(F.sum("n").alias("w"))
    return weight.agg(F.round(F.sum(F.col("w") * F.col("score")) / F.sum("w"), 6).alias("score"))


def query_scores(baseline: DataFrame, target: DataFrame, key: str = "line_id") -> DataFrame:
    """(query, precision, recall) of two tables (query, key); 0 where a denominator is empty.

    A line is one row before the second aggregation, so no set of lines is gathered.
    """
    rows = baseline.select("query", key, F.lit(1).alias("b"), F.lit(0).alias("t")).union(target.select("query", key, F.lit(0).alias("b"), F.lit(1).alias("t")))
    per_line = rows.groupBy("query", key).agg(F.max("b").alias("b"), F.max("t").alias("t"))
    n = per_line.groupBy("query").agg(F.sum(F.col("b") * F.col("t")).alias("both"), F.sum("b").alias("nb"), F.sum("t").alias("nt"))
    ratio = lambda d: F.round(F.when(F.col(d) > 0, F.col("both") / F.col(d)).otherwise(F.lit(0.0)), 6)
    return n.select("query", ratio("nt").alias("precision"), ratio("nb").alias("recall"))


def macro(scores: DataFrame) -> DataFrame:
    """Mean precision and recall over queries."""
    return scores.agg(F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("recall"), 6).alias("recall"))


def text_scores(found: DataFrame, truth: DataFrame, content: str = "content") -> DataFrame:
    """Precision and recall of distinct line texts against raw text files, by query."""
    own = lambda df: df.select("query", F.xxhash64(content).alias("h"), F.md5(content).alias("m")).select("query", F.concat_ws(":", "h", "m").alias("line_id"))
    return query_scores(own(truth), own(found))


def write_tsv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("error").option("sep", "\t").option("header", True).csv(path)
