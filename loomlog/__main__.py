"""Command line: ingest, query, learn, evaluate."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators import export, match, metrics, query, stats
from .plans.catalog import Catalog
from .sources import logs
from .streaming import discovery


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="loomlog", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, about in (("ingest", "export a log's lines as JSON"), ("query", "ids of the lines of each query of a file"), ("learn", "templates for the lines that none matches"), ("evaluate", "how well two catalogs agree")):
        s = sub.add_parser(name, help=about)
        s.add_argument("log")
        s.add_argument("out")
        s.add_argument("--catalog", required=name != "learn")
        if name == "ingest":
            s.add_argument("--taxonomy", action="store_true")
        if name == "query":
            s.add_argument("--queries", required=True, nargs="+")
        if name == "evaluate":
            s.add_argument("--target", required=True)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("loomlog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    lines = logs.read_log(spark, a.log)
    c = Catalog.load(a.catalog) if a.catalog else Catalog()
    if a.command == "ingest":
        parsed = match.parse(lines, c)
        export.write(parsed, c, a.out, a.taxonomy)
        print(stats.match_stats(parsed).first().asDict())
    elif a.command == "query":
        query.run_all(lines, c, query.load_queries(a.queries)).write.mode("error").partitionBy("query").csv(a.out)
    elif a.command == "learn":
        left = match.unmatched(match.parse(lines, c, partial=False)).select("line_id", "content")
        found, rounds = discovery.run(left, c)
        found.save(a.out)
        print(f"{len(found.templates) - len(c.templates)} templates in {rounds} rounds")
    else:
        other = Catalog.load(a.target)
        combos = metrics.combinations(lines, c, other)
        scores = {"group_accuracy": metrics.group_accuracy(combos), "group_similarity": metrics.group_accuracy(combos, True), "parser_accuracy": metrics.parser_accuracy(combos, c, other), "template_similarity": metrics.parser_accuracy(combos, c, other, True)}
        with open(a.out, "w", encoding="utf-8") as f:
            json.dump({k: df.first()[0] for k, df in scores.items()}, f)


if __name__ == "__main__":
    main()
