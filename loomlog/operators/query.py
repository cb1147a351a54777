"""Boolean queries over parsed lines.

Every predicate is about one line, so a query of any depth is one column
expression over the line's ``fields``, ``trail`` and ``matches``: no join, no
set operation and no shuffle.

Value predicates are true if any value of the attribute satisfies any target;
under negation, if any value fails any target.  Pairs that cannot be read as
numbers (or dates) are left out, under negation too.  Existence looks at
partial matches as well; its negation holds for all other lines.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..plans.catalog import Catalog, wildcard
from . import match

COMPARE = {
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    "=": lambda a, b: a == b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
}


@dataclass(frozen=True)
class Condition:
    names: tuple[str, ...]
    values: tuple[str, ...] = ()
    exact: bool = True
    case_sensitive: bool = True
    comparison: str | None = None
    negation: bool = False
    existence: bool = False
    static_match: bool = False


@dataclass(frozen=True)
class Query:
    operator: str
    conditions: tuple[Condition | Query, ...]


def _many(x) -> tuple[str, ...]:
    return tuple(str(v) for v in x) if isinstance(x, (list, tuple)) else (str(x),)


def read(data) -> Query | Condition:
    """A query from ``{operator, conditions}`` or a condition from its positional list."""
    if isinstance(data, dict):
        if data.get("operator") not in ("AND", "OR"):
            raise ValueError("operator must be AND or OR")
        if not data.get("conditions"):
            raise ValueError("a query needs conditions")
        return Query(data["operator"], tuple(read(c) for c in data["conditions"]))
    names, values, *rest = data
    exact, case, comparison, negation, existence, static = [*rest, *[True, True, None, False, False, False][len(rest) :]]
    if comparison and comparison not in COMPARE:
        raise ValueError(f"unknown comparison {comparison!r}")
    return Condition(_many(names), _many(values), bool(exact), bool(case), comparison or None, bool(negation), bool(existence), bool(static))


def prepare(parsed: DataFrame, catalog: Catalog, include_partial: bool = True) -> DataFrame:
    """``parsed`` with the columns that predicates read: fields and trail."""
    if not include_partial:
        parsed = parsed.withColumn("partial", F.array().cast(match.PARTIAL))
    return match.once(parsed, fields=match.fields_column(catalog), trail=match.trail_column(catalog))


def predicate(catalog: Catalog, query: Query | Condition, standardized: bool = False, events: tuple[str, ...] = (), reference: str = "1970-01-01") -> Column:
    """The query as a boolean column over ``prepare``'s result."""
    if isinstance(query, Query):
        parts = [predicate(catalog, c, standardized, events, reference) for c in query.conditions]
        return reduce((lambda a, b: a & b) if query.operator == "AND" else (lambda a, b: a | b), parts)
    names = list(query.names)
    if standardized:
        for e in sorted(events, key=len, reverse=True):
            names = [n.removeprefix(f"{e}.") for n in names]
    if query.static_match:
        return _static(catalog, query)
    nodes = catalog.attribute_nodes(names)
    if query.existence:
        has = F.arrays_overlap("trail", F.array(*[F.lit(n) for n in nodes])) if nodes else F.lit(False)
        return ~has if query.negation else has
    if not nodes or not query.values:
        return F.lit(False)
    dates = [n for n in nodes if catalog.nodes[n].token.type == "datetime_t"]
    groups = [(dates, True), ([n for n in nodes if n not in dates], False)] if query.comparison else [(nodes, False)]
    parts = [_any_value(query, own, date, reference) for own, date in groups if own]
    return reduce(lambda a, b: a | b, parts)


def _any_value(q: Condition, nodes: list[int], date: bool, reference: str) -> Column:
    return F.exists("fields", lambda f: f["node_id"].isin(nodes) & _test(q, f["value"], date, reference))


def _test(q: Condition, value: Column, date: bool, reference: str) -> Column:
    """Any target that ``value`` satisfies; under negation any that it does not."""
    if q.comparison:
        read_ = (lambda c: F.coalesce(c.try_cast("double"), scalars.parse_epoch(c, reference).cast("double"))) if date else scalars.parse_float
        left = read_(value)
        tests = [COMPARE[q.comparison](left, read_(F.lit(v))) for v in q.values]
    else:
        if not q.case_sensitive:
            value = F.lower(value)
        targets = [v if q.case_sensitive else v.lower() for v in q.values]
        if q.exact and not q.negation:
            return value.isin(targets)
        tests = [value == v if q.exact else value.contains(v) for v in targets]
    return F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(~t if q.negation else t, F.lit(False)) for t in tests]), F.lit(False))


def _static(catalog: Catalog, q: Condition) -> Column:
    """Lines of the templates whose text fits; attribute and negation do not matter."""
    fold = (lambda s: s) if q.case_sensitive else str.lower
    texts = {t: fold(wildcard(catalog, t).strip()) for t in catalog.templates}
    fits = [t for t, text in texts.items() if any(fold(v) == text if q.exact else fold(v) in text for v in q.values)]
    return F.exists("matches", lambda m: m["template_id"].isin(fits)) if fits else F.lit(False)


def where(lines: DataFrame, catalog: Catalog, query, content: str = "content", backend: str = "auto", include_partial: bool = True, **options) -> DataFrame:
    """The rows of ``lines`` that the query keeps, with their own columns."""
    q = query if isinstance(query, (Query, Condition)) else read(query)
    own = prepare(match.parse(lines, catalog, content, backend, include_partial), catalog, include_partial)
    return own.where(predicate(catalog, q, **options)).select(*lines.columns)


def run_all(lines: DataFrame, catalog: Catalog, queries: dict, key: str = "line_id", content: str = "content", **options) -> DataFrame:
    """(query, key) of all named queries, from one pass over the lines."""
    own = prepare(match.parse(lines, catalog, content), catalog)
    hits = F.array_compact(F.array(*[F.when(predicate(catalog, read(q), True, **options), F.lit(name)) for name, q in queries.items()]))
    return own.select(F.explode(hits).alias("query"), key)


def load_queries(paths: list[str]) -> dict:
    """Named queries of several JSON files: later ones win, missing or broken files are left out."""
    out: dict = {}
    for p in paths:
        try:
            with open(p, encoding="utf-8") as f:
                out |= json.load(f)
        except (OSError, ValueError):
            continue
    return out


def save_query(path: str, name: str, query: dict) -> None:
    read(query)
    own = load_queries([path])
    own[name] = query
    with open(path, "w", encoding="utf-8") as f:
        json.dump(own, f, indent=1)


def missing_mappings(spark, catalog: Catalog, exact: int = 0) -> DataFrame:
    """(attribute): none of its nodes mapped (1), some but not all (-1), or not all (0)."""
    rows = [(s.name, bool(s.mapping)) for s in catalog.semantics.values() if s.name]
    g = spark.createDataFrame(rows, "attribute string, has boolean").groupBy("attribute").agg(F.bool_or("has").alias("some"), F.bool_and("has").alias("all"))
    return g.where({1: "not some", -1: "some and not all", 0: "not all"}[exact]).select("attribute")
