"""Parsed lines as attributes, JSON entries and rows in the layout of log-parsing benchmarks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..plans.catalog import Catalog, wildcard
from . import match

ATTRIBUTES = "map<string,array<string>>"


def _by_node(entries: dict[int, list[str]]) -> Column:
    return F.create_map(*[x for n, v in entries.items() for x in (F.lit(n), F.array(*[F.lit(s) for s in v]))]) if entries else F.create_map().cast("map<int,array<string>>")


def _coerced(catalog: Catalog, node: Column, value: Column, reference: str) -> Column:
    """Values of typed nodes as they are exported."""
    out = value
    for kind in {catalog.nodes[n].token.type for n in catalog.nodes} & set(scalars.CONVERTERS) - {"string_t"}:
        own = [n for n in catalog.nodes if catalog.nodes[n].token.type == kind]
        out = F.when(node.isin(own), scalars.coerce(value, kind, reference)).otherwise(out)
    return out


def attributes_column(catalog: Catalog, names: dict[int, list[str]], reference: str = "1970-01-01") -> Column:
    """name -> distinct values in order of node id, over the line's full matches."""
    named = _by_node(names)
    own = F.when(F.size("matches") > 0, match.fields_column(catalog)).otherwise(F.array().cast(match.FIELDS))
    own = F.array_sort(own, lambda a, b: a["node_id"] - b["node_id"])
    pairs = F.flatten(
        F.transform(
            F.filter(own, lambda f: F.map_contains_key(named, f["node_id"])),
            lambda f: F.transform(F.element_at(named, f["node_id"]), lambda n: F.struct(n.alias("name"), _coerced(catalog, f["node_id"], f["value"], reference).alias("value"))),
        )
    )
    # one evaluation of the pairs, whatever is made of them
    return F.get(
        F.transform(
            F.array(pairs),
            lambda p: F.map_from_entries(
                F.transform(
                    F.array_sort(F.array_distinct(F.transform(p, lambda x: x["name"]))),
                    lambda n: F.struct(n, F.array_distinct(F.transform(F.filter(p, lambda x: x["name"] == n), lambda x: x["value"]))),
                )
            ),
        ),
        F.lit(0),
    ).cast(ATTRIBUTES)


def created(catalog: Catalog) -> dict[int, list[str]]:
    """Attribute of each node, reserved kinds included, as the export has them."""
    return {n: [s.attribute] for n, s in catalog.semantics.items() if s.attribute}


def mapped(catalog: Catalog) -> dict[int, list[str]]:
    return {n: list(s.mapping) for n, s in catalog.semantics.items() if s.mapping}


def entries(parsed: DataFrame, catalog: Catalog, taxonomy: bool = False, reference: str = "1970-01-01", keep: tuple[str, ...] = ("line_id", "content")) -> DataFrame:
    """Per line: templates, attributes; with ``taxonomy`` its fields and events, and raw attributes as ``unmapped``."""
    templates = F.array_sort(F.coalesce(F.col("matches.template_id"), F.array().cast("array<int>")))
    raw = attributes_column(catalog, created(catalog), reference)
    if not taxonomy:
        return parsed.select(*keep, templates.alias("templates"), raw.alias("attributes"))
    events = F.array_sort(F.array_distinct(F.flatten(F.transform("matches", lambda m: F.coalesce(F.element_at(_by_node({t: list(e) for t, e in catalog.events.items()}), m["template_id"]), F.array().cast("array<string>"))))))
    return parsed.select(*keep, templates.alias("templates"), attributes_column(catalog, mapped(catalog), reference).alias("attributes"), raw.alias("unmapped"), events.alias("events"))


def as_json(rows: DataFrame) -> DataFrame:
    """Entries as one JSON text each; an attribute with one value is written as a scalar.

    Values stay text: their types are in ``header``.
    """
    keys = F.map_keys("attributes")
    one = F.transform(
        keys,
        lambda k: F.concat(
            F.lit('"'), scalars.quoted(k), F.lit('":'),
            F.when(F.size(F.element_at("attributes", k)) == 1, F.concat(F.lit('"'), scalars.quoted(F.get(F.element_at("attributes", k), F.lit(0))), F.lit('"'))).otherwise(F.to_json(F.element_at("attributes", k))),
        ),
    )
    return rows.select("line_id", F.concat(F.lit('{"templates":'), F.to_json("templates"), F.lit(',"content":"'), scalars.quoted(F.col("content")), F.lit('","attributes":{'), F.array_join(one, ","), F.lit("}}")).alias("json"))


def header(catalog: Catalog) -> dict:
    """What is said once for an export: templates with their events, and variables with description and type."""
    variables = {}
    for n, s in sorted(catalog.semantics.items()):
        if s.attribute:
            variables.setdefault(s.attribute, {"description": s.description, "type": catalog.nodes[n].token.type})
    return {
        "templates": {str(t): {"template": wildcard(catalog, t, "name"), "events": list(catalog.events.get(t, ()))} for t in catalog.templates},
        "variables": variables,
    }


def write(parsed: DataFrame, catalog: Catalog, path: str, taxonomy: bool = False) -> None:
    """Entries as JSON lines, and the header beside them."""
    spark = parsed.sparkSession
    as_json(entries(parsed, catalog, taxonomy)).select("json").write.mode("error").text(f"{path}/entries")
    spark.createDataFrame([(json.dumps(header(catalog)),)], "json string").coalesce(1).write.mode("error").text(f"{path}/header")


def line_fields(parsed: DataFrame, catalog: Catalog, taxonomy: bool = False, dedup: bool = True) -> DataFrame:
    """(line_id, attribute, values): fields of a line's trail; nodes without a captured value give their literal."""
    names: dict[int, list[str]] = {}
    for n, s in catalog.semantics.items():
        own = list(s.mapping) if taxonomy and s.mapping else [s.name] if s.name else []
        if own:
            names[n] = own
    literals = {n: [catalog.nodes[n].token.value] for n in names}
    got = F.col("_f")
    captured = lambda n: F.get(F.filter(got, lambda f: (f["node_id"] == n) & (f["value"] != "")), F.lit(0))["value"]
    own = parsed.select("line_id", match.fields_column(catalog).alias("_f"), match.trail_column(catalog).alias("_t"))
    pairs = F.flatten(
        F.transform(
            F.array_sort(F.filter("_t", lambda n: F.map_contains_key(_by_node(names), n))),
            lambda n: F.transform(F.element_at(_by_node(names), n), lambda a: F.struct(a.alias("attribute"), F.coalesce(captured(n), F.get(F.element_at(_by_node(literals), n), F.lit(0))).alias("value"))),
        )
    )
    rows = own.select("line_id", F.transform(F.array(pairs), lambda p: F.transform(F.array_distinct(F.transform(p, lambda x: x["attribute"])), lambda a: F.struct(a.alias("attribute"), F.transform(F.filter(p, lambda x: x["attribute"] == a), lambda x: x["value"]).alias("values")))).alias("_p"))
    out = rows.select("line_id", F.inline(F.flatten("_p")))
    return out.withColumn("values", F.array_distinct("values")) if dedup else out


def benchmark_rows(parsed: DataFrame, catalog: Catalog, keep: tuple[str, ...] = ("line_id", "content")) -> DataFrame:
    """(…, EventIDs, EventTemplates, EventMatches), matches in order of template id."""
    text = F.create_map(*[x for t in catalog.templates for x in (F.lit(t), F.lit(wildcard(catalog, t).strip()))])
    own = F.array_sort("matches", lambda a, b: a["template_id"] - b["template_id"])
    return parsed.withColumn("_m", own).select(
        *keep,
        F.transform("_m", lambda m: m["template_id"]).alias("EventIDs"),
        F.transform("_m", lambda m: F.element_at(text, m["template_id"])).alias("EventTemplates"),
        F.transform("_m", lambda m: F.transform(m["fields"], lambda f: f["value"])).alias("EventMatches"),
    )
