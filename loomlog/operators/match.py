"""Lines against a catalog: which templates match, with which values, and how far the others got.

``parse`` adds two columns to a table of lines:

* ``matches``: array of (template_id, trail_len, fields) of all templates that
  match the whole line, longest path first;
* ``partial``: for lines that no template matches, array of (node_id, suffix,
  fields) of the furthest nodes of the tree that the line reaches.

A template matches a line if its full pattern does and, at each literal (or
closed) token that no blank follows, the text can go on without a blank.  The
second part is only tested where the compiler cannot prove it.

Two backends give the same result, on any script: ``expr`` is column expressions
with literal Java patterns, whose character kinds are spelled out (``regexes.java``),
no shuffle and no Python; ``arrow`` walks the tree with Python's
``re`` and suits catalogs of hundreds of templates.

Null lines count as empty; lines keep all their columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..plans import regexes
from ..plans.catalog import ROOT, Catalog

FIELDS = "array<struct<node_id:int,value:string>>"
MATCHES = f"array<struct<template_id:int,trail_len:int,fields:{FIELDS}>>"
PARTIAL = f"array<struct<node_id:int,suffix:string,fields:{FIELDS}>>"
#: Templates up to which expressions are used, and templates in one array expression.
MANY, CHUNK = 150, 50
SPREAD_LEAST, SPREAD_MOST = 1 << 18, 1 << 32
_MARK = "\x01"


@dataclass(frozen=True)
class Plan:
    """A compiled template or prefix."""

    path: tuple[int, ...]
    pattern: str
    variables: tuple[int, ...]
    literals: tuple[tuple[int, str], ...]  # nodes with a named attribute but no capture
    guards: tuple[str, ...]
    needle: str


def prefix_pattern(catalog: Catalog, path: tuple[int, ...], capture: bool) -> str:
    """Pattern of a path's start; where no blank follows the last token, none may follow."""
    tokens = [catalog.nodes[n].token for n in path]
    return "^" + "".join(t.pattern(capture) for t in tokens) + ("" if tokens[-1].ws else r"(?!\s)")


def is_checkable(catalog: Catalog, node: int) -> bool:
    t = catalog.nodes[node].token
    return regexes.checkable(t.is_variable, t.regex)


def compile_template(catalog: Catalog, template: int) -> Plan:
    path = catalog.templates[template]
    tokens = [catalog.nodes[n].token for n in path]
    guards = []
    for k, (n, t) in enumerate(zip(path[:-1], tokens[:-1], strict=True)):
        after = tokens[k + 1]
        if t.ws or not is_checkable(catalog, n):
            continue
        if after.is_variable and regexes.may_start_blank(after.regex) or not after.is_variable and (not after.value or after.value[0].isspace()):
            guards.append(prefix_pattern(catalog, path[: k + 1], capture=False))
    words = [w for t in tokens if not t.is_variable for w in t.value.split(" ")]
    return Plan(
        path,
        "^" + "".join(t.pattern(last=k == len(tokens) - 1) for k, t in enumerate(tokens)) + "$",
        tuple(n for n in path if catalog.nodes[n].token.is_variable),
        _literals(catalog, path),
        tuple(guards),
        max(words, key=len, default=""),
    )


def _literals(catalog: Catalog, path) -> tuple[tuple[int, str], ...]:
    named = lambda n: n in catalog.semantics and catalog.semantics[n].name
    return tuple((n, catalog.nodes[n].token.value) for n in path if not catalog.nodes[n].token.is_variable and named(n))


def _values(content: Column, pattern: str, n: int) -> Column:
    """The groups of an anchored pattern that is known to match, with one evaluation of it."""
    if not n:
        return F.array().cast("array<string>")
    one = F.split(F.regexp_replace(content, regexes.java(pattern), _MARK.join(f"${k}" for k in range(1, n + 1))), _MARK, -1)
    each = F.array(*[F.regexp_extract(content, regexes.java(pattern), k) for k in range(1, n + 1)])
    return F.when(content.contains(_MARK), each).otherwise(one)


def _fields(variables, literals, values: Column) -> Column:
    out = F.zip_with(F.array(*[F.lit(n) for n in variables]).cast("array<int>"), values, lambda i, v: F.struct(i.alias("node_id"), scalars.strip(v).alias("value")))
    if not literals:
        return out.cast(FIELDS)
    fixed = F.array(*[F.struct(F.lit(n).alias("node_id"), F.lit(v).alias("value")) for n, v in literals])
    return F.concat(out.cast(FIELDS), fixed.cast(FIELDS))


def _holds(p: Plan, content: Column) -> Column:
    holds = content.rlike(regexes.java(p.pattern))
    if len(p.needle) > 1:
        holds = content.contains(p.needle) & holds
    for g in p.guards:
        holds = holds & content.rlike(regexes.java(g))
    return holds


def templates_column(catalog: Catalog, content: Column) -> Column:
    """The template ids of ``matches_column``, without their fields."""
    content = scalars.strip(F.coalesce(content, F.lit("")))
    found = [F.when(_holds(compile_template(catalog, t), content), F.lit(t)) for t in catalog.order()]
    parts = [F.filter(F.array(*found[k : k + CHUNK]), lambda m: m.isNotNull()) for k in range(0, len(found), CHUNK)]
    return (F.concat(*parts) if parts else F.array()).cast("array<int>")


def matches_column(catalog: Catalog, content: Column) -> Column:
    content = scalars.strip(F.coalesce(content, F.lit("")))
    found = []
    for t in catalog.order():
        p = compile_template(catalog, t)
        holds = _holds(p, content)
        fields = _fields(p.variables, p.literals, _values(content, p.pattern, len(p.variables)))
        found.append(F.when(holds, F.struct(F.lit(t).alias("template_id"), F.lit(len(p.path)).alias("trail_len"), fields.alias("fields"))))
    parts = [F.filter(F.array(*found[k : k + CHUNK]), lambda m: m.isNotNull()) for k in range(0, len(found), CHUNK)]
    if not parts:
        return F.array().cast(MATCHES)
    return (parts[0] if len(parts) == 1 else F.concat(*parts)).cast(MATCHES)


def partial_column(catalog: Catalog, content: Column) -> Column:
    """The furthest checkable inner nodes that the line reaches; each prefix is tested once at most."""
    content = scalars.strip(F.coalesce(content, F.lit("")))
    below: dict[int, list[int]] = {}
    for n in catalog.nodes.values():
        below.setdefault(n.parent, []).append(n.id)
    none = F.array().cast(PARTIAL)

    def walk(node: int, path: tuple[int, ...]) -> Column | None:
        parts = [w for c in below.get(node, []) if c in below and (w := walk(c, (*path, c))) is not None]
        deeper = F.concat(*parts) if parts else None
        if node == ROOT or not is_checkable(catalog, node):
            return deeper
        pattern = prefix_pattern(catalog, path, capture=True)
        variables = [n for n in path if catalog.nodes[n].token.is_variable]
        values = F.array(*[F.regexp_extract(content, regexes.java(pattern), k + 1) for k in range(len(variables))]).cast("array<string>")
        suffix = scalars.strip(F.regexp_replace(content, regexes.java(pattern), ""))
        own = F.array(F.struct(F.lit(node).alias("node_id"), suffix.alias("suffix"), _fields(variables, _literals(catalog, path), values).alias("fields"))).cast(PARTIAL)
        got = own if deeper is None else F.get(F.transform(F.array(deeper), lambda d: F.when(F.size(d) > 0, d).otherwise(own)), F.lit(0))
        return F.when(content.rlike(regexes.java(prefix_pattern(catalog, path, capture=False))), got).otherwise(none)

    out = walk(ROOT, ())
    return none if out is None else out


class Walker:
    """The same matching with Python's ``re``, line by line; shared prefixes are tested once."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog
        self.below: dict[int, list[int]] = {}
        for n in catalog.nodes.values():
            self.below.setdefault(n.parent, []).append(n.id)
        self.paths = {n: tuple(catalog.lineage(n)) for n in catalog.nodes}
        self.prefix = {n: re.compile(prefix_pattern(catalog, self.paths[n], True)) for n in catalog.nodes if is_checkable(catalog, n)}
        self.plans = [(t, compile_template(catalog, t)) for t in catalog.order()]
        self.full = {t: re.compile(p.pattern) for t, p in self.plans}

    def __call__(self, line: str | None) -> tuple[list[dict], list[dict]]:
        line = (line or "").strip(scalars.BLANKS)
        reached: dict[int, re.Match] = {}
        open_: set[int] = {ROOT}
        far: list[int] = []

        def walk(node: int) -> bool:
            """True if a checkable inner node below ``node`` was reached."""
            any_ = False
            for c in self.below.get(node, []):
                if c in self.prefix:
                    m = self.prefix[c].match(line)
                    if not m:
                        continue
                    reached[c] = m
                open_.add(c)
                deeper = walk(c)
                if c in self.prefix and c in self.below:
                    if not deeper:
                        far.append(c)
                    any_ = True
                any_ |= deeper
            return any_

        walk(ROOT)
        matches = []
        for t, p in self.plans:
            if all(n in open_ for n in p.path[:-1]) and (m := self.full[t].match(line)):
                matches.append({"template_id": t, "trail_len": len(p.path), "fields": self._fields(p.variables, p.literals, m)})
        if matches:
            return matches, []
        out = []
        for n in far:
            path = self.paths[n]
            variables = [x for x in path if self.catalog.nodes[x].token.is_variable]
            out.append({"node_id": n, "suffix": line[reached[n].end() :].strip(scalars.BLANKS), "fields": self._fields(variables, _literals(self.catalog, path), reached[n])})
        return [], out

    @staticmethod
    def _fields(variables, literals, m) -> list[dict]:
        got = [{"node_id": n, "value": (m[k] or "").strip(scalars.BLANKS)} for k, n in enumerate(variables, 1)]
        return got + [{"node_id": n, "value": v} for n, v in literals]


def _by_arrow(lines: DataFrame, catalog: Catalog, content: str) -> DataFrame:
    at = lines.columns.index(content)
    fields = pa.list_(pa.struct([("node_id", pa.int32()), ("value", pa.string())]))
    kinds = [
        pa.list_(pa.struct([("template_id", pa.int32()), ("trail_len", pa.int32()), ("fields", fields)])),
        pa.list_(pa.struct([("node_id", pa.int32()), ("suffix", pa.string()), ("fields", fields)])),
    ]

    def run(batches):
        walk = Walker(catalog)
        for b in batches:
            got = [walk(x) for x in b.column(at).to_pylist()]
            arrays = [pa.array([g[k] for g in got], kinds[k]) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], [*b.schema.names, "matches", "partial"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema)
    return lines.mapInArrow(run, f"{ddl}, matches {MATCHES}, partial {PARTIAL}")


def parse(lines: DataFrame, catalog: Catalog, content: str = "content", backend: str = "auto", partial: bool = True) -> DataFrame:
    """``lines`` with ``matches`` and ``partial``, one row for each line and no shuffle (but see ``spread``)."""
    if {"matches", "partial"} & set(lines.columns):
        raise ValueError("lines must not have columns named matches or partial")
    lines = spread(lines)
    if backend == "auto":
        backend = "expr" if len(catalog.templates) <= MANY else "arrow"
    if backend == "arrow":
        return _by_arrow(lines, catalog, content)
    out = once(lines, matches=matches_column(catalog, F.col(content)))
    if not partial:
        return out.withColumn("partial", F.array().cast(PARTIAL))
    return once(out, partial=F.when(F.size("matches") == 0, partial_column(catalog, F.col(content))).otherwise(F.array().cast(PARTIAL)))


def spread(lines: DataFrame) -> DataFrame:
    """A small table dealt out over all cores: one file of a few MB is one task, and matching costs far more than reading.

    Tables of more than SPREAD_MOST bytes, or 16 MB for each core, have splits enough and stay where they are.
    """
    plan = getattr(lines, "_jdf", None)
    if plan is None or lines.isStreaming:
        return lines
    cores = lines.sparkSession.sparkContext.defaultParallelism
    size = int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return lines.repartition(cores) if SPREAD_LEAST <= size <= min(SPREAD_MOST, cores << 24) else lines


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are worked out once for each row.

    The optimiser would copy a projected expression into every later use of its
    column, filters above all; it does not do so across a generator, and that
    of one struct gives one row.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def shares_values(catalog: Catalog) -> bool:
    """Whether one line can give a node two values: several templates have the node."""
    seen: set[int] = set()
    for path in catalog.templates.values():
        own = {n for n in path if n in catalog.semantics or catalog.nodes[n].token.is_variable}
        if own & seen:
            return True
        seen |= own
    return False


def fields_column(catalog: Catalog) -> Column:
    """All (node_id, value) of a parsed line; of several values of a node the last candidate's stays."""
    every = F.concat(F.flatten(F.col("matches.fields")), F.flatten(F.col("partial.fields")))
    if not shares_values(catalog):
        return every
    last = lambda e: F.filter(e, lambda f, i: ~F.exists(F.slice(e, i + 2, F.greatest(F.size(e) - i - 1, F.lit(0))), lambda g: g["node_id"] == f["node_id"]))
    return F.get(F.transform(F.array(every), last), F.lit(0))


def trail_column(catalog: Catalog) -> Column:
    """Nodes that the line's candidates pass, whole or in part."""
    paths = F.create_map(*[x for t, p in catalog.templates.items() for x in (F.lit(t), F.array(*[F.lit(n) for n in p]))]) if catalog.templates else None
    lineages = F.create_map(*[x for n in catalog.nodes for x in (F.lit(n), F.array(*[F.lit(m) for m in catalog.lineage(n)]))]) if catalog.nodes else None
    if paths is None or lineages is None:
        return F.array().cast("array<int>")
    own = F.flatten(F.transform("matches", lambda m: F.element_at(paths, m["template_id"])))
    far = F.flatten(F.transform("partial", lambda p: F.element_at(lineages, p["node_id"])))
    return F.array_distinct(F.concat(own, far))


# --- long tables ---------------------------------------------------------


def line_matches(parsed: DataFrame, key: str = "line_id") -> DataFrame:
    """(key, template_id, trail_len) for each full match."""
    return parsed.select(key, F.inline(F.transform("matches", lambda m: F.struct(m["template_id"].alias("template_id"), m["trail_len"].alias("trail_len")))))


def field_values(parsed: DataFrame, catalog: Catalog, key: str = "line_id") -> DataFrame:
    """(key, node_id, value, full)."""
    return parsed.select(key, F.explode(fields_column(catalog)).alias("f"), (F.size("matches") > 0).alias("full")).select(key, "f.node_id", "f.value", "full")


def line_nodes(parsed: DataFrame, catalog: Catalog, key: str = "line_id") -> DataFrame:
    """(key, node_id, full) for each node on a line's trail."""
    return parsed.select(key, F.explode(trail_column(catalog)).alias("node_id"), (F.size("matches") > 0).alias("full"))


def _value_of(node: int) -> Column:
    return F.get(F.filter("_m.fields", lambda f: f["node_id"] == node), F.lit(0))["value"]


def wide(parsed: DataFrame, catalog: Catalog, template: int, keep: list[str]) -> DataFrame:
    """A column for each named variable of one template, over the lines that it matches."""
    own = F.get(F.filter("matches", lambda m: m["template_id"] == template), F.lit(0))
    columns = []
    for n in catalog.templates[template]:
        s = catalog.semantics.get(n)
        if s and s.name and catalog.nodes[n].token.is_variable:
            columns.append(_value_of(n).alias(s.name))
    return parsed.select(*keep, own.alias("_m")).where("_m is not null").select(*keep, *columns)


def unmatched(parsed: DataFrame) -> DataFrame:
    """Lines without a full match."""
    return parsed.where(F.size("matches") == 0)


def unused_templates(parsed: DataFrame, catalog: Catalog) -> DataFrame:
    """(template_id) of templates without a line."""
    every = parsed.sparkSession.createDataFrame([(t,) for t in catalog.templates], "template_id int")
    used = parsed.select(F.explode("matches.template_id").alias("template_id")).distinct()
    return every.join(F.broadcast(used), "template_id", "left_anti")  # at most one row for each template


def lost_lines(lines: DataFrame, before: Catalog, after: Catalog, content: str = "content") -> DataFrame:
    """Lines that ``before`` matches and ``after`` does not."""
    was = F.size(templates_column(before, F.col(content))) > 0
    now = F.size(templates_column(after, F.col(content))) > 0
    return spread(lines).where(was & ~now)


def changed_lines(lines: DataFrame, before: Catalog, after: Catalog, key: str = "line_id", content: str = "content") -> DataFrame:
    """(key, before, after): lines whose set of templates changed."""
    ids = lambda c: F.array_sort(templates_column(c, F.col(content)))
    return once(spread(lines.select(key, content)), before=ids(before), after=ids(after)).select(key, "before", "after").where("before <> after")
