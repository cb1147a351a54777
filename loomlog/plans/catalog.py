"""Parser catalogs: tokens, the template tree, field semantics, mappings and events.

A catalog is small driver-side metadata.  It is never changed in place: edits
give a new catalog (``loomlog.plans.edit``).  Node and template ids are never
used again after a removal.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from . import regexes

SYNTAX, KEY = "SYNTAX", "_KEY"
ROOT = 0


@dataclass(frozen=True)
class Token:
    """One step of a template: a literal, or a variable with a pattern; ``ws`` blanks follow it."""

    is_variable: bool
    value: str = ""
    regex: str = ".*?"
    ws: int = 0
    type: str = "string_t"
    placeholder: str | None = None
    fixed: bool = False

    @property
    def signature(self) -> tuple:
        """Tokens with equal signatures share a node of the tree."""
        return (self.is_variable, self.regex if self.is_variable else self.value, self.ws > 0)

    def pattern(self, capture: bool = True, last: bool = False) -> str:
        if self.is_variable:
            inner = regexes.capture_free(self.regex)
            body = f"({inner})" if capture else f"(?:{inner})"
        else:
            body = regexes.escape(self.value)
        return body if last or not self.ws else body + r"\s+"


@dataclass(frozen=True)
class Node:
    id: int
    parent: int
    token: Token


@dataclass(frozen=True)
class Semantics:
    attribute: str | None = None
    description: str | None = None
    cluster_description: str | None = None
    mapping: tuple[str, ...] = ()
    taxonomy: str = "OCSF"
    embedding: tuple[float, ...] | None = None

    @property
    def name(self) -> str | None:
        """The attribute, unless it is one of the reserved kinds."""
        a = self.attribute
        return None if not a or a == SYNTAX or a.endswith(KEY) else a


@dataclass(frozen=True)
class Catalog:
    nodes: dict[int, Node] = field(default_factory=dict)
    #: Template id -> node ids from the first token to the last.
    templates: dict[int, tuple[int, ...]] = field(default_factory=dict)
    semantics: dict[int, Semantics] = field(default_factory=dict)
    events: dict[int, tuple[str, ...]] = field(default_factory=dict)
    examples: dict[int, tuple[str, ...]] = field(default_factory=dict)
    next_node: int = 1
    next_template: int = 0

    # --- reading -------------------------------------------------------

    def tokens(self, template: int) -> list[Token]:
        return [self.nodes[n].token for n in self.templates[template]]

    def lineage(self, node: int) -> list[int]:
        """Node ids from the root's child down to ``node``."""
        out: list[int] = []
        while node != ROOT:
            if node in out:
                raise ValueError(f"node {node} is its own ancestor")
            out.append(node)
            node = self.nodes[node].parent
        return out[::-1]

    def children(self, node: int) -> list[int]:
        return [n.id for n in self.nodes.values() if n.parent == node]

    def templates_of(self, node: int) -> list[int]:
        return [t for t, path in self.templates.items() if node in path]

    def attribute_nodes(self, names: list[str]) -> list[int]:
        """Nodes that an attribute or taxonomy field name stands for."""
        return sorted(n for n, s in self.semantics.items() if n in self.nodes and (s.name in names or set(s.mapping) & set(names)))

    def field_nodes(self) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for n, s in sorted(self.semantics.items()):
            for name in dict.fromkeys([*([s.name] if s.name else []), *s.mapping]):
                out.setdefault(name, []).append(n)
        return out

    def order(self) -> list[int]:
        """Templates in the order of a line's candidates: longest path first, then by the tree's levels."""
        rank = {n: k for k, n in enumerate(self.breadth_first())}
        return sorted(self.templates, key=lambda t: (-len(self.templates[t]), rank[self.templates[t][-1]]))

    def breadth_first(self) -> list[int]:
        below: dict[int, list[int]] = {}
        for n in self.nodes.values():
            below.setdefault(n.parent, []).append(n.id)
        out, level = [], [ROOT]
        while level:
            level = [c for n in level for c in below.get(n, [])]
            out += level
        return out

    # --- building ------------------------------------------------------

    def add_template(self, tokens: list[Token], events: tuple[str, ...] = (), examples: tuple[str, ...] = ()) -> tuple[Catalog, int]:
        """The catalog with one more template, and its id; an equal template's id if there is one."""
        if not tokens:
            raise ValueError("a template needs a token")
        nodes, at, path, next_node = dict(self.nodes), ROOT, [], self.next_node
        if tokens[-1].ws:
            tokens = [*tokens[:-1], replace(tokens[-1], ws=0)]  # lines are stripped, so nothing can follow
        for t in tokens:
            if t.is_variable and not regexes.compiles(t.regex):
                raise ValueError(f"bad pattern {t.regex!r}")
            found = next((c for c in nodes.values() if c.parent == at and c.token.signature == t.signature), None)
            if found is None:
                found = Node(next_node, at, t)
                nodes[next_node] = found
                next_node += 1
            at = found.id
            path.append(at)
        for t, own in self.templates.items():
            if own == tuple(path):
                return self, t
        new = self.next_template
        out = replace(
            self,
            nodes=nodes,
            templates={**self.templates, new: tuple(path)},
            events={**self.events, new: tuple(events)} if events else self.events,
            examples={**self.examples, new: tuple(examples)} if examples else self.examples,
            next_node=next_node,
            next_template=new + 1,
        )
        return out, new

    def with_semantics(self, node: int, **changes) -> Catalog:
        if node not in self.nodes:
            raise ValueError(f"no node {node}")
        return replace(self, semantics={**self.semantics, node: replace(self.semantics.get(node, Semantics()), **changes)})

    # --- as text -------------------------------------------------------

    def to_json(self) -> dict:
        """Everything, ids included, so that reading it back gives an equal catalog."""
        return {
            "nodes": [{"id": n.id, "parent": n.parent, **vars(n.token)} for n in self.nodes.values()],
            "templates": {str(t): list(p) for t, p in self.templates.items()},
            "semantics": {str(n): vars(s) for n, s in self.semantics.items()},
            "events": {str(t): list(e) for t, e in self.events.items()},
            "examples": {str(t): list(e) for t, e in self.examples.items()},
            "next": [self.next_node, self.next_template],
        }

    @staticmethod
    def from_json(data: dict) -> Catalog:
        token = lambda d: Token(**{k: v for k, v in d.items() if k not in ("id", "parent")})
        semantics = lambda d: Semantics(**{**d, "mapping": tuple(d["mapping"]), "embedding": tuple(d["embedding"]) if d["embedding"] else None})
        return Catalog(
            {d["id"]: Node(d["id"], d["parent"], token(d)) for d in data["nodes"]},
            {int(t): tuple(p) for t, p in data["templates"].items()},
            {int(n): semantics(d) for n, d in data["semantics"].items()},
            {int(t): tuple(e) for t, e in data["events"].items()},
            {int(t): tuple(e) for t, e in data["examples"].items()},
            *data["next"],
        )

    def save(self, path: str) -> None:
        problems = validate(self)
        if problems:
            raise ValueError("; ".join(problems))
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.to_json(), f, indent=1)

    @staticmethod
    def load(path: str) -> Catalog:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        return Catalog.from_json(data) if "nodes" in data else from_parser_json(data)


def from_parser_json(data: dict) -> Catalog:
    """A catalog from ``{templates, var_mapping, event_types}`` files of other tools.

    Loading gives nodes new ids, so semantics are attached by the ids saved
    with the tokens.
    """
    catalog, new_id = Catalog(), {}
    for k, items in enumerate(data["templates"]):
        if not items:
            catalog = replace(catalog, next_template=catalog.next_template + 1)  # a removed template keeps its number
            continue
        tokens = [
            Token(bool(i["is_variable"]), i["value"], i.get("regex") or ".*?", int(i.get("trailing_whitespace") or 0), i.get("type") or "string_t", i.get("placeholder"))
            for i in items
        ]
        events = tuple(data.get("event_types", {}).get(str(k), ()))
        catalog, t = catalog.add_template(tokens, events)
        for i, node in zip(items, catalog.templates[t], strict=True):
            if i.get("id") is not None:
                new_id.setdefault(int(i["id"]), node)
    for saved, s in data.get("var_mapping", {}).items():
        node = new_id.get(int(saved))
        if node is not None:
            mapping = s.get("mapping") or {}
            catalog = catalog.with_semantics(
                node,
                attribute=s.get("created_attribute"),
                description=s.get("field_description"),
                cluster_description=s.get("cluster_description"),
                mapping=tuple(f for f in mapping.get("field_list", ()) if f),
                taxonomy=mapping.get("type", "OCSF"),
                embedding=tuple(s["embedding"]) if s.get("embedding") else None,
            )
    return catalog


def to_parser_json(catalog: Catalog) -> dict:
    """The interchange form read by ``from_parser_json``."""
    item = lambda n: {
        "is_variable": n.token.is_variable, "value": n.token.value, "regex": n.token.regex if n.token.is_variable else None,
        "placeholder": n.token.placeholder, "type": n.token.type, "id": n.id, "trailing_whitespace": n.token.ws,
    }
    last = max(catalog.templates, default=-1)
    return {
        "templates": [[item(catalog.nodes[n]) for n in catalog.templates.get(t, ())] for t in range(last + 1)],
        "var_mapping": {
            str(n): {
                "field_description": s.description, "cluster_description": s.cluster_description, "orig_node": n,
                "mapping": {"field_list": list(s.mapping), "type": s.taxonomy}, "created_attribute": s.attribute,
                "embedding": list(s.embedding) if s.embedding else None,
            }
            for n, s in catalog.semantics.items()
        },
        "event_types": {str(t): list(e) for t, e in catalog.events.items()},
    }


def validate(catalog: Catalog) -> list[str]:
    """What is wrong with a catalog: loops, broken paths, unused nodes, stray references."""
    out = []
    used = {n for path in catalog.templates.values() for n in path}
    for n in catalog.nodes.values():
        if n.parent != ROOT and n.parent not in catalog.nodes:
            out.append(f"node {n.id} has no parent {n.parent}")
            continue
        try:
            catalog.lineage(n.id)
        except (ValueError, KeyError) as e:
            out.append(f"node {n.id}: {e}")
        if n.id not in used:
            out.append(f"node {n.id} is in no template")
        if n.id >= catalog.next_node:
            out.append(f"node {n.id} is beyond the next free id")
        if n.token.is_variable and not regexes.compiles(n.token.regex):
            out.append(f"node {n.id} has a bad pattern")
    seen: dict[tuple, int] = {}
    for n in catalog.nodes.values():
        if (other := seen.setdefault((n.parent, *n.token.signature), n.id)) != n.id:
            out.append(f"nodes {other} and {n.id} are equal siblings")
    for t, path in catalog.templates.items():
        if not path:
            out.append(f"template {t} is empty")
            continue
        if any(n not in catalog.nodes for n in path):
            out.append(f"template {t} has an unknown node")
        elif [ROOT, *path[:-1]] != [catalog.nodes[n].parent for n in path]:
            out.append(f"template {t} is not a path of the tree")
    paths = list(catalog.templates.values())
    out += [f"templates have one path {p}" for p in {p for p in paths if paths.count(p) > 1}]
    out += [f"semantics of unknown node {n}" for n in catalog.semantics if n not in catalog.nodes]
    out += [f"events of unknown template {t}" for t in catalog.events if t not in catalog.templates]
    return out


# --- tables ------------------------------------------------------------


def tables(spark, catalog: Catalog) -> dict:
    """The catalog as DataFrames: nodes, template_nodes, semantics, mappings, template_events."""
    ends = {p[-1]: t for t, p in catalog.templates.items()}
    nodes = [
        (n.id, n.parent, len(catalog.lineage(n.id)), n.token.is_variable, n.token.value, n.token.regex, n.token.ws, n.token.type, n.token.placeholder, n.token.fixed, n.id in ends, ends.get(n.id))
        for n in catalog.nodes.values()
    ]
    make = spark.createDataFrame
    return {
        "nodes": make(nodes, "node_id int, parent_id int, depth int, is_variable boolean, value string, regexp string, ws int, type string, placeholder string, fixed boolean, terminal boolean, template_id int"),
        "template_nodes": make([(t, k, n) for t, p in catalog.templates.items() for k, n in enumerate(p)], "template_id int, pos int, node_id int"),
        "semantics": make([(n, s.attribute, s.description, list(s.embedding) if s.embedding else None) for n, s in catalog.semantics.items()], "node_id int, attribute string, description string, embedding array<float>"),
        "mappings": make([(n, s.taxonomy, f) for n, s in catalog.semantics.items() for f in s.mapping], "node_id int, taxonomy string, field string"),
        "template_events": make([(t, e) for t, own in catalog.events.items() for e in own], "template_id int, event string"),
    }


# --- templates as text -------------------------------------------------


def wildcard(catalog: Catalog, template: int, style: str = "star") -> str:
    """A template as text: ``<*>``, ``<name>``, ``<var_id>``, ``<PLACEHOLDER>`` or ``[type]`` for its variables."""
    out = []
    for n in catalog.templates[template]:
        t = catalog.nodes[n].token
        s = catalog.semantics.get(n, Semantics())
        if not t.is_variable:
            text = t.value
        elif style == "name" and s.attribute:
            text = f"<{s.attribute}>"
        elif style == "placeholder" and t.placeholder:
            text = f"<{t.placeholder}>"
        elif style == "type":
            text = f"[{t.type}]"
        elif style == "id":
            text = f"<var_{n}>"
        elif style == "example":
            text = t.value
        else:
            text = "<*>"
        out.append(text + " " * t.ws)
    return "".join(out)


def regex_mapping(catalog: Catalog, template: int) -> dict[str, str]:
    """Variable name -> pattern of a template."""
    return {f"var_{n}": catalog.nodes[n].token.regex for n in catalog.templates[template] if catalog.nodes[n].token.is_variable}


def keywords(tokens: list[Token]) -> list[str]:
    """Literals, whole and in alphanumeric parts, without repeats."""
    out: list[str] = []
    for t in tokens:
        if not t.is_variable:
            parts = "".join(c if c.isalnum() else " " for c in t.value).split()
            out += [t.value, *parts]
    return list(dict.fromkeys(x for x in out if x))


def outline(catalog: Catalog, node: int = ROOT, depth: int = 0) -> str:
    """The tree as an indented list."""
    lines = []
    for c in sorted(catalog.children(node)):
        t = catalog.nodes[c].token
        lines.append("  " * depth + f"- {c}: " + (f"<{t.regex}>" if t.is_variable else t.value))
        below = outline(catalog, c, depth + 1)
        lines += [below] if below else []
    return "\n".join(lines)


def graph(spark, catalog: Catalog):
    """(nodes, edges) of the template tree."""
    t = tables(spark, catalog)["nodes"]
    return t.select("node_id", "is_variable", "value", "regexp", "terminal", "template_id"), t.select(t["parent_id"].alias("src"), t["node_id"].alias("dst"))
