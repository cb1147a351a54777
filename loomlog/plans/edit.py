"""Changes to a catalog as a list of plain operations; nothing is ever executed from text.

``apply`` takes operations such as ``{"op": "edit_node", "node": 3, "regex":
"\\\\d+"}`` and returns a new catalog.  An operation that breaks a rule raises
``EditError`` with its number, and the catalog given stays as it was.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from . import catalog as cat
from . import regexes
from .catalog import ROOT, Catalog, Node, Token


class EditError(ValueError):
    pass


@dataclass(frozen=True)
class Result:
    catalog: Catalog
    changed_templates: frozenset[int]


def simplify(c: Catalog) -> Catalog:
    """Equal siblings become one (the lowest id stays); of templates with one path the first stays; unused nodes go."""
    nodes, templates = dict(c.nodes), dict(c.templates)
    while True:
        seen: dict[tuple, int] = {}
        merge = {}
        for n in sorted(nodes):
            key = (nodes[n].parent, *nodes[n].token.signature)
            if seen.setdefault(key, n) != n:
                merge[n] = seen[key]
        if not merge:
            break
        n, into = next(iter(sorted(merge.items())))
        del nodes[n]
        nodes = {k: replace(x, parent=into) if x.parent == n else x for k, x in nodes.items()}
        templates = {t: tuple(into if m == n else m for m in p) for t, p in templates.items()}
    first: dict[tuple, int] = {}
    for t in sorted(templates):
        first.setdefault(templates[t], t)
    templates = {t: p for t, p in templates.items() if p and first[p] == t}
    used = {n for p in templates.values() for n in p}
    nodes = {n: x for n, x in nodes.items() if n in used}
    keep = lambda d, own: {k: v for k, v in d.items() if k in own}
    return replace(c, nodes=nodes, templates=templates, semantics=keep(c.semantics, nodes), events=keep(c.events, templates), examples=keep(c.examples, templates))


def _need(c: Catalog, node=None, template=None) -> None:
    if node is not None and node not in c.nodes:
        raise EditError(f"no node {node}")
    if template is not None and template not in c.templates:
        raise EditError(f"no template {template}")


def _free(c: Catalog, nodes) -> None:
    for n in nodes:
        if c.nodes[n].token.fixed:
            raise EditError(f"node {n} is fixed")


def _tokens(items) -> list[Token]:
    return [t if isinstance(t, Token) else Token(**t) for t in items]


def add_template(c: Catalog, tokens, events=(), examples=()) -> Catalog:
    return c.add_template(_tokens(tokens), tuple(events), tuple(examples))[0]


def remove_template(c: Catalog, template: int) -> Catalog:
    _need(c, template=template)
    return simplify(replace(c, templates={t: p for t, p in c.templates.items() if t != template}))


def replace_template(c: Catalog, template: int, tokens) -> Catalog:
    """New tokens for a template, whose id and events stay."""
    _need(c, template=template)
    own = {n for n in c.templates[template] if c.templates_of(n) == [template]}
    _free(c, own)
    added, t = replace(c, templates={k: p for k, p in c.templates.items() if k != template}).add_template(_tokens(tokens))
    if t in c.templates and t != template:
        raise EditError(f"template {t} is equal")
    templates = {**{k: p for k, p in added.templates.items() if k != t}, template: added.templates[t]}
    return simplify(replace(added, templates=templates, next_template=c.next_template))


def edit_node(c: Catalog, node: int, **changes) -> Catalog:
    """Other text, pattern, blanks, type or kind for a node."""
    _need(c, node=node)
    _free(c, [node])
    token = replace(c.nodes[node].token, **changes)
    if token.is_variable and not regexes.compiles(token.regex):
        raise EditError(f"bad pattern {token.regex!r}")
    if not token.is_variable and not token.value:
        raise EditError("a literal needs text")
    return simplify(replace(c, nodes={**c.nodes, node: replace(c.nodes[node], token=token)}))


def add_node(c: Catalog, parent: int, token, before: list[int] | None = None) -> Catalog:
    """A node below ``parent``, put in front of the children ``before`` (all, if none are named)."""
    if parent != ROOT:
        _need(c, node=parent)
    token = _tokens([token])[0]
    below = c.children(parent) if before is None else before
    if not below:
        raise EditError("a node at the end needs a template of its own: add_template")
    if any(c.nodes[n].parent != parent for n in below):
        raise EditError("the nodes are not children of the parent")
    new = c.next_node
    nodes = {**c.nodes, new: Node(new, parent, token)} | {n: replace(c.nodes[n], parent=new) for n in below}
    put = lambda p: tuple(x for n in p for x in ((new, n) if n in below else (n,)))
    return simplify(replace(c, nodes=nodes, templates={t: put(p) for t, p in c.templates.items()}, next_node=new + 1))


def remove_node(c: Catalog, node: int) -> Catalog:
    """A node taken out of all its templates; what was below hangs on its parent."""
    _need(c, node=node)
    _free(c, [node])
    if any(p == (node,) for p in c.templates.values()):
        raise EditError("a template would be empty")
    up = c.nodes[node].parent
    nodes = {n: replace(x, parent=up) if x.parent == node else x for n, x in c.nodes.items() if n != node}
    return simplify(replace(c, nodes=nodes, templates={t: tuple(n for n in p if n != node) for t, p in c.templates.items()}))


def move_node(c: Catalog, node: int, parent: int) -> Catalog:
    """A node and all below it, under another parent."""
    _need(c, node=node)
    if parent != ROOT:
        _need(c, node=parent)
        if node in c.lineage(parent):
            raise EditError("a node cannot go below itself")
    _free(c, [node])
    head = tuple(c.lineage(parent)) if parent != ROOT else ()
    templates = {t: head + p[p.index(node) :] if node in p else p for t, p in c.templates.items()}
    return simplify(replace(c, nodes={**c.nodes, node: replace(c.nodes[node], parent=parent)}, templates=templates))


def set_semantics(c: Catalog, node: int, **changes) -> Catalog:
    _need(c, node=node)
    return c.with_semantics(node, **changes)


def set_syntax(c: Catalog, node: int) -> Catalog:
    return set_semantics(c, node, attribute=cat.SYNTAX)


def set_key(c: Catalog, node: int, attribute: str) -> Catalog:
    """The node is the label of the field ``attribute``, which must exist."""
    if not any(s.attribute == attribute for s in c.semantics.values()):
        raise EditError(f"no field {attribute}")
    return set_semantics(c, node, attribute=attribute + cat.KEY)


def set_field(c: Catalog, node: int, attribute: str, description: str | None = None, new: bool = False) -> Catalog:
    if new == any(s.attribute == attribute for s in c.semantics.values()):
        raise EditError(f"field {attribute} " + ("exists" if new else "does not exist"))
    changes = {"attribute": attribute} | ({"description": description} if description else {})
    return set_semantics(c, node, **changes)


def map_attribute(c: Catalog, attribute: str, fields, taxonomy: str = "OCSF") -> Catalog:
    """Taxonomy fields for all nodes of an attribute; none takes the mapping away."""
    own = [n for n, s in c.semantics.items() if s.attribute == attribute]
    if not own:
        raise EditError(f"no field {attribute}")
    for n in own:
        c = c.with_semantics(n, mapping=tuple(fields), taxonomy=taxonomy)
    return c


def set_events(c: Catalog, template: int, events) -> Catalog:
    _need(c, template=template)
    return replace(c, events={**c.events, template: tuple(dict.fromkeys(events))})


def lazy_repair(c: Catalog) -> Catalog:
    """Final greedy quantifiers of all variables made lazy."""
    nodes = {n: replace(x, token=replace(x.token, regex=regexes.lazy_tail(x.token.regex))) if x.token.is_variable else x for n, x in c.nodes.items()}
    return simplify(replace(c, nodes=nodes))


def greedy_repair(c: Catalog, template: int, line: str) -> Catalog:
    """If a template does not match its own line, its own greedy variables in front of other variables are made lazy."""
    import re

    from ..operators.match import compile_template

    _need(c, template=template)
    fits = lambda x: re.match(compile_template(x, template).pattern, line.strip()) is not None
    if fits(c):
        return c
    path, nodes = c.templates[template], dict(c.nodes)
    for n, after in zip(path, path[1:], strict=False):
        t = c.nodes[n].token
        if t.is_variable and c.nodes[after].token.is_variable and c.templates_of(n) == [template]:
            nodes[n] = replace(c.nodes[n], token=replace(t, regex=regexes.lazy(t.regex)))
    out = replace(c, nodes=nodes)
    if not fits(out):
        raise EditError("the template does not match its line")
    return out


OPERATIONS = {
    f.__name__: f
    for f in (add_template, remove_template, replace_template, edit_node, add_node, remove_node, move_node, set_semantics, set_syntax, set_key, set_field, map_attribute, set_events, lazy_repair, greedy_repair)
}


def apply(c: Catalog, operations: list[dict]) -> Result:
    """All operations in order, or none; and the templates whose lines must be matched anew."""
    out = c
    for k, item in enumerate(operations):
        own = dict(item)
        name = own.pop("op", None)
        if name not in OPERATIONS:
            raise EditError(f"operation {k}: unknown {name!r}")
        try:
            out = OPERATIONS[name](out, **own)
        except (EditError, TypeError, ValueError) as e:
            raise EditError(f"operation {k} ({name}): {e}") from e
    problems = cat.validate(out)
    if problems:
        raise EditError("; ".join(problems))
    shape = lambda x, t: [(n, x.nodes[n].token) for n in x.templates[t]] if t in x.templates else None
    return Result(out, frozenset(t for t in {*c.templates, *out.templates} if shape(c, t) != shape(out, t)))


def first_to_lose(c: Catalog, operations: list[dict], lines: list[str]) -> int | None:
    """Number of the first operation after which one of ``lines`` (a bounded sample) is matched no more."""
    from ..operators.match import Walker

    matched = [x for x in lines if Walker(c)(x)[0]]
    for k in range(1, len(operations) + 1):
        walk = Walker(apply(c, operations[:k]).catalog)
        if any(not walk(x)[0] for x in matched):
            return k - 1
    return None


def repair_schema(c: Catalog, template: int, proposal: dict[str, dict]) -> Catalog:
    """A proposed schema {name: {description, ids}} on one template.

    Ids outside the template are refused.  Nodes that have a name keep it.  A
    key whose field is missing becomes plain syntax, each one of them.
    """
    _need(c, template=template)
    own = set(c.templates[template])
    for name, d in proposal.items():
        if set(d["ids"]) - own:
            raise EditError(f"{name}: ids outside the template")
    fields = {n for n in proposal if not n.endswith(cat.KEY)} | {s.attribute for s in c.semantics.values() if s.attribute}
    for name, d in proposal.items():
        if not d["ids"]:
            continue
        kept = cat.SYNTAX if name.endswith(cat.KEY) and name.removesuffix(cat.KEY) not in fields else name
        for n in d["ids"]:
            if not (n in c.semantics and c.semantics[n].attribute):
                c = c.with_semantics(n, attribute=kept, description=d.get("description"))
    return c
