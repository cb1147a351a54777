"""Templates from lines that none matches: cluster, propose, validate, add, match again.

The proposer is pluggable.  The default works offline: it aligns the lines of a
cluster by position and makes what differs a variable.  A model behind a
``Client`` may propose instead; its answers are read as data and validated, and
never executed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import match, similarity
from ..plans import align, edit, regexes
from ..plans.catalog import Catalog, Token, keywords

CLUSTERS, ROUNDS = 5, 50


class Proposer(Protocol):
    def __call__(self, lines: list[str]) -> list[Token] | None: ...


def positional(lines: list[str]) -> list[Token] | None:
    """A template of the lines that have the most common number of words: equal words are literals, others variables."""
    words = [x.split() for x in lines if x.strip()]
    if not words:
        return None
    n = Counter(map(len, words)).most_common(1)[0][0]
    own = [w for w in words if len(w) == n]
    tokens = []
    for k in range(n):
        values = {w[k] for w in own}
        ws = int(k < n - 1)
        if len(values) == 1 and not (len(own) == 1 and any(c.isdigit() for c in own[0][k])):
            tokens.append(Token(False, own[0][k], ws=ws))
        else:
            tokens.append(Token(True, own[0][k], r"\d+" if all(v.isascii() and v.isdigit() for v in values) else r"\S+", ws))
    return tokens


def problems(tokens: list[Token], lines: list[str], blocked: Iterable[str] = ()) -> list[str]:
    """Why a proposal is refused: bad patterns, values their patterns do not match, lines it does not match, words it must not swallow."""
    out = []
    if not any(not t.is_variable for t in tokens) and len(tokens) > 1:
        out.append("no literal")
    for t in tokens:
        if not t.is_variable:
            continue
        if not regexes.compiles(t.regex):
            out.append(f"bad pattern {t.regex!r}")
        elif not re.fullmatch(t.regex, t.value):
            out.append(f"{t.regex!r} does not match {t.value!r}")
    if out:
        return out
    c, _ = Catalog().add_template(tokens)
    walk = match.Walker(c)
    blocked = set(blocked)
    for x in lines:
        got, _ = walk(x)
        if not got:
            out.append(f"no match: {x!r}")
        elif any(f["value"] in blocked for f in got[0]["fields"]):
            out.append(f"swallows a blocked word: {x!r}")
    return out


def relaxed(tokens: list[Token], lines: list[str]) -> list[Token] | None:
    """The same template with wider variables, if that makes it match."""
    for pattern in (r"\S+?", r".+?"):
        wide = [replace(t, regex=pattern) if t.is_variable else t for t in tokens]
        if not problems(wide, lines):
            return wide
    return None


def choose(candidates: list[list[Token]], lines: list[str], known: list[str]) -> list[Token] | None:
    """The valid candidate that takes the fewest lines of other templates, then covers the most of its own."""
    best = None
    for k, tokens in enumerate(candidates):
        c, _ = Catalog().add_template(tokens)
        walk = match.Walker(c)
        own = sum(bool(walk(x)[0]) for x in lines)
        if own:
            rank = (sum(bool(walk(x)[0]) for x in known), -own, k)
            best = min(best, (rank, tokens)) if best and rank != best[0] else best or (rank, tokens)
    return best[1] if best else None


@dataclass
class Overlap:
    """What to do with a new template that takes lines of others."""

    confirm: Callable[[list[Token], int], bool] = lambda tokens, template: False
    rejected: set[tuple] = field(default_factory=set)

    def __call__(self, c: Catalog, tokens: list[Token], taken: list[int]) -> str:
        """keep: beside the others; drop: not at all; replace: instead of them."""
        shape = tuple(t.signature for t in tokens)
        if shape in self.rejected:
            return "drop"
        for t in taken:
            own = c.tokens(t)
            if tuple(x.signature for x in own) == shape:
                return "drop"
            if any(x.fixed for x in own):
                return "keep"
            if not self.confirm(tokens, t):
                return "keep"
        return "replace" if taken else "keep"


def run(unmatched: DataFrame, catalog: Catalog, proposer: Proposer | None = None, buffer: int = 2500, content: str = "content", overlap: Overlap | None = None, rounds: int = ROUNDS, blocked: Iterable[str] = ()) -> tuple[Catalog, int]:
    """(catalog, rounds used): rounds of a bounded buffer of unmatched lines until none is left or nothing is found.

    Each round matches the whole table again with the new templates, so the
    buffer bounds what the driver holds and not what is covered.
    """
    proposer, overlap = proposer or positional, overlap or Overlap()
    start = catalog
    for used in range(rounds):
        fresh = replace(catalog, templates={t: p for t, p in catalog.templates.items() if start.templates.get(t) != p})
        left = unmatched.where(F.size(match.matches_column(fresh, F.col(content))) == 0) if fresh.templates else unmatched
        lines = [r[0] for r in left.where(F.col(content).isNotNull()).select(scalars.strip(F.col(content))).limit(buffer).collect()]
        lines = [x for x in lines if x]
        if not lines:
            return catalog, used
        before = catalog
        for medoid, _ in similarity.cluster_buffer(list(dict.fromkeys(lines)), CLUSTERS):
            group = _like(medoid, lines)
            tokens = proposer(group) or positional([medoid])
            if tokens is None:
                continue
            bad = problems(tokens, [medoid], blocked)
            if bad:
                tokens = relaxed(tokens, [medoid]) or positional([medoid])
            if tokens is None or problems(tokens, [medoid], blocked):
                continue
            walk = match.Walker(Catalog().add_template(tokens)[0])
            taken = [t for t, own in catalog.examples.items() if t in catalog.templates and any(walk(x)[0] for x in own)]
            decision = overlap(catalog, tokens, taken)
            if decision == "drop":
                continue
            catalog, t = catalog.add_template(tokens, examples=tuple(group[:5]))
            if decision == "replace":
                for old in taken:
                    catalog = edit.remove_template(catalog, old)
        if catalog == before:
            return catalog, used + 1
    return catalog, rounds


def _like(medoid: str, lines: list[str]) -> list[str]:
    """Lines with as many words as the medoid that share half of them, by place."""
    words = medoid.split()
    out = []
    for x in lines:
        own = x.split()
        if len(own) == len(words) and 2 * sum(a == b for a, b in zip(own, words, strict=True)) >= len(words):
            out.append(x)
    return out or [medoid]


# --- models behind an interface ----------------------------------------------


class Client(Protocol):
    def answer(self, prompts: list[str]) -> list[str]: ...


@dataclass
class Recorded:
    """A client that gives recorded answers, for tests and replays."""

    answers: dict[str, str]
    default: str = ""

    def answer(self, prompts: list[str]) -> list[str]:
        return [self.answers.get(p, self.default) for p in prompts]


def ask(prompts: DataFrame, client: Client, batch: int = 100) -> DataFrame:
    """(id, answer) of prompts(id, prompt), in batches on the executors."""
    import pandas as pd

    def run_(frames):
        for f in frames:
            for lo in range(0, len(f), batch):
                part = f.iloc[lo : lo + batch]
                yield pd.DataFrame({"id": part["id"], "answer": client.answer(part["prompt"].fillna("").tolist())})

    return prompts.select(F.col("id").cast("long"), "prompt").mapInPandas(run_, "id long, answer string")


def proposer(client: Client, prompt: Callable[[list[str]], str] = "\n".join, retries: int = 3) -> Proposer:
    """A proposer that asks a model for a token list and takes only what validates."""

    def propose(lines: list[str]) -> list[Token] | None:
        text = prompt(lines)
        for _ in range(retries):
            try:
                tokens = align.tolerant(scalars.loose_json(client.answer([text])[0]), lines[0])
            except (ValueError, KeyError, TypeError):
                continue
            if not problems(tokens, lines[:1]):
                return tokens
        return None

    return propose


def covered_words(tokens: list[Token]) -> list[str]:
    return keywords(tokens)
