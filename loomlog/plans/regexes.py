"""Regex text handling: rewriting, escaping, capture-free groups and guard analysis.

Patterns are Python regexes in the subset that Java and RE2 read alike, after
``capture_free`` has taken inner groups away; the one capture of a variable is
added by the compiler, so its group index is its ordinal.
"""

from __future__ import annotations

import re

_META = set("\\.^$|?*+()[]{}")
#: A variable whose pattern has one of these has no checkable prefix.
OPEN_ENDED = ("*", "+", "?", ".", "\\w", "\\S")


def escape(text: str) -> str:
    """A pattern for the literal ``text``; each space matches any run of white space."""
    return "".join(r"\s+" if c == " " else "\\" + c if c in _META else c for c in text)


def atoms(pattern: str):
    """The pattern cut into escapes, classes, group openings and single characters."""
    i, n = 0, len(pattern)
    while i < n:
        c = pattern[i]
        if c == "\\":
            j = i + 2
        elif c == "[":
            j = i + 1
            j += pattern[j : j + 1] == "^"
            j += pattern[j : j + 1] == "]"
            while j < n and pattern[j] != "]":
                j += 2 if pattern[j] == "\\" else 1
            j += 1
        elif pattern.startswith("(?P<", i):
            j = pattern.index(">", i) + 1
        elif pattern.startswith("(?", i):
            j = i + 3
        else:
            j = i + 1
        yield pattern[i:j]
        i = j


#: Python's character kinds for text, spelled out for Java, which has ASCII ones by default and other Unicode ones by flag.
UNICODE = {"w": r"\p{L}\p{N}_", "d": r"\p{Nd}", "s": r" \t\n\x0B\f\r\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"}
_WORD = f"[{UNICODE['w']}]"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def java(pattern: str) -> str:
    """The pattern with Python's meaning of ``\\w \\d \\s \\b`` and their opposites, and of ``.`` and ``$``, for Java."""

    def kind(escape: str, inside: bool) -> str:
        own = UNICODE.get(escape[1:].lower())
        if own is None:
            return escape
        if escape[1].isupper():
            return f"[^{own}]"  # Java joins a class within a class
        return own if inside else f"[{own}]"

    out = []
    for a in atoms(pattern):
        if a.startswith("["):
            a = "".join(kind(b, True) if b[0] == "\\" else "\\" + b if b in "[&" and k else b for k, b in enumerate(re.findall(r"\\.|.", a, re.S)))
        elif a in (r"\b", r"\B"):
            a = _EDGE if a == r"\b" else f"(?!{_EDGE})"
        else:
            a = kind(a, False)
        out.append(a)
    return "(?du)" + "".join(out)  # only \n ends a line; letters fold as in Unicode


def capture_free(pattern: str) -> str:
    """The same language without capture groups; back-references cannot be kept."""
    out = []
    for a in atoms(pattern):
        if re.fullmatch(r"\\[1-9]", a) or a.startswith("(?P="):
            raise ValueError(f"back-references are not supported: {pattern}")
        out.append("(?:" if a == "(" or a.startswith("(?P<") else a)
    return "".join(out)


def generalise(pattern: str) -> str:
    """A pattern without any operator is an example value: widen it to its kind."""
    bare = pattern.strip("^$")
    spaceless = re.sub(r"(?:\\s| )[+*?]*", "", bare)
    if any(c in _META for c in spaceless):
        return pattern
    if bare.isdigit():
        return r"\d+?"
    return r".+?" if " " in bare or r"\s" in bare else r"\S+?"


def normalise(pattern: str) -> str:
    """White space as ``\\s+``, no anchors or boundaries, no outer white space, lazy dots."""
    parts = [a for a in atoms(pattern) if a not in ("^", "$", r"\b")]
    out: list[str] = []
    for k, a in enumerate(parts):
        repeated = k + 1 < len(parts) and parts[k + 1] in ("+", "*", "?", "{")
        if a in (" ", r"\s") and not repeated and k + 1 < len(parts):
            if a == " " and out and out[-1] == r"\s+":
                continue
            out.append(r"\s+")
        else:
            out.append(a)
    text = "".join(out)
    quantified = r"(?:\\s(?:[+*?]|\{\d+(?:,\d*)?\})?)"
    text = re.sub(rf"^{quantified}|{quantified}$", "", text)
    text = re.sub(r"(?<!\\)\.([+*])(?!\?)", r".\1?", text)
    return generalise(text)


def lazy(pattern: str) -> str:
    """Greedy ``*`` and ``+`` made lazy, outside classes."""
    parts = list(atoms(pattern))
    return "".join(a + "?" if a in ("*", "+") and k and (k + 1 == len(parts) or parts[k + 1] not in ("?", "+")) else a for k, a in enumerate(parts))


def lazy_tail(pattern: str) -> str:
    """A final greedy quantifier made lazy."""
    return pattern + "?" if pattern.endswith(("+", "*")) and not pattern.endswith(("\\+", "\\*")) else pattern


def checkable(is_variable: bool, pattern: str) -> bool:
    return not is_variable or not any(x in pattern for x in OPEN_ENDED)


def may_start_blank(pattern: str) -> bool:
    """False only where a match certainly starts with something other than white space."""
    parts = list(atoms(pattern))
    depth = 0
    for a in parts:
        depth += a.startswith("(")
        depth -= a == ")"
        if a == "|" and depth == 0:
            return True
    while parts and parts[0] in ("(", "(?:"):
        parts = parts[1:]
        if "|" in parts:
            return True
    if not parts:
        return True
    first = parts[0]
    if len(parts) > 1 and parts[1] in ("*", "?", "{"):
        return True
    if first in (r"\d", r"\w", r"\S"):
        return False
    if first.startswith("[^"):
        return not (r"\s" in first or r"\S" in first[2:])
    if first.startswith("["):
        return " " in first or any(x in first for x in (r"\s", r"\W", r"\D", r"\t")) or re.fullmatch(first, " ") is not None
    if first.startswith("\\"):
        return first[1:].isalnum()
    return first in " .^$*+?{(" or first.isspace()


def compiles(pattern: str) -> bool:
    try:
        capture_free(pattern)
        re.compile(pattern)
    except (re.error, ValueError):
        return False
    return True
