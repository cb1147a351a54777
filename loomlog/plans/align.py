"""Token lists fitted to a line: strict (saved templates), tolerant (proposals), wildcard texts."""

from __future__ import annotations

import re
from dataclasses import replace

from .catalog import Token

#: Limits of the tolerant aligner: gap it fills in, tail it appends, relative change of a repaired value.
GAP, TAIL, REPAIR = 5, 5, 0.25
_QUOTES = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"'})


def _blanks(line: str, at: int) -> int:
    n = 0
    while at + n < len(line) and line[at + n].isspace():
        n += 1
    return n


def _token(item: dict, value: str, ws: int) -> Token:
    if "is_variable" in item:
        variable = bool(item["is_variable"])
    elif "type" in item:
        variable = str(item["type"]).upper() in ("VARIABLE", "VAR")
    else:
        raise ValueError("a token needs is_variable or type")
    return Token(variable, value, item.get("regex") or item.get("regexp") or ".*?", ws, placeholder=item.get("placeholder"))


def strict(items: list[dict], line: str | None = None) -> list[Token]:
    """Tokens of a saved template.

    With a line, each value is looked up from where the last one ended (by the
    token's pattern if the text differs); text in between becomes literals and
    blanks after a value its ``ws``.  Tokens without text are left out.
    """
    out: list[Token] = []
    at = 0
    for item in items:
        if "value" not in item:
            raise ValueError("a token needs a value")
        value = str(item["value"])
        if not value:
            continue
        if line is None:
            trimmed = value.rstrip(" ")
            out.append(_token(item, trimmed or value, int(item.get("trailing_whitespace") or 0) or len(value) - len(trimmed)))
            continue
        value = value.strip() or value
        found, size = line.find(value, at), len(value)
        if found < 0 and item.get("regex"):
            m = re.compile(item["regex"]).search(line, at)
            if m:
                found, size = m.start(), len(m[0])
        if found < 0:
            raise ValueError(f"{value!r} is not in the rest of the line")
        out += _literals(line[at:found])
        at = found + size
        ws = _blanks(line, at)
        out.append(_token(item, line[found : found + size], ws))
        at += ws
    if line is not None:
        out += _literals(line[at:])
    return out


def _literals(text: str) -> list[Token]:
    """Literal tokens of a stretch of text, blanks behind each as its ``ws``."""
    return [Token(False, m[1], ws=len(m[2])) for m in re.finditer(r"(\S+)(\s*)", text)]


def tolerant(items: list[dict], line: str) -> list[Token]:
    """Tokens of a proposed template, where the proposal may differ slightly from the line.

    A value is found as it stands, with other quotes or slashes, with other
    white space, or as the nearest part of the line of about its length.  Gaps
    and tails of a few characters become literals; longer ones are errors.
    """
    out: list[Token] = []
    at = 0
    for item in items:
        value = str(item.get("value") or "").strip()
        if not value:
            continue
        span = _find(value, line, at)
        if span is None:
            raise ValueError(f"{value!r} is not in the rest of the line")
        gap = line[at : span[0]]
        if len(gap.strip()) > GAP:
            raise ValueError(f"{gap!r} belongs to no token")
        out += _literals(gap)
        at = span[1]
        ws = _blanks(line, at)
        out.append(_token(item, line[span[0] : span[1]], ws))
        at += ws
    if len(line[at:].strip()) >= TAIL:
        raise ValueError(f"{line[at:]!r} belongs to no token")
    return out + _literals(line[at:])


def _find(value: str, line: str, at: int) -> tuple[int, int] | None:
    for form in (value, value.translate(_QUOTES), value.replace("\\\\", "\\"), value.replace('\\"', '"'), value.replace("'", '"'), value.replace('"', "'")):
        i = line.find(form, at)
        if i >= 0:
            return i, i + len(form)
    m = re.compile(r"\s+".join(map(re.escape, value.split()))).search(line, at)
    if m:
        return m.span()
    m = re.compile(r"\s*".join(re.escape(c) for c in value if not c.isspace())).search(line, at)
    if m:
        return m.span()
    most = int(len(value) * REPAIR)
    head = _common_prefix(value, line[at:])
    if len(value) > 3 and len(value) - head <= most and head:
        return at, at + head
    return None


def _common_prefix(a: str, b: str) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def from_wildcard(text: str, line: str, mark: str = "<*>") -> list[Token]:
    """Tokens of a wildcard text by what its marks stand for in ``line``."""
    for body in (text, text.strip("\"'")):
        parts = re.split(f"(?:{re.escape(mark)})+", body)
        pattern = "(.*?)".join(r"\s+".join(map(re.escape, re.split(r"\s+", p))) for p in parts)
        m = re.fullmatch(pattern, line)
        if m:
            break
    else:
        raise ValueError("the line does not fit the wildcard text")
    out: list[Token] = []
    at = 0
    for k in range(1, m.re.groups + 1):
        a, b = m.span(k)
        out += _literals(line[at:a])
        at = b
        if b > a:
            ws = _blanks(line, b)
            out.append(Token(True, line[a:b], ".*?" if ws or b == len(line) else ".+?", ws))
            at += ws
    out += _literals(line[at:])
    return [*out[:-1], replace(out[-1], ws=0)] if out else out


def wildcard_pattern(text: str, whole: bool = True, mark: str = "<*>") -> str:
    """A regex for a wildcard text; marks in a row count as one; ``whole`` asks for the full line."""
    parts = re.split(f"(?:{re.escape(mark)})+", text)
    from .regexes import escape

    body = "(.*?)".join(escape(re.sub(r"\s+", " ", p)) for p in parts)
    return f"^{body}$" if whole else f"^{body}"
