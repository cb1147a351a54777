"""Secret scanning: fixed patterns, and guess costs of values in a credential's place.

Base spans come from three patterns (``assign``, ``access``, ``hex``), leftmost
and non-overlapping for each kind.  Beside them, every value that follows a
credential word and a separator is rated by the cost of guessing it: dynamic
programming finds the cheapest segmentation into dictionary words (with capitals
and common digit-for-letter changes), dates, repeats, keyboard walks, sequences
and brute-force spans, whose characters cost by the alphabets in them (so
random values of 6 mixed characters, 7 small letters or 10 digits are found).  Values that cost ``GUESS_BITS`` or more are ``guess``
spans, unless a base ``assign`` span covers them already.

Offsets are code points.  Whole texts are scanned; cheap substring tests only
choose which patterns need to run at all.

Cases: a null text is empty and has no spans; very long texts are scanned
whole; rows are independent, so repeated rows and null ids keep one result
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|(?:access|private|auth)[_-]?(?:key|token)|credentials?)["']?[ \t]{0,8}(?:[:=]|=>|:=)[ \t]{0,8}["']?([^\s"'<>;,&|(){}]{6,})""",
    re.I | re.A,
)
#: A text without any of these, in lower case, has no match of ASSIGN or CONTEXT.
WORDS_NEAR = ("pass", "pwd", "secret", "token", "apikey", "api_key", "api-key", "key", "credential")
KINDS = ("assign", "access", "hex", "guess")
GUESS_BITS = 30.0

#: Common words and passwords, likeliest first.
COMMON = (
    "password 123456 qwerty admin welcome login letmein monkey dragon master shadow sunshine princess football baseball iloveyou trustno1 superman batman "
    "secret test guest user root default changeme example sample dummy demo none null true false string value token key pass your here name data "
    "the and for are but not you all any can had her was one our out day get has him his how man new now old see two way who boy did its let put say she too use "
    "this that with from have they will what when make like time just know take people into year good some could them other than then look only come over think "
    "also back after work first well even want because these give most house world school state never become between family student group country problem hand "
    "part place case week company system program question government number night point home water room mother area money story fact month lot right study book "
    "eye job word business issue side kind head service friend father power hour game line end member law car city community president team minute idea body "
    "information level office door health person art war history party result change morning reason research girl guy moment air teacher force education summer "
    "winter spring autumn monday friday sunday january february march april june july august september october november december server database production "
    "staging local host client access private public hello love flower ninja hunter killer pepper ginger cookie orange banana apple purple silver golden magic "
    "star cloud redacted placeholder insert replace required optional enabled disabled config setting environment variable"
).split()
RANK = {w: i + 1 for i, w in reversed(list(enumerate(COMMON)))}
LONGEST = max(map(len, RANK))
LEET = str.maketrans("4@831!05$7+", "aabelioss" + "tt")
WALKS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "1qaz", "2wsx", "3edc", "4rfv", "5tgb", "6yhn", "7ujm", "8ik,", "9ol.", "0p;/")
#: Forms of dates (year first, year last, a year alone), of YEAR to LONGEST_DATE characters.
DATES = tuple(map(re.compile, (
    r"(?:19|20)\d\d[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:0?[1-9]|[12]\d|3[01])",
    r"(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)\d\d",
    r"(?:19|20)\d\d",
)))
YEAR, LONGEST_DATE = 4, 10
#: Characters that a repeat, a sequence or a keyboard walk has at least.
RUN = 3
#: Characters of a brute-force span cost by the alphabets that the span uses: a-z, A-Z, 0-9, other ASCII, all else.
ALPHABETS = (26, 26, 10, 33, 100)
BRUTE = [math.log2(max(1, sum(n for k, n in enumerate(ALPHABETS) if used >> k & 1))) for used in range(1 << len(ALPHABETS))]


def _neighbours() -> set[str]:
    out = set()
    for row in WALKS:
        for a, b in zip(row, row[1:], strict=False):
            out |= {a + b, b + a}
    return out


NEAR = _neighbours()


def alphabet(c: str) -> int:
    """The bit of the alphabet of ``c``."""
    if not c.isascii():
        return 16
    return 1 if c.islower() else 2 if c.isupper() else 4 if c.isdigit() else 8


def guess_bits(value: str) -> float:
    """Base-two logarithm of the guesses that the cheapest segmentation of ``value`` needs."""
    n = len(value)
    lower = value.lower()
    if len(lower) != n:
        lower = value
    plain = lower.translate(LEET)
    best = [0.0] + [math.inf] * n
    # by alphabets, the cheapest way that ends in a brute-force span; spans do not adjoin, as they would be one
    own_alphabet = [alphabet(c) for c in value]
    used = 0
    for k in set(own_alphabet):
        used |= k
    brute = {k: math.inf for k in range(1, used + 1) if k & ~used == 0}
    ended = 0.0  # the cheapest way to the place before that does not end in such a span
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if lower[i].isdigit():
            for end in range(i + YEAR, min(n, i + LONGEST_DATE) + 1):
                if any(form.fullmatch(lower, i, end) for form in DATES):
                    dates.setdefault(end, []).append(i)
    # lengths of the runs that end at each place
    same = [1] * n
    step = [1] * n
    walk = [1] * n
    for i in range(1, n):
        if lower[i] == lower[i - 1]:
            same[i] = same[i - 1] + 1
        d = ord(lower[i]) - ord(lower[i - 1])
        if d in (1, -1):
            step[i] = step[i - 1] + 1 if step[i - 1] > 1 and ord(lower[i - 1]) - ord(lower[i - 2]) == d else 2
        if lower[i - 1 : i + 1] in NEAR:
            walk[i] = walk[i - 1] + 1
    # kinds of runs: their lengths, what a length costs, and the starts from which the run to here may be cheapest
    kinds = ((same, 1, []), (step, 2, []), (walk, 2, []))
    for j in range(1, n + 1):
        for k, before in brute.items():
            brute[k] = min(before, ended) + BRUTE[k] if k & own_alphabet[j - 1] else math.inf
        cost = math.inf
        for i in range(max(0, j - LONGEST), j - 2):
            for form, extra in ((lower, 0.0), (plain, 2.0)):
                if rank := RANK.get(form[i:j]):
                    own = value[i:j]
                    case = 0.0 if own == lower[i:j] else 1.0 if own[0].isupper() and own[1:] == lower[i + 1 : j] else 3.0
                    cost = min(cost, best[i] + 1 + math.log2(rank + 1) + case + (extra if form[i:j] != lower[i:j] else 0.0))
        for i in dates.get(j, ()):
            cost = min(cost, best[i] + (7.0 if j - i == YEAR else 16.0))
        for (runs, weight, starts), base in zip(kinds, (BRUTE[own_alphabet[j - 1]], 4.0, 5.0), strict=True):
            if runs[j - 1] < RUN:
                starts.clear()
                continue
            i = j - RUN  # an earlier start that is no dearer here stays so, as logarithms draw together
            if all(best[s] + weight * math.log2(j - s) > best[i] + weight * math.log2(RUN) for s in starts):
                starts[:] = [s for s in starts if best[s] < best[i]] + [i]
            cost = min(cost, base + 1 + min(best[s] + weight * math.log2(j - s) for s in starts))
        ended = cost
        best[j] = min(cost, *brute.values())
    # a block that is repeated throughout costs its own guesses and the count
    period = (value + value).find(value, 1) if n else 0
    sizes = range(period, n // 2 + 1, period) if period else ()
    return min([best[n], *(best[size] + math.log2(n // size) + 1 for size in sizes if n % size == 0)])


def base_spans(text: str, low: str | None = None) -> list[tuple[int, int, str]]:
    low = text.lower() if low is None else low
    out = []
    if any(w in low for w in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans, by start and kind."""
    low = text.lower()
    base = base_spans(text, low)
    found = []
    if any(w in low for w in WORDS_NEAR):
        assigned = [s for s in base if s[2] == "assign"]
        for m in CONTEXT.finditer(text):
            a, b = m.span(1)
            if not any(s <= a < e for s, e, _ in assigned) and guess_bits(m[1]) >= GUESS_BITS:
                found.append((a, b, "guess"))
    return base, sorted(base + found, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(own: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in own)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): kind:start:end of the base spans and of all spans of each text."""

    def run(batches):
        for b in batches:
            found = [spans(x.as_py() or "") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([joined(x) for x, _ in found], pa.string()), pa.array([joined(x) for _, x in found], pa.string())], ["doc_id", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, base string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced; other columns are kept. A null text stays null."""

    def clean(text: str) -> str:
        out, at = [], 0
        for a, b, _ in spans(text)[1]:
            if b > at:
                if a >= at:
                    out += [text[at:a], mark]
                at = b
        return "".join(out) + text[at:]

    def run(batches):
        for b in batches:
            k = b.schema.get_field_index("text")
            yield b.set_column(k, "text", pa.array([None if (t := x.as_py()) is None else clean(t) for x in b.column(k)], b.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir):
    s = scan(common.read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.regexp_extract_all("base", F.lit(f"({kind}):"))).cast("long").alias(f"n_{kind}")
    return s.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2("base", 256).alias("base_sha256"), "spans")
