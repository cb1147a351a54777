"""Scalar functions as column expressions (JVM side) and a few plain helpers for driver-side metadata."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\x0b"

# Date formats in order of preference, as Spark patterns; ISO forms are read by a cast, and those without a year take the reference date's.
NAMED = ["MMMM d, yyyy", "d MMMM yyyy", "yyyy MMMM d", "d MMM yyyy", "MMM d, yyyy"]
SLASHED = ["yyyy/MM/dd", "M/d/yyyy", "d/M/yyyy", "M/d/yyyy HH:mm:ss", "d/M/yyyy HH:mm:ss", "M/d/yyyy HH:mm", "d/M/yyyy HH:mm"]
DASHED = ["M-d-yyyy", "d-M-yyyy", "M-d-yyyy HH:mm:ss", "d-M-yyyy HH:mm:ss", "M-d-yyyy HH:mm", "d-M-yyyy HH:mm"]
YEARLESS = ["yyyy MMM d HH:mm:ss", "yyyy MMMM d HH:mm:ss"]
TIMES = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm"]
LAST_EPOCH = 4_102_444_800


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def blank_each(c: Column) -> Column:
    """Outer white space away, each inner white space character as one space."""
    return F.translate(strip(c), BLANKS[1:], " " * (len(BLANKS) - 1))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none outside."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def parse_float(c: Column) -> Column:
    """The text as a double; else its first token that has digits or dots once all else is gone (so "-5ms" is 5); else null.  NaN is null."""
    s = strip(c)
    whole = F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf(inity)?)$"), s.try_cast("double"))
    tokens = F.transform(F.split(s, r"\s+"), lambda t: F.regexp_replace(t, "[^0-9.]", ""))
    return F.coalesce(whole, F.get(F.filter(tokens, lambda t: t != ""), F.lit(0)).try_cast("double"))


def parse_int(c: Column) -> Column:
    """The text as a long; else the digits of its first token that has any; else null."""
    s = strip(c)
    tokens = F.transform(F.split(s, r"\s+"), lambda t: F.regexp_replace(t, "[^0-9]", ""))
    return F.coalesce(F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("long")), F.get(F.filter(tokens, lambda t: t != ""), F.lit(0)).try_cast("long"))


def parse_epoch(c: Column, reference: str = "1970-01-01") -> Column:
    """Seconds since 1970 of a date or time text; missing parts come from ``reference`` (yyyy-mm-dd), zones default to UTC.

    Digits alone are a date (8 or 14 of them, if valid) or seconds.
    """
    s = collapse(c)
    zone = F.regexp_extract(s, r"(Z|[+-]\d{2}:?\d{2})$", 1)
    zoned = s.rlike(r"\d{2}:\d{2}(:\d{2}([.,]\d+)?)?\s?(Z|[+-]\d{2}:?\d{2})$")
    bare = F.regexp_replace(F.when(zoned, F.regexp_replace(s, r"\s?(Z|[+-]\d{2}:?\d{2})$", "")).otherwise(F.regexp_replace(s, r"\s(UTC|GMT|Z|[A-Z]{3,4})$", "")), r"(\d{2}:\d{2}:\d{2}),(\d)", "$1.$2")
    bare = F.regexp_replace(bare, r"(:\d{2}\.\d{6})\d+$", "$1")
    sign = F.when(zone.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    digits = F.regexp_replace(zone, "[^0-9]", "")
    shift = F.when(zoned & (digits != ""), sign * (F.substring(digits, 1, 2).try_cast("long") * 3600 + F.substring(digits, 3, 2).try_cast("long") * 60)).otherwise(F.lit(0))
    year = reference[:4]
    stamp = lambda x, f: F.try_to_timestamp(x, F.lit(f)).cast("long")
    first = lambda formats, x: F.coalesce(*[stamp(x, f) for f in formats])
    # a format that does not fit costs an exception, so the text's shape chooses which are tried
    by_shape = (
        F.when(bare.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?$"), bare.try_cast("timestamp").cast("long"))
        .when(bare.rlike(r"^\d{1,2}:\d{2}"), first(TIMES, F.concat(F.lit(f"{reference} "), bare)))
        .when(bare.rlike("[A-Za-z]"), F.coalesce(first(NAMED, bare), first(YEARLESS, F.concat(F.lit(f"{year} "), bare))))
        .when(bare.contains("/"), first(SLASHED, bare))
        .when(bare.contains("-"), first(DASHED, bare))
    )
    number = s.try_cast("long")
    numeric = F.coalesce(F.when(F.length(s) == 14, stamp(s, "yyyyMMddHHmmss")), F.when(F.length(s) == 8, stamp(s, "yyyyMMdd")), F.when((number > 0) & (number < LAST_EPOCH), number))
    return F.when(s.rlike(r"^\d+$"), numeric).otherwise(by_shape - shift)


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; two empty texts are equal."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def line_tokens(c: Column, strict: bool = False) -> Column:
    """The set of lower-case words of a line, parted by ``. - / _ : \\`` and white space; strict keeps letters alone."""
    s = F.lower(c)
    if strict:
        s = F.regexp_replace(s, "[^a-z]", "")
    return F.array_distinct(F.filter(F.split(s, r"[.\-/_:\\\s]+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def template_tokens(c: Column) -> Column:
    """Words for template weights: quotes and punctuation part them, pure numbers go."""
    s = F.translate(c, "\"'", "  ")
    return F.filter(F.split(s, r"[\[\](){}.:|,;\s]+"), lambda t: (t != "") & ~t.rlike("^[0-9$]+$"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(eps))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def dotted_similarity(a: Column, b: Column) -> Column:
    """Leading dotted segments shared, over segments of the longer name, the first segment aside."""
    x, y = F.split(a, r"\."), F.split(b, r"\.")
    longest = F.greatest(F.size(x), F.size(y))
    same = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q))
    differ = F.array_position(same, False).cast("int")  # 1-based, 0: none
    index = F.when(differ == 0, longest - 1).otherwise(differ - 1)
    return F.greatest(F.lit(0), index - 1) / F.greatest(F.lit(1), longest - 1)


def separation(a: Column, b: Column, normalised: bool = False) -> Column:
    """Length of the common start of two lineages; over the longer one, if normalised."""
    same = F.zip_with(a, b, lambda p, q: p.eqNullSafe(q))
    differ = F.array_position(same, False).cast("int")
    n = F.when(differ == 0, F.size(same)).otherwise(differ - 1)
    return n / F.greatest(F.lit(1), F.size(same)) if normalised else n


def checksum(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("0")).otherwise(F.md5(c))


def quoted(c: Column) -> Column:
    """The text as the inside of a JSON string."""
    j = F.to_json(F.array(c))
    return F.substring(j, F.lit(3), F.length(j) - 4)


def unquoted(c: Column) -> Column:
    return F.get(F.from_json(F.concat(F.lit('["'), c, F.lit('"]')), "array<string>"), F.lit(0))


def without_prefix(c: Column, events: list[str]) -> Column:
    """A field name without a leading ``event.``."""
    if not events:
        return c
    return F.regexp_replace(c, "^(?:" + "|".join(re.escape(e) for e in sorted(events, key=len, reverse=True)) + r")\.", "")


def occurrences(c: Column, word: Column) -> Column:
    """0-based places at which ``word`` starts, overlapping ones too."""
    last = F.length(c) - F.length(word)
    places = F.when((last >= 0) & (F.length(word) > 0), F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: F.substring(c, i + 1, F.length(word)) == word)


def clean_text(c: Column) -> Column:
    """Text of an HTML cell: tags away, entities of the common kinds read, white space collapsed."""
    s = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return collapse(s)


def typed(c: Column, type_: str, regex: str | None = None, max_len: int | None = None, low=None, high=None) -> Column:
    """(value, error): the text read as ``type_`` and held against constraints; value is its canonical text."""
    kinds = {"string": "string", "integer": "long", "long": "long", "float": "double", "boolean": "boolean", "json": "string"}
    if type_ not in kinds:
        raise ValueError(f"no base type {type_}")
    s = strip(c) if type_ != "string" else c
    if type_ == "boolean":
        value = F.lower(s) == "true"
    elif type_ == "json":
        value = F.when(F.try_parse_json(s).isNotNull(), s)
    elif type_ in ("integer", "long"):
        value = F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("long"))
    elif type_ == "float":
        value = F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))
    else:
        value = s
    error = F.when(value.isNull(), F.lit(f"not a {type_}"))
    if regex is not None:
        error = F.coalesce(error, F.when(~value.cast("string").rlike(f"^(?:{regex})"), F.lit("regex")))
    if max_len is not None:
        error = F.coalesce(error, F.when(F.length(value.cast("string")) > max_len, F.lit("max_len")))
    if low is not None or high is not None:
        error = F.coalesce(error, F.when((value < low if low is not None else F.lit(False)) | (value > high if high is not None else F.lit(False)), F.lit("range")))
    return F.struct(F.when(error.isNull(), value.cast("string")).alias("value"), error.alias("error"))


#: Named converters for exported values; nothing is ever executed from a model's output.
CONVERTERS = {
    "string_t": lambda c, reference: c,
    "integer_t": lambda c, reference: F.coalesce(c.try_cast("double").cast("string"), c),
    "long_t": lambda c, reference: F.coalesce(c.try_cast("double").cast("string"), c),
    "float_t": lambda c, reference: F.coalesce(c.try_cast("double").cast("string"), c),
    "boolean_t": lambda c, reference: F.when(F.lower(c).isin("true", "false"), F.lower(c)).otherwise(c),
    "datetime_t": lambda c, reference: F.coalesce(parse_epoch(c, reference).cast("string"), c),
}


def coerce(c: Column, type_: str, reference: str = "1970-01-01") -> Column:
    """The exported text of a value by its type; what cannot be read stays as it is."""
    return CONVERTERS.get(type_, CONVERTERS["string_t"])(c, reference)


# --- driver-side helpers -------------------------------------------------


def loose_json(text: str):
    """JSON from a text, from its last fenced block, or after doubling stray backslashes; else ValueError."""
    fenced = re.findall(r"```(?:json)?\s*(.*?)```", text, re.S)
    for part in [text.strip(), *(b.strip() for b in fenced[::-1])]:
        for form in (part, re.sub(r'\\(?!["\\/bfnrtu])', r"\\\\", part)):
            try:
                return json.loads(form)
            except ValueError:
                continue
    raise ValueError("no JSON in the text")


def longest_common(a: str, b: str) -> int:
    """Length of the longest common substring."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else 0), row[j]
            best = max(best, row[j])
    return best


def name_digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
