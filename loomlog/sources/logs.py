"""Log files, parsed-log tables of other tools, taxonomy pages and parser files as DataFrames."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars

#: Lines beyond this length are not offered to discovery.
MAX_LINE = 1500


def normalise(lines: DataFrame, content: str = "content", collapse: bool = True) -> DataFrame:
    """White space in order and empty lines gone; without ``collapse`` each white space character becomes one space."""
    c = F.coalesce(F.col(content), F.lit(""))
    return lines.withColumn(content, scalars.collapse(c) if collapse else scalars.blank_each(c)).where(F.col(content) != "")


def read_log(spark: SparkSession, path: str, split: str | None = None, collapse: bool = True, share: float | None = None) -> DataFrame:
    """(line_id, content) of a log file or folder, ids in file order and without gaps.

    Bytes that are no UTF-8 become U+FFFD.  ``split`` is another line separator
    (a regex, per whole file).  ``share`` keeps that part of the lines from the
    start.  Ids need one pass that counts lines by partition.
    """
    if split is None:
        raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"))
        rows = raw.select(F.col("value").alias("content"), "_f", "_b", F.monotonically_increasing_id().alias("_k"))
    else:
        files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("_f"))
        rows = files.select(F.posexplode(F.split("value", split)).alias("_k", "content"), "_f", F.lit(0).alias("_b"))
    rows = normalise(rows, "content", collapse)
    # number lines within (file, block), then add what stands before: one small row for each block
    from pyspark.sql import Window

    w = Window.partitionBy("_f", "_b").orderBy("_k")
    numbered = rows.withColumn("_n", F.row_number().over(w) - 1)
    blocks = rows.groupBy("_f", "_b").agg(F.count("*").alias("_size"))
    first = blocks.withColumn("_first", F.sum("_size").over(Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1))).select("_f", "_b", F.coalesce("_first", F.lit(0)).alias("_first"))
    out = numbered.join(F.broadcast(first), ["_f", "_b"]).select((F.col("_first") + F.col("_n")).cast("long").alias("line_id"), "content")
    if share is not None:
        n = blocks.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("_t"))
        out = out.join(F.broadcast(n)).where(F.col("line_id") < F.floor(F.col("_t") * F.lit(share))).drop("_t")  # the total is one row
    return out


def read_bytes_log(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) with each file decoded by Python's replacing UTF-8 decoder, for input with bad bytes."""

    def run(batches):
        for b in batches:
            paths, lines = [], []
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = raw.decode("utf-8", "replace").split("\n")
                paths += [p] * len(own)
                lines += own
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lines, pa.string())], ["path", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, content string")


def read_structured(spark: SparkSession, path: str) -> DataFrame:
    """(LineId, Content, EventId, EventTemplate) of a structured CSV; NUL bytes go, more columns are dropped, missing ones are an error."""
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", False).csv(path)
    missing = {"LineId", "Content", "EventId", "EventTemplate"} - set(raw.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    clean = lambda c: F.translate(F.col(c), "\0", "").alias(c)
    return raw.select(F.col("LineId").cast("int").alias("LineId"), clean("Content"), clean("EventId"), clean("EventTemplate"))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """(EventId, EventTemplate, Occurrences) of a templates CSV, or of lines ``template count``."""
    head = spark.read.text(path).limit(1).collect()
    if head and head[0][0].startswith("EventId"):
        return spark.read.option("header", True).option("escape", '"').csv(path).select("EventId", "EventTemplate", F.col("Occurrences").cast("long").alias("Occurrences"))
    lines = spark.read.text(path)
    m = r"^(.*)\s(\d+)\s*$"
    text = F.regexp_extract("value", m, 1)
    return lines.where(F.col("value").rlike(m)).select(F.md5(text).alias("EventId"), text.alias("EventTemplate"), F.regexp_extract("value", m, 2).cast("long").alias("Occurrences"))


def corrected(structured: DataFrame, corrections: DataFrame) -> DataFrame:
    """Event templates replaced by corrections(EventId, template)."""
    c = corrections.select("EventId", F.col("template").alias("_t"))
    return structured.join(c, "EventId", "left").withColumn("EventTemplate", F.coalesce("_t", "EventTemplate")).drop("_t")


def event_of_line(lines: DataFrame, structured: DataFrame) -> DataFrame:
    """(line_id, EventId): lines joined by text; of several rows with one text the last counts."""
    last = structured.groupBy(scalars.collapse(F.col("Content")).alias("content")).agg(F.max_by("EventId", "LineId").alias("EventId"))
    return lines.withColumn("content", scalars.collapse(F.col("content"))).join(last, "content").select("line_id", "EventId")


def first_lines(structured: DataFrame) -> DataFrame:
    """(EventId, EventTemplate, Content): the first line of each event, to fit its wildcard text to."""
    return structured.groupBy("EventId").agg(F.min_by("EventTemplate", "LineId").alias("EventTemplate"), F.min_by("Content", "LineId").alias("Content"))


def discover(spark: SparkSession, folder: str, suffix: str = "_full.log") -> DataFrame:
    """(name, path) of the files below a folder whose name ends so; name is what stands before it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(folder).select("path")
    return files.select(F.regexp_extract("path", rf"([^/]*){suffix.replace('.', '[.]')}$", 1).alias("name"), "path")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A table by its file's ending: json, jsonl, csv, tsv, parquet, txt or log.  Pickles are never loaded."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "json":
        return spark.read.option("multiLine", True).json(path)
    if kind == "jsonl":
        return spark.read.json(path)
    if kind in ("csv", "tsv"):
        return spark.read.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("txt", "log"):
        return spark.read.text(path)
    raise ValueError(f"no reader for .{kind}")


def seeds(path: str):
    """Seed templates [{template, examples}] as token lists with their examples."""
    from ..plans import align

    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    return [(align.strict(d["template"], (d.get("examples") or [None])[0]), tuple(d.get("examples", ()))) for d in data]


# --- taxonomy pages ---------------------------------------------------------


class _Tables(HTMLParser):
    """Tables of a page under the last h2 or h3 before them, as rows of cell texts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, list[list[str]]]] = []
        self.heading, self.into = "", None
        self.rows: list[list[str]] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in ("h2", "h3"):
            self.heading, self.into = "", "heading"
        elif tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append("")
            self.into = "cell"

    def handle_endtag(self, tag):
        if tag in ("h2", "h3", "td", "th"):
            self.into = None
        elif tag == "table" and self.rows is not None:
            self.found.append((" ".join(self.heading.split()), [[" ".join(c.split()) for c in r] for r in self.rows]))
            self.rows = None

    def handle_data(self, data):
        if self.into == "heading":
            self.heading += data
        elif self.into == "cell" and self.rows and self.rows[-1]:
            self.rows[-1][-1] += data


def field_tables(html: str) -> dict[str, dict[str, dict]]:
    """Type name -> field -> {type, label, description}, or enum value -> {}."""
    p = _Tables()
    p.feed(html)
    out: dict[str, dict[str, dict]] = {}
    for heading, rows in p.found:
        if not rows:
            continue
        head = rows[0]
        if "Field Name" in head:
            at = {h: k for k, h in enumerate(head)}
            own = {r[at["Field Name"]]: {k.lower(): r[at[k]] for k in ("Type", "Label", "Description") if k in at and at[k] < len(r)} for r in rows[1:] if len(r) > at["Field Name"]}
            out.setdefault(heading, {}).update(own)
        elif "Enum Value" in head:
            out.setdefault(heading, {}).update({r[head.index("Enum Value")]: {"type": "enum_value"} for r in rows[1:] if r})
    return out


def dotted_fields(types: dict[str, dict[str, dict]], root: str, prefix: str = "") -> dict[str, dict]:
    """All dotted paths below a type; a type is not opened again below itself."""
    out: dict[str, dict] = {}

    def walk(kind: str, path: str, seen: tuple[str, ...]) -> None:
        for name, d in types.get(kind, {}).items():
            if d.get("type") == "enum_value":
                continue
            full = f"{path}.{name}" if path else name
            inner = d.get("type", "")
            fields = types.get(inner, {})
            is_enum = bool(fields) and all(x.get("type") == "enum_value" for x in fields.values())
            out[full] = {**d, "type": "enum" if is_enum else "object" if fields else inner}
            if fields and not is_enum and inner not in seen:
                walk(inner, full, (*seen, inner))

    walk(root, prefix, (root,))
    return out


def read_field_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """(type, field, field_type, label, description) of all field tables in a table of pages."""
    at = pages.columns.index(html)

    def run(batches):
        for b in batches:
            rows = [(t, f, d.get("type"), d.get("label"), d.get("description")) for x in b.column(at).to_pylist() if x for t, own in field_tables(x).items() for f, d in own.items()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["type", "field", "field_type", "label", "description"])

    # most pages have no table, which the JVM tells far faster than the parser
    return pages.where(F.col(html).rlike("(?i)<table")).mapInArrow(run, "type string, field string, field_type string, label string, description string")
