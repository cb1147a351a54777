"""Security taxonomies as tables: dotted attributes, their expansion, siblings and candidates for a mapping.

A taxonomy is (name, parent, type, base_type, is_object, is_array, description,
events); names are dotted paths.  It is reference data of bounded size, so the
joins here broadcast it after its row count has been checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars

SCHEMA = "name string, parent string, type string, base_type string, is_object boolean, is_array boolean, description string, events array<string>"
#: Candidates that a mapping is offered, siblings beside each, rows up to which a taxonomy is broadcast.
CANDIDATES, SIBLINGS, BROADCAST_ROWS = 50, 25, 200_000

# Kinds of protobuf-like type names.
NUMERIC = ("int32", "int64", "uint32", "uint64", "sint32", "sint64", "fixed32", "fixed64", "sfixed32", "sfixed64", "float", "double")


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it is small enough, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def expand(spark, classes: dict[str, dict[str, dict]], objects: dict[str, dict[str, dict]], base_types: dict[str, str] | None = None, depth: int = 12) -> DataFrame:
    """The dotted attributes that event classes reach through objects.

    ``classes`` and ``objects`` give name -> attribute -> {type, object_type,
    is_array, description}.  An object is not opened again below itself.
    """
    rows: dict[str, dict] = {}

    def walk(event: str, prefix: str, attributes: dict, seen: tuple[str, ...]) -> None:
        for a, d in sorted(attributes.items()):
            name = f"{prefix}.{a}" if prefix else a
            kind = d.get("object_type")
            row = rows.setdefault(name, {"parent": prefix or None, "type": kind or d.get("type", "string_t"), "is_object": bool(kind), "is_array": bool(d.get("is_array")), "description": d.get("description"), "events": set()})
            row["events"].add(event)
            if kind and kind not in seen and len(seen) < depth:
                walk(event, name, objects.get(kind, {}), (*seen, kind))

    for event, attributes in classes.items():
        walk(event, "", attributes, ())
    base = base_types or {}
    return spark.createDataFrame(
        [(n, r["parent"], r["type"], base.get(r["type"], r["type"]), r["is_object"], r["is_array"], r["description"], sorted(r["events"])) for n, r in sorted(rows.items())], SCHEMA
    )


def meta_type(name: str) -> str:
    """The general kind of a field type's name."""
    low = name.lower()
    if "date" in low or "time" in low:
        return "DATETIME"
    if low in NUMERIC:
        return "NUMERIC"
    return {"string": "STRING", "bytes": "STRING", "bool": "BOOL", "enum": "ENUM", "object": "OBJECT", "message": "OBJECT"}.get(low, "UNKNOWN")


def from_fields(spark, fields: dict[str, dict]) -> DataFrame:
    """A taxonomy from dotted name -> {type, label, description}; parents that are missing are made; additional fields are left out."""
    rows: dict[str, tuple] = {}
    for name, d in sorted(fields.items()):
        if name.startswith("event.additional"):
            continue
        parts = name.split(".")
        for k in range(1, len(parts)):
            p = ".".join(parts[:k])
            rows.setdefault(p, (p, ".".join(parts[: k - 1]) or None, "OBJECT", "OBJECT", True, False, None, [parts[0]]))
        kind = meta_type(d.get("type", ""))
        rows[name] = (name, ".".join(parts[:-1]) or None, d.get("type", ""), kind, kind == "OBJECT", d.get("label") == "repeated", d.get("description"), [parts[0]])
    return spark.createDataFrame([rows[n] for n in sorted(rows)], SCHEMA)


def select(taxonomy: DataFrame, events: list[str] | None = None, type_: str | None = None, fuzzy: int = 0) -> DataFrame:
    """Attributes of any of the events and of a type: 0 the very type, 1 one with its base type, 2 any."""
    out = taxonomy
    if events:
        out = out.where(F.arrays_overlap("events", F.array(*[F.lit(e) for e in events])))
    if type_ is None or fuzzy >= 2:
        return out
    if fuzzy == 0:
        return out.where(F.col("type") == type_)
    base = taxonomy.where(F.col("type") == type_).select(F.col("base_type").alias("_b")).distinct()
    return out.join(F.broadcast(base.limit(1)), (F.col("base_type") == F.col("_b")) | (F.col("type") == type_), "left_semi")  # one row


def siblings(taxonomy: DataFrame, most: int | None = SIBLINGS) -> DataFrame:
    """(name, sibling, score): attributes with the same parent, by shared leading segments and name."""
    t = taxonomy.select("name", "parent")
    pairs = t.join(t.withColumnRenamed("name", "sibling"), "parent").where("name <> sibling")
    scored = pairs.select("name", "sibling", F.round(scalars.dotted_similarity(F.col("name"), F.col("sibling")), 6).alias("score"))
    if most is None:
        return scored
    w = Window.partitionBy("name").orderBy(F.desc("score"), "sibling")
    return scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def candidates(fields: DataFrame, taxonomy: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(field, name, score, exact): attributes to offer for fields(field, type, events, embedding).

    The taxonomy must carry ``embedding``.  Attributes of the very type come
    first with score 1 where there are fewer than k; the rest fill up by cosine.
    """
    t = small(taxonomy.select("name", F.col("type").alias("t_type"), F.col("events").alias("t_events"), F.col("embedding").alias("t_vec")))
    pairs = fields.join(t, F.arrays_overlap("events", "t_events"))
    scored = pairs.select("field", "name", F.round(scalars.cosine(F.col("embedding"), F.col("t_vec")), 6).alias("cos"), (F.col("type") == F.col("t_type")).alias("exact"))
    few = F.count_if("exact").over(Window.partitionBy("field")) < k
    scored = scored.withColumn("score", F.when(F.col("exact") & few, F.lit(1.0)).otherwise(F.col("cos")))
    w = Window.partitionBy("field").orderBy((F.col("exact") & (F.col("score") == 1.0)).desc(), F.desc("score"), "name")
    return scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("field", "name", "score", "exact")


def graph(taxonomy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from parents to children."""
    return taxonomy.select("name", "type", "is_object"), taxonomy.where("parent is not null").select(F.col("parent").alias("src"), F.col("name").alias("dst"))


def outline(taxonomy: DataFrame) -> DataFrame:
    """(name, line): an indented list in order of path."""
    depth = F.size(F.split("name", r"\.")) - 1
    return taxonomy.select("name", F.concat(F.expr("repeat('  ', size(split(name, '[.]')) - 1)"), F.lit("- "), F.element_at(F.split("name", r"\."), -1)).alias("line"), depth.alias("depth")).orderBy("name").drop("depth")


def save(taxonomy: DataFrame, path: str) -> None:
    taxonomy.write.mode("overwrite").parquet(path)
