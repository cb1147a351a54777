"""The registered queries over the driver's tables, and their SQL.

``events`` are rendered as log lines and matched with a catalog of four
templates; each query applies one operator to its whole table.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars, sql
from .operators import export, graphs, heuristics, match, metrics, query, similarity, stats, taxonomy, votes
from .oracles import ORACLES  # noqa: F401
from .plans.catalog import Catalog, Token, tables, wildcard
from .sources import logs
from .streaming import ingest


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, content): an application log made of ``events``."""
    cents = F.round(F.col("value") * 100).cast("long")
    content = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" host"), (F.col("user_id") % 4).cast("string"), F.lit(" app["), F.col("user_id").cast("string"), F.lit("]: "),
        F.col("event_type"), F.lit(" value="), cents.cast("string"), F.lit(" "), F.col("props"),
    )
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("line_id"), content.alias("content"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("long").cast("string")
    content = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" status="), F.col("o_orderstatus"), F.lit(" total="), cents, F.lit(" prio="), F.col("o_orderpriority"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line_id"), content.alias("content"))


def _var(value, regex, ws=0, type_="string_t"):
    return Token(True, value, regex, ws, type_)


def _lit(value, ws=0):
    return Token(False, value, ws=ws)


def app_catalog(kinds=("error", "click", "purchase"), mixed: str | None = "(?:error|purchase|signup)") -> Catalog:
    """Templates of the application log: one for each kind, and one for several; ``view`` lines match none in whole."""
    head = [_var("2024-01-01", r"\d{4}-\d{2}-\d{2}", 1, "datetime_t"), _var("00:00:07", r"\d{2}:\d{2}:\d{2}", 1), _lit("host"), _var("0", r"\d+", 1), _lit("app["), _var("8", r"\d+", 0, "integer_t"), _lit("]:", 1)]
    tail = [_lit("value="), _var("655", r"\d+", 1, "integer_t"), _var('{"k": 69}', r"\{.*\}", 0, "composite_t")]
    c = Catalog()
    middles = [_lit(k, 1) for k in kinds] + ([_var("signup", mixed, 1)] if mixed else [])
    for m in middles:
        c, t = c.add_template([*head, m, *tail], ("app_activity", "auth") if m.value == "signup" else ("app_activity",))
        path = c.templates[t]
        for k, name, mapping in ((0, "date", ()), (1, "time", ()), (3, "host", ("device.hostname",)), (5, "user_id", ("actor.user.uid", "user.uid")), (7, "event_type", ("activity_name",)), (8, "value_KEY", ()), (9, "value", ("count",)), (10, "props", ("unmapped",))):
            c = c.with_semantics(path[k], attribute=name, mapping=mapping, description=f"the {name}")
    return c


def order_catalog() -> Catalog:
    c, t = Catalog().add_template([_lit("order", 1), _var("1", r"\d+", 1, "long_t"), _lit("status="), _var("F", "[A-Z]", 1), _lit("total="), _var("1", r"\d+", 1, "long_t"), _lit("prio="), _var("5-LOW", r"\d-.+")])
    for k, name in ((1, "order_id"), (3, "status"), (5, "total"), (7, "priority")):
        c = c.with_semantics(c.templates[t][k], attribute=name)
    return c


def _parsed(spark, sf_dir, partial=True):
    c = app_catalog()
    return match.parse(event_lines(spark, sf_dir), c, partial=partial), c


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error lines with a value above 100.00."""
    return _query(["event_type", "error"], ["value", "10000", True, True, ">"])(spark, sf_dir)


def _query(*conditions, operator="AND", **options):
    def run(spark, sf_dir):
        q = {"operator": operator, "conditions": list(conditions)}
        return query.where(event_lines(spark, sf_dir), app_catalog(), q, **options)

    return run


# --- one function for each query that needs one --------------------------------


def normalize_lines(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_id"), F.col("text").alias("content"))
    text = logs.normalise(docs)
    return text.select("line_id", F.md5("content").alias("digest"), F.length("content").cast("long").alias("n"))


def full_match_templates(spark, sf_dir):
    parsed, _ = _parsed(spark, sf_dir, False)
    return match.line_matches(parsed)


def multi_match_lines(spark, sf_dir):
    parsed, _ = _parsed(spark, sf_dir, False)
    ids = F.array_sort("matches.template_id")
    return parsed.where(F.size("matches") > 1).select("line_id", F.array_join(ids.cast("array<string>"), ",").alias("templates"))


def unmatched_lines(spark, sf_dir):
    parsed, _ = _parsed(spark, sf_dir, False)
    talk = read(spark, sf_dir, "conversations").select((-1 - F.col("conv_id") * 1000 - F.col("turn")).alias("line_id"), F.col("text").alias("content"))
    other = match.parse(logs.normalise(talk), app_catalog(), partial=False)
    return match.unmatched(parsed).select("line_id").union(match.unmatched(other).select("line_id"))


def unused_templates(spark, sf_dir):
    c = app_catalog(("error", "click", "purchase", "refund"))
    return match.unused_templates(match.parse(event_lines(spark, sf_dir), c, partial=False), c)


def extract_fields_long(spark, sf_dir):
    parsed, c = _parsed(spark, sf_dir)
    return match.field_values(parsed, c)


def extract_fields_wide(spark, sf_dir):
    c = order_catalog()
    return match.wide(match.parse(order_lines(spark, sf_dir), c, partial=False), c, 0, ["line_id"])


def partial_matches(spark, sf_dir):
    parsed, _ = _parsed(spark, sf_dir)
    return parsed.select("line_id", F.inline("partial")).select("line_id", "node_id", "suffix")


def wildcard_render(spark, sf_dir):
    c = app_catalog()
    return spark.createDataFrame([(t, wildcard(c, t), wildcard(c, t, "name"), wildcard(c, t, "type")) for t in c.templates], "template_id int, star string, named string, typed string")


def q_batch_from_json(spark, sf_dir):
    return query.run_all(event_lines(spark, sf_dir), app_catalog(), {
        "errors": {"operator": "AND", "conditions": [["event_type", "error"], ["value", "10000", True, True, ">"]]},
        "users": {"operator": "OR", "conditions": [["user_id", ["1", "2"]], ["host", "3"]]},
        "none": {"operator": "AND", "conditions": [["absent", "", True, True, None, False, True]]},
    })


def value_counts(spark, sf_dir):
    return stats.value_counts(extract_fields_long(spark, sf_dir))


def top_values(spark, sf_dir):
    return stats.top_values(extract_fields_long(spark, sf_dir), 10)


def template_counts(spark, sf_dir):
    return stats.template_counts(_parsed(spark, sf_dir, False)[0])


def node_counts(spark, sf_dir):
    return stats.node_counts(*_parsed(spark, sf_dir))


def match_stats(spark, sf_dir):
    return stats.match_stats(_parsed(spark, sf_dir, False)[0])


def tree_stats(spark, sf_dir):
    own = stats.tree_stats(app_catalog())
    return spark.createDataFrame([(k, v) for k, v in own.items()], "name string, n long")


def examples_per_template(spark, sf_dir):
    return stats.examples(_parsed(spark, sf_dir, False)[0], 5)


def last_n_per_template(spark, sf_dir):
    return stats.last_lines(_parsed(spark, sf_dir, False)[0], 7)


def _flat(column):
    keys = F.map_keys(column)
    return F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit("="), F.array_join(F.element_at(column, k), "|"))), ";")


def export_attributes(spark, sf_dir):
    parsed, c = _parsed(spark, sf_dir, False)
    rows = export.entries(parsed, c)
    return rows.select("line_id", F.array_join(F.col("templates").cast("array<string>"), ",").alias("templates"), _flat("attributes").alias("attributes"))


def export_taxonomy(spark, sf_dir):
    parsed, c = _parsed(spark, sf_dir, False)
    rows = export.entries(parsed, c, taxonomy=True)
    return rows.select("line_id", _flat("attributes").alias("attributes"), F.array_join("events", ",").alias("events"))


def export_json(spark, sf_dir):
    parsed, c = _parsed(spark, sf_dir, False)
    return export.as_json(export.entries(parsed, c))


def loghub_rows(spark, sf_dir):
    parsed, c = _parsed(spark, sf_dir, False)
    rows = export.benchmark_rows(parsed, c)
    return rows.select("line_id", F.array_join(F.col("EventIDs").cast("array<string>"), ",").alias("ids"), F.array_join("EventTemplates", "|").alias("texts"))


def overlap_pairs(spark, sf_dir):
    return stats.overlap_pairs(_parsed(spark, sf_dir, False)[0])


def overlap_components(spark, sf_dir):
    pairs = overlap_pairs(spark, sf_dir).select(F.col("t1").alias("u"), F.col("t2").alias("v"))
    return graphs.components(pairs).select(F.col("node").alias("template_id"), F.col("root").alias("component"))


def partition_shares(spark, sf_dir):
    return stats.partition_shares(_parsed(spark, sf_dir, False)[0])


def _two(spark, sf_dir):
    """The catalog, and one that parts the kinds in another way."""
    a, b = app_catalog(), app_catalog(("error", "view"), "(?:click|purchase)")
    return metrics.combinations(event_lines(spark, sf_dir), a, b), a, b


def group_accuracy(spark, sf_dir):
    return metrics.group_accuracy(_two(spark, sf_dir)[0])


def group_similarity(spark, sf_dir):
    return metrics.group_accuracy(_two(spark, sf_dir)[0], soft=True)


def parser_accuracy(spark, sf_dir):
    return metrics.parser_accuracy(*_two(spark, sf_dir))


def template_similarity(spark, sf_dir):
    return metrics.parser_accuracy(*_two(spark, sf_dir), soft=True)


def _renamed() -> Catalog:
    """The catalog with time and date under one name, a value under another, and other mappings."""
    c = app_catalog()
    for n, s in list(c.semantics.items()):
        if s.attribute in ("date", "time"):
            c = c.with_semantics(n, attribute="stamp", mapping=("time",))
        if s.attribute == "user_id":
            c = c.with_semantics(n, mapping=("user.uid", "user.name"))
    c = c.with_semantics(c.templates[0][9], attribute="amount")
    return c


def schema_group_similarity(spark, sf_dir):
    return metrics.schema_group_score(event_lines(spark, sf_dir), app_catalog(), _renamed(), soft=True, penalise_overcapture=False)


def mapping_score(spark, sf_dir):
    return metrics.mapping_score(event_lines(spark, sf_dir), app_catalog(), _renamed())


def query_precision_recall(spark, sf_dir):
    q = {"errors": ["event_type", "error"], "dear": ["value", "20000", True, True, ">="], "users": ["user_id", "7"]}
    other = {"errors": ["event_type", "r", False], "dear": ["value", "30000", True, True, ">="], "users": ["user_id", "absent"]}
    lines, c = event_lines(spark, sf_dir), app_catalog()
    return metrics.query_scores(query.run_all(lines, c, q), query.run_all(lines, c, other))


def jaccard_topk(spark, sf_dir):
    own = lambda t, i: match.spread(read(spark, sf_dir, t).select(i, "text")).select(F.col(i).alias("id"), scalars.line_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    found = similarity.jaccard_topk(own("benchmark", "item_id"), own("documents", "doc_id"), 3)
    return found.withColumn("score", F.round("score", 6))


def _urls(spark, sf_dir):
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("text"))


def jaccard_clusters(spark, sf_dir):
    return similarity.jaccard_clusters(_urls(spark, sf_dir), 0.3)


def cluster_medoid(spark, sf_dir):
    lines = _urls(spark, sf_dir)
    return similarity.medoids(lines, similarity.jaccard_clusters(lines, 0.3))


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("label"))


def cosine_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return similarity.cosine_topk(v.where("id % 100 = 0"), v, 5).withColumn("score", F.round("score", 6))


def centroid_rank(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return similarity.centroid_rank(similarity.centroids(v), v, k=1).select("id", "label", F.round("score", 6).alias("score"))


def cosine_clusters(spark, sf_dir):
    return similarity.merge_clusters(similarity.centroids(_vectors(spark, sf_dir)), least=0.2)


def nearest_description(spark, sf_dir):
    return similarity.nearest_description(_vectors(spark, sf_dir))


def density_clusters(spark, sf_dir):
    return heuristics.density_clusters(_vectors(spark, sf_dir), 1.05)


def line_prefixes(spark, sf_dir):
    return heuristics.prefixes(*_parsed(spark, sf_dir))


def filled_matches(spark, sf_dir):
    return heuristics.filled(_parsed(spark, sf_dir, False)[0])


def structured_matches(spark, sf_dir):
    lines = order_lines(spark, sf_dir).select(F.col("line_id").alias("LineId"), F.col("content").alias("Content"))
    found = heuristics.parse_structured(lines, {"any": "order <*> status=<*> total=<*> prio=<*>", "open": "order <*> status=O total=<*> <*>"})
    return found.select("LineId", F.array_join("ids", ",").alias("ids"), F.array_join(F.flatten("groups"), "|").alias("groups"))


def log_fields_udtf(spark, sf_dir):
    """The SQL table function over all lines."""
    sql.register(spark, app_catalog(), "app_")
    event_lines(spark, sf_dir).createOrReplaceTempView("app_lines")
    return spark.sql("SELECT line_id, f.template_id, f.node_id, f.value FROM app_lines, LATERAL app_log_fields(content) AS f")


def token_weights(spark, sf_dir):
    return stats.token_weights(extract_fields_long(spark, sf_dir))


def value_overlap(spark, sf_dir):
    return stats.value_overlap(value_counts(spark, sf_dir))


def parse_float_lenient(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", scalars.parse_float(F.col("props")).alias("k"), scalars.parse_float(F.concat(F.lit("-"), F.col("user_id").cast("string"), F.lit("ms"))).alias("ms"))


def parse_datetime(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    texts = F.array(*[F.date_format("o_orderdate", f) for f in ("yyyy-MM-dd HH:mm:ss", "M/d/yyyy", "d MMM yyyy", "yyyyMMdd")])
    return o.select("o_orderkey", F.posexplode(texts).alias("form", "t")).select("o_orderkey", "form", scalars.parse_epoch(F.col("t"), "2024-01-01").alias("epoch"))


def type_validate(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    last = F.regexp_extract("url", r"/([^/?#]*)(?:[?#].*)?$", 1)
    checked = scalars.typed(last, "integer", low=100, high=600)
    return p.select("page_id", checked["value"].alias("value"), checked["error"].alias("error"))


def lineage(spark, sf_dir):
    c = app_catalog()
    return spark.createDataFrame([(n, len(c.lineage(n)), "/".join(map(str, c.lineage(n)))) for n in c.nodes], "node_id int, depth int, path string")


def degree_of_separation(spark, sf_dir):
    t = tables(spark, app_catalog())["template_nodes"]
    paths = t.groupBy("template_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node_id"))), lambda s: s["node_id"]).alias("p"))
    a, b = paths.toDF("t1", "p1"), paths.toDF("t2", "p2")
    return a.join(F.broadcast(b), F.col("t1") < F.col("t2")).select("t1", "t2", scalars.separation(F.col("p1"), F.col("p2")).cast("int").alias("degree"))  # a row for each template


def _nations(spark, sf_dir):
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.concat("r_name", F.lit("."), "n_name").alias("name"), F.col("r_name").alias("parent"))


def taxonomy_siblings(spark, sf_dir):
    return taxonomy.siblings(_nations(spark, sf_dir), None).select("name", "sibling")


def type_votes(spark, sf_dir):
    """The most common priority of each customer."""
    return votes.plurality(read(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


def html_fields(spark, sf_dir):
    """Field tables in the pages (prose has none) and in one page rendered for each part."""
    cells = lambda tag, *x: F.concat(F.lit("<tr>"), *[F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>\n")) for c in x], F.lit("</tr>"))
    head = cells("th", *[F.lit(x) for x in ("Field Name", "Type", "Label", "Description")])
    key = cells("td", F.lit("key"), F.lit("int32"), F.lit("optional"), F.concat(F.lit("the <b>key</b> &amp; "), F.col("p_partkey").cast("string")))
    size = cells("td", F.lit(" size "), F.lit("<i>uint64</i>"), F.lit(""), F.col("p_size").cast("string"))
    html = F.concat(F.lit("<html><h2>Part "), F.col("p_partkey").cast("string"), F.lit("</h2><p>text</p><table>"), head, key, size, F.lit("</table></html>"))
    return logs.read_field_pages(read(spark, sf_dir, "pages").select("html").union(read(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(spark.sparkContext.defaultParallelism).select(html)))


def stream_match_available_now(spark, sf_dir):
    home = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    lines = event_lines(spark, sf_dir)
    lines.write.parquet(f"{home}/in")
    stream = spark.readStream.schema(lines.schema).parquet(f"{home}/in")
    ingest.start(stream, app_catalog(), f"{home}/out").awaitTermination()
    return match.line_matches(ingest.matched_table(spark, f"{home}/out"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine only where all run on it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="loomlog-")


QUERIES = {
    f.__name__: f
    for f in (
        normalize_lines, full_match_templates, multi_match_lines, unmatched_lines, unused_templates, extract_fields_long, extract_fields_wide, partial_matches, wildcard_render, q_batch_from_json,
        value_counts, top_values, template_counts, node_counts, match_stats, tree_stats, examples_per_template, last_n_per_template, export_attributes, export_taxonomy, export_json, loghub_rows,
        overlap_pairs, overlap_components, partition_shares, group_accuracy, group_similarity, parser_accuracy, template_similarity, schema_group_similarity, mapping_score, query_precision_recall,
        jaccard_topk, jaccard_clusters, cluster_medoid, cosine_topk, centroid_rank, cosine_clusters, nearest_description, density_clusters, line_prefixes, filled_matches, structured_matches, log_fields_udtf, token_weights, value_overlap, parse_float_lenient, parse_datetime, type_validate,
        lineage, degree_of_separation, taxonomy_siblings, type_votes, html_fields, stream_match_available_now,
    )
} | {
    "flagship": flagship,
    "q_exact": _query(["event_type", "click"]),
    "q_exact_ci": _query(["event_type", "ERROR", True, False]),
    "q_contains": _query(["event_type", "c", False]),
    "q_contains_ci": _query(["props", "K", False, False]),
    "q_multi_value": _query(["user_id", ["3", "5", "8"]]),
    "q_negation": _query(["event_type", "error", True, True, None, True]),
    "q_numeric_gt": _query(["value", "17807", True, True, ">"]),
    "q_numeric_ge": _query(["value", "17807", True, True, ">="]),
    "q_numeric_lt": _query(["value", "150ms", True, True, "<"]),
    "q_numeric_le": _query(["value", "150", True, True, "<="]),
    "q_numeric_eq": _query(["value", "655", True, True, "="]),
    "q_datetime_range": _query(["date", "2024-01-05", True, True, ">="], ["date", "Jan 9, 2024", True, True, "<"]),
    "q_exists": _query(["host", "", True, True, None, False, True]),
    "q_not_exists": _query(["event_type", "", True, True, None, True, True]),
    "q_static_match": _query(["", "click", False, True, None, False, False, True]),
    "q_standardized": _query(["app_activity.actor.user.uid", "7"], standardized=True, events=("app_activity",)),
    "q_and": _query(["event_type", "error"], ["host", "2"]),
    "q_or": _query(["event_type", "click"], ["host", "2"], operator="OR"),
    "q_nested": _query(["host", "1"], {"operator": "OR", "conditions": [["event_type", "purchase"], ["value", "1000", True, True, "<"]]}),
}
