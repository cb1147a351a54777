"""More registered queries: functions, sampling, parsers' helpers, scores and streams over whole tables, each with SQL of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .catalogue import _two, _var, app_catalog, event_lines, order_catalog, order_lines, read, shared_dir
from .functions import scalars
from .operators import heuristics, match, metrics, query, stats, taxonomy
from .oracles import _B, _ORDERS, _V, _W
from .plans.catalog import Catalog
from .sources import logs
from .streaming import ingest


def _parsed(spark, sf_dir):
    c = app_catalog()
    return match.parse(event_lines(spark, sf_dir), c), c


# --- scalar functions -------------------------------------------------------------


def parse_int_lenient(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", scalars.parse_int(F.col("o_orderpriority")).alias("rank"), scalars.parse_int(F.concat(F.lit(" +"), F.col("o_custkey").cast("string"), F.lit(" "))).alias("cust"))


def html_text(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", scalars.clean_text(F.coalesce("html", F.lit(""))).alias("t"))
    return p.select("page_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


def word_occurrences(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", F.array_join(scalars.occurrences(F.col("url"), F.lit("e")).cast("array<string>"), ",").alias("places"))


def event_prefix(spark, sf_dir):
    n = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 rows
    return n.select("n_nationkey", scalars.without_prefix(F.concat("r_name", F.lit("."), "n_name"), ["AFRICA", "ASIA"]).alias("field"))


def _dotted(o):
    own = F.concat(F.lit("order."), F.col("o_orderstatus"), F.lit("."), F.date_format("o_orderdate", "yyyy.MM"))
    return own, F.concat(F.lit("order.F."), F.date_format("o_orderdate", "yyyy"), F.lit(".06"))


def dotted_likeness(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.round(scalars.dotted_similarity(*_dotted(o)), 6).alias("score"))


def lineage_likeness(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    parts = [F.split(x, r"\.") for x in _dotted(o)]
    return o.select("o_orderkey", F.round(scalars.separation(*parts, normalised=True), 6).alias("score"))


def typed_float(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(F.round("value").cast("long").cast("string"))
    checked = scalars.typed(text, "long", regex=r"\d+$", max_len=3, low=1)
    return e.select("event_id", checked["value"].alias("value"), checked["error"].alias("error"))


def template_words(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.array_join(scalars.template_tokens(F.concat(F.col("event_type"), F.lit(".'5' "), F.col("props"))), " ").alias("words"))


def text_digests(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", scalars.checksum(F.col("text")).alias("digest"), scalars.unquoted(scalars.quoted(F.substring("text", 1, 200))).alias("head"))


def edit_ratios(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(scalars.edit_ratio(F.col("p_name"), F.reverse("p_name")), 6).alias("score"))


def vector_lengths(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    x, y = F.col("embedding"), F.reverse("embedding")
    return v.select("vec_id", F.round(scalars.euclidean(x, y), 4).alias("far"), F.round(scalars.cosine(x, y), 4).alias("cosine"))


# --- lines and catalogs -----------------------------------------------------------


def kept_lines(spark, sf_dir):
    return stats.keep_lines(match.parse(event_lines(spark, sf_dir), app_catalog(), partial=False), 1)


def simplified_weights(spark, sf_dir):
    parsed, c = _parsed(spark, sf_dir)
    return stats.token_weights(match.field_values(parsed, c), simplify=0.01, at_least=30)


def numeric_summary(spark, sf_dir):
    parsed, c = _parsed(spark, sf_dir)
    own = stats.numeric_summary(match.field_values(parsed, c).where("node_id <> 2"))  # times of day read as whatever digits they have
    return own.select("node_id", "n", "low", "high", F.round("mean", 4).alias("mean"))


def lost_lines(spark, sf_dir):
    return match.lost_lines(event_lines(spark, sf_dir), app_catalog(), app_catalog(("error", "click"), None)).select("line_id")


def changed_lines(spark, sf_dir):
    out = match.changed_lines(event_lines(spark, sf_dir), app_catalog(), app_catalog(("error", "view"), None))
    return out.select("line_id", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"))


def rematched(spark, sf_dir):
    before, after = app_catalog(), app_catalog(("error", "click", "refund"))
    lines = event_lines(spark, sf_dir)
    return ingest.rematch(lines, match.line_matches(match.parse(lines, before, partial=False)), before, after, frozenset([2]))


def pattern_takes(spark, sf_dir):
    return heuristics.previous_matches(_parsed(spark, sf_dir)[0], r"value=1\d*", 1_000_000_000)


def pattern_counts(spark, sf_dir):
    return heuristics.all_match(event_lines(spark, sf_dir), r"[0-9]+:")


def prefix_templates(spark, sf_dir):
    lines = order_lines(spark, sf_dir).select(F.col("line_id").alias("LineId"), F.col("content").alias("Content"))
    found = heuristics.parse_structured(lines, {"open": "order <*> status=O", "first": "order 1"}, whole=False)
    return found.select("LineId", F.array_join("ids", ",").alias("ids"))


def suffix_views(spark, sf_dir):
    lines = event_lines(spark, sf_dir).withColumn("suffix", F.regexp_extract("content", r"\]: (.*)$", 1))
    out = heuristics.suffix_matches(lines, app_catalog())
    return out.select("line_id", "template_id", "text", F.array_join("values", "|").alias("values"))


def events_of_lines(spark, sf_dir):
    """Order lines told their event by a structured table that has the even orders, some of them twice."""
    o = order_lines(spark, sf_dir)
    rows = o.where("line_id % 2 = 0").select(F.col("line_id").cast("int").alias("LineId"), F.concat(F.lit(" "), F.replace("content", F.lit(" "), F.lit("  "))).alias("Content"), F.lit("E1").alias("EventId"))
    again = rows.where("LineId % 3 = 0").select((F.col("LineId") + 1).alias("LineId"), "Content", F.lit("E2").alias("EventId"))
    return logs.event_of_line(o, rows.union(again))


def first_event_lines(spark, sf_dir):
    o = order_lines(spark, sf_dir)
    s = o.select(F.col("line_id").cast("int").alias("LineId"), F.col("content").alias("Content"), F.regexp_extract("content", "prio=(.*)$", 1).alias("EventId"), F.lit("order <*>").alias("EventTemplate"))
    return logs.first_lines(s)


def prefix_groups(spark, sf_dir):
    clusters = event_lines(spark, sf_dir).select(F.col("line_id").alias("id"), F.when(F.col("line_id") % 5 > 0, F.col("line_id") % 5).alias("cluster"))
    out = heuristics.by_prefix(clusters, heuristics.prefixes(*_parsed(spark, sf_dir)))
    return out.select("cluster", "node_id", "n", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def direction_groups(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return heuristics.direction_clusters(v, 0.45)


def words_of_four_languages(spark, sf_dir):
    """The first words of each document by a template of Unicode word characters."""
    c, t = Catalog().add_template([_var("x", r"\w+", 1), _var("y", r"\w+\W*?", 1), _var("z", r"\S.*")])
    for k, name in enumerate(("first", "second", "rest")):
        c = c.with_semantics(c.templates[t][k], attribute=name)
    docs = logs.normalise(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_id"), F.col("text").alias("content")))
    own = match.wide(match.parse(docs, c, partial=False), c, t, ["line_id"])
    return own.select("line_id", "first", "second", F.length("rest").cast("long").alias("n"))


def open_order_fields(spark, sf_dir):
    """A query over the order log, with the fields that it matched."""
    c = order_catalog()
    kept = query.where(order_lines(spark, sf_dir), c, {"operator": "AND", "conditions": [["status", "O"], ["total", "1000000", True, True, ">="]]})
    return match.field_values(match.parse(kept, c, partial=False), c).select("line_id", "node_id", "value")


# --- scores -----------------------------------------------------------------------


def reference_group_accuracy(spark, sf_dir):
    return metrics.group_accuracy_of_reference(_two(spark, sf_dir)[0], soft=True)


def _found(spark, sf_dir):
    lines, c = event_lines(spark, sf_dir), app_catalog()
    q = {"errors": ["event_type", "error"], "click": ["event_type", "click"], "host": ["host", "2"]}
    other = {"errors": ["event_type", "r", False], "click": ["event_type", "click"], "host": ["host", ["1", "2"]]}
    return query.run_all(lines, c, q), query.run_all(lines, c, other), lines


def macro_scores(spark, sf_dir):
    a, b, _ = _found(spark, sf_dir)
    return metrics.macro(metrics.query_scores(a, b))


def line_text_scores(spark, sf_dir):
    a, b, lines = _found(spark, sf_dir)
    short = lines.select("line_id", F.substring("content", 1, 24).alias("content"))
    return metrics.text_scores(a.join(short, "line_id"), b.join(short, "line_id"))


# --- taxonomies and streams ---------------------------------------------------------


def _taxonomy(spark, sf_dir):
    n = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 rows
    kind = F.when(F.col("n_nationkey") % 2 == 0, "email_t").otherwise(F.when(F.col("n_nationkey") % 3 == 0, "string_t").otherwise("port_t"))
    leaves = n.select(F.concat("r_name", F.lit("."), "n_name").alias("name"), F.col("r_name").alias("parent"), kind.alias("type"), F.array("r_name").alias("events"))
    return leaves.withColumn("base_type", F.when(F.col("type") == "port_t", "integer_t").otherwise("string_t"))


def taxonomy_by_type(spark, sf_dir):
    return taxonomy.select(_taxonomy(spark, sf_dir), ["ASIA", "EUROPE", "AMERICA"], "email_t", 1).select("name", "type")


def taxonomy_outline(spark, sf_dir):
    return taxonomy.outline(_taxonomy(spark, sf_dir))


def taxonomy_edges(spark, sf_dir):
    return taxonomy.graph(_taxonomy(spark, sf_dir).withColumn("is_object", F.lit(False)))[1]


def mapping_candidates(spark, sf_dir):
    """The k attributes to offer for each of ten fields, vectors in place of descriptions."""
    v = read(spark, sf_dir, "embeddings")
    kind = F.concat(F.lit("t"), (F.col("vec_id") % 40).cast("string"))
    t = v.select(F.concat(F.lit("a"), F.col("vec_id").cast("string")).alias("name"), kind.alias("type"), F.array(F.concat(F.lit("e"), F.col("label").cast("string"))).alias("events"), F.col("embedding"))
    fields = v.where("vec_id < 10").select(F.concat(F.lit("f"), F.col("vec_id").cast("string")).alias("field"), kind.alias("type"), F.array(*[F.lit(f"e{k}") for k in range(3)]).alias("events"), F.col("embedding"))
    return taxonomy.candidates(fields, t, 6)


def stream_dead_letters(spark, sf_dir):
    home = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    lines = event_lines(spark, sf_dir)
    lines.write.parquet(f"{home}/in")
    ingest.start(spark.readStream.schema(lines.schema).parquet(f"{home}/in"), app_catalog(), f"{home}/out").awaitTermination()
    return ingest.dead_letters(spark, f"{home}/out").select("line_id", "content")


QUERIES = {
    f.__name__: f
    for f in (
        parse_int_lenient, html_text, word_occurrences, event_prefix, dotted_likeness, lineage_likeness, typed_float, template_words, text_digests, edit_ratios, vector_lengths, kept_lines, simplified_weights, numeric_summary,
        lost_lines, changed_lines, rematched, pattern_takes, pattern_counts, prefix_templates, suffix_views, events_of_lines, first_event_lines, prefix_groups, direction_groups, words_of_four_languages, open_order_fields,
        reference_group_accuracy, macro_scores, line_text_scores, taxonomy_by_type, taxonomy_outline, taxonomy_edges, mapping_candidates, stream_dead_letters,
    )
}

_TAX = """x AS (SELECT r_name || '.' || n_name AS name, r_name AS parent, CASE WHEN n_nationkey % 2 = 0 THEN 'email_t' WHEN n_nationkey % 3 = 0 THEN 'string_t' ELSE 'port_t' END AS type
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""
_PAIR = """q AS (SELECT 'errors' AS query, line_id, e = 'error' AS a, e <> 'view' AND e LIKE '%r%' AS b FROM p UNION ALL SELECT 'click', line_id, e = 'click', e = 'click' FROM p
  UNION ALL SELECT 'host', line_id, h = '2', h IN ('1', '2') FROM p)"""
_SAME_STATUS, _SAME_MONTH = "o_orderstatus = 'F'", "month(o_orderdate) = 6"

ORACLES: dict[str, str] = {
    "parse_int_lenient": "SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS rank, o_custkey::BIGINT AS cust FROM orders",
    "html_text": r"""SELECT page_id, length(t)::BIGINT AS n, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
        regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'gs'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM pages)""",
    "word_occurrences": "SELECT page_id, array_to_string(list_filter(range(0, length(url)), lambda i: substr(url, i::INTEGER + 1, 1) = 'e'), ',') AS places FROM pages",
    "event_prefix": "SELECT n_nationkey, CASE WHEN r_name IN ('AFRICA', 'ASIA') THEN n_name ELSE r_name || '.' || n_name END AS field FROM nation JOIN region ON n_regionkey = r_regionkey",
    "dotted_likeness": f"SELECT o_orderkey, round(CASE WHEN NOT {_SAME_STATUS} THEN 0 WHEN {_SAME_MONTH} THEN 2 ELSE 2 END / 3, 6)::DOUBLE AS score FROM orders",
    "lineage_likeness": f"SELECT o_orderkey, round(CASE WHEN NOT {_SAME_STATUS} THEN 1 WHEN {_SAME_MONTH} THEN 4 ELSE 3 END / 4, 6)::DOUBLE AS score FROM orders",
    "typed_float": """SELECT event_id, CASE WHEN n >= 1 AND length(n::VARCHAR) <= 3 THEN n::VARCHAR END AS value,
        CASE WHEN n IS NULL THEN 'not a long' WHEN n < 0 THEN 'regex' WHEN length(n::VARCHAR) > 3 THEN 'max_len' WHEN n < 1 THEN 'range' END AS error
        FROM (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN CAST(round(value) AS BIGINT) END AS n FROM events)""",
    "template_words": r"""SELECT event_id, array_to_string(list_filter(regexp_split_to_array(translate(event_type || '.''5'' ' || props, '"''', '  '), '[\[\](){}.:|,;\s]+'), lambda w: w <> '' AND NOT regexp_matches(w, '^[0-9$]+$')), ' ') AS words FROM events""",
    "text_digests": "SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN '0' ELSE md5(text) END AS digest, substr(text, 1, 200) AS head FROM documents",
    "edit_ratios": "SELECT p_partkey, round(CASE WHEN length(p_name) = 0 THEN 1 ELSE 1 - levenshtein(p_name, reverse(p_name)) / length(p_name) END, 6)::DOUBLE AS score FROM part",
    "vector_lengths": "SELECT vec_id, round(list_distance(x, list_reverse(x)), 4) AS far, round(list_cosine_similarity(x, list_reverse(x)), 4) AS cosine FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)",
    "kept_lines": f"""{_W}, k AS (SELECT line_id, count(*) AS c FROM m GROUP BY line_id), r AS (SELECT m.line_id, m.content FROM m JOIN k USING (line_id) QUALIFY row_number() OVER (PARTITION BY template_id ORDER BY c, m.line_id) = 1)
        SELECT DISTINCT line_id, content FROM r UNION ALL SELECT line_id, content FROM l WHERE line_id NOT IN (SELECT line_id FROM m)""",
    "simplified_weights": f"""{_W}, s AS (SELECT node_id, count(*) AS k FROM f GROUP BY node_id),
        t AS (SELECT node_id, unnest(list_distinct(list_filter(list_concat([value], regexp_split_to_array(value, '[^0-9A-Za-z]+')), lambda x: x <> ''))) AS token FROM f),
        w AS (SELECT node_id, token, count(*) AS n, round(count(*) / any_value(k), 6)::DOUBLE AS weight FROM t JOIN s USING (node_id) GROUP BY node_id, token)
        SELECT node_id, token, n, weight FROM w QUALIFY count(*) OVER (PARTITION BY node_id) < 30 OR weight > 0.01""",
    "numeric_summary": f"""{_W}, x AS (SELECT node_id, CASE node_id WHEN 1 THEN TRY_CAST(replace(value, '-', '') AS DOUBLE) ELSE CASE WHEN regexp_matches(value, '^[0-9]+$') THEN CAST(value AS DOUBLE) WHEN value LIKE '{{%' THEN CAST(regexp_extract(value, ': *([0-9]+)', 1) AS DOUBLE) END END AS v FROM f WHERE node_id <> 2)
        SELECT node_id, count(*) AS n, min(v) AS low, max(v) AS high, round(avg(v), 4) AS mean FROM x WHERE v IS NOT NULL GROUP BY node_id""",
    "lost_lines": f"{_W} SELECT line_id FROM p WHERE e IN ('purchase', 'signup')",
    "changed_lines": f"""{_W}, s AS (SELECT line_id, CASE e WHEN 'error' THEN '0,3' WHEN 'click' THEN '1' WHEN 'purchase' THEN '2,3' WHEN 'signup' THEN '3' ELSE '' END AS before, CASE e WHEN 'error' THEN '0' WHEN 'view' THEN '1' ELSE '' END AS after FROM p)
        SELECT * FROM s WHERE before <> after""",
    "rematched": f"{_W} SELECT line_id, template_id, 11::INTEGER AS trail_len FROM m WHERE template_id <> 2",
    "pattern_takes": f"{_W} SELECT template_id, count(*) AS n FROM m WHERE regexp_matches(content, 'value=1[0-9]*') GROUP BY template_id",
    "pattern_counts": f"{_W} SELECT bool_and(regexp_matches(content, '[0-9]+:')) AS \"all\", count_if(regexp_matches(content, '[0-9]+:'))::BIGINT AS lines, sum(len(regexp_extract_all(content, '[0-9]+:')))::BIGINT AS times FROM l",
    "prefix_templates": f"WITH {_ORDERS} SELECT line_id AS LineId, concat_ws(',', CASE WHEN regexp_matches(content, '^order [^ ]+ status=O') THEN 'open' END, CASE WHEN content LIKE 'order 1%' THEN 'first' END) AS ids FROM o",
    "suffix_views": f"""{_W} SELECT m.line_id, template_id, CASE template_id WHEN 3 THEN '<*>' ELSE e END || ' value=<*> <*>' AS text, CASE WHEN template_id = 3 THEN e || '|' ELSE '' END || v || '|' || p.p AS values FROM m JOIN p ON m.line_id = p.line_id""",
    "events_of_lines": f"WITH {_ORDERS} SELECT line_id, CASE WHEN line_id % 3 = 0 THEN 'E2' ELSE 'E1' END AS EventId FROM o WHERE line_id % 2 = 0",
    "first_event_lines": f"WITH {_ORDERS}, s AS (SELECT line_id, content, regexp_extract(content, 'prio=(.*)$', 1) AS e FROM o) SELECT e AS EventId, 'order <*>' AS EventTemplate, arg_min(content, line_id) AS Content FROM s GROUP BY e",
    "prefix_groups": f"""{_W}, x AS (SELECT line_id, CASE WHEN line_id % 5 > 0 THEN line_id % 5 END AS cluster FROM p WHERE e = 'view')
        SELECT cluster, 7::INTEGER AS node_id, count(*) AS n, array_to_string(list_sort(list(line_id))[1:5], ',') AS ids FROM x GROUP BY cluster""",
    "direction_groups": f"""WITH RECURSIVE {_V}, e AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id AND list_cosine_similarity(a.x, b.x) >= 0.45),
        r AS (SELECT DISTINCT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id) SELECT v.id, c.root AS cluster FROM v LEFT JOIN (SELECT id, min(root) AS root FROM r GROUP BY id) c USING (id)""",
    "words_of_four_languages": r"""WITH t AS (SELECT doc_id AS line_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS c FROM documents), x AS (SELECT line_id, c, '^([\p{L}\p{N}_]+)\s+([\p{L}\p{N}_]+[^\p{L}\p{N}_]*?)\s+([^\s].*)$' AS r FROM t)
        SELECT line_id, regexp_extract(c, '^([\p{L}\p{N}_]+)\s+([\p{L}\p{N}_]+[^\p{L}\p{N}_]*?)\s+([^\s].*)$', 1) AS first, trim(regexp_extract(c, '^([\p{L}\p{N}_]+)\s+([\p{L}\p{N}_]+[^\p{L}\p{N}_]*?)\s+([^\s].*)$', 2)) AS second,
        length(regexp_extract(c, '^([\p{L}\p{N}_]+)\s+([\p{L}\p{N}_]+[^\p{L}\p{N}_]*?)\s+([^\s].*)$', 3))::BIGINT AS n FROM x WHERE regexp_matches(c, '^([\p{L}\p{N}_]+)\s+([\p{L}\p{N}_]+[^\p{L}\p{N}_]*?)\s+([^\s].*)$')""",
    "open_order_fields": f"""WITH {_ORDERS}, x AS (SELECT line_id, regexp_extract(content, '^order (\\d+) status=([A-Z]) total=(\\d+) prio=(.+)$', ['k', 's', 't', 'p']) AS g FROM o)
        SELECT line_id, unnest([2, 4, 6, 8])::INTEGER AS node_id, unnest([g['k'], g['s'], g['t'], g['p']]) AS value FROM x WHERE g['s'] = 'O' AND CAST(g['t'] AS BIGINT) >= 1000000""",
    "reference_group_accuracy": f"""{_W}, {_B}, a AS (SELECT line_id, template_id AS bt FROM m), na AS (SELECT bt, count(*) AS n FROM a GROUP BY bt),
        nb AS (SELECT tt, count(*) AS n FROM b WHERE line_id IN (SELECT line_id FROM a) GROUP BY tt), pair AS (SELECT bt, tt, count(*) AS n FROM a JOIN b USING (line_id) GROUP BY bt, tt),
        best AS (SELECT line_id, max(pair.n / (na.n + nb.n - pair.n)) AS s FROM a JOIN b USING (line_id) JOIN pair USING (bt, tt) JOIN na USING (bt) JOIN nb USING (tt) GROUP BY line_id)
        SELECT round((SELECT sum(s) FROM best) / (SELECT count(DISTINCT line_id) FROM a), 6)::DOUBLE AS score""",
    "macro_scores": f"{_W}, {_PAIR}, s AS (SELECT query, round(count_if(a AND b) / count_if(b), 6) AS p, round(count_if(a AND b) / count_if(a), 6) AS r FROM q GROUP BY query) SELECT round(avg(p), 6)::DOUBLE AS precision, round(avg(r), 6)::DOUBLE AS recall FROM s",
    "line_text_scores": f"""{_W}, {_PAIR}, d AS (SELECT query, substr(content, 1, 24) AS c, bool_or(a) AS a, bool_or(b) AS b FROM q JOIN l USING (line_id) GROUP BY 1, 2 HAVING bool_or(a) OR bool_or(b))
        SELECT query, round(count_if(a AND b) / count_if(a), 6)::DOUBLE AS precision, round(count_if(a AND b) / count_if(b), 6)::DOUBLE AS recall FROM d GROUP BY query""",
    "taxonomy_by_type": f"WITH {_TAX} SELECT name, type FROM x WHERE parent IN ('ASIA', 'EUROPE', 'AMERICA') AND type <> 'port_t'",
    "taxonomy_outline": f"WITH {_TAX} SELECT name, '  - ' || split_part(name, '.', 2) AS line FROM x",
    "taxonomy_edges": f"WITH {_TAX} SELECT parent AS src, name AS dst FROM x",
    "mapping_candidates": f"""WITH {_V}, y AS (SELECT a.id AS f, b.id AS t, round(list_cosine_similarity(a.x, b.x), 6) AS cos, a.id % 40 = b.id % 40 AS exact FROM v a JOIN v b ON a.id < 10 AND b.label < 3),
        z AS (SELECT *, CASE WHEN exact AND count_if(exact) OVER (PARTITION BY f) < 6 THEN 1.0 ELSE cos END AS score FROM y)
        SELECT 'f' || f AS field, 'a' || t AS name, score::DOUBLE AS score, exact FROM z QUALIFY row_number() OVER (PARTITION BY f ORDER BY (exact AND score = 1.0) DESC, score DESC, name) <= 6""",
    "stream_dead_letters": f"{_W} SELECT line_id, content FROM l WHERE line_id NOT IN (SELECT line_id FROM m)",
}
