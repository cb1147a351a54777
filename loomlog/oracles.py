"""SQL for the registered queries, written on its own: nothing here comes from the catalog's compiler."""

_L = """l AS (SELECT event_id AS line_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' host' || (user_id % 4) || ' app[' || user_id || ']: ' || event_type
  || ' value=' || CAST(round(value * 100) AS BIGINT) || ' ' || props AS content FROM events)"""


def _r(event: str) -> str:
    return rf"^(\d{{4}}-\d{{2}}-\d{{2}})\s+(\d{{2}}:\d{{2}}:\d{{2}})\s+host(\d+)\s+app\[(\d+)\]:\s+{event}\s+value=(\d+)\s+(\{{.*\}})$"


_ANY = _r(r"(\w+)")
_P = rf"""p AS (SELECT line_id, content, x['d'] AS d, x['t'] AS t, x['h'] AS h, x['u'] AS u, x['e'] AS e, x['v'] AS v, x['p'] AS p
  FROM (SELECT line_id, content, regexp_extract(content, '{_ANY}', ['d', 't', 'h', 'u', 'e', 'v', 'p']) AS x FROM l))"""
_M = "m AS (" + " UNION ALL ".join(f"SELECT line_id, content, {t}::INTEGER AS template_id FROM l WHERE regexp_matches(content, '{_r(e)}')" for t, e in enumerate(("error", "click", "purchase", "(?:error|purchase|signup)"))) + ")"
_F = (
    "f AS ("
    + " UNION ALL ".join(f"SELECT line_id, {n}::INTEGER AS node_id, {c} AS value, e <> 'view' AS \"full\" FROM p" for n, c in ((1, "d"), (2, "t"), (4, "h"), (6, "u")))
    + "".join(
        f" UNION ALL SELECT line_id, {n}::INTEGER, {c}, true FROM p WHERE {w}"
        for at, w in ((8, "e = 'error'"), (12, "e = 'click'"), (16, "e = 'purchase'"), (20, "e IN ('error', 'purchase', 'signup')"))
        for n, c in ((at, "e"), (at + 2, "v"), (at + 3, "p"))
    )
    + ")"
)
_W = f"WITH {_L}, {_P}, {_M}, {_F} "
_FULL = "e <> 'view'"
_TEXT = {0: "<*> <*> host<*> app[<*>]: error value=<*> <*>", 1: "<*> <*> host<*> app[<*>]: click value=<*> <*>", 2: "<*> <*> host<*> app[<*>]: purchase value=<*> <*>", 3: "<*> <*> host<*> app[<*>]: <*> value=<*> <*>"}
_NAMED = {t: "<date> <time> host<host> app[<user_id>]: " + e + " value=<value> <props>" for t, e in enumerate(("error", "click", "purchase", "<event_type>"))}
_TYPED = {t: "[datetime_t] [string_t] host[string_t] app[[integer_t]]: " + e + " value=[integer_t] [composite_t]" for t, e in enumerate(("error", "click", "purchase", "[string_t]"))}
_EPOCH = "CAST(CAST(epoch(CAST(d AS TIMESTAMP)) AS BIGINT) AS VARCHAR)"
_NUM = "CAST(CAST({} AS DOUBLE) AS VARCHAR)"
_IDS = "CASE e WHEN 'error' THEN '0,3' WHEN 'click' THEN '1' WHEN 'purchase' THEN '2,3' WHEN 'signup' THEN '3' ELSE '' END"


def _where(condition: str) -> str:
    return f"{_W} SELECT line_id, content FROM p WHERE {condition}"


#: The second parser of the metrics: 0 error, 1 view, 2 click or purchase.
_B = "b AS (SELECT line_id, 0 AS tt FROM p WHERE e = 'error' UNION ALL SELECT line_id, 1 FROM p WHERE e = 'view' UNION ALL SELECT line_id, 2 FROM p WHERE e IN ('click', 'purchase'))"
_GROUPS = f"""{_W}, {_B},
a AS (SELECT line_id, template_id AS bt FROM m), na AS (SELECT bt, count(*) AS n FROM a GROUP BY bt), nb AS (SELECT tt, count(*) AS n FROM b GROUP BY tt),
pair AS (SELECT bt, tt, count(*) AS n FROM a JOIN b USING (line_id) GROUP BY bt, tt),
score AS (SELECT bt, tt, CASE WHEN pair.n = na.n AND pair.n = nb.n THEN 1.0 ELSE 0 END AS same, CASE WHEN pair.n < nb.n THEN 0 ELSE pair.n / (na.n + nb.n - pair.n) END AS soft FROM pair JOIN na USING (bt) JOIN nb USING (tt)),
best AS (SELECT line_id, max(same) AS same, max(soft) AS soft FROM a JOIN b USING (line_id) JOIN score USING (bt, tt) GROUP BY line_id)"""
_VALUES_A = ", ".join(f"({t}, '{x}')" for t, x in _TEXT.items())
_VALUES_B = f"(0, '{_TEXT[0]}'), (1, '<*> <*> host<*> app[<*>]: view value=<*> <*>'), (2, '{_TEXT[3]}')"
_TEXTS = f"""{_W}, {_B}, ta(bt, x) AS (VALUES {_VALUES_A}), tb(tt, y) AS (VALUES {_VALUES_B}),
best AS (SELECT line_id, max(CASE WHEN x = y THEN 1.0 ELSE 0 END) AS same, max(1 - levenshtein(x, y) / greatest(length(x), length(y))) AS soft
  FROM (SELECT line_id, template_id AS bt FROM m) JOIN b USING (line_id) JOIN ta USING (bt) JOIN tb USING (tt) GROUP BY line_id)"""


def _share(column: str) -> str:
    return f"SELECT round((SELECT sum({column}) FROM best) / (SELECT count(*) FROM l), 6)::DOUBLE AS score"


_TOKENS = r"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[.\-/_:\\\s]+'), lambda x: x <> ''))"
_URLS = f"""u AS (SELECT page_id AS id, list_sort({_TOKENS.format("url")}) AS s FROM pages), k AS (SELECT s, min(id) AS least, count(*) AS n FROM u WHERE len(s) > 0 GROUP BY s),
e AS (SELECT a.least AS a, b.least AS b FROM k a JOIN k b ON a.least <> b.least AND len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) >= 0.7 - 1e-12),
r AS (SELECT least AS id, least AS root FROM k UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
c AS (SELECT id AS least, min(root) AS root FROM r GROUP BY id),
cl AS (SELECT u.id, CASE WHEN k.n > 1 OR EXISTS (SELECT 1 FROM e WHERE e.a = k.least) THEN c.root END AS cluster FROM u LEFT JOIN k USING (s) LEFT JOIN c USING (least))"""
_V = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label::BIGINT AS label FROM embeddings)"
_C = "c AS (SELECT label, list(m ORDER BY i) AS y FROM (SELECT label, i, avg(x[i]) AS m FROM (SELECT label, x, unnest(range(1, len(x) + 1)) AS i FROM v) GROUP BY label, i) GROUP BY label)"
_ORDERS = "o AS (SELECT o_orderkey AS line_id, 'order ' || o_orderkey || ' status=' || o_orderstatus || ' total=' || CAST(round(o_totalprice * 100) AS BIGINT) || ' prio=' || o_orderpriority AS content FROM orders)"
_ORDER_R = r"^order\s+(\d+)\s+status=([A-Z])\s+total=(\d+)\s+prio=(\d-.+)$"
_PATHS = [(n, n, "/".join(map(str, range(1, n + 1)))) for n in range(1, 8)] + [(at + k, 8 + k, "/".join(map(str, [*range(1, 8), *range(at, at + k + 1)]))) for at in (8, 12, 16, 20) for k in range(4)]

ORACLES: dict[str, str] = {
    "flagship": _where("e = 'error' AND CAST(v AS BIGINT) > 10000"),
    "normalize_lines": r"SELECT line_id, md5(t) AS digest, length(t)::BIGINT AS n FROM (SELECT doc_id AS line_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents) WHERE t <> ''",
    "full_match_templates": f"{_W} SELECT line_id, template_id, 11::INTEGER AS trail_len FROM m",
    "multi_match_lines": f"{_W} SELECT line_id, string_agg(template_id, ',' ORDER BY template_id) AS templates FROM m GROUP BY line_id HAVING count(*) > 1",
    "unmatched_lines": f"{_W} SELECT line_id FROM l WHERE line_id NOT IN (SELECT line_id FROM m) UNION ALL SELECT -1 - conv_id * 1000 - turn FROM conversations WHERE regexp_matches(coalesce(text, ''), '\\S')",
    "unused_templates": f"{_W} SELECT t::INTEGER AS template_id FROM (VALUES (0, 'error'), (1, 'click'), (2, 'purchase'), (3, 'refund'), (4, '')) AS x(t, k) WHERE t < 4 AND k NOT IN (SELECT e FROM p)",
    "extract_fields_long": f"{_W} SELECT * FROM f",
    "extract_fields_wide": f"WITH {_ORDERS} SELECT line_id, regexp_extract(content, '{_ORDER_R}', 1) AS order_id, regexp_extract(content, '{_ORDER_R}', 2) AS status, regexp_extract(content, '{_ORDER_R}', 3) AS total, regexp_extract(content, '{_ORDER_R}', 4) AS priority FROM o WHERE regexp_matches(content, '{_ORDER_R}')",
    "partial_matches": f"{_W} SELECT line_id, 7::INTEGER AS node_id, regexp_extract(content, '\\]:\\s+(.*)$', 1) AS suffix FROM p WHERE e = 'view'",
    "wildcard_render": "SELECT t::INTEGER AS template_id, star, named, typed FROM (VALUES " + ", ".join(f"({t}, '{_TEXT[t]}', '{_NAMED[t]}', '{_TYPED[t]}')" for t in range(4)) + ") AS x(t, star, named, typed)",
    "q_exact": _where("e = 'click'"),
    "q_exact_ci": _where("e = 'error'"),
    "q_contains": _where(f"{_FULL} AND e LIKE '%c%'"),
    "q_contains_ci": _where(f"{_FULL} AND lower(p) LIKE '%k%'"),
    "q_multi_value": _where("u IN ('3', '5', '8')"),
    "q_negation": _where(f"{_FULL} AND e <> 'error'"),
    "q_numeric_gt": _where(f"{_FULL} AND CAST(v AS DOUBLE) > 17807"),
    "q_numeric_ge": _where(f"{_FULL} AND CAST(v AS DOUBLE) >= 17807"),
    "q_numeric_lt": _where(f"{_FULL} AND CAST(v AS DOUBLE) < 150"),
    "q_numeric_le": _where(f"{_FULL} AND CAST(v AS DOUBLE) <= 150"),
    "q_numeric_eq": _where(f"{_FULL} AND CAST(v AS DOUBLE) = 655"),
    "q_datetime_range": _where("CAST(d AS DATE) >= DATE '2024-01-05' AND CAST(d AS DATE) < DATE '2024-01-09'"),
    "q_exists": _where("true"),
    "q_not_exists": _where("e = 'view'"),
    "q_static_match": _where("e = 'click'"),
    "q_standardized": _where("u = '7'"),
    "q_and": _where("e = 'error' AND h = '2'"),
    "q_or": _where("e = 'click' OR h = '2'"),
    "q_nested": _where(f"h = '1' AND (e = 'purchase' OR ({_FULL} AND CAST(v AS DOUBLE) < 1000))"),
    "q_batch_from_json": f"{_W} SELECT 'errors' AS query, line_id FROM p WHERE e = 'error' AND CAST(v AS BIGINT) > 10000 UNION ALL SELECT 'users', line_id FROM p WHERE u IN ('1', '2') OR h = '3'",
    "value_counts": f"{_W} SELECT node_id, value, count(*) AS n FROM f GROUP BY node_id, value",
    "top_values": f"{_W} SELECT node_id, row_number() OVER (PARTITION BY node_id ORDER BY n DESC, first, value)::INTEGER AS rank, value, n FROM (SELECT node_id, value, count(*) AS n, min(line_id) AS first FROM f GROUP BY node_id, value) QUALIFY rank <= 10",
    "template_counts": f"{_W} SELECT template_id, count(*) AS n FROM m GROUP BY template_id",
    "node_counts": f"""{_W} SELECT n::INTEGER AS node_id, count(*) AS n FROM (
        SELECT unnest(range(1, 8)) AS n FROM p UNION ALL SELECT unnest(range(8, 12)) FROM p WHERE e = 'error' UNION ALL SELECT unnest(range(12, 16)) FROM p WHERE e = 'click'
        UNION ALL SELECT unnest(range(16, 20)) FROM p WHERE e = 'purchase' UNION ALL SELECT unnest(range(20, 24)) FROM p WHERE e IN ('error', 'purchase', 'signup')) GROUP BY ALL""".replace("SELECT n::INTEGER AS node_id, count(*) AS n FROM (", "SELECT k::INTEGER AS node_id, count(*) AS n FROM (").replace("AS n FROM p UNION", "AS k FROM p UNION"),
    "match_stats": f"{_W} SELECT count(*) AS total, count_if({_FULL})::BIGINT AS matched, count_if(NOT ({_FULL}))::BIGINT AS unmatched, round(100.0 * count_if({_FULL}) / count(*), 6)::DOUBLE AS percentage FROM p",
    "tree_stats": "SELECT name, n::BIGINT AS n FROM (VALUES ('nodes', 23), ('variables', 13), ('templates', 4), ('fields', 7), ('mappings', 6)) AS x(name, n)",
    "examples_per_template": f"{_W} SELECT template_id, row_number() OVER (PARTITION BY template_id ORDER BY line_id)::INTEGER AS rank, line_id, content FROM m QUALIFY rank <= 5",
    "last_n_per_template": f"{_W} SELECT template_id, row_number() OVER (PARTITION BY template_id ORDER BY line_id DESC)::INTEGER AS rank, line_id, content FROM m QUALIFY rank <= 7",
    "export_attributes": f"""{_W} SELECT line_id, {_IDS} AS templates, CASE WHEN {_FULL} THEN 'date=' || {_EPOCH} || ';event_type=' || e || ';host=' || h || ';props=' || p || ';time=' || t
        || ';user_id=' || {_NUM.format("u")} || ';value=' || {_NUM.format("v")} ELSE '' END AS attributes FROM p""",
    "export_taxonomy": f"""{_W} SELECT line_id, CASE WHEN {_FULL} THEN 'activity_name=' || e || ';actor.user.uid=' || {_NUM.format("u")} || ';count=' || {_NUM.format("v")} || ';device.hostname=' || h
        || ';unmapped=' || p || ';user.uid=' || {_NUM.format("u")} ELSE '' END AS attributes, CASE WHEN e = 'view' THEN '' WHEN e = 'click' THEN 'app_activity' ELSE 'app_activity,auth' END AS events FROM p""",
    "export_json": f"""{_W} SELECT line_id, '{{"templates":[' || {_IDS} || '],"content":"' || replace(content, '"', '\\"') || '","attributes":{{' || CASE WHEN {_FULL} THEN '"date":"' || {_EPOCH} || '","event_type":"' || e
        || '","host":"' || h || '","props":"' || replace(p, '"', '\\"') || '","time":"' || t || '","user_id":"' || {_NUM.format("u")} || '","value":"' || {_NUM.format("v")} || '"' ELSE '' END || '}}}}' AS json FROM p""",
    "loghub_rows": f"{_W} SELECT line_id, {_IDS} AS ids, CASE e WHEN 'error' THEN '{_TEXT[0]}|{_TEXT[3]}' WHEN 'click' THEN '{_TEXT[1]}' WHEN 'purchase' THEN '{_TEXT[2]}|{_TEXT[3]}' WHEN 'signup' THEN '{_TEXT[3]}' ELSE '' END AS texts FROM p",
    "overlap_pairs": f"{_W} SELECT a.template_id AS t1, b.template_id AS t2, count(*) AS n FROM m a JOIN m b ON a.line_id = b.line_id AND a.template_id < b.template_id GROUP BY t1, t2",
    "overlap_components": f"""{_W.replace("WITH", "WITH RECURSIVE", 1)}, e AS (SELECT DISTINCT a.template_id AS a, b.template_id AS b FROM m a JOIN m b ON a.line_id = b.line_id AND a.template_id <> b.template_id),
        r AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id) SELECT id AS template_id, min(root) AS component FROM r GROUP BY id""",
    "partition_shares": f"{_W} SELECT {_IDS} AS templates, count(*) AS n, round(count(*) / (SELECT count(*) FROM l), 6)::DOUBLE AS share FROM p GROUP BY 1",
    "group_accuracy": f"{_GROUPS} {_share('same')}",
    "group_similarity": f"{_GROUPS} {_share('soft')}",
    "parser_accuracy": f"{_TEXTS} {_share('same')}",
    "template_similarity": f"{_TEXTS} {_share('soft')}",
    "schema_group_similarity": f"""{_W}, k AS (SELECT count(*) AS n, count_if({_FULL}) AS f, count_if(e = 'error') AS err, count_if(e = 'click') AS c, count_if(e = 'purchase') AS b, count_if(e IN ('error', 'purchase', 'signup')) AS s FROM p)
        SELECT round((4 * n + err * (err / f) + err + 2 * c + 2 * b + 3 * s) / (4 * n + 2 * err + 2 * c + 2 * b + 3 * s), 6)::DOUBLE AS score FROM k""",
    "mapping_score": f"{_W} SELECT round((3.5 * count(*) + 3 * count_if({_FULL})) / (4 * count(*) + 3 * count_if({_FULL})), 6)::DOUBLE AS score FROM p",
    "query_precision_recall": f"""{_W} SELECT 'errors' AS query, round(count_if(e = 'error') / count_if({_FULL} AND e LIKE '%r%'), 6)::DOUBLE AS precision, 1.0::DOUBLE AS recall FROM p
        UNION ALL SELECT 'dear', 1.0, round(count_if({_FULL} AND CAST(v AS BIGINT) >= 30000) / count_if({_FULL} AND CAST(v AS BIGINT) >= 20000), 6) FROM p UNION ALL SELECT 'users', 0.0, 0.0""",
    "jaccard_topk": f"""WITH q AS (SELECT item_id AS id, {_TOKENS.format("text")} AS s FROM benchmark), d AS (SELECT doc_id AS id, {_TOKENS.format("text")} AS s FROM documents),
        x AS (SELECT q.id AS query_id, d.id AS target_id, CASE WHEN len(q.s) = 0 OR len(d.s) = 0 THEN 0 ELSE len(list_intersect(q.s, d.s)) / (len(q.s) + len(d.s) - len(list_intersect(q.s, d.s))) END AS score FROM q, d)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, target_id)::INTEGER AS rank, target_id, round(score, 6)::DOUBLE AS score FROM x QUALIFY rank <= 3""",
    "jaccard_clusters": f"WITH RECURSIVE {_URLS} SELECT id, cluster FROM cl",
    "cluster_medoid": f"""WITH RECURSIVE {_URLS}, w AS (SELECT cl.cluster, u.id, u.s FROM u JOIN cl USING (id) WHERE cluster IS NOT NULL),
        d AS (SELECT a.cluster, a.id, round(sum(1 - len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))), 9) AS t FROM w a JOIN w b USING (cluster) GROUP BY a.cluster, a.id)
        SELECT cluster, id FROM d QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY t, id) = 1""",
    "cosine_topk": f"""WITH {_V}, x AS (SELECT a.id AS query_id, b.id AS target_id, list_cosine_similarity(a.x, b.x) AS score FROM v a, v b WHERE a.id % 100 = 0 AND a.id <> b.id)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, target_id)::INTEGER AS rank, target_id, round(score, 6) AS score FROM x QUALIFY rank <= 5""",
    "centroid_rank": f"WITH {_V}, {_C} SELECT id, c.label, round(list_cosine_similarity(x, y), 6) AS score FROM v, c QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(list_cosine_similarity(x, y), 9) DESC, c.label) = 1",
    "cosine_clusters": f"""WITH RECURSIVE {_V}, {_C}, e AS (SELECT a.label AS a, b.label AS b FROM c a, c b WHERE a.label <> b.label AND list_cosine_similarity(a.y, b.y) > 0.2),
        r AS (SELECT label AS id, label AS root FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id) SELECT id AS label, min(root) AS merged FROM r GROUP BY id""",
    "nearest_description": f"WITH {_V}, {_C} SELECT label, id FROM v JOIN c USING (label) QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(list_cosine_similarity(x, y), 9) DESC, id) = 1",
    "density_clusters": f"""WITH RECURSIVE {_V}, e AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id AND list_distance(a.x, b.x) <= 1.05),
        r AS (SELECT DISTINCT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id) SELECT v.id, c.root AS cluster FROM v LEFT JOIN (SELECT id, min(root) AS root FROM r GROUP BY id) c USING (id)""",
    "line_prefixes": f"{_W} SELECT line_id, 7::INTEGER AS node_id, regexp_extract(content, '^(.*\\]:\\s+)', 1) AS prefix, regexp_extract(content, '\\]:\\s+(.*)$', 1) AS suffix FROM p WHERE e = 'view'",
    "filled_matches": f"{_W} SELECT line_id, template_id FROM m",
    "structured_matches": f"""WITH {_ORDERS}, x AS (SELECT line_id, content, regexp_extract(content, '{_ORDER_R}', ['k', 's', 't', 'p']) AS g FROM o)
        SELECT line_id AS LineId, CASE WHEN g['s'] = 'O' THEN 'any,open' ELSE 'any' END AS ids, g['k'] || '|' || g['s'] || '|' || g['t'] || '|' || g['p'] || CASE WHEN g['s'] = 'O' THEN '|' || g['k'] || '|' || g['t'] || '|prio=' || g['p'] ELSE '' END AS groups FROM x""",
    "log_fields_udtf": f"""{_W}, y AS (SELECT m.line_id, template_id, [8, 12, 16, 20][template_id + 1] AS base, d, p.t AS c, h, u, e, v, p.p AS j FROM m JOIN p ON m.line_id = p.line_id),
        z AS (SELECT line_id, template_id, unnest([1, 2, 4, 6, base, base + 2, base + 3]) AS n, unnest([d, c, h, u, e, v, j]) AS value FROM y)
        SELECT line_id, template_id, n::INTEGER AS node_id, value FROM z""",
    "token_weights": f"""{_W}, s AS (SELECT node_id, count(*) AS k FROM f GROUP BY node_id),
        t AS (SELECT node_id, unnest(list_distinct(list_filter(list_concat([value], regexp_split_to_array(value, '[^0-9A-Za-z]+')), lambda x: x <> ''))) AS token FROM f)
        SELECT node_id, token, count(*) AS n, round(count(*) / any_value(k), 6)::DOUBLE AS weight FROM t JOIN s USING (node_id) GROUP BY node_id, token""",
    "value_overlap": f"""{_W}, c AS (SELECT node_id, value, count(*) AS n FROM f GROUP BY node_id, value), s AS (SELECT node_id, sum(n) AS k FROM c GROUP BY node_id)
        SELECT a.node_id AS n1, b.node_id AS n2, round(sum(a.n + b.n) / any_value(sa.k + sb.k), 6)::DOUBLE AS weight FROM c a JOIN c b ON a.value = b.value AND a.node_id < b.node_id
        JOIN s sa ON sa.node_id = a.node_id JOIN s sb ON sb.node_id = b.node_id GROUP BY n1, n2""",
    "parse_float_lenient": "SELECT event_id, CAST(regexp_extract(props, ': (\\d+)\\}', 1) AS DOUBLE) AS k, CAST(user_id AS DOUBLE) AS ms FROM events",
    "parse_datetime": "SELECT o_orderkey, form::INTEGER AS form, CASE WHEN form = 0 THEN epoch(o_orderdate)::BIGINT ELSE epoch(date_trunc('day', o_orderdate))::BIGINT END AS epoch FROM orders, (VALUES (0), (1), (2), (3)) AS x(form)",
    "type_validate": r"""SELECT page_id, CASE WHEN n BETWEEN 100 AND 600 THEN CAST(n AS VARCHAR) END AS value, CASE WHEN n IS NULL THEN 'not a integer' WHEN n NOT BETWEEN 100 AND 600 THEN 'range' END AS error
        FROM (SELECT page_id, TRY_CAST(CASE WHEN regexp_matches(s, '^[+-]?\d+$') THEN s END AS BIGINT) AS n FROM (SELECT page_id, regexp_extract(url, '/([^/?#]*)(?:[?#].*)?$', 1) AS s FROM pages))""",
    "lineage": "SELECT n::INTEGER AS node_id, depth::INTEGER AS depth, path FROM (VALUES " + ", ".join(f"({n}, {d}, '{p}')" for n, d, p in _PATHS) + ") AS x(n, depth, path)",
    "degree_of_separation": "SELECT a::INTEGER AS t1, b::INTEGER AS t2, 7::INTEGER AS degree FROM range(4) AS x(a), range(4) AS y(b) WHERE a < b",
    "taxonomy_siblings": "WITH t AS (SELECT r_name || '.' || n_name AS name, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT a.name, b.name AS sibling FROM t a JOIN t b USING (parent) WHERE a.name <> b.name",
    "type_votes": "SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY o_custkey, o_orderpriority QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) = 1",
    "html_fields": """SELECT 'Part ' || p_partkey AS type, field, field_type, label, CASE field WHEN 'key' THEN 'the key & ' || p_partkey ELSE p_size::VARCHAR END AS description
        FROM part, (VALUES ('key', 'int32', 'optional'), ('size', 'uint64', '')) AS x(field, field_type, label)""",
    "stream_match_available_now": f"{_W} SELECT line_id, template_id, 11::INTEGER AS trail_len FROM m",
}
