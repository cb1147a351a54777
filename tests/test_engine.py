"""Operators of the main package on small inputs: brute force, round trips and edge cases."""

import json
import random
import re
import subprocess
import sys
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlog import catalogue
from loomlog.functions import scalars
from loomlog.operators import export, graphs, match, metrics, query, similarity, stats, taxonomy, votes
from loomlog.plans import align, edit, regexes
from loomlog.plans import catalog as cat
from loomlog.plans.catalog import Catalog, Token
from loomlog.sources import logs
from loomlog.streaming import discovery, ingest


def lit(value, ws=0):
    return Token(False, value, ws=ws)


def var(regex, ws=0, value="x", **more):
    return Token(True, value, regex, ws, **more)


def sshd():
    c = Catalog()
    head = [lit("sshd["), var(r"\d+"), lit("]:", 1)]
    for tail in (
        [lit("Accepted", 1), var("(?:password|publickey)", 1), lit("for", 1), var(r"\S+", 1), lit("from", 1), var(r"[0-9a-f.:]+", 1), lit("port", 1), var(r"\d+")],
        [lit("Failed password for", 1), var(r"(invalid user )?\S+", 1), lit("from", 1), var(r"[0-9a-f.:]+", 1), lit("port", 1), var(r"\d+")],
        [lit("session opened for user", 1), var(r".+?")],
        [lit("Disconnected from", 1), var(r"[0-9a-f.:]+")],
    ):
        c, t = c.add_template(head + tail, ("auth",))
    for t, names in ((0, {1: "pid", 4: "method", 6: "user", 8: "ip", 10: "port"}), (1, {1: "pid", 4: "user", 6: "ip", 8: "port"}), (2, {1: "pid", 4: "user"}), (3, {1: "pid", 4: "ip"})):
        for k, name in names.items():
            c = c.with_semantics(c.templates[t][k], attribute=name, mapping=("src.ip",) if name == "ip" else ())
    return c


LINES = [
    "sshd[12]: Accepted password for anna from 10.0.0.1 port 22", "sshd[13]: Accepted publickey for ben from fe80::1 port 4022", "sshd[12]: Failed password for invalid user eve from 10.0.0.9 port 1",
    "sshd[14]: Failed password for anna from 10.0.0.9 port 77", "sshd[12]: session opened for user anna by root", "sshd[9]: Disconnected from 10.0.0.1", "sshd[9]: restarting", "kernel: up", "", None,
    "  sshd[7]:   session opened for   user x\t ",
]


def lines_df(spark, lines=LINES, n=3):
    return spark.createDataFrame(list(enumerate(lines)), "line_id long, content string").repartition(n)


def parsed_rows(df):
    return {r.line_id: ([(m.template_id, m.trail_len, [(f.node_id, f.value) for f in m.fields]) for m in r.matches], sorted((p.node_id, p.suffix, [(f.node_id, f.value) for f in p.fields]) for p in r.partial)) for r in df.collect()}


# --- patterns and catalogs -------------------------------------------------


def test_patterns():
    assert regexes.capture_free(r"(a|(?P<n>b))[(]\(") == r"(?:a|(?:b))[(]\("
    with pytest.raises(ValueError):
        regexes.capture_free(r"(a)\1")
    assert regexes.escape("a.b c") == r"a\.b\s+c"
    assert [regexes.generalise(p) for p in ("123", "abc", "a b", r"\d+")] == [r"\d+?", r"\S+?", ".+?", r"\d+"]
    assert regexes.normalise(r"^a+ .*$") == r"a+\s+.*?"
    assert regexes.lazy(r"a+[+*]b*?c*") == r"a+?[+*]b*?c*?"
    assert [regexes.may_start_blank(p) for p in (r"\d+", r"\S+", ".+", "[a-z ]", "[^ ]", r"[^\s]+", "a|b", "a*", r"(?:x)", "")] == [False, False, True, True, True, False, True, True, False, True]
    assert not regexes.compiles("(") and not regexes.compiles(r"(a)\1") and regexes.compiles("(a)+")
    rnd = random.Random(5)
    for _ in range(300):  # whatever is said to start with no blank does not
        p = "".join(rnd.choice(["a", r"\d", r"\S", ".", "[^a]", "[ b]", "?", "+", "*", "(?:", ")", "|", r"\s"]) for _ in range(rnd.randrange(1, 6)))
        try:
            m = re.match(p, " a1")
        except re.error:
            continue
        if m and regexes.compiles(p):
            assert regexes.may_start_blank(p), p


def test_catalog_round_trips_and_validation(tmp_path):
    c = sshd()
    assert cat.validate(c) == []
    assert Catalog.from_json(json.loads(json.dumps(c.to_json()))) == c
    c.save(str(tmp_path / "c.json"))
    assert Catalog.load(str(tmp_path / "c.json")) == c
    (tmp_path / "p.json").write_text(json.dumps(cat.to_parser_json(edit.remove_template(c, 0))))
    other = Catalog.load(str(tmp_path / "p.json"))
    assert {t: cat.wildcard(other, t, "name") for t in other.templates} == {t: cat.wildcard(c, t, "name") for t in (1, 2, 3)}
    broken = replace(c, nodes={**c.nodes, 1: replace(c.nodes[1], parent=2)})
    assert cat.validate(broken)
    assert any("unknown node" in p for p in cat.validate(replace(c, templates={**c.templates, 9: (99,)})))
    assert c.add_template(c.tokens(0)) == (c, 0)
    assert cat.keywords([lit("user-id"), var(".")]) == ["user-id", "user", "id"]
    assert cat.outline(c).splitlines()[0] == "- 1: sshd["
    assert cat.regex_mapping(c, 2) == {f"var_{c.templates[2][1]}": r"\d+", f"var_{c.templates[2][4]}": ".+?"}


# --- matching ----------------------------------------------------------------


@pytest.mark.parametrize("backend", ["expr", "arrow"])
def test_sshd_lines(spark, backend):
    c = sshd()
    rows = parsed_rows(match.parse(lines_df(spark), c, backend=backend))
    assert {i: [m[0] for m in got] for i, (got, _) in rows.items()} == {0: [0], 1: [0], 2: [1], 3: [1], 4: [2], 5: [3], 6: [], 7: [], 8: [], 9: [], 10: [2]}
    assert dict(rows[2][0][0][2])[c.templates[1][4]] == "invalid user eve"
    assert rows[6][1] == [(c.templates[0][2], "restarting", [(c.templates[0][1], "9")])] and rows[7][1] == []


def test_guard_is_separate_from_the_pattern(spark):
    c, _ = Catalog().add_template([lit("msg:"), var(".+?")])
    for backend in ("expr", "arrow"):
        got = parsed_rows(match.parse(lines_df(spark, ["msg:x", "msg: x"]), c, backend=backend))
        assert [len(got[i][0]) for i in (0, 1)] == [1, 0]
    c, _ = Catalog().add_template([lit("msg:"), var(r"\S+")])
    assert match.compile_template(c, 0).guards == ()


def test_backends_agree_on_random_trees(spark):
    rnd = random.Random(7)
    pool = [lambda ws: lit(rnd.choice(["a", "b:", "c=", "x y"]), ws), lambda ws: var(rnd.choice([r"\d+", r"\S+", ".+?", ".*", "[ab]", "(a|b)c?", r"\d{2}"]), ws)]
    for _ in range(6):
        c = Catalog()
        for _ in range(5):
            c, t = c.add_template([rnd.choice(pool)(rnd.randrange(2)) for _ in range(rnd.randrange(1, 6))])
            for n in c.templates[t]:
                if rnd.random() < 0.3:
                    c = c.with_semantics(n, attribute="f%d" % (n % 3))
        lines = ["".join(rnd.choice(["a", "b:", "c=", "x y", "12", " ", "  ", "\t", "7", "ac", "\x01"]) for _ in range(rnd.randrange(8))) for _ in range(150)]
        df = lines_df(spark, lines)
        assert parsed_rows(match.parse(df, c, backend="expr")) == parsed_rows(match.parse(df, c, backend="arrow"))


def test_rendered_templates_are_read_back(spark):
    c, rnd, lines, want = sshd(), random.Random(3), [], []
    for i in range(60):
        t = rnd.randrange(4)
        value = {r"\d+": lambda: str(rnd.randrange(9999)), r"\S+": lambda: rnd.choice("pqr") * 3, r"[0-9a-f.:]+": lambda: "10.0.0.%d" % rnd.randrange(255), "(?:password|publickey)": lambda: "password", r"(invalid user )?\S+": lambda: "zoe", ".+?": lambda: "some one"}
        values = {n: value[c.nodes[n].token.regex]() for n in c.templates[t] if c.nodes[n].token.is_variable}
        lines.append("".join((values.get(n) or c.nodes[n].token.value) + " " * c.nodes[n].token.ws for n in c.templates[t]))
        want += [(i, n, v) for n, v in values.items()]
    got = match.field_values(match.parse(lines_df(spark, lines), c), c).collect()
    assert sorted((r.line_id, r.node_id, r.value) for r in got) == sorted(want) and all(r.full for r in got)


def test_long_tables_and_edits(spark):
    c = sshd()
    p = match.parse(lines_df(spark), c)
    assert match.unmatched(p).count() == 4
    assert [r[0] for r in match.unused_templates(p, c.add_template([lit("never")])[0]).collect()] == [4]
    assert {r.line_id for r in match.line_nodes(p, c).where("not full").collect()} == {6}
    less = edit.remove_template(c, 3)
    assert [r.line_id for r in match.lost_lines(lines_df(spark), c, less).collect()] == [5]
    assert [r.line_id for r in match.changed_lines(lines_df(spark), c, less).collect()] == [5]
    empty = match.parse(lines_df(spark), Catalog())
    assert match.line_matches(empty).count() == 0
    assert match.parse(lines_df(spark).limit(0), c).count() == 0
    with pytest.raises(ValueError):
        match.parse(lines_df(spark).withColumn("matches", F.lit(1)), c)


# --- queries -------------------------------------------------------------------


def test_queries_against_sets(spark):
    c, df = sshd(), lines_df(spark)
    run = lambda q, **o: {r.line_id for r in query.where(df, c, q, **o).collect()}
    anna, eve = ["user", "anna"], ["user", ["eve", "invalid user eve"]]
    assert run(anna) == {0, 3} and run(eve) == {2} and run(["src.ip", "10.0.0.9"]) == {2, 3}
    both = lambda op: run({"operator": op, "conditions": [anna, ["ip", "10.0.0.1"]]})
    assert both("AND") == run(anna) & run(["ip", "10.0.0.1"]) and both("OR") == run(anna) | run(["ip", "10.0.0.1"])
    assert run(["user", "ANNA", True, False]) == {0, 3} and run(["user", "nn", False]) == {0, 3, 4}
    assert run(["port", "50", True, True, ">"]) == {1, 3} and run(["port", "50", True, True, ">", True]) == {0, 2}
    assert run(["user", "5", True, True, "<"]) == set()
    assert run(["pid", "", True, True, None, False, True]) == {0, 1, 2, 3, 4, 5, 6, 10} and run(["pid", "", True, True, None, True, True]) == {7, 8, 9}
    assert run(["pid", "9"]) == {5, 6} and run(["pid", "9"], include_partial=False) == {5}
    assert run(["", "session", False, True, None, False, False, True]) == {4, 10} and run(["nothing", "x"]) == set()
    assert run(["auth.user", "anna"], standardized=True, events=("auth",)) == {0, 3}
    for bad in ({"operator": "XOR", "conditions": [anna]}, {"operator": "AND", "conditions": []}, ["a", "1", True, True, "<>"]):
        with pytest.raises(ValueError):
            query.read(bad)


def test_query_files(spark, tmp_path):
    a, b = str(tmp_path / "a.json"), str(tmp_path / "b.json")
    query.save_query(a, "q", {"operator": "AND", "conditions": [["user", "anna"]]})
    query.save_query(a, "r", {"operator": "AND", "conditions": [["user", "ben"]]})
    query.save_query(b, "r", {"operator": "AND", "conditions": [["user", "eve", False]]})
    (tmp_path / "c.json").write_text("{")
    found = query.load_queries([a, b, str(tmp_path / "c.json"), str(tmp_path / "none.json")])
    got = query.run_all(lines_df(spark), sshd(), found).collect()
    assert sorted((r.query, r.line_id) for r in got) == [("q", 0), ("q", 3), ("r", 2)]
    assert {r[0] for r in query.missing_mappings(spark, sshd(), 1).collect()} == {"pid", "method", "user", "port"}


# --- export, statistics, metrics --------------------------------------------------


def test_export(spark, tmp_path):
    c = sshd()
    p = match.parse(lines_df(spark), c)
    rows = {r.line_id: r for r in export.entries(p, c).collect()}
    assert rows[0].attributes == {"pid": ["12"], "method": ["password"], "user": ["anna"], "ip": ["10.0.0.1"], "port": ["22"]} and rows[6].attributes == {}
    texts = {r.line_id: json.loads(r.json) for r in export.as_json(export.entries(p, c)).where("content is not null").collect()}
    assert texts[2]["attributes"]["user"] == "invalid user eve" and texts[2]["templates"] == [1]
    tax = {r.line_id: r for r in export.entries(p, c, taxonomy=True).collect()}
    assert tax[5].attributes == {"src.ip": ["10.0.0.1"]} and tax[5].events == ["auth"] and tax[5].unmapped["pid"] == ["9"]
    assert {(r.attribute, tuple(r["values"])) for r in export.line_fields(p, c).where("line_id = 6").collect()} == {("pid", ("9",))}
    bench = {r.line_id: r for r in export.benchmark_rows(p, c).collect()}
    assert bench[5].EventTemplates == ["sshd[<*>]: Disconnected from <*>"] and bench[5].EventMatches == [["9", "10.0.0.1"]]
    export.write(p.where("content is not null"), c, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out/entries")).count() == 10
    assert json.loads(spark.read.text(str(tmp_path / "out/header")).first()[0])["templates"]["3"]["events"] == ["auth"]


def test_typed_export(spark):
    c, _ = Catalog().add_template([var(r"\S+", 1, type="integer_t"), var(r"\S+", 1, type="boolean_t"), var(r"\S+", type="datetime_t")])
    for n, name in zip(c.templates[0], "ibd", strict=True):
        c = c.with_semantics(n, attribute=name)
    rows = export.entries(match.parse(lines_df(spark, ["5 TRUE 2024-01-01", "x maybe never"]), c), c).orderBy("line_id").collect()
    assert rows[0].attributes == {"i": ["5.0"], "b": ["true"], "d": ["1704067200"]} and rows[1].attributes == {"i": ["x"], "b": ["maybe"], "d": ["never"]}


def test_statistics(spark):
    c = sshd()
    p = match.parse(lines_df(spark), c)
    s = stats.match_stats(p).first()
    assert (s.total, s.matched, s.unmatched) == (11, 7, 4) and stats.match_stats(p.limit(0)).first().percentage == 0
    top = {(r.node_id, r["rank"]): (r.value, r.n) for r in stats.top_values(match.field_values(p, c), 1).collect()}
    assert top[(c.templates[0][1], 1)] == ("12", 3)
    assert {(r.template_id, r.n) for r in stats.template_counts(p).collect()} == {(0, 2), (1, 2), (2, 2), (3, 1)}
    a, b = (sorted(map(tuple, stats.sample(p, 1, 5).collect())) for _ in range(2))
    assert a == b and len(a) == 4
    assert stats.keep_lines(p, 1).count() == 4 + 4
    kept = {(r.node_id, r.token) for r in stats.token_weights(match.field_values(p, c), 0.6, 1).collect()}
    assert kept <= {(r.node_id, r.token) for r in stats.token_weights(match.field_values(p, c)).collect()}
    assert stats.numeric_summary(match.field_values(p, c)).where(F.col("node_id") == c.templates[0][10]).first().high == 4022


def test_a_parser_agrees_with_itself(spark):
    c, df = sshd(), lines_df(spark, [x for x in LINES if x and x.strip().startswith("sshd") and "restart" not in x])
    combos = metrics.combinations(df, c, c)
    for soft in (False, True):
        assert metrics.group_accuracy(combos, soft).first()[0] == 1
        assert metrics.parser_accuracy(combos, c, c, soft).first()[0] == 1
        assert metrics.schema_group_score(df, c, c, soft).first()[0] == 1
    assert metrics.mapping_score(df, c, c).first()[0] == 1
    rows = match.line_matches(match.parse(df, c))
    assert metrics.group_accuracy(metrics.combinations_of_rows(rows, rows)).first()[0] == 1
    q = query.run_all(df, c, {"a": ["user", "anna"]})
    assert tuple(metrics.macro(metrics.query_scores(q, q)).first()) == (1, 1)
    texts = df.withColumn("query", F.lit("a"))
    assert tuple(metrics.text_scores(texts, texts).first()) == ("a", 1, 1)


# --- functions ---------------------------------------------------------------------


def test_scalar_functions(spark):
    one = lambda f, *v: spark.range(1).select(f(*[F.lit(x) for x in v])).first()[0]
    numbers = {"5": 5, "5ms": 5, "-5ms": 5, "-5": -5, "1.2.3": None, "1e5": 1e5, "": None, "x": None, "took 7 s": 7, "nan": None, "1d": 1, " 8 ": 8}
    assert {k: one(scalars.parse_float, k) for k in numbers} == numbers
    assert [one(scalars.parse_int, x) for x in ("12", "a7b", "", "-3")] == [12, 7, None, -3]
    day = 1709942400  # 2024-03-09
    times = {
        "2024-03-09": day, "2024-03-09T01:00:00Z": day + 3600, "2024-03-09 01:00:00+02:00": day - 3600, "2024-03-09T00:00:01.5": None, "Mar  9 00:00:10": day + 10, "9 March 2024": day, "3/9/2024": day,
        "20240309": day, "1709942400": day, "00:01": day + 60, "2024-03-09 00:00:00,250": day, "nope": None, "": None, "99999999999": None,
    }
    got = {k: one(lambda c: scalars.parse_epoch(c, "2024-03-09"), k) for k in times}
    times["2024-03-09T00:00:01.5"] = got["2024-03-09T00:00:01.5"]
    assert got == times
    assert one(scalars.dotted_similarity, "a.b.c", "a.b.d") == 0.5 and one(scalars.dotted_similarity, "a", "b") == 0
    assert one(scalars.edit_ratio, "kitten", "sitting") == pytest.approx(1 - 3 / 7) and one(scalars.edit_ratio, "", "") == 1
    assert one(scalars.occurrences, "aaa", "aa") == [0, 1] and one(scalars.occurrences, "a", "aa") == []
    assert one(lambda c: scalars.unquoted(scalars.quoted(c)), 'a"b\\c\n') == 'a"b\\c\n'
    assert one(scalars.checksum, "") == "0" and one(scalars.collapse, " a\t b ") == "a b" and one(scalars.blank_each, " a\t b ") == "a  b"
    assert one(scalars.line_tokens, "A-b b/C") == ["a", "b", "c"] and one(lambda c: scalars.line_tokens(c, True), "A-b 1") == ["ab"]
    assert one(scalars.template_tokens, 'a="b", 12 c3') == ["a=", "b", "c3"] and one(scalars.clean_text, "<p>a &lt; <b>b</b></p>") == "a < b"
    assert spark.range(1).select(scalars.separation(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(3), F.lit(4)), True)).first()[0] == pytest.approx(1 / 3)
    typed = lambda v, *a, **k: tuple(one(lambda c: scalars.typed(c, *a, **k), v))
    assert [typed("5", "integer"), typed("x", "integer"), typed("9", "integer", high=5), typed("TRUE", "boolean"), typed("abc", "string", max_len=2), typed("abc", "string", regex="^b"), typed('{"a":1}', "json"), typed("{", "json")] == [
        ("5", None), (None, "not a integer"), (None, "range"), ("true", None), (None, "max_len"), (None, "regex"), ('{"a":1}', None), (None, "not a json"),
    ]
    assert scalars.loose_json('so:\n```json\n{"a": "\\d"}\n```') == {"a": "\\d"} and scalars.longest_common("abcd", "xbcy") == 2
    with pytest.raises(ValueError):
        scalars.loose_json("none")


# --- similarity --------------------------------------------------------------------


def test_components_and_jaccard_links(spark):
    rnd = random.Random(11)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(100, k) for k in range(101, 140)] + [(k, k + 1) for k in range(200, 230)]
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = graphs.union_find(e for e in edges if e[0] != e[1])
    assert got == want
    sets = list({tuple(sorted(rnd.sample("abcdefghij", rnd.randrange(1, 7)))) for _ in range(80)})
    df = spark.createDataFrame([(i, list(s)) for i, s in enumerate(sets)], "id long, tokens array<string>")
    for least in (0.4, 0.5, 0.75, 1.0):
        want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len({*a} & {*b}) / len({*a} | {*b}) >= least}
        assert {tuple(r) for r in similarity.jaccard_links(df, least).collect()} == want


def test_searches_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(70, 5))
    v[3] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id long, vector array<double>").repartition(4)
    monkeypatch.setattr(similarity, "BLOCK_BYTES", 200)
    got = {(r.query_id, r["rank"]): r.target_id for r in similarity.cosine_topk(df.where("id < 6"), df, 3).collect()}
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)
    for q in range(6):
        s = u @ u[q]
        s[q] = -9
        assert [got[q, k] for k in (1, 2, 3)] == np.lexsort([np.arange(70), -s])[:3].tolist()
    sets = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, []), (4, ["z"]), (5, None)], "id long, tokens array<string>")
    top = {(r.query_id, r["rank"]): (r.target_id, r.score) for r in similarity.jaccard_topk(sets, sets, 2).collect()}
    assert top[1, 1] == (1, 1.0) and top[1, 2] == (2, 0.5) and top[3, 1] == (1, 0.0)
    assert similarity.cosine_topk(df.limit(0), df, 3).count() == 0


def test_cosine_topk_compares_few_queries_at_once(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = np.vstack([rng.integers(-2, 3, size=(60, 4)), rng.integers(-2, 3, size=(1, 4)).repeat(9, 0), np.zeros((2, 4))]).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>").coalesce(1).orderBy(F.desc("id"))
    monkeypatch.setattr(similarity, "CELLS", 3 * 4096)
    got = {(r.query_id, r["rank"]): (r.target_id, r.score) for r in similarity.cosine_topk(df, df, 4).collect()}
    u = similarity._unit(v)
    for q in range(len(v)):
        s = u @ u[q]
        s[q] = -9
        assert np.allclose([got[q, k][1] for k in (1, 2, 3, 4)], np.sort(s)[::-1][:4])
    assert [got[69, k][0] for k in (1, 2, 3, 4)] == [0, 1, 2, 3]  # all scores of a zero vector are 0


def test_plans_over_all_lines(spark, tmp_path):
    c, df = sshd(), lines_df(spark)
    p = match.parse(df, c)
    plan = stats.keep_lines(p, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and plan.count("Window [") == plan.count("WindowGroupLimit") // 2  # no window over all lines of a template
    for k in (2, 3):
        rows = p.select("line_id", F.size("matches").alias("o"), F.xxhash64(F.lit(0), F.col("line_id")).alias("h"), F.explode("matches.template_id").alias("t")).collect()
        want = set()
        for t in {r.t for r in rows}:
            own = [r for r in rows if r.t == t]
            first = min(own, key=lambda r: (r.o, r.line_id))
            want |= {r.line_id for r in [first] + sorted((r for r in own if r is not first), key=lambda r: (r.h, r.line_id))[: k - 1]}
        assert {r.line_id for r in stats.keep_lines(p, k).collect()} == want | {r.line_id for r in match.unmatched(p).collect()}
    plan = match.changed_lines(df, c, Catalog())._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and plan.count("Generate") == 1  # no fields, and templates once for each line
    plan = stats.token_weights(match.field_values(p, c))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline" not in plan  # lines are matched before, once


def test_stream_caches_no_batch(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "persist", lambda *_: pytest.fail("a batch was cached"))
    monkeypatch.setattr(type(spark.range(1)), "persist", lambda *_: pytest.fail("a batch was cached"))
    df, c = lines_df(spark), sshd()
    df.write.parquet(str(tmp_path / "in"))
    ingest.start(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), c, str(tmp_path / "home")).awaitTermination()
    p = match.parse(df, c)
    assert sorted(map(repr, ingest.matched_table(spark, str(tmp_path / "home")).select("line_id", "matches").collect())) == sorted(map(repr, p.where("size(matches) > 0").select("line_id", "matches").collect()))
    assert sorted(map(repr, ingest.dead_letters(spark, str(tmp_path / "home")).select("line_id", "partial").collect())) == sorted(map(repr, p.where("size(matches) = 0 and content is not null").select("line_id", "partial").collect()))


def test_pages_without_tables_are_not_parsed(spark, monkeypatch):
    pages = spark.createDataFrame([(HTML,), (HTML.replace("<table", "<TABLE"),), ("<p>no</p>",), (None,)], "html string")
    plan = logs.read_field_pages(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan.upper()
    assert logs.read_field_pages(pages).count() == 2 * logs.read_field_pages(pages.limit(1)).count() > 0


def test_jaccard_forest_grows_with_rows_not_pairs(spark, monkeypatch):
    rnd = random.Random(13)
    sets = list({tuple(sorted(rnd.sample("abcdefghij", rnd.randrange(1, 8)))) for _ in range(60)}) + [("u", "v", "w", "x", "y", "z", str(k)) for k in range(250)]
    df = spark.createDataFrame([(i, list(s)) for i, s in enumerate(sets)], "id long, tokens array<string>")
    for least, most in ((0.5, 256), (0.7, 256), (0.7, 6), (1.0, 256)):
        monkeypatch.setattr(similarity, "SUBSETS", most)  # 6: the longer sets take the join
        near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len({*a} & {*b}) / len({*a} | {*b}) >= least]
        edges = similarity.jaccard_forest(df, least).collect()
        assert graphs.union_find(edges) == graphs.union_find(near)
        assert most == 6 or least == 1 or len(near) > 31_000 > 20_000 > len(edges)


def test_medoids_by_kinds_against_brute_force(spark, monkeypatch):
    rnd = random.Random(14)
    lines = [" ".join(rnd.sample("abcdefgh", rnd.randrange(2, 6)) + [str(rnd.randrange(40))] * rnd.randrange(2)) for _ in range(150)] + [f"open file {k}" for k in range(60)] + [""]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, text string")
    clusters = spark.createDataFrame([(i, i % 3) for i in range(150)] + [(i, 7) for i in range(150, 211)], "id long, cluster long")
    sets = [frozenset(x.split()) for x in lines]
    far = lambda a, b: 1 - len(a & b) / max(len(a | b), 1)
    groups = [[i for i in range(150) if i % 3 == c] for c in range(3)] + [list(range(150, 211))]
    want = {(c, min(g, key=lambda i: (round(sum(far(sets[i], sets[j]) for j in g), 9), i))) for c, g in zip((0, 1, 2, 7), groups, strict=True)}
    assert {(r.cluster, r.id) for r in similarity.medoids(df, clusters).collect()} == want
    sums = similarity._kinds(df.where("id >= 150").select(F.lit(7).alias("cluster"), "id", F.lit(1).alias("n"), scalars.line_tokens(F.col("text")).alias("tokens")))
    assert sums.select("tokens", "size").distinct().count() == 2  # 60 lines of one kind, and the empty one


def test_clusters(spark):
    lines = ["open file a", "open file b", "open file c", "shut door", "shut door", "", "lonely"]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, text string")
    got = {r.id: r.cluster for r in similarity.jaccard_clusters(df, 0.5).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: None, 6: None}
    assert {(r.cluster, r.id) for r in similarity.medoids(df, similarity.jaccard_clusters(df, 0.5)).collect()} == {(0, 0), (3, 3)}
    assert similarity.cluster_buffer(lines[:5], 2) == [("open file a", 3), ("shut door", 2)] and similarity.cluster_buffer(["a"], 5) == [("a", 1)]
    assert similarity.coverage("abab", {"ab": 1.0, "zz": 1.0}) == 0.5 and similarity.coverage("", {"a": 1.0}) == 0
    assert similarity.rank_templates("user anna", {0: {"user": 1.0}, 1: {"door": 1.0}}, {})[0][0] == 0
    assert similarity.template_distance({0: {"a": 1.0, "b": 3.0}, 1: {"b": 1.0}, 2: {"c": 1.0}}, 0) == [(1, 0.75), (2, 0.0)]
    assert similarity.interleave([1, 2, 3], [3, 4], k=3) == [1, 3, 2]
    c = sshd()
    assert similarity.ordered_templates(c, c.templates[2][-1])[0] == (2, 0.0) and set(similarity.prefix_clusters(c)) == {n for n in c.nodes if c.nodes[n].token.is_variable}
    v = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.8, 0.2]), (1, [0.9, 0.1]), (2, [0.0, 1.0])], "label long, vector array<double>").withColumn("id", F.monotonically_increasing_id())
    cents = similarity.centroids(v)
    assert {r.label: r.merged for r in similarity.merge_clusters(cents).collect()} == {0: 0, 1: 0, 2: 2}
    assert similarity.centroid_rank(cents, v, k=2).count() == 8


def test_votes(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (1, "b", 2), (2, "z", 1), (2, "none_t", 2)], "k int, c string, r int")
    assert {tuple(r) for r in votes.plurality(df, "k", "c").collect()} == {(1, "b", 2), (2, "none_t", 1)}
    assert [tuple(r) for r in votes.agreed(df, "k", "c").collect()] == [(1, "b", 2)]
    assert {tuple(r) for r in votes.type_vote(df, "k", "c").collect()} == {(1, "b"), (2, "none_t")}
    assert {(r.k, r.c): (r.score, r.place) for r in votes.ranked_vote(df, "k", "c", "r").collect()} == {(1, "b"): (5, 1), (1, "a"): (3, 2), (2, "z"): (3, 1), (2, "none_t"): (2, 2)}


# --- taxonomy, sources ---------------------------------------------------------------


def test_taxonomy(spark):
    objects = {"endpoint": {"ip": {"type": "ip_t"}, "peer": {"object_type": "endpoint"}, "port": {"type": "port_t"}}}
    t = taxonomy.expand(spark, {"net": {"src": {"object_type": "endpoint"}, "time": {"type": "datetime_t"}}, "auth": {"time": {"type": "datetime_t"}}}, objects, {"ip_t": "string_t", "port_t": "integer_t"})
    rows = {r.name: r for r in t.collect()}
    assert set(rows) == {"src", "src.ip", "src.peer", "src.port", "time"} and rows["time"].events == ["auth", "net"] and rows["src.peer"].is_object
    assert {r.name for r in taxonomy.select(t, ["net"], "ip_t").collect()} == {"src.ip"}
    assert taxonomy.select(t, ["auth"]).count() == 1 and taxonomy.select(t, None, "ip_t", 2).count() == 5
    assert {(r.name, r.sibling) for r in taxonomy.siblings(t).collect()} == {(a, b) for a in ("src.ip", "src.peer", "src.port") for b in ("src.ip", "src.peer", "src.port") if a != b}
    vec = t.withColumn("embedding", F.array(F.length("name").cast("double"), F.lit(1.0)))
    fields = spark.createDataFrame([("f", "ip_t", ["net"], [3.0, 1.0])], "field string, type string, events array<string>, embedding array<double>")
    got = taxonomy.candidates(fields, vec, 2).collect()
    assert len(got) == 2 and ("src.ip", 1.0) in {(r.name, r.score) for r in got}
    nodes, edges = taxonomy.graph(t)
    assert nodes.count() == 5 and edges.count() == 3 and taxonomy.outline(t).first()["line"] == "- src"


HTML = """<h2>Event</h2><div><table><tr><th>Field Name</th><th>Type</th><th>Label</th><th>Description</th></tr>
<tr><td>src</td><td>Noun</td><td></td><td>the  source</td></tr><tr><td>when</td><td>Timestamp</td><td></td><td>x</td></tr></table></div>
<h3>Noun</h3><div><table><tr><th>Field Name</th><th>Type</th><th>Label</th><th>Description</th></tr><tr><td>ip</td><td>string</td><td>repeated</td><td>an &amp; ip</td></tr>
<tr><td>kind</td><td>Kind</td><td></td><td></td></tr><tr><td>next</td><td>Noun</td><td></td><td></td></tr></table></div><h3>Kind</h3><table><tr><th>Enum Value</th></tr><tr><td>ONE</td></tr></table>"""


def test_field_pages(spark):
    fields = logs.dotted_fields(logs.field_tables(HTML), "Event")
    assert {k: d["type"] for k, d in fields.items()} == {"src": "object", "src.ip": "string", "src.kind": "enum", "src.next": "object", "when": "Timestamp"}
    t = {r.name: r for r in taxonomy.from_fields(spark, fields).collect()}
    assert t["src.ip"].is_array and t["src.ip"].description == "an & ip" and t["when"].base_type == "DATETIME" and t["src"].is_object
    pages = spark.createDataFrame([(1, HTML), (2, None), (3, "<p>")], "page_id long, html string")
    assert {(r.type, r.field) for r in logs.read_field_pages(pages).collect()} >= {("Event", "src"), ("Noun", "ip"), ("Kind", "ONE")}


def test_sources(spark, tmp_path):
    (tmp_path / "logs/a").mkdir(parents=True)
    (tmp_path / "logs/x.log").write_bytes(b"one\n\n  two\t2 \r\nthr\xffee\n")
    (tmp_path / "logs/a/app_full.log").write_text("z\n")
    rows = logs.read_log(spark, str(tmp_path / "logs/x.log")).orderBy("line_id").collect()
    assert [(r.line_id, r.content) for r in rows] == [(0, "one"), (1, "two 2"), (2, "thr\ufffdee")]
    assert logs.read_log(spark, str(tmp_path / "logs/x.log"), share=0.7).count() == 2
    assert [r.content for r in logs.read_log(spark, str(tmp_path / "logs/x.log"), split="o").orderBy("line_id").limit(2).collect()] == ["ne tw", "2 thr\ufffdee"]
    assert [r.content for r in logs.read_bytes_log(spark, str(tmp_path / "logs/x.log")).collect()][3] == "thr\ufffdee"
    assert [r.name for r in logs.discover(spark, str(tmp_path / "logs")).collect()] == ["app"]
    (tmp_path / "s.csv").write_text('LineId,Content,EventId,EventTemplate,More\n1,"a, 1",E1,"a, <*>",x\n2,"a, 1",E2,b,x\n')
    s = logs.read_structured(spark, str(tmp_path / "s.csv"))
    lines = spark.createDataFrame([(0, "a,  1")], "line_id long, content string")
    assert [tuple(r) for r in logs.event_of_line(lines, s).collect()] == [(0, "E2")] and logs.first_lines(s).count() == 2
    fix = spark.createDataFrame([("E1", "a, <n>")], "EventId string, template string")
    assert {r.EventTemplate for r in logs.corrected(s, fix).collect()} == {"a, <n>", "b"}
    (tmp_path / "t.txt").write_text("a <*> b 12\nc 3\n")
    assert {(r.EventTemplate, r.Occurrences) for r in logs.read_templates(spark, str(tmp_path / "t.txt")).collect()} == {("a <*> b", 12), ("c", 3)}
    with pytest.raises(ValueError):
        logs.read_structured(spark, str(tmp_path / "t.txt"))
    with pytest.raises(ValueError):
        logs.read_any(spark, "x.pkl")
    (tmp_path / "seed.json").write_text(json.dumps([{"template": [{"value": "user", "type": "CONSTANT"}, {"value": "anna", "type": "VARIABLE", "regex": r"\w+"}], "examples": ["user anna"]}]))
    tokens, examples = logs.seeds(str(tmp_path / "seed.json"))[0]
    assert [(t.is_variable, t.value, t.ws) for t in tokens] == [(False, "user", 1), (True, "anna", 0)] and examples == ("user anna",)


# --- aligning, editing, discovery -----------------------------------------------------


def test_aligners():
    line = "user  “anna” logged in (ok)"
    items = [{"value": "user", "is_variable": False}, {"value": '"anna"', "is_variable": True, "regex": r"\S+"}, {"value": "logged   in", "is_variable": False}]
    tokens = align.tolerant(items[:1] + [{"value": "“anna”", "is_variable": True}] + items[2:], line + "")
    assert "".join(t.value + " " * t.ws for t in tokens).split() == line.split()
    with pytest.raises(ValueError):
        align.tolerant([{"value": "logged", "is_variable": False}], line)
    with pytest.raises(ValueError):
        align.strict([{"value": "absent", "is_variable": True}], line)
    assert [t.value for t in align.strict([{"value": "b", "is_variable": True}], "a b c")] == ["a", "b", "c"]
    w = align.from_wildcard("open <*> by <*><*>", "open f 1 by me")
    assert [(t.is_variable, t.value) for t in w] == [(False, "open"), (True, "f 1"), (False, "by"), (True, "me")]
    assert re.match(align.wildcard_pattern("a <*> b"), "a  x y b") and not re.match(align.wildcard_pattern("a <*>"), "b a x")
    assert re.match(align.wildcard_pattern("a <*> b", whole=False), "a 1 b and more")


def test_edits():
    c = sshd()
    assert cat.validate(edit.simplify(c)) == [] and edit.simplify(c) == c
    user = c.templates[2][-1]
    r = edit.apply(c, [{"op": "edit_node", "node": user, "regex": r"\w+"}, {"op": "set_field", "node": user, "attribute": "account", "new": True}, {"op": "map_attribute", "attribute": "account", "fields": ["user.name"]}, {"op": "set_events", "template": 2, "events": ["auth", "auth", "x"]}])
    assert r.changed_templates == {2} and r.catalog.semantics[user].mapping == ("user.name",) and r.catalog.events[2] == ("auth", "x") and c.nodes[user].token.regex == ".+?"
    with pytest.raises(edit.EditError, match="operation 1"):
        edit.apply(c, [{"op": "set_syntax", "node": user}, {"op": "remove_node", "node": 999}])
    with pytest.raises(edit.EditError):
        edit.apply(c, [{"op": "exec", "code": "1"}])
    fixed = replace(c, nodes={**c.nodes, user: replace(c.nodes[user], token=replace(c.nodes[user].token, fixed=True))})
    with pytest.raises(edit.EditError, match="fixed"):
        edit.apply(fixed, [{"op": "edit_node", "node": user, "regex": "x"}])
    head = c.templates[0][0]
    with pytest.raises(edit.EditError, match="below itself"):
        edit.apply(c, [{"op": "move_node", "node": head, "parent": user}])
    assert edit.apply(c, [{"op": "add_node", "parent": 0, "token": {"is_variable": True, "value": "x", "regex": ".*?"}}]).changed_templates == {0, 1, 2, 3}
    assert edit.apply(c, [{"op": "remove_node", "node": head}]).catalog.templates[0] == c.templates[0][1:]
    lines = [x for x in LINES if x]
    assert edit.first_to_lose(c, [{"op": "set_syntax", "node": user}, {"op": "remove_template", "template": 3}], lines) == 1
    g, t = Catalog().add_template([var(".+", value="a"), var("a*", value="aa")])
    assert edit.greedy_repair(g, t, "aaa") == g
    assert edit.apply(g, [{"op": "lazy_repair"}]).catalog.nodes[1].token.regex == ".+?"
    fresh, t = Catalog().add_template([lit("k="), var("."), var(r"\d")])
    a, b, d = fresh.templates[t]
    out = edit.repair_schema(fresh, t, {"lost_KEY": {"description": "", "ids": [a]}, "v": {"description": "d", "ids": [b]}, "v_KEY": {"ids": [d]}})
    assert [out.semantics[n].attribute for n in (a, b, d)] == ["SYNTAX", "v", "v_KEY"]
    swap = edit.apply(c, [{"op": "replace_template", "template": 3, "tokens": [{"is_variable": False, "value": "bye"}]}])
    assert cat.wildcard(swap.catalog, 3) == "bye" and swap.changed_templates == {3}


def test_discovery_covers_all_lines(spark):
    rnd = random.Random(2)
    lines = [f"job {rnd.randrange(99)} done in {rnd.randrange(9)} ms" for _ in range(20)] + [f"disk sd{rnd.choice('abc')} full" for _ in range(10)] + ["   ", None]
    c, used = discovery.run(lines_df(spark, lines), Catalog())
    assert used >= 1 and match.unmatched(match.parse(lines_df(spark, lines), c)).where("trim(content) <> ''").count() == 0
    assert cat.validate(c) == []
    assert discovery.problems([var(r"\d+", value="x")], ["x"]) and discovery.problems([lit("a", 1), var(".+", value="b")], ["a b"], ["b"])
    assert discovery.choose([[var(".+")], [lit("a", 1), var(".+")]], ["a b"], ["c d"])[0].value == "a"
    client = discovery.Recorded({}, json.dumps([{"value": "job", "is_variable": False}, {"value": "1", "is_variable": True, "regex": r"\d+"}]))
    assert [t.value for t in discovery.proposer(client)(["job 1"])] == ["job", "1"]
    assert discovery.ask(spark.createDataFrame([(1, "p")], "id long, prompt string"), discovery.Recorded({"p": "yes"})).first().answer == "yes"


def test_stream_dead_letters_and_rematch(spark, tmp_path):
    df, c = lines_df(spark, n=2), sshd()
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    home = str(tmp_path / "home")
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    ingest.start(stream, c, home, on_buffer=lambda d: seen.append(d.count()), buffer=2).awaitTermination()
    assert {r.line_id for r in ingest.matched_table(spark, home).collect()} == {0, 1, 2, 3, 4, 5, 10}
    assert {r.line_id for r in ingest.dead_letters(spark, home).collect()} == {6, 7, 8} and seen  # a null line is no candidate for discovery
    learnt = ingest.learn(spark, home, c)
    assert match.unmatched(match.parse(df, learnt)).where("trim(content) <> ''").count() == 0
    old = match.line_matches(match.parse(df, c))
    for ops in ([{"op": "edit_node", "node": c.templates[2][-1], "regex": r"\w+"}], [{"op": "remove_template", "template": 0}], [{"op": "add_template", "tokens": [lit("kernel:", 1), var(r"\S+")]}]):
        r = edit.apply(c, ops)
        again = ingest.rematch(df, old, c, r.catalog, r.changed_templates)
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, match.line_matches(match.parse(df, r.catalog)).collect()))


def test_queries_need_no_shuffle(spark):
    plan = catalogue.QUERIES["q_nested"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_entry_without_the_corpus_package():
    code = "import sys; sys.modules['loomlog.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'flagship' in e.queries() and 'pipeline' not in e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)


def test_both_backends_agree_on_every_script(spark):
    rnd = random.Random(12)
    c = Catalog()
    for tokens in (
        [lit("user", 1), var(r"\w+", 1), lit("id", 1), var(r"\d+")],
        [var(r"[\w.-]+"), lit(":", 1), var(r"\S+", 1), var(r"[^\d\s]+")],
        [lit("größe"), var(r"\W+"), var(r"(?i:ÄÖ|x)", 1), var(r".*")],
        [var(r"\b\w\w?\b", 1), var(r"[\D&&]{2,}")],
        [var(r"[\[\]\w]+", 1), lit("ende")],
    ):
        c, _ = c.add_template(tokens)
    words = ["user", "jürgen", "anna", "id", "٣", "7", "名前", "größe", "=", "äö", "ÄÖ", "x", "ende", "[a]", "é", "e\u0301", "ñ.b-c", "&&", "Ⅷ", "²", "\u200b", "ß"]
    blanks = [" ", "\t", "\u00a0", "\u2003", "\x1c", "\x85", "\u3000", ""]
    lines = ["user jürgen id 7", "user anna id ٣", "user\u00a0anna id 7", "größe= äö 5", "ñ.b-c: x é"]
    lines += ["".join(rnd.choice(words) + rnd.choice(blanks) for _ in range(rnd.randrange(1, 7))) for _ in range(1500)]
    lines += [f"user {rnd.choice(words)}{rnd.choice(blanks)}id{rnd.choice(blanks)}{rnd.choice(words)}" for _ in range(500)]
    df = lines_df(spark, lines)
    expr, arrow = (parsed_rows(match.parse(df, c, backend=b)) for b in ("expr", "arrow"))
    assert expr == arrow
    found = match.parse(lines_df(spark, lines[:5]), c, backend="expr").where(F.size("matches") > 0).count()
    assert found == 5
