import json
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from loomlog import __main__ as cli
from loomlog.functions import sql
from loomlog.operators import graphs, heuristics, match
from loomlog.sources import logs
from tests.test_engine import LINES, lines_df, lit, sshd, var
from loomlog.plans.catalog import Catalog


def test_prefixes_and_samples(spark):
    c = sshd()
    p = match.parse(lines_df(spark), c)
    got = {r.line_id: (r.node_id, r.prefix, r.suffix) for r in heuristics.prefixes(p, c).collect()}
    assert got == {6: (c.templates[0][2], "sshd[9]: ", "restarting"), 7: (0, "", "kernel: up"), 8: (0, "", ""), 9: (0, "", "")}
    e, _ = Catalog().add_template([lit("k="), var(".*")])
    assert [r.line_id for r in heuristics.filled(match.parse(lines_df(spark, ["k=", "k=v"]), e)).collect()] == [1]
    assert heuristics.same_prefix(["sshd[1]: a", "sshd[22]: b", "x"], c, c.templates[0][2]) == ["sshd[1]: a", "sshd[1]: b", "x"]
    r = heuristics.all_match(lines_df(spark, ["a1b2", "c3", "d"]), r"\d").first()
    assert tuple(r) == (False, 2, 3)
    assert {tuple(x) for x in heuristics.previous_matches(p, "Failed").collect()} == {(1, 2)}
    assert heuristics.representatives(["a b", "a c", "z", "z"], 2) == heuristics.representatives(["a b", "a c", "z", "z"], 2) and len(heuristics.representatives(list("abcdefg"), 3)) == 3
    assert heuristics.representatives([]) == []


def test_density_clusters_against_brute_force(spark):
    rng = np.random.default_rng(4)
    v = np.vstack([rng.normal(size=(60, 4)), rng.normal(size=(40, 4)) * 0.1, np.zeros((3, 4))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(500, None)], "id long, vector array<double>")
    for eps in (0.1, 0.4):
        near = [(i, j) for i in range(len(v)) for j in range(i) if np.linalg.norm(v[i] - v[j]) <= eps]
        root = graphs.union_find(near)
        assert {r.id: r.cluster for r in heuristics.density_clusters(df, eps).collect()} == {i: root.get(i) for i in range(len(v))}
    u = v[:100] / np.linalg.norm(v[:100], axis=1, keepdims=True)
    root = graphs.union_find((i, j) for i in range(100) for j in range(i) if u[i] @ u[j] >= 0.9)
    assert {r.id: r.cluster for r in heuristics.direction_clusters(df, 0.9).collect()} == {i: root.get(i) for i in range(100)}


def test_vector_forest_grows_with_rows_not_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = np.vstack([rng.normal(size=(300, 12)) * 0.01 + 1e3, rng.normal(size=(200, 12)) * 0.6, np.full((1, 12), np.nan), np.full((1, 12), np.inf)])
    df = spark.createDataFrame([(7 * i, x.tolist()) for i, x in enumerate(v)] + [(5, [1e3] * 11)], "id long, vector array<double>")
    monkeypatch.setattr(heuristics, "BLOCK_BYTES", 12 * 8 * 60)
    monkeypatch.setattr(heuristics, "ROWS", 16)
    monkeypatch.setattr(heuristics, "COLUMNS", 32)
    eps = 1.6
    near = [(7 * i, 7 * j) for i in range(len(v)) for j in range(i) if np.linalg.norm(v[i] - v[j]) <= eps]
    assert len(near) > 44_000
    edges = heuristics.vector_forest(df, eps).collect()
    assert graphs.union_find(edges) == graphs.union_find(near)
    assert len(edges) < 500 * 10  # a tree for each of ten blocks at most
    got = {r.id: r.cluster for r in heuristics.density_clusters(df, eps).collect()}
    assert got == {r.id: graphs.union_find(near).get(r.id) for r in df.collect()}


def test_directions_take_one_norm_for_each_vector(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(heuristics, "density_clusters", lambda vectors, eps: seen.append(vectors) or vectors)
    heuristics.direction_clusters(spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id long, vector array<double>"), 0.9)
    assert [r.vector for r in seen[0].collect()] == [[0.6, 0.8]]
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and plan.count("aggregate(") <= 2  # in the generator and a filter that it lets pass, not for each element


def test_labels_and_metadata(spark):
    assert heuristics.merge_labels({1: 1, 2: 1}, {2: 2, 3: 2}, kind={1: "a", 2: "a", 3: "b"}) == {1: 1, 2: 1, 3: 3}
    clusters = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, None)], "id long, cluster long")
    prefix = spark.createDataFrame([(1, 7), (2, 7), (3, 0), (4, 0)], "line_id long, node_id int")
    assert [(r.cluster, r.node_id, r.n, r.ids) for r in heuristics.by_prefix(clusters, prefix).collect()] == [(1, 7, 2, [1, 2]), (1, 0, 1, [3]), (None, 0, 1, [4])]
    c = sshd()
    a, b, d = (c.templates[t][1 if t == 0 else 4] for t in (0, 1, 2))
    c = c.with_semantics(b, attribute="user", description="one", embedding=(1.0, 0.0)).with_semantics(d, attribute="user", description="two", embedding=(0.9, 0.1)).with_semantics(a, attribute="user", description="far", embedding=(0.8, 0.6))
    assert heuristics.attribute_medoids(c) == {"user": "two"}
    near = heuristics.closest_variables(c, b, {d: 0.5}, {2: 1.0})
    assert near[0] == d and len(near) == len(set(near)) and b not in near
    assert heuristics.few_shots([1.0, 0.0], {0: [0.0, 1.0], 1: [1.0, 0.1]}, [9], 2) == [9, 1]


def test_tables_of_other_tools(spark, tmp_path):
    s = spark.createDataFrame([(1, "open f by me"), (2, "open g"), (3, "z")], "LineId int, Content string")
    got = {r.LineId: (r.ids, r.groups) for r in heuristics.parse_structured(s, {"A": "open <*>", "B": "open <*> by <*>"}).collect()}
    assert got == {1: (["A", "B"], [["f by me"], ["f", "me"]]), 2: (["A"], [["g"]]), 3: ([], [])}
    assert heuristics.parse_structured(s, {"A": "open"}, whole=False).where("size(ids) > 0").count() == 2
    c = sshd()
    df = spark.createDataFrame([(0, LINES[5], "Disconnected from 10.0.0.1"), (1, LINES[5], "0.0.1"), (2, LINES[5], "other"), (3, LINES[7], "up")], "line_id long, content string, suffix string")
    got = {r.line_id: (r.text, list(r["values"])) for r in heuristics.suffix_matches(df, c).collect()}
    assert got == {0: ("Disconnected from <*>", ["10.0.0.1"]), 1: ("<*>", ["0.0.1"])}
    heuristics.write_benchmark(match.parse(lines_df(spark), c).where("size(matches) > 0"), c, str(tmp_path / "b"))
    assert logs.read_structured(spark, str(tmp_path / "b/structured")).count() == 7
    assert logs.read_templates(spark, str(tmp_path / "b/templates")).agg(F.sum("Occurrences")).first()[0] == 7


def test_sql_surface(spark):
    c = sshd()
    sql.register(spark, c)
    lines_df(spark).where("line_id < 3").createOrReplaceTempView("some_lines")
    rows = spark.sql("SELECT line_id, size(parse_log(content)) AS n FROM some_lines").collect()
    assert {r.line_id: r.n for r in rows} == {0: 1, 1: 1, 2: 1}
    fields = spark.sql("SELECT line_id, f.value FROM some_lines, LATERAL log_fields(content) AS f WHERE line_id = 2").collect()
    assert sorted(r.value for r in fields) == ["1", "10.0.0.9", "12", "invalid user eve"]


def test_command_line(spark, tmp_path):
    log = tmp_path / "x.log"
    rnd = random.Random(1)
    log.write_text("\n".join(f"job {rnd.randrange(99)} done" for _ in range(30)) + "\nother thing\n")
    cat = str(tmp_path / "c.json")
    cli.main(["learn", str(log), cat])
    cli.main(["ingest", str(log), str(tmp_path / "out"), "--catalog", cat])
    assert spark.read.text(str(tmp_path / "out/entries")).count() == 31
    (tmp_path / "q.json").write_text(json.dumps({"q": {"operator": "AND", "conditions": [["", "job", False, True, None, False, False, True]]}}))
    cli.main(["query", str(log), str(tmp_path / "hits"), "--catalog", cat, "--queries", str(tmp_path / "q.json")])
    assert duckdb.sql(f"SELECT count(*) FROM read_csv('{tmp_path}/hits/**/*.csv', header = false)").fetchall() == [(30,)]
    cli.main(["evaluate", str(log), str(tmp_path / "scores.json"), "--catalog", cat, "--target", cat])
    assert json.loads((tmp_path / "scores.json").read_text())["group_accuracy"] == 1
