import numpy as np
import pytest

from loomlog.llm import ann


def brute(rows, k):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    d = max({len(v) for _, v in ok}, key=lambda n: sum(len(v) == n for _, v in ok))
    ok = [(i, v) for i, v in ok if len(v) == d]
    out = {}
    for i, q in ok:
        if i % 20 == 0:
            best = {}
            for j, v in ok:
                if j != i:
                    best[j] = max(best.get(j, -np.inf), float(q @ v))
            out[i] = sorted(((-s, j) for j, s in best.items()))[:k]
    return out


def test_recall_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 900)] + 0.4 * rng.normal(size=(900, 16))).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] + [1.0] * 15), (2060, [None] + [1.0] * 15), (2080, [float("inf")] + [1.0] * 15), (2100, [1.0, 2.0]), (None, [1.0] * 16), (40, rows[40][1])]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<float>, score double").repartition(3)
    index, books = ann.index(df)
    got = {}
    for r in ann.search(index, books, index.where("vec_id % 20 = 0"), k=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    want = brute(rows, 20)
    assert set(got) == set(want)
    hit = 0
    for q, own in got.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert [(s, i) for _, s, i in own] == sorted((s, i) for _, s, i in own)
        hit += len({i for _, _, i in own} & {i for _, i in want[q]})
    assert hit / sum(map(len, want.values())) >= 0.97
    common_query = got[200]
    assert [i for _, _, i in common_query][:20] == [i for _, i in want[200]]


def test_few_rows_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 2.0])], "vec_id long, embedding array<double>")
    index, books = ann.index(df)
    assert [tuple(r) for r in ann.search(index, books, index.where("vec_id % 20 = 0")).collect()] == [(0, 1, 1, 0.5)]
    index, books = ann.index(df.limit(0))
    assert ann.search(index, books, index).count() == 0


def test_beam_is_at_least_as_good_as_greedy():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 8)).astype(np.float32)
    books = ann.fit(x, 4, 16)

    def error(beam):
        codes, _, _ = ann.encode(x, books, beam)
        return ((x - books[np.arange(4)[None, :], codes].sum(1)) ** 2).sum()

    assert error(8) < error(1)


def made(n, d=64):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, d)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbours(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    return out


def recall(ids, x, got, k=20):
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:k]].tolist())
        hit, total = hit + len(best & {i for _, i in got[int(ids[q])]}), total + len(best)
    return hit / total


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_table_against_a_full_scan(spark, sf):
    t = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").toPandas()
    assert recall(t.vec_id.to_numpy(), np.stack(t.embedding), neighbours(ann.query(spark, f"/root/testdata/{sf}"))) >= 0.97


def test_recall_without_any_structure_and_exact_mode(spark):
    x = made(3000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    index, books = ann.index(df)
    queries = index.where("vec_id % 20 = 0")
    assert recall(np.arange(3000), x, neighbours(ann.search(index, books, queries))) >= 0.95
    assert recall(np.arange(3000), x, neighbours(ann.search(index, books, queries, exact=True))) == 1.0
