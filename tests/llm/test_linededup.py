import random

import duckdb
from loomlog.llm import linededup


def brute(rows):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        if text is None:
            out.append((doc_id, None))
            continue
        lines, gone = text.split("\n"), set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        out.append((doc_id, "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def test_brute_force_and_sql(spark):
    rnd = random.Random(5)
    rows = [(1, None), (2, ""), (3, "a\nb"), (4, "\n\n\n\n"), (5, "x" * 30_000 + "\n" + "y\n" * 4000)]
    rows += [(10 + i, "\n".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 9)))) for i in range(80)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, n_lines string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in linededup.dedup(df).collect()), key=lambda r: r[0])
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    import hashlib

    sql = {r[0]: r[1:] for r in con.execute(linededup.ORACLE).fetchall()}
    for doc_id, text in got:
        assert sql[doc_id][2] == (None if text is None else hashlib.md5(text.encode()).hexdigest())


def test_repeated_rows_null_ids_and_empty(spark):
    t = "a\nb\nc\nd"
    rows = [(None, t), (1, t), (1, t), (2, "z\na\nb\nc")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.text) for r in linededup.dedup(df).collect())
    assert got == [(-1, t), (1, ""), (1, ""), (2, "z")]
    assert linededup.dedup(df.limit(0)).count() == 0


def test_a_text_of_many_lines_takes_linear_time(spark):
    once = [f"line {i}" for i in range(200_000)]
    df = spark.createDataFrame([(1, "\n".join(once + once[:100_000]))], "doc_id long, text string")
    r = linededup.dedup(df).first()  # minutes would pass if lines were found by splitting the text for each
    assert (r.text, r._n_lines, r._n_removed) == ("\n".join(once), 300_000, 100_000)
