"""Every registered query of the main package against its SQL."""

import math
import os

import duckdb
import pytest

from loomlog import catalogue, catalogue_more

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*' if os.path.isdir(p) else ''}'")
    return c


QUERIES, ORACLES = catalogue.QUERIES | catalogue_more.QUERIES, catalogue.ORACLES | catalogue_more.ORACLES


def canonical(rows):
    value = lambda x: ("null",) if x is None else (round(x, 5) if not math.isnan(x) else "nan") if isinstance(x, float) else x
    return sorted([tuple(value(x) for x in r) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    if name not in ORACLES:
        assert df.columns
        return
    res = duck.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(range(len(names)), key=lambda k: names[k])
    want = [tuple(r[k] for k in order) for r in res.fetchall()]
    assert canonical(got) == canonical(want)
    assert got or name in ("unused_templates",)
