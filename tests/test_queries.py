"""Every query with SQL gives what the SQL gives, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from leafmill import plans

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    if not Path(FOLDER).is_dir():
        pytest.skip("no test tables here")
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(None if r[i] is None else cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_against_sql(spark, con, name):
    df = plans.queries()[name](spark, FOLDER)
    sql = con.execute(plans.oracle_sql()[name])
    names = [d[0] for d in sql.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(df.collect(), df.columns) == plain(sql.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_runs(spark, con, name):
    assert plans.queries()[name](spark, FOLDER).count() > 0
