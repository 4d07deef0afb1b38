"""Every registered evaluation query against its SQL, and the entry point."""

import math

import duckdb
import pytest

from trialweave import workloads

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _rows(rows, columns, order):
    clean = lambda v: "NaN" if isinstance(v, float) and math.isnan(v) else v
    at = [columns.index(c) for c in order]
    return sorted((tuple(clean(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(workloads.oracle_sql()))
def test_query_agrees_with_its_sql(spark, sf_dir, duck, name):
    df = workloads.queries()[name](spark, sf_dir)
    order = sorted(df.columns)
    got = duck.execute(workloads.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == order
    assert _rows(df.collect(), df.columns, order) == _rows(got.fetchall(), columns, order)


def test_entry(spark):
    import __spark_entry__ as entry

    assert {r["model_id"] for r in entry.entry(spark).collect()} == {"baseline", "candidate"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
