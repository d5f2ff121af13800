"""Every query against its SQL, and the entry points."""

import datetime
import os
import subprocess
import sys

import duckdb
import pytest

from offerflow import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    return con


def plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return list(value) if isinstance(value, (list, tuple)) else value


def rows_of(rows):
    return sorted(([plain(v) for v in r] for r in rows), key=lambda r: [(v is not None, str(type(v)), v if not isinstance(v, list) else str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_sql(spark, con, name):
    found = catalog.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    expected = con.execute(f"SELECT {quoted} FROM ({catalog.ORACLE[name]})").fetchall()
    assert rows_of(found.select(*columns).collect()) == rows_of(expected)


@pytest.mark.parametrize("name", ["free_server", "rebalance_candidate", "crawl_parameter_collapse", "sync_diff"])
def test_queries_that_must_find_something(spark, name):
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_queries_without_sql_give_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_the_flagship_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_points_without_the_training_data_part():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'list_top_bought' in q and not any(n.startswith('op1') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_the_library_does_not_import_the_training_data_part():
    code = "import sys; from offerflow import catalog; import offerflow.streaming.feed; assert not any(m.startswith('offerflow.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
