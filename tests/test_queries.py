"""Every query with SQL gives DuckDB's rows on the smallest tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from notewright.plans import queries as plans
from notewright.plans import songs  # noqa: F401

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, D)
    columns = sorted(df.columns)
    got = Counter(tuple(normal(v) for v in r) for r in df.select(*columns).collect())
    want = duck.sql(plans.SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == Counter(tuple(normal(r[i]) for i in at) for r in want.fetchall())


def test_release_facts_take_the_first_of_equal_lines(spark, duck, tmp_path):
    # Six lines of one number and part, in two files; a stable sort takes the first one of the first file. Suppliers 9 and 11 have a year, 4 and 5 none.
    for name, suppliers in (("a", (11, 4, 5)), ("b", (9, 1, 2))):
        duck.execute("create or replace temp table li as select 7::BIGINT AS l_orderkey, 3::BIGINT AS l_partkey, unnest(?::BIGINT[]) AS l_suppkey, 1::INT AS l_linenumber", [list(suppliers)])
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        duck.execute(f"copy li to '{tmp_path}/lineitem.parquet/{name}.parquet' (format parquet)")
    duck.execute(f"copy (select 7::BIGINT AS o_orderkey) to '{tmp_path}/orders.parquet' (format parquet)")
    duck.execute(f"copy (select unnest(range(20)) AS s_suppkey) to '{tmp_path}/supplier.parquet' (format parquet)")
    duck.execute(f"copy (select unnest(range(20)) AS p_partkey) to '{tmp_path}/part.parquet' (format parquet)")
    assert [tuple(r) for r in songs.q_release_facts(spark, str(tmp_path)).select("query", "year", "cover_url").collect()] == [(7, "1911", "front3")]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
