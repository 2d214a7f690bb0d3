"""Every query with SQL against DuckDB, over the whole tables of the smallest scale."""

import duckdb
import pytest

from quire import registry
from quire.views import TABLES


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def rows(frame):
    return sorted(map(tuple, frame[sorted(frame)].astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(name, spark, data, con):
    ours, theirs = registry.QUERIES[name](spark, data).toPandas(), con.sql(registry.ORACLES[name]).df()
    assert sorted(ours) == sorted(theirs)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_html_text(spark, data):
    out = registry.QUERIES["html_text"](spark, data).collect()
    assert len(out) == 50 and all("# " in r.markdown and "<p" not in r.markdown for r in out)
