"""Every query with a SQL check gives the same rows as DuckDB on the same files."""

import oracle
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, duck, name):
    assert oracle.compare(QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()) is None


@pytest.mark.parametrize("name", ["probe_transfer", "pca_project", "paired_link_median", "welch_ttest_pvalue"])
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_names_line_up():
    assert set(SQL) <= set(QUERIES)
