"""Every query that SQL can express gives DuckDB's rows."""

import math

import duckdb
import pytest

from marlstone import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return str(v).removesuffix(" 00:00:00")
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    result = duck.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=str)


def test_every_query_has_sql_or_a_test():
    assert {q for q in QUERIES if q not in SQL} == {
        "isolation_forest", "score_prices", "area_clusters", "backtest_models", "forecast_models", "forecast_verdicts",
    }
