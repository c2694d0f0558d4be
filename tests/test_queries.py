import duckdb
import pandas as pd
import pytest

from chronoforest.queries import ORACLE_SQL, QUERIES, flagship

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(df):
    cols = sorted(df.columns)
    cell = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return cols, sorted(str([cell(v.item() if hasattr(v, "item") else v) for v in r]) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, sf, db, name):
    assert plain(QUERIES[name](spark, sf).toPandas()) == plain(db.sql(ORACLE_SQL[name]).df())


def test_entry(spark, sf):
    assert flagship(spark, sf).count() > 0
