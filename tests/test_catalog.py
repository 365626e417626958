"""Every query of the catalog against its SQL on the small tables."""

import duckdb
import pytest

from wayfold.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, db, name):
    ours, theirs = catalog.QUERIES[name](spark, DATA).toPandas(), db.execute(catalog.ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    ours, theirs = (x[columns].sort_values(columns).reset_index(drop=True) for x in (ours, theirs))
    assert len(ours) == len(theirs)
    for c in columns:
        a, b = ours[c], theirs[c]
        assert ((a == b) | (a.isna() & b.isna())).all(), (name, c)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_queries_without_sql_have_whole_rows(spark, name):
    made = catalog.QUERIES[name](spark, DATA)
    assert made.count() == spark.read.parquet(f"{DATA}/events.parquet").count() and len(set(made.columns)) == len(made.columns)


def test_every_query_has_rows(spark, db):
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
    for name, sql in catalog.ORACLE_SQL.items():
        assert db.execute(f"SELECT count(*) FROM ({sql})").fetchone()[0] > 0, name
