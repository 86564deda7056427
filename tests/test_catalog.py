import os

import duckdb
import pytest

import __spark_entry__
from pagelode.plans import catalog, more, oracle, oracle_more

SF = "/root/testdata/sf0.001"
TWINS = {**oracle.SQL, **oracle_more.SQL}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        at = f"{SF}/{f}/*.parquet" if os.path.isdir(f"{SF}/{f}") else f"{SF}/{f}"
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{at}'")
    return c


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_matches_oracle(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    r = db.sql(TWINS[name])
    assert sorted(r.columns) == columns
    expected = sorted((tuple(map(plain, x)) for x in db.sql(f"SELECT {', '.join(columns)} FROM ({TWINS[name]}) q").fetchall()), key=repr)
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(TWINS)))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_catalogues_are_apart():
    assert not set(catalog.QUERIES) & set(more.QUERIES) and not set(oracle.SQL) & set(oracle_more.SQL)
    assert set(more.QUERIES) <= set(TWINS)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["page_id", "url", "score", "failed"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_does_not_import_llm():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(f"{root}/pagelode"):
        if "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    assert "pagelode.llm" not in open(f"{folder}/{n}").read()
