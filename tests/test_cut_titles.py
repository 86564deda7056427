"""Lint queries against their twins where titles were cut inside an entity."""

import duckdb
import pytest

from pagelode.plans import catalog
from tests.test_catalog import SF, TWINS

NAMES = ["lint_changed", "lint_findings", "lint_full", "lint_scores"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The test pages, every title ending in an entity without its semicolon, about as long as the rules about lengths allow."""
    to = tmp_path_factory.mktemp("cut")
    lengths = "substr(repeat('title words ', 6), 1, CASE WHEN page_id % 2 = 0 THEN 24 ELSE 59 END + (page_id // 2 % 6)::INT)"
    duckdb.sql(f"COPY (SELECT page_id, url, regexp_replace(html, '(?s)<title>.*?</title>', '<title>' || {lengths} || ['x&amp', 'x&quot', 'x&lt'][page_id % 3 + 1] || '</title>') AS html FROM '{SF}/pages.parquet') TO '{to}/pages.parquet'")
    return str(to)


@pytest.mark.parametrize("name", NAMES)
def test_cut_titles_match_the_twin(spark, folder, name):
    df = catalog.queries()[name](spark, folder)
    columns = ", ".join(df.columns)
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
        want = db.sql(f"SELECT {columns} FROM ({TWINS[name]}) q").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
