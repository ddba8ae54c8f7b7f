"""Every reference query against DuckDB on the smallest tables."""

import duckdb
import pytest
from conftest import same

from quaero.plans import catalog, evidence, verification  # noqa: F401  the others add their queries to the catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_oracle(spark, duck, name):
    same(catalog.queries()[name](spark, DIR), duck.sql(catalog.oracle_sql()[name]).df())


def test_pages_reach_the_end_of_long_texts(spark, tmp_path):
    rows = [(1, "x" * 128_657), (2, "x" * 40_000), (3, "x" * 39_998), (4, "x" * 5), (5, ""), (6, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["page"] for r in catalog.page_for_offset(spark, f"file://{tmp_path}").collect()}
    assert got == {1: 129, 2: 41, 3: 40, 4: 1, 5: 1, 6: 1}
