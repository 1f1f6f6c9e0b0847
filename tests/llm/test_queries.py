"""The registered queries on the smallest tables: equal to their SQL, or whole results."""

import pytest

from check import compare, database
from siftwell.llm.queries import QUERIES, SQL
from tests.conftest import DATA


@pytest.mark.parametrize("name", list(SQL))
def test_equals_sql(spark, name):
    assert compare(spark, database(DATA), DATA, name) == ""


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL and n[:4] not in ("op3_", "op6_")])
def test_one_row_per_document(spark, name):
    found = QUERIES[name](spark, DATA)
    assert found.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert found.select("doc_id").distinct().count() == found.count()
