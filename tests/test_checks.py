"""Every registered query against its check SQL on the smallest tables."""

import duckdb
import pytest

from sightline.plans import CHECKS, QUERIES
from sightline.plans.fixtures import TABLES
from tools.check import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    verdict, _, _ = compare(spark, duck, name, SF)
    assert verdict == ("ok" if name in CHECKS else "rows only")
