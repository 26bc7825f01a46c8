import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sightline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def column(spark):
    """Values of an expression over rows of literals."""

    def run(rows, schema, expression):
        numbered = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
        df = spark.createDataFrame(numbered, f"_i int, {schema}")
        return [r.v for r in df.select("_i", expression.alias("v")).orderBy("_i").collect()]

    return run
