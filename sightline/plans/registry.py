"""Register of queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function under ``name``, with its check SQL where SQL can say the same."""

    def add(function: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: plain(function(spark, sf_dir))
        if sql:
            CHECKS[name] = sql
        return function

    return add


def plain(df: DataFrame) -> DataFrame:
    """Dates and times as text and all whole numbers as long, so two engines compare equal."""
    def column(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long")
        return c.alias(field.name)

    return df.select([column(f) for f in df.schema.fields])
