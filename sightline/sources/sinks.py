"""Tables on shared storage: captures, state versions, decisions, run audits, digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .. import tables
from ..schemas import CAPTURES


def write_captures(captures: DataFrame, path: str) -> None:
    """Partitioned by parser and run, so each parser reads only its own files of a run.

    Rows spread over files by company and page: one large portal does not become one file.
    """
    spread = captures.repartition("parser", "run_date", "company_id", "page_idx")
    spread.write.mode("append").partitionBy("parser", "run_date").parquet(path)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    fields = [*CAPTURES.fields, T.StructField("parser", T.StringType())]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def write_state(state: DataFrame, path: str, version: int, keep: int = 2) -> None:
    """A new version beside the newest old ones; writing the same version again replaces it."""
    tables.publish(state.sparkSession, path, version, tables.write_part(state, path, "state"))
    tables.remove_old(state.sparkSession, path, keep)


def read_state(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """One version of the state, by default the newest that was written to its end."""
    return tables.read_table(spark, path, "state", version)


def write_by_run(rows: DataFrame, path: str) -> None:
    """Decisions, audits, errors or digest rows by run; a repeated run replaces its own part."""
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_date")
        .parquet(path)
    )
