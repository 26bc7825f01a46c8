"""Versions of several tables, told by a manifest.

A version is a list of parts: folders of rows, each belonging to a table and maybe to one hash bucket of
a key. Rows go to folders with new names; the manifest, a single file written last, makes them a version.
So a job that dies leaves the version before as it was, one that runs again writes the same version anew,
and parts that did not change are named by many versions without being read or written. Folders that none
of the newest versions name are removed.

One writer at a time is assumed. A manifest has as many rows as there are parts, so buckets and parts a
bucket bound what the driver holds.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import astuple, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MANIFEST = "table string, bucket int, folder string, schema string"
WHOLE = -1  # the bucket of a part that is not one of buckets


@dataclass(frozen=True)
class Part:
    table: str
    bucket: int
    folder: str
    schema: str


def _files(spark: SparkSession, path: str):
    """The file system of a path and the path in its terms."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _children(spark: SparkSession, path: str) -> list[str]:
    files, at = _files(spark, path)
    return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []


def _remove(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_part(rows: DataFrame, root: str, table: str) -> list[Part]:
    """Rows as one part."""
    folder = f"{root}/data/{table}/{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    return [Part(table, WHOLE, folder, rows.schema.json())]


def write_buckets(rows: DataFrame, root: str, table: str, key: str, buckets: int, spread: str, files: int = 8) -> list[Part]:
    """Rows as one part for each bucket of ``key`` that has any; a bucket's rows go to several files by ``spread``.

    So a key that a third of the rows share is no single task or file.
    """
    folder = f"{root}/data/{table}/{uuid.uuid4().hex}"
    placed = rows.withColumn("bucket", bucket_of(key, buckets))
    placed.repartition(F.col("bucket"), F.pmod(F.xxhash64(spread), F.lit(files))).write.partitionBy("bucket").parquet(folder)
    found = [c for c in _children(rows.sparkSession, folder) if c.startswith("bucket=")]
    schema = rows.schema.json()
    return [Part(table, int(c.removeprefix("bucket=")), f"{folder}/{c}", schema) for c in sorted(found)]


def read_parts(spark: SparkSession, parts: Iterable[Part], table: str) -> DataFrame | None:
    """The rows of a table, or nothing if no part has any. A column that a part lacks is null there."""
    by_schema: dict[str, list[str]] = {}
    for p in parts:
        if p.table == table:
            by_schema.setdefault(p.schema, []).append(p.folder)
    if not by_schema:
        return None
    read = [spark.read.schema(StructType.fromJson(json.loads(s))).parquet(*folders) for s, folders in by_schema.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read)


def publish(spark: SparkSession, root: str, version: int, parts: Iterable[Part]) -> None:
    """Make the parts the given version. The one file of the manifest appears as a whole or not at all."""
    rows = spark.createDataFrame([astuple(p) for p in parts], _MANIFEST).coalesce(1)
    rows.write.mode("overwrite").parquet(f"{root}/manifests/version={version}")


def versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions, oldest first."""
    found = [c for c in _children(spark, f"{root}/manifests") if c.startswith("version=")]
    whole = [c for c in found if "_SUCCESS" in _children(spark, f"{root}/manifests/{c}")]
    return sorted(int(c.removeprefix("version=")) for c in whole)


def parts_of(spark: SparkSession, root: str, version: int) -> list[Part]:
    rows = spark.read.schema(_MANIFEST).parquet(f"{root}/manifests/version={version}").collect()
    return [Part(*r) for r in rows]


def newest(spark: SparkSession, root: str, before: int | None = None) -> tuple[int | None, list[Part]]:
    """The newest complete version, if given below ``before``, and its parts."""
    known = [v for v in versions(spark, root) if before is None or v < before]
    return (known[-1], parts_of(spark, root, known[-1])) if known else (None, [])


def read_table(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame | None:
    """A table of the newest version, or of the given one."""
    parts = newest(spark, root)[1] if version is None else parts_of(spark, root, version)
    return read_parts(spark, parts, table)


def remove_old(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Remove versions but the newest ``keep``, and all folders that none of those names."""
    known = versions(spark, root)
    live = {p.folder for v in known[-keep:] for p in parts_of(spark, root, v)}
    for v in known[:-keep]:
        _remove(spark, f"{root}/manifests/version={v}")
    for table in _children(spark, f"{root}/data"):
        for attempt in _children(spark, f"{root}/data/{table}"):
            folder = f"{root}/data/{table}/{attempt}"
            if folder in live:
                continue
            below = [f"{folder}/{c}" for c in _children(spark, folder) if c.startswith("bucket=")]
            if not live.intersection(below):
                _remove(spark, folder)
            else:
                for old in set(below) - live:
                    _remove(spark, old)
