"""URL filter rules as a sort-merge range join over reversed-host keys.

The labels of a host in reverse order, each closed by a dot, make a key on which "this host and all
its subdomains" is one interval: all keys that begin with the rule's. URLs and rules are dealt to
the same key ranges, a rule to every range its interval touches, and each range is swept once in
key order with a stack of the rules still open.

A key that fills several ranges (a hot host or page) is spread over them by a hash of the row.

Edge cases: a null URL or one without ``://`` has an empty host and path, which no rule fits; empty
tables give empty results; repeated rows are judged one by one; of rules with equal host and path
the smallest verdict in text order wins; other columns of the input are left out.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LAST = "\U0010ffff"
_ROWS = "page_id long, host string, path string, rule string, verdict string"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a URL; both empty without ``://``."""
    rest = F.when(F.contains(url, F.lit("://")), F.expr("substr({0}, instr({0}, '://') + 3)".format("url")))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", sample: int = 10_000) -> DataFrame:
    """Rule and verdict of every page.

    ``rules`` has ``host, path, verdict``. Of the fitting rules the longest (host and path together)
    wins; ``default`` is the verdict without one. ``sample`` is about the number of rows from which the
    range limits are read; they affect balance only.
    """
    spark = pages.sparkSession
    host, path = host_path(F.col("url"))
    urls = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", F.concat(host_key(F.col("host")), "path")).withColumn(
        "mark", F.xxhash64("page_id", "host", "path", F.monotonically_increasing_id()))
    ranges = partitions(spark)
    every = max(1, pages.count() // sample)  # so that about ``sample`` rows reach the driver, at most twice as many
    drawn = [r.key for r in urls.where(F.pmod("mark", F.lit(every)) == 0).select("key").collect()]
    drawn.sort()
    limits = [drawn[len(drawn) * i // ranges] for i in range(1, ranges)] if drawn else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = []
            for key, mark in zip(batch["key"].to_pylist(), batch["mark"].to_pylist(), strict=True):
                low, high = bisect_left(limits, key), bisect_right(limits, key)
                at.append(low + mark % (high - low + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), *(batch[c] for c in ("key", "page_id", "host", "path"))],
                ["at", "key", "page_id", "host", "path"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (at, r["key"], r["host"], r["path"], r["verdict"])
                for r in batch.to_pylist()
                for at in range(bisect_left(limits, r["key"]), bisect_right(limits, r["key"] + _LAST) + 1)
            ]
            columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 5
            kinds = [pa.int32(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["at", "key", "host", "path", "verdict"])

    none = F.lit(None).cast
    dealt = urls.mapInArrow(deal, "at int, key string, page_id long, host string, path string").select(
        "at", "key", F.lit(1).alias("kind"), "page_id", "host", "path", none("string").alias("verdict"))
    keyed = rules.select("host", "path", "verdict").where("host is not null and path is not null")
    keyed = keyed.select(host_key(F.col("host")).alias("key"), "host", "path", "verdict")
    opened = keyed.mapInArrow(spread, "at int, key string, host string, path string, verdict string").select(
        "at", "key", F.lit(0).alias("kind"), none("long").alias("page_id"), "host", "path", "verdict")
    events = dealt.unionByName(opened).repartitionById(ranges, F.col("at")).sortWithinPartitions(
        "at", "key", "kind", "path", "verdict")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rules: list[tuple[str, str, str, str]] = []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                while open_rules and not r["key"].startswith(open_rules[-1][0]):
                    open_rules.pop()
                if r["kind"] == 0:
                    open_rules.append((r["key"], r["path"], r["host"] + r["path"], r["verdict"]))
                    continue
                fits = [x for x in open_rules if r["path"].startswith(x[1])]
                best = min(fits, key=lambda x: (-len(x[2]), x[2], x[3]), default=None)
                out.append((r["page_id"], r["host"], r["path"], *(best[2:] if best else (None, default))))
            columns = [list(c) for c in zip(*out, strict=True)] or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, [pa.int64(), *[pa.string()] * 4], strict=True)],
                ["page_id", "host", "path", "rule", "verdict"])

    return events.mapInArrow(sweep, _ROWS)


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


_FIT = " ".join(
    f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{h}{p}'"
    for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1]))
)
SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, coalesce(rest, '') AS rest FROM cut)
), fitted AS (SELECT *, CASE {_FIT} END AS rule FROM parts)
SELECT page_id, host, path, rule,
       CASE {" ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in RULES)} ELSE 'allow' END AS verdict
FROM fitted
"""
