"""First-row-per-key and exact numbering, both safe for a key that holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written


def compute_once(df: DataFrame, fields: Column, keep) -> DataFrame:
    """Add the fields of a struct, keeping rows that pass ``keep(struct)``.

    A filter on a computed column is pushed below the projection and computes it again; a
    generator over a list of no or one struct computes it once.
    """
    rows = F.filter(F.array(fields), keep)
    return df.select("*", F.explode(rows).alias("_once")).select(*df.columns, "_once.*")


def first_by(df: DataFrame, keys: list, order: list) -> DataFrame:
    """Keep the first row of every key.

    A rank filter on a window is pushed below the shuffle, so a hot key sends one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_by(df: DataFrame, keys: list, order: list, n: int) -> DataFrame:
    """First ``n`` rows of every key, numbered in ``position``; ``n`` is a small constant."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def number_rows(df: DataFrame, keys: list[str], order: list, name: str, bucket: Column | None = None) -> DataFrame:
    """Exact 1-based row number per key without one task holding a whole key.

    With ``bucket``: a column that does not decrease along ``order`` and holds a bounded number of
    rows per value, such as a range of a unique id. Rows are numbered inside (key, bucket), and a
    bucket starts after the counts of the buckets before it.

    Without it the rows are sorted over the cluster by ranges of key and order, so a hot key spreads
    over many ranges, and written once to the shared folder, which fixes the ranges.
    """
    if bucket is None:
        placed = df.orderBy(*keys, *order).withColumn("_id", F.monotonically_increasing_id())
        cut = written(placed, "numbered").withColumn("_bucket", F.shiftright("_id", 33))
    else:
        cut = df.withColumn("_bucket", bucket)
    # A struct of the keys is never null, so counting and joining treat absent keys alike.
    cut = cut.withColumn("_key", F.struct(*keys))
    starts = F.min("_id") if bucket is None else F.lit(0).cast("long")
    counts = cut.groupBy("_key", "_bucket").agg(F.count(F.lit(1)).alias("_n"), starts.alias("_start"))
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_key", "_bucket", "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    if bucket is None:
        placed_in = cut.join(offsets, ["_key", "_bucket"])
        inside = F.col("_id") - F.col("_start") + 1
    else:
        w = Window.partitionBy("_key", "_bucket").orderBy(*order)
        placed_in = cut.withColumn("_nth", F.row_number().over(w)).join(offsets, ["_key", "_bucket"])
        inside = F.col("_nth")
    return placed_in.withColumn(name, F.col("_offset") + inside).drop(
        "_key", "_bucket", "_id", "_nth", "_start", "_offset"
    )
