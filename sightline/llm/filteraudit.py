"""What every filter removes in every order of a set of filters.

A row fails some of the filters, its mask. For an order of the filters the removal step of a row is
the smallest place of a filter that it fails. As matrices over (minimum, plus): masks as rows of 0 for
a failed filter and of "never" for a passed one, combined with the places that every order gives to the
filters, the inverse permutations.

Rows with equal masks are removed alike, so the masks are counted first, by part and in every task, with
their weights. At most ``2 ** filters`` rows a part meet the orders, whatever the number of rows. The
removal steps then deal these weights to the steps (removed, kept after), and from the masks follow
what a filter would have removed had it come first (redundant) and what no other filter removes.

The filter on copies fails a text that stands under a smaller id anywhere in the table. Ids and digests of
texts are counted in the tasks first; the smallest id of a digest is an aggregate, and its rows are
found again by id and digest, so a text that a third of the rows share is never one group.

Edge cases: a null text is empty; a null part is the empty string and the same part as one; rows with a
null id, or with the smallest id of their text (repeated rows too), are no copies, and null ids have no
label; a label row counts for its id if any row of that id has the mark; an empty table gives no rows;
other columns are left out, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COPY = "E"


def conditions() -> dict[str, Column]:
    """Filters on one row: the condition on its ``text`` under which it fails."""
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    n, chars = F.size(words), F.length("text")
    upper = chars - F.length(F.translate("text", UPPER, ""))
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n.cast("long"),
        "C": 100 * upper.cast("long") > 3 * chars.cast("long"),
        "D": F.col("text").rlike(r"[#$%&*|]"),
    }


def _bit(letters: str, letter: str) -> int:
    return 1 << letters.index(letter)


def masks(docs: DataFrame, letters: str, own: dict[str, Column]) -> DataFrame:
    """(doc_id, part, mask, n): rows counted by the filters that they fail."""
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    mask = sum((F.when(fails, _bit(letters, x)).otherwise(0) for x, fails in own.items()), F.lit(0))
    rows = written(rows.select("doc_id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "masks")
    counted = rows.where("doc_id is not null").groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    copied = F.when(F.col("first").isNull(), F.lit(_bit(letters, COPY))).otherwise(F.lit(0))
    counted = counted.join(first, ["doc_id", "digest"], "left").select("doc_id", "part", F.col("mask").bitwiseOR(copied).alias("mask"), "n")
    # Rows without an id meet no other table.
    unnamed = rows.where("doc_id is null").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"))
    return counted.unionByName(unnamed.withColumn("doc_id", F.lit(None).cast(rows.schema["doc_id"].dataType)))


def weighed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows of ``masks`` and those among them that the labels mark."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    named = rows.where("doc_id is not null").join(marks, "doc_id", "left")
    none = rows.where("doc_id is null").select("*", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return named.unionByName(none).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *(F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")))


def removals(counts: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step, from (part, mask, n, good, toxic)."""
    size = len(letters)
    never = size + 1
    orders = F.array(*(
        F.struct(F.lit("".join(order)).alias("filter_order"), F.array(*(F.lit(order.index(x) + 1) for x in letters)).alias("places"))
        for order in permutations(letters)))
    fails = F.array(*(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.lit(0)).otherwise(F.lit(never)) for i in range(size)))
    rows = counts.withColumn("fails", fails).select("*", F.explode(orders).alias("o")).select("part", "mask", "n", "good", "toxic", "fails", "o.*")
    rows = rows.withColumn("gone", F.array_min(F.zip_with("fails", "places", lambda a, b: a + b)))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(size))))
    rows = rows.withColumn("bit", F.expr(f"shiftleft(1, instr('{letters}', substring(filter_order, step, 1)) - 1)"))
    here, failing = F.col("gone") == F.col("step"), F.col("mask").bitwiseAND(F.col("bit")) != 0

    def total(what: str, where: Column) -> Column:
        return F.sum(F.when(where, F.col(what)).otherwise(0)).cast("long")

    report = rows.groupBy("part", "filter_order", "step", "bit").agg(
        total("n", F.col("gone") > F.col("step")).alias("kept"),
        total("n", here).alias("removed"),
        total("n", failing & (F.col("gone") < F.col("step"))).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
    )
    # A filter stands once in every order: as many rows a group as there are orders.
    return report.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def audit(docs: DataFrame, labels: DataFrame, own: dict[str, Column] | None = None) -> DataFrame:
    """The report on the filters ``own`` (conditions on ``text``) and the one on copies, by lang.

    The orders are all permutations, so the number of filters should stay small.
    """
    own = conditions() if own is None else own
    letters = "".join(sorted({*own, COPY}))
    return removals(weighed(masks(docs, letters, own), labels), letters)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
firsts AS (SELECT t, min(doc_id) AS low FROM texts GROUP BY t),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
docs AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN texts.doc_id > low THEN 'E' ELSE '' END) AS fails
  FROM texts JOIN firsts USING (t) LEFT JOIN marks ON texts.doc_id = marks.doc_id),
counted AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM docs GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
judged AS (
  SELECT part, filter_order, step, own, fails, n, good, toxic, contains(fails, own) AS now,
    regexp_matches(fails, '[' || earlier || 'x]') AS before
  FROM counted, steps),
report AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN NOT now AND NOT before THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN now AND NOT before THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN now AND before THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN now AND NOT before THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN now AND NOT before THEN toxic ELSE 0 END) AS toxic_lost
  FROM judged GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM report
"""
