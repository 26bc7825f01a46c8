"""Helpers of the corpus operators: tables, word hashes over bytes, groups of linked rows."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import written

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Return freed memory to the system: both allocators keep it otherwise, and a worker serves many operators."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over the batches of a task, which gives back at its end what it freed."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def kept(name: str, key: object, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once in a Python process for the last name and key.

    What is kept under another name belongs to an operator that ran before in the process, and goes. Helpers travel to the executors by value, with fresh globals for every task, so what should outlive
    a task hangs on a module that every process has.
    """
    store = sys.__dict__.setdefault("_kept_over_tasks", {})
    if name not in store or store[name][0] != key:
        if store:
            store.clear()
            gc.collect()
            give_back()
        store[name] = (key, make())
    return store[name][1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse; those of the longest text so far are kept."""
    def made() -> tuple[np.ndarray, np.ndarray]:
        up, down = np.full(n, _BASE, _U), np.full(n, _BASE_INVERSE, _U)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)

    known = kept("powers", "base", made)
    if len(known[0]) < n:
        known = made()
        sys.__dict__["_kept_over_tasks"]["powers"] = ("base", known)
    return known


def spans_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every span values[start:end], the same wherever the span stands."""
    size = 1 << max(10, int(len(values)).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], dtype=_U, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word, a run of bytes other than blank, tab and line ends."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_IS_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(raw: bytes, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of every word of a UTF-8 text, in order; ``lower`` folds A to Z first."""
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.zeros(0, _U)
    if lower:
        data = _LOWER[data]
    starts, ends = word_bounds(data)
    return spans_hashes(data.astype(_U) + _U(1), starts, ends)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` consecutive words; none where there are fewer."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    starts = np.arange(n)
    return spans_hashes(words, starts, starts + size)


def raw_texts(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow text column; null reads as empty."""
    return [x or b"" for x in column.cast("binary").to_pylist()]


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most so many rows, so that no more of them are Python values at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


SLOTS = 1 << 18


def slot_bits(slots: DataFrame) -> DataFrame:
    """One row (bits): a bit for each of the ``SLOTS`` slots that the column ``slot`` has."""
    own = slots.groupBy(F.shiftright("slot", 6).cast("long").alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, slot % 64)")).alias("bits"))
    every = slots.sparkSession.range(SLOTS // 64).join(own, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")).alias("w"))
    return every.agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["bits"]).alias("bits"))


def has_bit(bits: str, slot: Column) -> Column:
    """Whether the slot is among those of ``slot_bits``."""
    return F.get(F.col(bits), F.shiftright(slot, 6)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), slot % 64)) != 0


def mark() -> Column:
    """With doc_id, what a row is known by: rows with both equal have equal texts."""
    return F.xxhash64("text")


def marked_rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, mark): the columns of ``docs`` in one, where no name of theirs meets a helper's."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id"), mark().alias("mark"))


def touched(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` that may have a key (doc_id, mark), as ``marked_rows``, and all other rows as they are.

    Keys fall in ``SLOTS`` slots by hash, and the table of occupied slots, bounded by that number, is
    broadcast. So a join on a few keys does not shuffle every text. With more keys than slots nearly all rows
    are in the first part, and the join shuffles all texts: whole, but no longer cheap.
    """
    slot = F.pmod(F.xxhash64("doc_id", "mark"), F.lit(SLOTS)).cast("int")
    occupied = F.broadcast(keys.select(slot.alias("slot")).distinct())
    rows = marked_rows(docs).withColumn("slot", slot)
    return rows.join(occupied, "slot", "left_semi").drop("slot"), rows.join(occupied, "slot", "left_anti").select("row.*")


def join_rows(rows: DataFrame, keys: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``keys`` by doc_id and mark, which both have; a null id fits a null id."""
    own = keys.withColumnsRenamed({"doc_id": "key_id", "mark": "key_mark"})
    return rows.join(own, F.expr("doc_id <=> key_id AND mark = key_mark"), how).drop("key_id", "key_mark")


def linked_groups(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id of the edges (a, b) reaches.

    Every round links the larger neighbours of an id, then its smaller ones, to the smallest id
    near it, which halves distances. Rounds write their edges to the shared folder, so a lost
    executor costs no more than the round, and the driver sees two numbers a round.
    """
    both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now, seen = written(both, "edges"), None
    while True:
        ways = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = ways.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                            F.col("m").alias("b"))
        now = written(small.where("a <> b").distinct(), "edges")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("b").alias("id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component"))
    )
