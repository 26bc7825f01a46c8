"""Repeated passages: seed and extend over winnowed anchors.

A passage is repeated when a window of ``size`` words (35) of it stands elsewhere too, in another
text or the same one. Every word that such a window covers is removed; windows are judged on the
input.

1. Seeds. In every window the run of ``seed`` words with the smallest hash is its anchor (the first
   of equal ones). Equal windows have equal anchors, so windows whose anchor stands only once in the
   corpus are unique. The windows that share an anchor occurrence form one stretch, known by the
   hash of the anchor and the hash of all its words.
2. Joins. Anchors are counted by hash and the repeated ones joined back; stretches with equal words
   are repeated from end to end, which extends a match over all windows of both at once.
3. Ends of matches. A stretch that stands once, but has the anchor of others, is extended window by
   window: its windows are counted against those of one occurrence of every stretch with that
   anchor. What is covered in the end are the maximal repeats of at least ``size`` words.

Texts with equal word rows are one class, removed whole; a task gives the anchors of a class once,
so a hot text does not multiply. Counting aggregates before the shuffle, and joins can be split.
Windows are compared by 64-bit hashes: two different ones are taken for equal with a chance of 2^-57.

Edge cases: null and empty texts have no words; texts shorter than a window lose nothing; repeated
rows and equal texts under several ids are copies; empty tables give empty results; other columns
are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, join_rows, mark, mix, raw_texts, spans_hashes, tidy, touched, window_hashes, word_bounds, word_hashes, written

_U = np.uint64
SIZE, SEED = 35, 8
_SEEN = 200_000
_DIGEST = "doc_id long, mark long, n_words long, n_removed long, kept_sha256 string"


def anchor_of_windows(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Start of the anchor of every window of ``size`` words."""
    grams = window_hashes(words, seed)
    width = size - seed + 1
    if len(grams) < width:
        return np.zeros(0, np.int64)
    # Position of the smallest hash in every run of ``width``: runs of doubling length, two of which
    # cover a run of the full length. The earlier of equal ones wins.
    best, reach = np.arange(len(grams)), 1
    while reach * 2 <= width:
        a, b = best[:-reach], best[reach:]
        best = np.where(grams[a] <= grams[b], a, b)
        reach *= 2
    a, b = best[: len(grams) - width + 1], best[width - reach:]
    return np.where(grams[a] <= grams[b], a, b)


def stretches(words: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window, anchor hash and hash of all words, of the windows of one anchor."""
    anchors = anchor_of_windows(words, size, seed)
    if not len(anchors):
        none = np.zeros(0, np.int64)
        return none, none, none.view(_U), none.view(_U)
    first = np.flatnonzero(np.diff(anchors, prepend=-1))
    last = np.append(first[1:], len(anchors)) - 1
    inside = (anchors[first] - first).astype(_U)
    whole = mix(spans_hashes(words, first, last + size) + inside)
    return first, last, window_hashes(words, seed)[anchors[first]], whole


def text_words(raw: bytes) -> list[bytes]:
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return []
    starts, ends = word_bounds(data)
    return [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def seeded(docs: DataFrame, size: int, seed: int) -> DataFrame:
    """Words, digest and stretches of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            n, shas, lists = [], [], []
            for raw in raw_texts(batch["text"]):
                words = word_hashes(raw)
                sha = digest(text_words(raw))
                n.append(len(words))
                shas.append(sha)
                lists.append(None if sha in seen else stretches(words, size, seed))
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(sha)
            none = np.zeros(0, np.int64)
            offsets = np.cumsum([0, *(0 if x is None else len(x[0]) for x in lists)]).astype(np.int32)
            flat = [np.concatenate([none, *(x[i].view(np.int64) for x in lists if x is not None)]) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()), batch["mark"], pa.array(n, pa.int64()), pa.array(shas, pa.string()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
                     [pa.array(flat[0].astype(np.int32)), pa.array(flat[1].astype(np.int32)), pa.array(flat[2]), pa.array(flat[3])],
                     ["first", "last", "anchor", "whole"]))],
                ["doc_id", "mark", "n", "sha", "runs"])

    rows = docs.select("doc_id", "text", mark().alias("mark"))
    return rows.mapInArrow(tidy(run), "doc_id long, mark long, n long, sha string, runs array<struct<first:int,last:int,anchor:long,whole:long>>")


def placed_texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Texts with the rows of ``places`` (doc_id, mark, ...), equal ones once."""
    texts = touched(docs.select("doc_id", "text"), places)[0]
    return join_rows(texts, places).withColumn("text", F.col("row.text")).drop("row").dropDuplicates(["doc_id", "mark"])


def repeated(docs: DataFrame, size: int = SIZE, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, ranges): every text with its class, and the ranges of words that are repeated.

    ``ranges`` has doc_id, mark and a list of (start, end) words for texts that lose a part and
    ``rows`` has n words, sha of the kept words if nothing is removed, and ``copied`` if all is.
    """
    rows = written(seeded(docs, size, seed), "stretches")
    copies = rows.where(F.col("n") >= size).groupBy("sha").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("sha", F.lit(True).alias("copied"))
    runs = rows.select("doc_id", "mark", F.explode("runs").alias("r")).select("doc_id", "mark", "r.*")
    # Written before the join, which can then be split where an anchor is hot.
    counted = written(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors")
    seeds = written(runs.join(counted, "anchor"), "seeds")
    one = F.xxhash64("doc_id", "mark", "first")
    wholes = written(seeds.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("times"), F.min(one).alias("one")), "wholes")
    several = wholes.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("anchor", F.lit(True).alias("several"))
    wholes = written(wholes.join(several, "anchor", "left"), "wholes")
    judged = seeds.join(wholes, ["anchor", "whole"])
    judged = written(judged.select(
        "doc_id", "mark", "first", "last", (F.col("times") > 1).alias("full"),
        (F.coalesce("several", F.lit(False)) & (F.col("one") == one)).alias("ends"),
    ).where("full or ends"), "judged")
    # Windows of the stretches that must be taken one by one.
    ends = judged.where("ends").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "last")).alias("ends"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            sizes = [len(h[0]) for h in held]
            columns = [np.concatenate([h[0] for h in held]), np.repeat([h[2] for h in held], sizes), np.concatenate([h[3] for h in held])]
            ids = pa.array([h[1] for h in held], pa.int64()).take(pa.array(np.repeat(np.arange(len(held)), sizes)))
            return pa.RecordBatch.from_arrays([pa.array(columns[0]), ids, pa.array(columns[1]), pa.array(columns[2])], ["window", "doc_id", "mark", "first"])

        for batch in batches:
            for doc_id, of_text, raw, spans in zip(batch["doc_id"].to_pylist(), batch["mark"].to_pylist(), raw_texts(batch["text"]), batch["ends"], strict=True):
                found = window_hashes(word_hashes(raw), size)
                first, last = (spans.values.field(i).to_numpy() for i in (0, 1))
                at = np.repeat(first - np.concatenate(([0], np.cumsum(last - first + 1)[:-1])), last - first + 1) + np.arange((last - first + 1).sum())
                held.append((found[at].view(np.int64), doc_id, of_text, at.astype(np.int32)))
                if sum(len(h[0]) for h in held) > 50_000:
                    yield flushed()
                    held.clear()
        if held:
            yield flushed()

    single = placed_texts(docs, written(ends, "ends"))
    single = written(single.mapInArrow(tidy(windows), "window long, doc_id long, mark long, first int"), "windows")
    twice = written(single.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window"), "twice")
    alone = single.join(twice, "window").select("doc_id", "mark", "first", F.col("first").alias("last"))
    both = judged.where("full").select("doc_id", "mark", "first", "last").unionByName(alone)
    spans = both.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"))
    rows = rows.select("doc_id", "mark", "n", "sha").join(copies, "sha", "left").withColumn("copied", F.coalesce("copied", F.lit(False)))
    return rows, written(spans, "spans")


def cover(spans: list[dict], n: int, size: int) -> np.ndarray:
    """Which words the windows of the spans cover."""
    edges = np.zeros(n + 1, np.int64)
    first = np.array([s["first"] for s in spans])
    last = np.array([s["last"] for s in spans])
    np.add.at(edges, first, 1)
    np.add.at(edges, last + size, -1)
    return np.cumsum(edges[:-1]) > 0


def trimmed(docs: DataFrame, size: int = SIZE, seed: int = SEED) -> DataFrame:
    """(doc_id, mark, n_words, n_removed, kept_sha256) of every row of (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    rows, spans = repeated(docs, size, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas = [], []
            for raw, of in zip(raw_texts(batch["text"]), batch["spans"].to_pylist(), strict=True):
                words = text_words(raw)
                gone = cover(of, len(words), size)
                removed.append(int(gone.sum()))
                shas.append(digest([w for w, x in zip(words, gone.tolist(), strict=True) if not x]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["mark"], pa.array(removed, pa.int64()), pa.array(shas, pa.string())],
                                             ["doc_id", "mark", "removed", "kept"])

    parts = placed_texts(docs, spans).select("doc_id", "mark", "text", "spans").mapInArrow(tidy(run), "doc_id long, mark long, removed long, kept string")
    out = join_rows(rows, parts, "left")
    whole = F.lit(digest([]))
    return out.select(
        "doc_id", "mark", F.col("n").alias("n_words"),
        F.when(F.col("copied"), F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copied"), whole).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, size: int = SIZE, seed: int = SEED) -> DataFrame:
    """``docs`` less the repeated words, with ``n_chars`` of what is kept; texts left without a word go.

    Texts that lose nothing stay as they are; in others single blanks stand between the kept words.
    """
    rows, spans = repeated(docs.select("doc_id", "text"), size, seed)
    whole = written(rows.where("copied").select("doc_id", "mark").distinct(), "copied")
    part, rest = touched(docs, spans.select("doc_id", "mark").unionByName(whole))
    part = join_rows(part, whole, "left_anti")
    part = join_rows(part, spans, "left")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            fields = dict(zip(names, batch["row"].flatten(), strict=True))
            for text, of in zip(fields["text"], batch["spans"].to_pylist(), strict=True):
                if not of:
                    kept.append(text.as_py())
                    continue
                words = text_words((text.as_py() or "").encode())
                gone = cover(of, len(words), size)
                kept.append(b" ".join(w for w, x in zip(words, gone.tolist(), strict=True) if not x).decode())
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()) if c == "text" else fields[c] for c in names], names)

    cut = part.select("row", "spans").mapInArrow(tidy(run), docs.schema).where(F.col("text").isNull() | (F.col("text") != ""))
    both = cut.unionByName(rest)
    return both.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else both


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trimmed(documents(spark, sf_dir)).drop("mark")
