"""Exact n-gram Jaccard self-join by parity sketches.

A text's set holds the hashes of its distinct word shingles. Two sets link when
``den * intersection >= num * union``, so the sets differ in at most
d = (a + b) * (den - num) / (den + num) shingles.

1. Texts with equal sets are one class (an aggregate on a digest); only classes are compared.
2. Size bands: a pair belongs to the band of its smaller set, which bounds d. The shingles of a set
   are dealt by hash to d + 1 + e parts, each XOR-hashed to one word of the band's sketch. Shingles
   in which two sets differ spoil at most d words, so at least e + 1 words agree. Words of parts with
   few shingles say little (of none: nothing), so those of the e weakest parts are left out. Of e + 1
   agreeing parts the strongest has e weaker ones in either set, so its word is kept in both.
3. Words that more than one class has make the candidates (``shared_words``). First every class is verified against
   the one with which it shares most words as their smallest member, and links make components.
4. Then the groups that still hold several components are compared in blocks of bounded size with
   a second, single-bit parity sketch: its Hamming distance is at most the symmetric difference,
   so a pair beyond d cannot link. First a forest of the pairs that pass is verified, then every
   pair that passes between the components that are left. After that no link between two
   components can exist.

Verification counts shared shingles of the two texts. A hot class is one row; a word that many
classes share is split in blocks, whose pairs stay inside the task unless they pass.

Shingles are 64-bit hashes: two different shingles are taken for one with a chance of 2^-64 a pair.

Edge cases: a null or empty text, or one without words, has an empty set and no links; repeated rows
are one class; equal doc_id values with different texts are different classes; a null doc_id is
never the smallest unless alone; empty tables give empty results; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import (
    SLOTS, documents, has_bit, join_rows, linked_groups, mark, mix, partitions, pieces, raw_texts, slot_bits, tidy, touched, window_hashes, word_hashes, written,
)

_U = np.uint64
BLOCK = 2048
_SAMPLED = 256
_SEEN = 200_000
_NONE = np.zeros(0, np.int64)


def shingle_set(raw: bytes, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of a shorter text, the hash of all its words."""
    words = word_hashes(raw, lower=True)
    return np.unique(window_hashes(words, min(size, max(1, len(words)))))


class Bands:
    """Size bands for a threshold of num / den and the sketches of sets in them."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self._bands: list[tuple[int, int, int, int]] = []

    def distance(self, both: int) -> int:
        """Most differing shingles of a linked pair with so many shingles in all."""
        return both * (self.den - self.num) // (self.den + self.num)

    def band(self, k: int) -> tuple[int, int, int, int]:
        """Smallest size, first size above, parts, and agreeing words beyond the first of band ``k``."""
        while len(self._bands) <= k:
            low = self._bands[-1][1] if self._bands else 1
            high = max(low + 1, low * 3 // 2)
            d = self.distance(high - 1 + (high - 1) * self.den // self.num)
            spare = (d + 1) // 2 + 1
            self._bands.append((low, high, d + 1 + spare if d else 0, spare))
        return self._bands[k]

    def of(self, n: int) -> list[int]:
        """Bands of the pairs that a set of ``n`` can be in: as the smaller one, or as the larger."""
        k = 0
        while self.band(k)[1] <= n:
            k += 1
        out = [k]
        while k and n * self.num <= (self.band(k - 1)[1] - 1) * self.den:
            k -= 1
            out.append(k)
        return out

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """Keys of the sketch words by which a set is joined."""
        out = []
        for k in self.of(len(hashes)):
            _, _, parts, spare = self.band(k)
            if not parts:
                continue  # only equal sets can link here
            part = (mix(hashes ^ _U(k + 1)) % _U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            counts = np.bincount(part, minlength=parts)
            full = np.flatnonzero(counts)
            xors = np.zeros(parts, _U)
            xors[full] = np.bitwise_xor.reduceat(hashes[order], (np.cumsum(counts) - counts)[full])
            at = np.argsort(counts, kind="stable")[spare:]  # ties by part number, as in every other set
            out.append(mix(xors[at] ^ mix(at.astype(_U) + _U(k << 40))))
        return np.concatenate(out) if out else np.zeros(0, _U)

    def bits(self, hashes: np.ndarray) -> bytes:
        """One parity bit a shingle, at least four bits for every difference a link allows."""
        size = 1 << max(9, (4 * self.distance(2 * len(hashes))).bit_length())
        at = (mix(hashes ^ _U(0x5851F42D4C957F2D)) & _U(size - 1)).astype(np.int64)
        return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8)).tobytes()


def sketched(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(doc_id, mark of the text, set size, class, bits, words) of every row.

    A task gives the words of a class once, so those of a hot class come once from each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), set()
        for batch in pieces(batches):
            n, classes, bits, words = [], [], [], []
            for raw in raw_texts(batch["text"]):
                found = shingle_set(raw, size)
                n.append(len(found))
                digest = hashlib.blake2b(found.tobytes(), digest_size=8).digest()
                classes.append(int.from_bytes(digest, "little", signed=True))
                bits.append(bands.bits(found) if len(found) else b"")
                words.append(bands.words(found).view(np.int64) if len(found) and digest not in seen else _NONE)
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(digest)
            offsets = np.cumsum([0, *map(len, words)]).astype(np.int32)
            values = np.concatenate(words) if words else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()), batch["mark"], pa.array(n, pa.int64()), pa.array(classes, pa.int64()),
                 pa.array(bits, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                ["doc_id", "mark", "n", "class", "bits", "words"])

    rows = docs.select("doc_id", "text", mark().alias("mark"))
    return rows.mapInArrow(tidy(run), "doc_id long, mark long, n long, class long, bits binary, words array<long>")


def within(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) of classes whose bits allow a link."""
    for end in "ab":
        pairs = pairs.join(classes.select(F.col("class").alias(end), F.col("n").alias(f"n_{end}"), F.col("bits").alias(f"bits_{end}")), end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ends = (batch[c].to_pylist() for c in ("bits_a", "bits_b", "n_a", "n_b"))
            keep = [int(_distances([x, y])[0]) * (den + num) <= (n + m) * (den - num) for x, y, n, m in zip(*ends, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(tidy(run), "a long, b long")


def _folded(bits: list[bytes]) -> np.ndarray:
    """Parity bits of several sets at the width of the narrowest."""
    width, out = min(map(len, bits)), []
    for raw in bits:
        words = np.frombuffer(raw, _U)
        while len(words) * 8 > width:
            words = words[: len(words) // 2] ^ words[len(words) // 2:]
        out.append(words)
    return np.array(out)


def _distances(bits: list[bytes]) -> np.ndarray:
    """Hamming distance of the first set's bits to those of the others."""
    folded = _folded(bits)
    return np.bitwise_count(folded[1:] ^ folded[0]).sum(axis=1, dtype=np.int64)


def verified(pairs: DataFrame, places: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Those pairs of classes (a, b) whose texts link. ``places``: one (doc_id, mark) of each class.

    Only texts that may be in a pair are shuffled.
    """
    def place(end: str) -> DataFrame:
        return places.select(F.col("class").alias(end), F.col("doc_id").alias(f"doc_{end}"), F.col("mark").alias(f"mark_{end}"))

    pairs = written(pairs.join(place("a"), "a").join(place("b"), "b"), "pairs")
    ends = pairs.select(F.col("doc_a").alias("doc_id"), F.col("mark_a").alias("mark")).unionByName(
        pairs.select(F.col("doc_b").alias("doc_id"), F.col("mark_b").alias("mark")))
    texts = touched(docs.select("doc_id", "text"), ends)[0]

    found = pairs
    for end in "ba":
        own = texts.select(F.col("doc_id").alias("id"), F.col("mark").alias("of"), F.col("row.text").alias(f"text_{end}"))
        found = found.join(own, F.expr(f"doc_{end} <=> id AND mark_{end} = of")).drop("id", "of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in pieces(batches):
            keep = []
            for raw_a, raw_b in zip(raw_texts(batch["text_a"]), raw_texts(batch["text_b"]), strict=True):
                if raw_a != last:
                    last, left = raw_a, shingle_set(raw_a, size)
                right = shingle_set(raw_b, size)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(den * both >= num * (len(left) + len(right) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return found.select("a", "b", "text_a", "text_b").mapInArrow(tidy(run), "a long, b long").distinct()


def unsettled(shared: DataFrame, classes: DataFrame, components: DataFrame, num: int, den: int, every: bool) -> DataFrame:
    """Pairs of classes in different components that share a word and may link by their bits.

    With ``every`` all such pairs, else a forest of them for each group.
    """
    spark = shared.sparkSession
    known = classes.join(components.withColumnRenamed("id", "class"), "class", "left").select(
        "class", "n", "bits", F.coalesce("component", "class").alias("component"))
    placed = shared.join(known.select("class", "component"), "class")
    groups = placed.groupBy("word").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    open_groups = groups.where("low <> high").select("word", blocks.alias("blocks"))
    rows = shared.join(open_groups, "word").withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("word", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class").join(known, "class")
    rows = rows.repartition(partitions(spark), "word", "i", "j").sortWithinPartitions("word", "i", "j", "n", "class")

    def compare(group: list[tuple]) -> list[tuple[int, int]]:
        i, j = group[0][1:3]
        own = np.array([r[3] for r in group])
        ids = [r[4] for r in group]
        n = np.array([r[5] for r in group], np.int64)
        label = np.array([r[7] for r in group], np.int64)
        bits = _folded([r[6] for r in group])
        out = []
        for x in range(len(group) - 1):
            far = np.bitwise_count(bits[x + 1:] ^ bits[x]).sum(axis=1, dtype=np.int64)
            may = (far * (den + num) <= (n[x + 1:] + n[x]) * (den - num)) & (label[x + 1:] != label[x])
            if i != j:
                may &= own[x + 1:] != own[x]
            for y in np.flatnonzero(may) + x + 1:
                if label[y] == label[x]:
                    continue
                out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
                if not every:
                    label[label == label[y]] = label[x]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def pairs(of: list[tuple]) -> pa.RecordBatch:
            found = compare(of) if len(of) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])

        for batch in pieces(batches):
            for row in zip(*(batch[c].to_pylist() for c in ("word", "i", "j", "own", "class", "n", "bits", "component")), strict=True):
                if group and row[:3] != group[0][:3]:
                    yield pairs(group)
                    group = []
                group.append(row)
        if group:
            yield pairs(group)

    return rows.select("word", "i", "j", "own", "class", "n", "bits", "component").mapInArrow(tidy(run), "a long, b long").distinct()


def shared_words(rows: DataFrame) -> DataFrame:
    """(word, class, low): the words that more than one class has, with the smallest class of each.

    Nearly all words are single, so they are dealt by word once and sorted, and no aggregate before that
    would shrink them. Words that many classes share, as far as a sample of the classes shows, are
    aggregated first instead and then joined back, which can be split; their slots are a table of at most
    SLOTS bits, looked up as the words are made. The sample decides the way of a word and never the result.
    """
    def slot() -> Column:
        return F.pmod(F.xxhash64("word"), F.lit(SLOTS)).cast("int")

    picked = rows.where(F.pmod("class", F.lit(_SAMPLED)) == 0)
    often = max(8, picked.select("class").distinct().count() // 1000)
    hot = picked.select("class", F.explode("words").alias("word")).distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(written(slot_bits(hot.where(F.col("n") >= often).select(slot().alias("slot"))).withColumnRenamed("bits", "hot"), "hot-slots"))
    words = rows.select("class", "words").join(hot, how="cross").select("class", "hot", F.explode("words").alias("word"))
    few, many = (words.where(is_hot).select("class", "word") for is_hot in (~has_bit("hot", slot()), has_bit("hot", slot())))
    own = Window.partitionBy("word")
    few = few.select("word", "class", F.min("class").over(own).alias("low"), F.max("class").over(own).alias("high"))
    low = many.groupBy("word").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    low = written(low.where("low <> high").select("word", "low"), "low-words")
    return few.where("low <> high").drop("high").unionByName(many.join(low, "word").select("word", "class", "low"))


def labelled(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(doc_id, mark, n_shingles, component, component_id) of every row of (doc_id, text).

    ``component_id`` is the smallest doc_id that links reach and null only if no row has an id; it may
    name several groups if texts share an id, ``component`` names one. ``mark`` tells texts of equal ids apart.
    """
    docs = docs.select("doc_id", "text")
    rows = written(sketched(docs, size, num, den), "sketches")
    some = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")  # null ids last
    places = written(
        rows.where("n > 0").groupBy("class").agg(F.min(some).alias("p")).select("class", "p.doc_id", "p.mark"),
        "classes")
    classes = written(rows.where("n > 0").groupBy("class").agg(F.max("n").alias("n"), F.first("bits").alias("bits")), "class-bits")
    shared = written(shared_words(rows), "shared-words")
    best = Window.partitionBy("class").orderBy(F.col("times").desc(), "low")
    stars = shared.where("class <> low").groupBy("class", "low").agg(F.count(F.lit(1)).alias("times"))
    stars = stars.withColumn("nth", F.row_number().over(best)).where("nth = 1").select(F.col("low").alias("a"), F.col("class").alias("b"))
    edges = written(verified(within(stars, classes, num, den), places, docs, size, num, den), "links")
    components = written(linked_groups(docs.sparkSession, edges), "components")
    shared = shared.select("word", "class")
    for every in (False, True):
        candidates = written(unsettled(shared, classes, components, num, den, every), "candidates")
        if candidates.isEmpty():
            break
        more = written(verified(candidates, places, docs, size, num, den), "links")
        edges = edges.unionByName(more)
        components = written(linked_groups(docs.sparkSession, edges), "components")
    reached = places.join(components.withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = reached.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    reached = reached.join(smallest, "component").select("class", "component", "component_id")
    alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "mark", "n", "class").join(reached, "class", "left").select(
        "doc_id", "mark", F.col("n").alias("n_shingles"), "component", alone.alias("component_id"))


def grouped(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, mark, n_shingles, component_id) of every row: ``labelled`` without the groups' own names."""
    return labelled(docs, size, num, den).drop("component")


def one_of_each(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of every group: of those with the smallest doc_id, one; rows without words all stay."""
    rows = written(labelled(docs, size, num, den).where("n_shingles > 0"), "groups")
    gone = rows.where("not (doc_id <=> component_id)").select("doc_id", "mark")
    again = rows.groupBy("doc_id", "mark").count().where("count > 1").select("doc_id", "mark")
    # Two texts under the group's smallest id: the smaller mark stays.
    heads = rows.where("doc_id <=> component_id")
    firsts = heads.groupBy("component").agg(F.min("mark").alias("first"), F.max("mark").alias("last"))
    twins = heads.join(firsts.where("first <> last"), "component").where("mark <> first").select("doc_id", "mark")
    gone = written(gone.unionByName(twins).distinct(), "gone")
    near, rest = touched(docs, gone.unionByName(again))
    near = join_rows(near, gone, "left_anti")
    single = join_rows(near, again, "left_semi").dropDuplicates(["doc_id", "mark"])
    near = join_rows(near, again, "left_anti").unionByName(single)
    return near.select("row.*").unionByName(rest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(documents(spark, sf_dir)).drop("mark")
