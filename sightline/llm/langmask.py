"""Language identification with n-gram Bloom filters sliced by language.

One table of slots holds a bit per language in each slot, so the AND of an n-gram's slots is the set
of all languages whose filter holds it: one lookup for every language. A text's hits per language
are corrected for false positives with the share of that language's bits that are set, and the
language with the highest corrected rate wins.

An n-gram enters the filter of a language when its share of the language's n-grams is at least
``min_share``, which bounds a filter to 1 / min_share entries whatever the corpus, and at least
``distinct`` times its highest share in any language. Shares are taken from a bounded sample, the
``sample`` different texts a language of smallest text hash.

Edge cases: a null text or one without a letter is ``und`` with score 0, as is every text when
nothing can be learned; of equal rates the language first in text order wins; texts are read whole;
repeated rows are judged one by one; empty tables give empty results; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, mix, pieces, tidy, written

_U = np.uint64
SIZES = (1, 2, 3, 4, 5)
EVIDENCE = (3, 4, 5)
_BLANK = 0x20


def _letters() -> np.ndarray:
    """Code point, in lower case if it is a letter, else a blank."""
    return kept("letters", None, _letter_table)


def _letter_table() -> np.ndarray:
    table = np.full(0x110000, _BLANK, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def grams(text: str, sizes: tuple[int, ...]) -> np.ndarray:
    """Hashes of the n-grams of a text: letters in lower case, one blank between words."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = _letters()[points]
    blank = points == _BLANK
    if blank.all():
        return np.zeros(0, _U)
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    points = points[keep]
    points = np.concatenate(([_BLANK], points, [_BLANK])).astype(_U) if points[-1] != _BLANK else np.concatenate(([_BLANK], points)).astype(_U)
    if points[1] == _BLANK:
        points = points[1:]
    out, value = [], np.zeros(len(points), _U)
    for size in range(1, max(sizes) + 1):
        if len(points) < size:
            break
        value = value[: len(points) - size + 1] * _U(0x100000001B3) + points[size - 1 :]
        if size in sizes:
            whole = value if size > 1 else value[points != _BLANK]
            out.append(mix(whole + _U(size << 56)))
    return np.concatenate(out) if out else np.zeros(0, _U)


def astuple(model: MaskFilter) -> tuple:
    """The model's plain values, which need no class of this package to be read."""
    return model.languages, model.slots, model.hashes, model.fill


@dataclass
class MaskFilter:
    """Slots of language bits. ``fill`` is the chance, per language, that an absent n-gram hits."""

    languages: list[str]
    slots: np.ndarray  # (slots, words) of 64 language bits
    hashes: int
    fill: np.ndarray

    @staticmethod
    def build(languages: list[str], values: np.ndarray, numbers: np.ndarray, hashes: int = 3, per_entry: int = 16) -> MaskFilter:
        """``values``: n-gram hashes; ``numbers``: the language of each."""
        size = 1 << max(10, (max(1, len(values)) * per_entry - 1).bit_length())
        slots = np.zeros((size, -(-max(1, len(languages)) // 64)), _U)
        for at in _places(values, size, hashes):
            np.bitwise_or.at(slots, (at, numbers // 64), _U(1) << (numbers % 64).astype(_U))
        set_bits = [((slots[:, i // 64] >> _U(i % 64)) & _U(1)).mean() for i in range(len(languages))]
        return MaskFilter(languages, slots, hashes, np.array(set_bits) ** hashes)

    def masks(self, values: np.ndarray) -> np.ndarray:
        """For every n-gram the bits of all languages that may hold it."""
        mask = None
        for at in _places(values, len(self.slots), self.hashes):
            mask = self.slots[at] if mask is None else mask & self.slots[at]
        return mask

    def rates(self, values: np.ndarray) -> np.ndarray:
        """Share of the n-grams that each language holds, corrected for false positives."""
        mask = self.masks(values)
        hits = np.array([((mask[:, i // 64] >> _U(i % 64)) & _U(1)).sum() for i in range(len(self.languages))])
        return np.clip((hits / len(values) - self.fill) / np.maximum(1 - self.fill, 1e-9), 0, 1)


def _places(values: np.ndarray, size: int, hashes: int) -> Iterator[np.ndarray]:
    step = mix(values ^ _U(0xD6E8FEB86659FD93)) | _U(1)
    for i in range(hashes):
        yield ((values + _U(i) * step) & _U(size - 1)).astype(np.int64)


def fit(labelled: DataFrame, sample: int = 1500, min_share: float = 2e-6, distinct: float = 0.5,
        sizes: tuple[int, ...] = SIZES) -> MaskFilter:
    """Learn from (text, lang); rows with a null lang or a text without letters teach nothing."""
    known = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("mark"))
    # Marks are ranked first and texts then picked by the last mark of their language, so texts that
    # are not in the sample are not shuffled. Copies count once. One row a language, as the model has.
    first = Window.partitionBy("lang").orderBy("mark")
    ranked = known.select("lang", "mark").distinct().withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= sample)
    last = written(ranked.groupBy("lang").agg(F.max("mark").alias("last")), "sample")
    drawn = known.join(F.broadcast(last), "lang").where("mark <= last").groupBy("lang", "mark").agg(F.any_value("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                values, n = np.unique(grams(text.as_py(), sizes), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))],
                    ["lang", "gram", "n"])

    counts = drawn.select("lang", "text").mapInArrow(tidy(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = written(counts, "grams")
    totals = written(counts.groupBy("lang").agg(F.sum("n").alias("every")), "totals")  # one row a language
    counts = counts.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("every"))
    common = counts.where(F.col("share") >= min_share)
    top = common.withColumn("top", F.max("share").over(Window.partitionBy("gram")))
    # At most 1 / min_share rows a language, held as arrays of 8 and 4 bytes a row.
    rows = top.where(F.col("share") >= distinct * F.col("top")).select("lang", "gram").toArrow()
    names = rows["lang"].combine_chunks().dictionary_encode()
    spelled = names.dictionary.to_pylist()
    languages = sorted(spelled)
    number = np.array([languages.index(x) for x in spelled] or [0])
    return MaskFilter.build(languages, rows["gram"].to_numpy().view(_U), number[names.indices.to_numpy(zero_copy_only=False)])


def predict(docs: DataFrame, model: MaskFilter, keep: list[str], names: tuple[str, str] = ("lang_pred", "score"),
            sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the language and its score (the winner's part of all rates)."""
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))  # bounded by min_share and the languages
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = MaskFilter(*shared.value)
        for batch in batches:
            langs, scores = [], []
            for text in batch["text"]:
                values = grams(text.as_py() or "", sizes)
                if not len(values) or not found.languages:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                rates = found.rates(values)
                best = int(np.argmax(rates))
                langs.append(found.languages[best])
                scores.append(float(rates[best] / rates.sum()) if rates[best] > 0 else 0.0)
            yield pa.RecordBatch.from_arrays([*batch["row"].flatten(), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             [*keep, *names])

    own = rows.schema["row"].dataType.fields
    schema = T.StructType([*own, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return rows.mapInArrow(tidy(run), schema)


def told(docs: DataFrame, model: MaskFilter, floor: float = 0.3, margin: float = 0.15) -> DataFrame:
    """Rows whose 3- to 5-grams show one language: a corrected rate of ``floor``, ``margin`` above the second.

    Single letters and pairs are no evidence here, as any text of the alphabet has them. Held-out
    documents of the sf0.01 table have rates from 0.51 and margins from 0.30; random letters and
    unlearned languages have rates up to 0.14, and an even mix of two languages a margin of 0.10.
    """
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))  # bounded by min_share and the languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = MaskFilter(*shared.value)
        for batch in pieces(batches):
            keep = []
            for text in batch["text"]:
                values = grams(text.as_py() or "", EVIDENCE)
                rates = np.sort(found.rates(values))[::-1] if len(values) and found.languages else np.zeros(1)
                keep.append(bool(rates[0] >= floor and rates[0] - (rates[1] if len(rates) > 1 else 0.0) >= margin))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame) -> MaskFilter:
    """The model that queries and the pipeline use: learned from the documents not held out."""
    return fit(docs.where(~held_out()).select("text", "lang"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    ids = F.col("doc_id").cast("long").alias("doc_id")
    return predict(docs.select(ids, "text", held_out().alias("held_out")), train(docs), ["doc_id", "held_out"])
