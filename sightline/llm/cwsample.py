"""Fingerprints by consistent weighted sampling.

The terms of a text are its words in lower case, weighted by how often they occur. For sample i a
term with weight w draws r and c from Gamma(2, 1) and b from the unit interval, all by hash of the
term and i alone, takes t = floor(ln w / r + b) and competes with ln a = ln c - r * (t - b) - r. The
smallest wins, and the pair (term, t) is the sample. Two texts share a sample with a probability
equal to the generalised Jaccard similarity, sum of minima over sum of maxima of their weights.

A sample is kept as one number: ln a in steps of 2^-24 above a hash of (term, t), so the smallest
number is the winner and equal numbers mean equal samples. Weights come from the sorted words of a
text, in which equal words are one run. The next document is found inside blocks of 256 ids and
over blocks of blocks, so no task orders all rows; texts are shuffled once.

Most draws need no logarithm. The smallest a of a text of n words is exponentially distributed with
rate n, so it is below ``ENOUGH`` / n but for one sample in e^16, and a draw whose lower bound (a few
products, see ``_below``) lies above that cannot win. A sample whose winner is not below is not taken
from what is left: the texts that have one, about one in 100,000, are drawn again without a bound,
read with their neighbours only. So the samples are those of all draws, whatever the bound.

Edge cases: a null text is empty; a text without words has an empty fingerprint, like any other such
text and unlike all others; ids need not be dense; null ids come first; of repeated ids the one
with the smaller text comes first, and equal rows follow each other; a table of one row is its own
next; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SLOTS, documents, written

SAMPLES = 64
ENOUGH = 16.0
_AT_ONCE = 4
_BLOCK, _REGION = 8, 12  # bits
_KEYS = ["block", "nth"]


def terms(text: Column) -> Column:
    """Runs of equal words, each followed by a blank, in sorted order."""
    words = F.sort_array(F.split(F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " ")), " "))
    return F.regexp_extract_all(F.concat(F.array_join(words, " "), F.lit(" ")), F.lit(r"([^ ]+) (?:\1 )*+"), F.lit(0))


def _unit(h: Column, shift: int) -> Column:
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(0x1FFFFF)) + F.lit(0.5)) / F.lit(float(1 << 21))


def _draws(word: Column, number: Column) -> tuple[Column, Column, Column]:
    """e^-r, e^-c and b."""
    one, two = F.xxhash64(word, number), F.xxhash64(word, number, F.lit(1))
    return _unit(one, 0) * _unit(one, 21), _unit(one, 42) * _unit(two, 0), _unit(two, 21)


def _below(word: Column, log_weight: Column, number: Column, most: Column) -> Column:
    """Whether the term may draw an a of at most ``most`` over its weight; false only where it does not.

    With p = e^-r, v = e^-c and f the part of ln w / r + b that floor cuts off, a * w is c * p^(1 - f). There c is at
    least 2 * (1 - v) / (1 + v), and the power at least the harmonic mean p / (1 - f + f * p). A weight of 1 has f = b,
    others are taken with the least, f = 0.
    """
    p, v, b = _draws(word, number)
    f = F.when(log_weight == 0, b).otherwise(F.lit(0.0))
    return F.lit(2.0) * (F.lit(1.0) - v) * p <= most * (F.lit(1.0) + v) * (F.lit(1.0) - f + f * p)


def sample(word: Column, log_weight: Column, number: Column) -> Column:
    """What the term draws for one sample, as a number whose minimum over terms is the sample."""
    p, v, b = _draws(word, number)
    r, c = -F.log(p), -F.log(v)
    t = F.floor(log_weight / r + b)
    log_a = F.log(c) - r * (t - b) - r
    high = F.shiftleft(F.floor((F.greatest(log_a, F.lit(-63.0)) + 64.0) * float(1 << 24)).cast("long"), 32)
    return high.bitwiseOR(F.xxhash64(word, t).bitwiseAND(F.lit(0xFFFFFFFF)))


def _block() -> Column:
    return F.coalesce(F.shiftright(F.col("doc_id").cast("long"), _BLOCK), F.lit(-(1 << 56)))


def _after(blocks: DataFrame) -> DataFrame:
    """(block, next): the next block that holds rows; after the last one the first."""
    inside = Window.partitionBy("region").orderBy("block")
    steps = blocks.withColumn("region", F.shiftright("block", _REGION)).withColumn("next", F.lead("block").over(inside))
    heads = steps.groupBy("region").agg(F.min("block").alias("head"))
    over = Window.orderBy("region")  # one row for 2^20 ids
    ends = Window.orderBy("region").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("region", F.coalesce(F.lead("head").over(over), F.first("head").over(ends)).alias("far"))
    return steps.join(heads, "region").select("block", F.coalesce("next", "far").alias("next"))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows in order of doc_id with the text of the next: block, nth, text, following, next_block, next_nth."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("block", _block())
    w = Window.partitionBy("block").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    ordered = rows.withColumn("nth", F.row_number().over(w)).withColumn("near", F.lead("text").over(w))
    heads = rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").select(F.col("block").alias("next"), F.col("text").alias("head"))
    follow = _after(rows.select("block").distinct()).join(heads, "next")
    joined = ordered.join(follow, "block")
    last = F.col("near").isNull()
    return joined.select(
        "doc_id", "block", "nth", "text", F.coalesce("near", "head").alias("following"),
        F.when(last, F.col("next")).otherwise(F.col("block")).alias("next_block"),
        F.when(last, F.lit(1)).otherwise(F.col("nth") + 1).alias("next_nth"),
    )


def edited(text: Column, following: Column) -> Column:
    """The text with its last quarter replaced by as much of the start of the following one."""
    cut = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.left(text, F.length(text) - cut), F.left(following, cut))


def drawn(rows: DataFrame, keys: list[str], samples: int, enough: float) -> DataFrame:
    """(keys, kind, own_below, changed_below, n, s): what terms draw for sample n, without draws that cannot count.

    The kind is 0 for terms with the same weight in ``text`` and ``edited``, 1 for those of ``text``, 2 for those of
    ``edited``. A draw may be the sample of a text if s is less than the bound for it. Sample 0 keeps all draws, so every
    row with a word is among the result.
    """
    # The generators keep lists from being computed for every use.
    both = rows.select(*keys, F.explode(F.array(F.struct(terms(F.col("text")).alias("x"), terms(F.col("edited")).alias("y")))).alias("t"))
    x, y = F.col("t.x"), F.col("t.y")

    def likely(runs: Column) -> Column:
        text = F.array_join(runs, "")
        return F.lit(enough) / F.greatest(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))), F.lit(1))

    parts = F.struct(F.array_intersect(x, y).alias("shared"), F.array_except(x, y).alias("own"), F.array_except(y, x).alias("changed"),
                     likely(x).alias("in_own"), likely(y).alias("in_changed"))
    parted = both.select(*keys, F.explode(F.array(parts)).alias("p"))

    def limit(most: Column) -> Column:
        return F.shiftleft(F.floor((F.least(F.log(most), F.lit(63.0)) + 64.0) * float(1 << 24)).cast("long"), 32)

    sized = parted.select(*keys, F.size("p.shared").alias("n_shared"), F.size("p.own").alias("n_own"), "p.in_own", "p.in_changed",
                          limit(F.col("p.in_own")).alias("own_below"), limit(F.col("p.in_changed")).alias("changed_below"),
                          F.posexplode(F.concat("p.shared", "p.own", "p.changed")).alias("at", "run"))
    kind = F.when(F.col("at") < F.col("n_shared"), 0).when(F.col("at") < F.col("n_shared") + F.col("n_own"), 1).otherwise(2)
    runs = sized.withColumns({"kind": kind, "word": F.substring_index("run", " ", 1)})
    runs = runs.withColumn("weight", F.length("run") / (F.length("word") + 1))
    most = F.when(F.col("kind") == 0, F.greatest("in_own", "in_changed")).when(F.col("kind") == 1, F.col("in_own")).otherwise(F.col("in_changed"))
    weighed = runs.select(*keys, "kind", "own_below", "changed_below", F.xxhash64("word").alias("word"),
                          F.when(F.col("weight") == 1, F.lit(0.0)).otherwise(F.log("weight")).alias("log_weight"),
                          (most * F.col("weight") * (1 + 1e-6)).alias("most"))  # more than what rounding may take
    draws = weighed.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples // _AT_ONCE * _AT_ONCE - 1))).alias("n"))
    draw = F.col("word"), F.col("log_weight"), F.col("n")
    draws = draws.where(_below(*draw, F.col("most")) | (F.col("n") == 0))
    return draws.select(*keys, "kind", "own_below", "changed_below", "n", sample(*draw).alias("s"))


def signatures(rows: DataFrame, keys: list[str], samples: int, enough: float = float("inf")) -> DataFrame:
    """(keys, own, changed, open): the samples of ``text`` and ``edited`` of every row, as lists in order.

    What a term with its weight draws is drawn once for both texts. No row where neither has a word. The lists of an
    open row, of which there are none without ``enough``, lack samples.
    """
    draws = drawn(rows, keys, samples, enough)
    names = {"own": 2, "changed": 1}  # the kind of terms that the text lacks

    def least(name: str, lacks: int, i: int) -> Column:
        fits = (F.col("n") % _AT_ONCE == i) & (F.col("kind") != lacks) & (F.col("s") < F.col(f"{name}_below"))
        return F.min(F.when(fits, F.col("s"))).alias(f"{name}{i}")

    few = draws.groupBy(*keys, F.shiftright("n", _AT_ONCE.bit_length() - 1).alias("g")).agg(
        *(least(n, lacks, i) for n, lacks in names.items() for i in range(_AT_ONCE)), *(F.max(F.col("kind") != lacks).alias(f"has_{n}") for n, lacks in names.items()))
    flat = [F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("g", F.array(*(F.col(f"{n}{i}") for i in range(_AT_ONCE))).alias("s")))), lambda part: part["s"])) for n in names]
    found = few.groupBy(*keys).agg(*(F.filter(f, lambda v: v.isNotNull()).alias(n) for f, n in zip(flat, names, strict=True)),
                                   *(F.max(f"has_{n}").alias(f"has_{n}") for n in names))
    lacking = [F.col(f"has_{n}") & (F.size(n) < samples // _AT_ONCE * _AT_ONCE) for n in names]
    return found.select(*keys, *names, (lacking[0] | lacking[1]).alias("open"))


def _around(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows in the blocks, found by hash: those of other blocks may be among them, but no part of a block."""
    def slot(block: Column) -> Column:
        return F.pmod(F.xxhash64(block), F.lit(SLOTS)).cast("int").alias("slot")

    occupied = F.broadcast(blocks.select(slot(F.col("block"))).distinct())
    return docs.withColumn("slot", slot(_block())).join(occupied, "slot", "left_semi").drop("slot")


def settled(docs: DataFrame, samples: int, enough: float) -> DataFrame:
    """(block, nth, own, changed): the samples of all texts that have words, whatever is ``enough``."""
    def texts(some: DataFrame) -> DataFrame:
        return with_next(some).select(*_KEYS, "next_block", "text", edited(F.col("text"), F.col("following")).alias("edited"))

    found = written(signatures(texts(docs), [*_KEYS, "next_block"], samples, enough), "signatures")
    again = found.where("open")
    if not again.isEmpty():
        # A block and the one after it are all that the edited texts of a block need.
        blocks = again.select("block").union(again.select("next_block"))
        rest = texts(_around(docs, blocks)).join(again.select(*_KEYS), _KEYS, "left_semi")
        found = found.where("NOT open").unionByName(written(signatures(rest, [*_KEYS, "next_block"], samples), "signatures"))
    return found.select(*_KEYS, "own", "changed")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; two empty fingerprints are alike, an empty and another are not."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.greatest(F.size(a), F.size(b))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(same)


def shown(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lower(F.hex(x))), "")


def compared(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and the next."""
    rows = with_next(docs)
    found = settled(docs, samples, ENOUGH)
    none = F.array().cast("array<bigint>")
    facts = rows.select("doc_id", "block", "nth", "next_block", "next_nth", F.length("text").cast("long").alias("n_chars"),
                        F.sha2(edited(F.col("text"), F.col("following")), 256).alias("edited_sha256"))
    facts = facts.join(found, _KEYS, "left")
    others = found.select(F.col("block").alias("next_block"), F.col("nth").alias("next_nth"), F.col("own").alias("next_own"))
    out = facts.join(others, ["next_block", "next_nth"], "left")
    own, changed, after = (F.coalesce(c, none) for c in ("own", "changed", "next_own"))
    return out.select("doc_id", "n_chars", "edited_sha256", shown(own).alias("fingerprint"), shown(changed).alias("edited_fingerprint"),
                      likeness(own, changed).alias("near_edited"), likeness(own, after).alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(documents(spark, sf_dir))
