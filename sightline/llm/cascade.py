"""Quality rules as a short-circuit cascade.

Every rule has a name and a test on the measures of a text. Cost and rejection rate of each are
measured on a sample of the texts; the cascade then runs the rules by rejection per cost, and stops
at the first that rejects. A verdict is a conjunction, so the order changes the work and never the
result. Counts that the caller wants of every text are computed beside the cascade and shared by
its rules, which makes those rules almost free and puts the costly ones last.

Edge cases: null and empty texts have no words and fail; repeated rows are judged one by one; an
empty table gives an empty result (an empty sample keeps the order in which the rules are listed);
other columns of the input are left out.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, window_hashes, word_bounds, word_hashes

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


class Measures:
    """Measures of one text, each computed when first asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> np.ndarray:
        return word_hashes(self.raw)

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def n_lines(self) -> int:
        return sum(1 for line in self.text.split("\n") if line.strip(SPACES))

    @cached_property
    def n_dup_lines(self) -> int:
        lines = [line for line in self.text.split("\n") if line.strip(SPACES)]
        return len(lines) - len(set(lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words covered by windows of three words that occur twice or more."""
        windows = window_hashes(self.words, 3)
        if not len(windows):
            return 0
        _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(counts[which] > 1)
        covered = np.zeros(len(self.words), bool)
        for shift in range(3):
            covered[starts + shift] = True
        return int(covered.sum())

    @cached_property
    def shouted(self) -> int:
        """Words of two or more ASCII letters with a capital and no small one."""
        data = np.frombuffer(self.raw, np.uint8)
        starts, _ = word_bounds(data)
        if not len(starts):
            return 0
        large = np.add.reduceat((data >= 65) & (data <= 90), starts, dtype=np.int64)
        small = np.add.reduceat((data >= 97) & (data <= 122), starts, dtype=np.int64)
        return int(((large > 1) & (small == 0)).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], bool]


RULES = [
    Rule("too_few_words", lambda m: m.n_words < 50),
    Rule("repeated_words", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
    Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words),
    Rule("word_length", lambda m: not 2 * m.n_words <= m.word_chars <= 15 * m.n_words),
    Rule("repeated_lines", lambda m: 10 * m.n_dup_lines > 5 * m.n_lines),
    Rule("shouting", lambda m: 2 * m.shouted > m.n_words),
]


def profile(docs: DataFrame, rules: list[Rule], fraction: float) -> dict[str, tuple[float, float]]:
    """Seconds a text and share rejected of every rule, over the texts that a hash picks."""
    picked = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(fraction * 1_000_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, rejected, n = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for text in batch["text"]:
                n += 1
                for i, rule in enumerate(rules):
                    measures = Measures(text.as_py() or "")
                    began = time.perf_counter()
                    rejected[i] += rule.rejects(measures)
                    spent[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays(
            [pa.array([r.name for r in rules]), pa.array(spent), pa.array(rejected, pa.int64()), pa.array([n] * len(rules), pa.int64())],
            ["rule", "seconds", "rejected", "n"])

    found = picked.mapInArrow(run, "rule string, seconds double, rejected long, n long")
    found = found.groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected"), F.sum("n").alias("n"))
    return {r.rule: (r.seconds / r.n, r.rejected / r.n) for r in found.collect() if r.n}


def ordered(rules: list[Rule], measured: dict[str, tuple[float, float]]) -> list[Rule]:
    """Rules by rejection per cost, highest first."""
    def gain(rule: Rule) -> float:
        cost, share = measured.get(rule.name, (1.0, 0.0))
        return share / max(cost, 1e-9)

    return sorted(rules, key=gain, reverse=True)


def judge(docs: DataFrame, rules: list[Rule] = RULES, fraction: float = 0.01) -> DataFrame:
    """Measures and verdict of every text. ``fraction`` of the texts orders the cascade."""
    steps = ordered(rules, profile(docs, rules, fraction))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                m = Measures(text.as_py() or "")
                base = m.n_words < 50 or 100 * m.n_repeat_words > 50 * m.n_words
                kept = not base and not any(rule.rejects(m) for rule in steps)
                rows.append((*(getattr(m, name) for name in names), base, kept))
            columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 7
            kinds = [*[pa.int64()] * 5, pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", *names, "base_failed", "kept"])

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))


_WORD = r"[^\x20\x09-\x0D]+"
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
), windows AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS p, w FROM d WHERE len(w) >= 3
), counted AS (
  SELECT r, p, count(*) OVER (PARTITION BY r, w[p : p + 2]) AS n FROM windows
), repeats AS (
  SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM counted WHERE n > 1) GROUP BY r
), lines AS (
  SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}') GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
         coalesce(lines.n, 0) AS n_lines,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Z].*[A-Z]', 's') AND NOT regexp_matches(x, '[a-z]'))) AS shouted
  FROM d LEFT JOIN repeats USING (r) LEFT JOIN lines USING (r)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 10 * n_symbols <= n_words AND word_chars BETWEEN 2 * n_words AND 15 * n_words
       AND 10 * n_dup_lines <= 5 * n_lines AND 2 * shouted <= n_words AS kept
FROM b
"""
