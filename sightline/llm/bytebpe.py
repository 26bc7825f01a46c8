"""Byte-level BPE by a tree reduction, and its inverse.

Encoding. A text is cut in halves, at any code point, until the pieces are short; leaves are encoded on
their own and neighbours joined by encoding a window around the seam anew. The window grows on both sides
until the tokens outside are provably those of the whole:

- It ends where a non-space is followed by white space: no match of the split pattern spans that border and
  none looks back over it, so tokens beyond it do not depend on the window.
- Where a half has no such border, the window takes all of it. The matches of a long window are cut again: inside
  one long match the window around the seam grows, tokens at a time, until the outermost token of the
  window and its outer neighbour, encoded together, give the same two tokens. A token row whose
  neighbours all pass that test is the encoding of its bytes: the first merge across a token border would
  happen in the pair alone as well.

Decoding concatenates byte strings up the same kind of tree.

Edge cases: null and empty texts have no tokens and decode to nothing; repeated rows are encoded one
by one; empty tables give empty results; other columns of the input are left out. Memory of a task
is bounded by one Arrow batch and one text with its tokens.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, kept

_SEAM = re.compile(r"(?<=\S)(?=[ \t\n])")
LEAF_CHARS, LEAF_BYTES, WINDOW = 1024, 512, 8


class TreeEncoder:
    """Encode and decode with the ranks of a file; ``pattern`` splits texts before the merges."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bytes = {i: b for b, i in ranks.items()}
        self._core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._split = regex.compile(pattern)
        self._piece = lru_cache(maxsize=65536)(lambda raw: self._core._encode_single_piece(raw))

    def encode(self, text: str) -> list[int]:
        if len(text) <= LEAF_CHARS:
            return self._core.encode_ordinary(text)
        half = len(text) // 2
        left, right = text[:half], text[half:]
        before, after = self._last_border(left), self._first_border(right)
        if before == 0 and after == len(right):  # the window would be all of the text
            return self._matches(text)
        head, tail = self.encode(left), self.encode(right)
        # What the halves gave inside the window goes: it was encoded as if the text ended at the seam.
        spoiled = len(self._short(left[before:])), len(self._short(right[:after]))
        return head[: len(head) - spoiled[0]] + self._short(left[before:] + right[:after]) + tail[spoiled[1]:]

    def _short(self, text: str) -> list[int]:
        return self._core.encode_ordinary(text) if len(text) <= LEAF_CHARS else self._matches(text)

    def _matches(self, text: str) -> list[int]:
        return [i for m in self._split.finditer(text) for i in self.encode_match(m.group().encode())]

    @staticmethod
    def _last_border(text: str) -> int:
        """The last place where white space follows a non-space, or the start."""
        step = 64
        while True:
            low = max(0, len(text) - step)
            near = [m.start() for m in _SEAM.finditer(text, low)]
            if near or not low:
                return near[-1] if near else 0
            step *= 4

    @staticmethod
    def _first_border(text: str) -> int:
        """The first place where white space follows a non-space, or the end."""
        found = _SEAM.search(text)
        return found.start() if found else len(text)

    def encode_match(self, raw: bytes) -> list[int]:
        """Tokens of one match of the pattern."""
        if len(raw) <= LEAF_BYTES:
            return self._core._encode_single_piece(raw)
        half = len(raw) // 2
        return self.join(self.encode_match(raw[:half]), self.encode_match(raw[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of the bytes of both, given the tokens of each."""
        size = WINDOW
        while True:
            a, b = left[-size:], right[:size]
            middle = self._core._encode_single_piece(self.decode(a) + self.decode(b))
            whole_left, whole_right = size >= len(left), size >= len(right)
            if (whole_left or self._stable(left[-size - 1], middle[0])) and (
                whole_right or self._stable(middle[-1], right[size])
            ):
                return left[: len(left) - len(a)] + middle + right[len(b):]
            size *= 2

    def _stable(self, a: int, b: int) -> bool:
        return self._piece(self._bytes[a] + self._bytes[b]) == [a, b]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self._bytes.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def encoder(path: str, pattern: str) -> TreeEncoder:
    return kept("byte bpe", (path, pattern), lambda: TreeEncoder(path, pattern))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Number and digest of the tokens of every text, and the digest of the bytes decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            n, ids_sha, decoded_sha = [], [], []
            for text in batch["text"]:
                ids = bpe.encode(text.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                decoded_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()),
                 pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
