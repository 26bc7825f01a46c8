"""Packing token sequences into as few bins of fixed capacity as possible.

Texts become token pieces of at most the capacity, row by row. All that packing needs from the
corpus is how many pieces have each length, at most ``capacity`` numbers, so the driver solves the
instance on lengths and the cluster deals the pieces to the slots:

1. Martello and Toth's dominance: a set of a bin's largest piece with nothing, or with the largest
   partner that fits, is fixed for good when no other filling of that bin can be better. Lengths
   with many pieces are fixed many bins at once.
2. Best fit in decreasing order packs the rest, again many equal bins at once.
3. Every piece gets its rank among the pieces of its length, from counts per length and bucket and
   a rank inside the bucket, so a length that a third of all pieces share is never one task. Slots
   of a length are ranges of ranks; a table of ranges, bounded by the capacity, gives the bin.

Edge cases: null and empty texts are one closing token; repeated rows are packed one by one; empty
tables give empty results; other columns of the input are left out.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, kept, written

CAPACITY = 2048
BUCKETS = 256
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
# Bytes of the table that a Python process keeps over tasks, and about what Python needs for an entry besides.
_KEEP_WORDS, _ENTRY = 128 << 20, 190
_LONG, _TOGETHER, _CHARS, _DEALT = 64, 20_000, 2_000_000, 1 << 19


def _classes() -> np.ndarray:
    """The class of every Latin-1 character in the split pattern of the vocabulary file."""
    out = np.full(256, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, "[A-Za-zªµºÀ-ÖØ-öø-ÿ]"), (_DIGIT, "[0-9²³¹¼½¾]"), (_SPACE, "[\t-\r \x85\xa0]")):
        out[[i for i in range(256) if re.match(pattern, chr(i))]] = kind
    return out


_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_CLASS = _classes()
_LOWER = "".join(map(chr, range(256))).lower().encode("latin-1")


def word_starts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lower-case Latin-1 text: whether each character is in a word, and whether it begins a match of

    ``'s|'t|'re|'ve|'m|'ll|'d|[letters]+|[digit]|[others]+`` (or a run of blanks).
    """
    kind = _CLASS[data]
    new = np.ones(len(data), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    # An apostrophe alone before letters takes one or two of them along.
    mark = np.flatnonzero((data[:-1] == ord("'")) & new[:-1] & (kind[1:] == _LETTER))
    first, second = data[mark + 1], np.append(data, 0)[mark + 2]
    pairs = first.astype(np.int64) << 8 | second
    size = np.where(np.isin(first, list(b"stmd")), 1, np.where(np.isin(pairs, [a << 8 | b for a, b in (b"re", b"ve", b"ll")]), 2, 0))
    mark, size = mark[size > 0], size[size > 0]
    new[mark + 1] = False
    rest = (mark + size + 1)[mark + size + 1 < len(data)]
    new[rest[kind[rest] == _LETTER]] = True
    return kind != _SPACE, new


class Recent:
    """Values of byte strings, kept for those of late in about ``size`` bytes, and found many at a time.

    There are two tables: a full one becomes the old one, and what is asked for again moves up.
    """

    def __init__(self, make: Callable[[list[bytes]], list[bytes]], size: int):
        self.now: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}
        self._make, self._size, self._bytes = make, size // 2, 0

    def filled(self, keys: set[bytes]) -> dict[bytes, bytes]:
        """The present table, with all keys in it."""
        if self._bytes > self._size:
            self._old, self.now, self._bytes = self.now, {}, 0
        old, now, new = self._old, self.now, []
        for key in keys.difference(now):
            value = old.get(key)
            if value is None:
                new.append(key)
            else:
                now[key] = value
                self._bytes += len(key) + len(value) + _ENTRY
        for key, value in zip(new, self._make(new), strict=True):
            now[key] = value
            self._bytes += len(key) + len(value) + _ENTRY
        return now


class Merges:
    """Byte-pair merges of many words at once: in every round each word merges its leftmost pair of lowest rank."""

    def __init__(self, ids: dict[str, int], pairs: list[list[str]], end: str, symbols: dict[str, str]):
        """``symbols``: how the vocabulary spells the bytes of every Latin-1 character."""
        self._inner, self._last = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for char, spelled in symbols.items():
            raw = char.encode()
            for byte, symbol in zip(raw, spelled, strict=True):
                self._inner[byte] = ids[symbol]
            self._last[raw[-1]] = ids[spelled[-1] + end]
        keys = np.array([ids[a] << 20 | ids[b] for a, b in pairs], np.int64)
        self._made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self._never = len(keys)
        self._size = 1 << (8 * len(keys) - 1).bit_length()
        self._keys, self._ranks, self._probes = np.full(self._size, -1, np.int64), np.full(self._size, self._never, np.int64), 0
        # A pair listed twice counts by its last rank, as in a dict.
        keys, last = np.unique(keys[::-1], return_index=True)
        ranks = len(self._made) - 1 - last
        while len(keys):
            at = (self._slot(keys) + self._probes) & (self._size - 1)
            free = self._keys[at] < 0
            self._keys[at[free]], self._ranks[at[free]] = keys[free], ranks[free]
            placed = self._keys[at] == keys
            self._ranks[at[placed]] = ranks[placed]
            keys, ranks, self._probes = keys[~placed], ranks[~placed], self._probes + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) & (self._size - 1)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the pair (a, b), ``_never`` where it is none."""
        keys = np.where((a < 0) | (b < 0), -2, a << 20 | b)
        slot, out = self._slot(keys), np.full(keys.shape, self._never, np.int64)
        for probe in range(self._probes):
            at = (slot + probe) & (self._size - 1)
            out = np.where(self._keys[at] == keys, self._ranks[at], out)
        return out

    def merged(self, words: list[str]) -> list[bytes]:
        """Ids of the words as little-endian 32-bit words; words of like length should come together."""
        raws = [w.encode() for w in words]
        sizes = np.array([len(r) for r in raws])
        flat = np.frombuffer(b"".join(raws), np.uint8)
        ends = np.cumsum(sizes)
        ids = np.full((len(words), int(sizes.max())), -1, np.int64)
        ids[np.arange(ids.shape[1]) < sizes[:, None]] = self._inner[flat]
        ids[np.arange(len(words)), sizes - 1] = self._last[flat[ends - 1]]
        ranks = self._rank(ids[:, :-1], ids[:, 1:])
        rows, done_rows, done_ids = np.arange(len(words)), [], []
        while len(rows):
            width = ranks.shape[1]
            at = ranks.argmin(axis=1) if width else np.zeros(len(rows), np.int64)
            best = ranks[np.arange(len(rows)), at] if width else np.full(len(rows), self._never)
            live = best < self._never
            done_rows.append(rows[~live])
            done_ids.append(ids[~live])
            rows, ids, ranks, at, best = rows[live], ids[live], ranks[live], at[live], best[live]
            if not len(rows):
                break
            n = np.arange(len(rows))
            ids[n, at] = self._made[best]
            place = np.arange(width)
            ids = np.take_along_axis(ids, place + (place > at[:, None]), 1)  # the second of the pair goes
            ranks = np.take_along_axis(ranks, place[:-1] + (place[:-1] >= at[:, None]), 1)
            right = at < width - 1
            ranks[n[right], at[right]] = self._rank(ids[n[right], at[right]], ids[n[right], at[right] + 1])
            left = at > 0
            ranks[n[left], at[left] - 1] = self._rank(ids[n[left], at[left] - 1], ids[n[left], at[left]])
        out: list[bytes] = [b""] * len(words)
        for part, found in zip(done_rows, done_ids, strict=True):
            counts = (found >= 0).sum(axis=1)
            raw = found[found >= 0].astype("<u4").tobytes()
            cuts = np.concatenate([[0], np.cumsum(4 * counts)]).tolist()
            for row, low, up in zip(part.tolist(), cuts, cuts[1:], strict=False):
                out[row] = raw[low:up]
        return out


class WordTokens:
    """Token ids of texts as little-endian 32-bit words.

    The vocabulary lower-cases texts and encodes every match of its split pattern alone, and no
    match spans white space. So some texts are cut together into such words, and the ids of each
    different word looked up once, in a table bounded in bytes; unseen words are merged here, all
    of some texts together. Texts beyond Latin-1 (where case and classes could differ between
    libraries), with separators that the libraries class differently, or with what may be a special
    token, and very long words go to the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        symbols = self._tokenizer.pre_tokenizer
        shown = {c: symbols.pre_tokenize_str(c)[0][0] for c in map(chr, range(256)) if symbols.pre_tokenize_str(c)}
        self._merges = Merges(model["vocab"], pairs, model["end_of_word_suffix"], shown)
        self._words = Recent(self._of_words, _KEEP_WORDS)

    def _of_words(self, raws: list[bytes]) -> list[bytes]:
        words = [raw.decode("latin-1") for raw in raws]
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        while order and len(words[order[-1]]) > _LONG:
            i = order.pop()
            out[i] = self._whole(words[i])
        for low in range(0, len(order), _TOGETHER):
            part = order[low : low + _TOGETHER]
            for i, ids in zip(part, self._merges.merged([words[i] for i in part]), strict=True):
                out[i] = ids
        return out

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of every text, in order; texts of about ``_CHARS`` characters are looked up together."""
        low = 0
        while low < len(texts):
            up, chars = low, 0
            while up < len(texts) and (up == low or chars + len(texts[up]) <= _CHARS):
                chars += len(texts[up])
                up += 1
            part = texts[low:up]
            plain = [self._is_plain(text) for text in part]
            found = iter(self._of_plain([text.encode("latin-1") for text, is_plain in zip(part, plain, strict=True) if is_plain]))
            for text, is_plain in zip(part, plain, strict=True):
                yield next(found) if is_plain else self._whole(text)
            low = up

    def _of_plain(self, texts: list[bytes]) -> list[bytes]:
        """The ids of Latin-1 texts: what each different word has is dealt to where it stands."""
        data = np.frombuffer(b"\n".join(texts).translate(_LOWER), np.uint8)
        inside, new = word_starts(data)
        begun = np.concatenate([[0], np.cumsum(inside & new)])  # words that begin before each character
        bounds = np.cumsum([0, *(len(text) + 1 for text in texts)])
        bounds = begun[np.minimum(bounds, len(data))]
        data, cuts = data[inside], np.flatnonzero(new[inside])
        cuts = np.append(cuts, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        codes, (_, places, spelled) = coded.indices.to_numpy(), coded.dictionary.buffers()
        spelled, places = spelled.to_pybytes() if spelled else b"", np.frombuffer(places, np.int32)[: len(coded.dictionary) + 1].tolist()
        keys = [spelled[low:up] for low, up in zip(places, places[1:], strict=False)]
        raws = list(map(self._words.filled(set(keys)).__getitem__, keys))
        ids = np.frombuffer(b"".join(raws), "<u4")
        sizes = np.fromiter(map(len, raws), np.int64, len(raws)) // 4
        starts = np.cumsum(sizes) - sizes
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])
        out = np.empty(ends[-1], "<u4")
        for low in range(0, len(codes), _DEALT):
            at = codes[low : low + _DEALT]
            first, last = ends[low], ends[low + len(at)]
            out[first:last] = ids[np.repeat(starts[at] - ends[low : low + len(at)], sizes[at]) + np.arange(first, last)]
        bounds = ends[bounds].tolist()
        return [out[low:up].tobytes() for low, up in zip(bounds, bounds[1:], strict=False)]

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    @staticmethod
    def _is_plain(text: str) -> bool:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return False
        return not any(odd in text for odd in _ODD)

    def _whole(self, text: str) -> bytes:
        ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


def word_tokens(path: str) -> WordTokens:
    return kept("word tokens", path, lambda: WordTokens(path))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, closing: int = 0) -> DataFrame:
    """Token pieces of every text: its tokens and the closing one, cut only above the capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, last = word_tokens(path), closing.to_bytes(4, "little")
        for batch in batches:
            rows = []
            texts = [text or "" for text in batch["text"].to_pylist()]
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), tokens.encode_all(texts), strict=True):
                raw = ids + last
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def solve(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fillings of bins, as (lengths in falling order, number of such bins), that use every piece."""
    left = {size: n for size, n in counts.items() if n > 0}
    sizes = sorted(left)
    done: list[tuple[tuple[int, ...], int]] = []

    def take(filling: tuple[int, ...]) -> None:
        need = Counter(filling)
        times = min(left[s] // k for s, k in need.items())
        done.append((filling, times))
        for s, k in need.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
                sizes.pop(bisect_left(sizes, s))

    def at_most(room: int, besides: int) -> int | None:
        """The largest length within the room that is left when one piece of ``besides`` is used."""
        i = bisect_left(sizes, room + 1) - 1
        if i >= 0 and sizes[i] == besides and left[besides] == 1:
            i -= 1
        return sizes[i] if i >= 0 else None

    # Dominance: take the largest piece; what may share its bin decides.
    while sizes:
        big = sizes[-1]
        room = capacity - big
        partner = at_most(room, big)
        if partner is None:
            take((big,))
            continue
        two_smallest = sizes[0] * 2 if left[sizes[0]] > (2 if sizes[0] == big else 1) else (
            sizes[0] + sizes[1] if len(sizes) > 1 else capacity + 1)
        if partner == room or two_smallest > room:
            take((big, partner))  # nothing else fits, or nothing fills the bin better
            continue
        break
    # Best fit decreasing on the rest: bins by room, equal bins together.
    open_bins: dict[int, Counter] = {}
    rooms: list[int] = []

    def put(room: int, filling: tuple[int, ...], n: int) -> None:
        if room == 0:
            done.append((filling, n))
            return
        if room not in open_bins:
            insort(rooms, room)
            open_bins[room] = Counter()
        open_bins[room][filling] += n

    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                each = capacity // size
                full, rest = divmod(n, each)
                if full:
                    put(capacity - each * size, (size,) * each, full)
                if rest:
                    put(capacity - rest * size, (size,) * rest, 1)
                break
            room = rooms[i]
            filling, bins = next(iter(open_bins[room].items()))
            each = room // size
            full = min(bins, n // each)
            used, times = (each, full) if full else (n, 1)
            open_bins[room][filling] -= times
            if not open_bins[room][filling]:
                del open_bins[room][filling]
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(i)
            put(room - used * size, filling + (size,) * used, times)
            n -= used * times
    done += [(filling, n) for by in open_bins.values() for filling, n in by.items()]
    return done


def slots(fillings: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Ranges of ranks: (length, first rank, pieces, pieces of it per bin, first bin, offset)."""
    rank: Counter = Counter()
    out, first = [], 0
    for filling, times in fillings:
        offset = 0
        for size, k in Counter(filling).items():
            out.append((size, rank[size], k * times, k, first, offset))
            rank[size] += k * times
            offset += k * size
        first += times
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """``parts`` (doc_id, piece, start, length, ids_crc32) with ``sequence_id`` and ``offset``."""
    spark = parts.sparkSession
    parts = written(parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets))), "pieces")
    per_bucket = parts.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in per_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranges = spark.createDataFrame(
        slots(solve(counts, capacity)), "length long, low long, n long, each long, first long, shift long")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = parts.withColumn("nth", F.row_number().over(inside) - 1).join(starts, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("nth") + F.col("skip"))
    # The ranges of a length in one array, looked up by counting those that start at or before the rank.
    by_length = ranges.groupBy("length").agg(
        F.sort_array(F.collect_list(F.struct("low", "each", "first", "shift"))).alias("ranges"))
    own = F.expr("ranges[size(filter(ranges, r -> r.low <= rank)) - 1]")
    placed = ranked.join(F.broadcast(by_length), "length").withColumn("own", own)
    at = F.col("rank") - F.col("own.low")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("own.first") + F.floor(at / F.col("own.each"))).alias("sequence_id"),
        (F.col("own.shift") + F.pmod(at, F.col("own.each")) * F.col("length")).alias("offset"),
    )


def packed(docs: DataFrame) -> DataFrame:
    """Pack (doc_id, text) with the word vocabulary file that is installed, closing token 0."""
    import public_tokenizers

    return pack(pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))
