"""Merkle trees over sorted rows, with every row's proof, by butterfly exchange.

Rows of a group ascend in a given order and are numbered by a cluster-wide sort. Aligned blocks of a
power of the fanout are subtrees, which tasks hash on their own. Above them blocks exchange roots in
rounds: in round r the blocks whose numbers differ only in digit r (to the base ``swap``, a power of the
fanout) form a group, each gives the root of its subtree, and every one hashes the common ancestors
again. So a block knows after a round the root of a subtree ``swap`` times as large and the siblings on
its own way up, and after the last round the root and its whole upper proof: nothing is sent down. Where
the last subtree of a level has fewer blocks than the others, its blocks stand in for the missing ones.

The roots of the groups (languages) are the leaves of a second tree, made by the same function. A row's
proof is its siblings in its block, its block's upper proof and its group's proof.

A node is the SHA-256, in lowercase hexadecimal, of its children's digests as text; the last node of a
level may have fewer children, even one. Tables hold digests as 32 bytes, proofs as their concatenation.

No group of rows is ever one task: rows are sorted over ranges, where equal rows are told apart by a row
number, blocks hold at most ``block`` rows, groups of an exchange at most ``swap`` roots. What a round or
a sort gives is written to the shared folder.

Edge cases: null values are "-" in a leaf, so a null and an empty text differ; null langs are a group of
their own, first among groups; null ids come first in their group; rows with equal ids are ordered by
their leaf, and repeated rows are leaves of their own; a group of one row has the leaf as its root, and a
single group's root is the root; an empty table gives no rows; other columns are left out, whatever
their names.
"""

from __future__ import annotations

from binascii import hexlify
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import written
from .common import partitions

FANOUT, BLOCK, SWAP = 2, 4096, 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NUMBER = (1 << 33) - 1  # of a row in its partition, in monotonically_increasing_id


def _levels(n: int, fanout: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    up = 0
    while n > 1:
        n, up = -(-n // fanout), up + 1
    return up


def _climb(nodes: list[bytes], fanout: int, levels: int) -> list[list[bytes]]:
    """The nodes of a subtree by level, from the given ones up."""
    out = [nodes]
    for _ in range(levels):
        nodes = [sha256(hexlify(b"".join(nodes[i : i + fanout]))).digest() for i in range(0, len(nodes), fanout)]
        out.append(nodes)
    return out


def _siblings(tree: list[list[bytes]], at: int, fanout: int) -> bytes:
    """What stands beside node ``at`` and its ancestors, level by level, left to right."""
    if fanout == 2:
        return b"".join([nodes[other] for level, nodes in enumerate(tree[:-1]) if (other := (at >> level) ^ 1) < len(nodes)])
    out = []
    for nodes in tree[:-1]:
        first = at - at % fanout
        out += nodes[first:at] + nodes[at + 1 : first + fanout]
        at //= fanout
    return b"".join(out)


def _folded(node: bytes, proof: bytes, at: int, n: int, fanout: int) -> bytes:
    """The root that a node at place ``at`` of ``n`` gives with its siblings."""
    used = 0
    while n > 1:
        first = at - at % fanout
        left, right = 32 * (at - first), 32 * (min(first + fanout, n) - at - 1)
        node = sha256(hexlify(proof[used : used + left] + node + proof[used + left : used + left + right])).digest()
        used += left + right
        at, n = at // fanout, -(-n // fanout)
    return node


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place`` in their group by ``order`` and its size ``members``, both from 0 up."""
    spark = rows.sparkSession
    # The row number parts equal rows, which are interchangeable.
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    keys = [group, *order, "tie"]
    ranged = tied.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).drop("tie")
    ranged = ranged.withColumn("range", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id().bitwiseAND(F.lit(_NUMBER)))
    ranged = written(ranged, "sorted")
    sizes = ranged.groupBy(group, "range").agg(F.min("nth").alias("low"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(group)  # as many rows as there are ranges
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("skip"), F.sum("n").over(whole).alias("members"))
    placed = ranged.join(written(starts, "starts"), [group, "range"])
    return placed.withColumn("place", F.col("nth") + F.col("skip")).drop("range", "nth", "skip")


def hashed_blocks(rows: DataFrame, fanout: int, block: int) -> DataFrame:
    """``rows`` (group, place, members, digest, ...) with ``beside``, the siblings in their block.

    The first row of a block has the block's root as ``top``.
    """
    high = _levels(block, fanout)
    rows = rows.withColumn("block", F.floor(F.col("place") / block).cast("long"))
    rows = rows.repartition(partitions(rows.sparkSession), "group", "block").sortWithinPartitions("group", "place")
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None

        def done() -> Iterator[pa.RecordBatch]:
            whole = pa.concat_tables(held).combine_chunks()
            digests = whole["digest"].to_pylist()
            tree = _climb(digests, fanout, min(high, _levels(whole["members"][0].as_py(), fanout)))
            beside = pa.array([_siblings(tree, i, fanout) for i in range(len(digests))], pa.binary())
            top = pa.array([tree[-1][0]] + [None] * (len(digests) - 1), pa.binary())
            yield from whole.append_column("beside", beside).append_column("top", top).to_batches()

        for batch in batches:
            table = pa.table(batch.columns, names=names)
            keys = list(zip(table["group"].to_pylist(), table["block"].to_pylist(), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for low, up in zip(cuts, cuts[1:], strict=False):
                if low == up:
                    continue
                if held and keys[low] != last:
                    yield from done()
                    held.clear()
                held.append(table.slice(low, up - low))
                last = keys[low]
        if held:
            yield from done()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, beside binary, top binary")


def butterfly(tops: DataFrame, fanout: int, swap: int) -> DataFrame:
    """(group, block, above, root) from (group, block, blocks, top): siblings above every block, and the group's root.

    One written table a round; the driver sees the largest number of blocks.
    """
    high = _levels(swap, fanout)
    now = written(tops.select("group", "block", "blocks", "top", F.lit(b"").alias("above")), "round")
    most, span = now.agg(F.max("blocks")).first()[0] or 0, 1
    while span < most:
        size, node = F.lit(span).cast("long"), F.expr(f"block div {span}")
        inside = F.col("blocks") - node * size  # blocks from this subtree's first to the group's last
        low, digit = F.pmod("block", size), F.pmod(node, F.lit(swap))
        short = (inside < size) & (digit > 0)
        lows = F.when(short, F.sequence(low, size - 1, inside)).otherwise(F.array(low))
        sent = now.select("*", F.expr(f"block div {span * swap}").alias("of"), digit.alias("digit"), low.alias("own"), F.explode(lows).alias("low"))
        here = F.col("own") == F.col("low")
        roots = F.struct("digit", "top", F.when(here, F.col("block")).alias("block"), F.when(here, F.col("above")).alias("above"))
        met = sent.groupBy("group", "blocks", "of", "low").agg(F.sort_array(F.collect_list(roots)).alias("roots"))

        def run(batches: Iterator[pa.RecordBatch], span: int = span) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple] = []
                for group, blocks, roots in zip(*(batch[c].to_pylist() for c in ("group", "blocks", "roots")), strict=True):
                    tree = _climb([r["top"] for r in roots], fanout, min(high, _levels(-(-blocks // span), fanout)))
                    out += [(group, r["block"], blocks, tree[-1][0], r["above"] + _siblings(tree, i, fanout))
                            for i, r in enumerate(roots) if r["block"] is not None]
                columns = list(zip(*out, strict=True)) or [()] * 5
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["group", "block", "blocks", "top", "above"])

        now = written(met.select("group", "blocks", "roots").mapInArrow(run, "group string, block long, blocks long, top binary, above binary"), "round")
        span *= swap
    return now.select("group", "block", "above", F.col("top").alias("root"))


def proofs(rows: DataFrame, order: list[str], fanout: int = FANOUT, block: int = BLOCK, swap: int = SWAP) -> DataFrame:
    """``rows`` (group, digest, ...) with ``place``, ``members``, ``proof`` and the group's ``root``.

    ``block`` and ``swap`` are powers of the fanout.
    """
    hashed = written(hashed_blocks(numbered(rows, "group", order), fanout, block), "blocks")
    tops = hashed.where("top is not null").select("group", "block", F.ceil(F.col("members") / block).cast("long").alias("blocks"), "top")
    upper = butterfly(tops, fanout, swap)
    joined = hashed.drop("top").join(upper, ["group", "block"])
    return joined.withColumn("proof", F.concat("beside", "above")).drop("block", "beside", "above")


def leaf(fields: dict[str, Column]) -> Column:
    """The digest of a row: byte count, colon and value of every field, or a dash."""
    def part(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(part, fields.values())), 256))


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, when: Column | None = None, *,
             fanout: int = FANOUT, block: int = BLOCK, swap: int = SWAP) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and the root that its proof gives for its present leaf.

    ``changed`` holds values of fields that replace the recorded ones where ``when`` holds: what a
    reader would find in a table that was tampered with.
    """
    fields = {c: F.col(c) for c in FIELDS}
    other = leaf(fields | changed) if changed else F.lit(None).cast("binary")
    group = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))  # null first, then by bytes
    rows = docs.select(group.alias("group"), "doc_id", leaf(fields).alias("digest"), (F.when(when, other) if when is not None else other).alias("other"))
    rows = proofs(rows, ["doc_id", "digest"], fanout, block, swap).withColumnsRenamed({"root": "subroot", "place": "at", "members": "rows"})
    rows = written(rows, "proofs")
    roots = rows.where("at = 0").select(F.lit("").alias("group"), F.col("group").alias("name"), F.col("subroot").alias("digest"))
    groups = proofs(roots, ["name"], fanout, block, swap).select(F.col("name").alias("group"), "place", "members", F.col("proof").alias("upper"), "root")
    rows = rows.join(written(groups, "groups"), "group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("digest", "other", "subroot", "root", "proof", "at", "rows", "upper", "place", "members")
        for batch in batches:
            out = []
            for digest, other, subroot, root, proof, at, n, upper, place, members in zip(*(batch[c].to_pylist() for c in names), strict=True):
                found = _folded(_folded(other or digest, proof, at, n, fanout), upper, place, members, fanout)
                out.append((digest.hex(), subroot.hex(), root.hex(), sha256(hexlify(proof + upper)).hexdigest(), found.hex(), found == root))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.string()] * 5 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return rows.mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    picked = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return manifest(docs, {"n_chars": more}, picked & F.col("n_chars").isNotNull())


SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT) ORDER BY i) AS t
  FROM range(256) r(i)),
fields AS (
  SELECT doc_id, lang, coalesce('=' || lang, '') AS grp, n_chars,
    [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text] AS f,
    [doc_id::VARCHAR, source, lang, (n_chars::HUGEINT + 1)::VARCHAR, text] AS g,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 7 = 0 AS picked
  FROM documents, crc),
leaves AS (
  SELECT doc_id, grp, coalesce(picked, false) AS picked,
    sha256(list_aggregate([coalesce(strlen(x)::VARCHAR || ':' || x, '-') for x in f], 'string_agg', '')) AS leaf,
    sha256(list_aggregate([coalesce(strlen(x)::VARCHAR || ':' || x, '-') for x in g], 'string_agg', '')) AS changed
  FROM fields),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
tree AS (
  SELECT grp, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY grp
  UNION ALL
  SELECT grp, level + 1, [sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')) for i in range((len(nodes) + 1) // 2)]
  FROM tree WHERE len(nodes) > 1),
trees AS (SELECT grp, list(nodes ORDER BY level) AS levels, arg_max(nodes[1], level) AS subroot FROM tree GROUP BY grp),
tops AS (SELECT *, row_number() OVER (ORDER BY grp) - 1 AS place FROM trees),
upper AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM tops
  UNION ALL
  SELECT level + 1, [sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')) for i in range((len(nodes) + 1) // 2)]
  FROM upper WHERE len(nodes) > 1),
uppers AS (SELECT list(nodes ORDER BY level) AS levels, arg_max(nodes[1], level) AS root FROM upper),
ways AS (
  SELECT p.doc_id, p.leaf, p.picked, p.changed, t.subroot, u.root,
    list_concat(
      [{'left': (p.pos >> l) & 1 = 1, 'other': t.levels[l + 1][xor(p.pos >> l, 1) + 1]} for l in range(len(t.levels) - 1)],
      [{'left': (t.place >> l) & 1 = 1, 'other': u.levels[l + 1][xor(t.place >> l, 1) + 1]} for l in range(len(u.levels) - 1)]) AS way
  FROM placed p JOIN tops t USING (grp), uppers u),
folded AS (
  SELECT *, list_reduce(way, lambda a, s:
      {'left': false, 'other': sha256(CASE WHEN s.left THEN s.other || a.other ELSE a.other || coalesce(s.other, '') END)},
      {'left': false, 'other': CASE WHEN picked THEN changed ELSE leaf END}).other AS folded_root
  FROM ways)
SELECT doc_id, leaf, subroot, root,
  sha256(coalesce(list_aggregate([s.other for s in way if s.other IS NOT NULL], 'string_agg', ''), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified
FROM folded
"""
