"""A deterministic sharded WARC writer, and its reader.

Records are sorted by ranges of their id: a range of ``span`` ids is a shard, whatever the cluster's
size, and a shard's records are written in order, each a gzip member of its own. A file is rolled
when its compressed size reaches ``roll_bytes``. Lengths, digests and record ids are computed from
the payload at writing. A task writes to a name of its own attempt; the names of finished files
form a manifest table; only files of the manifest are then renamed to their final names, which
depend on shard and number alone, and a marker closes the archive. A lost task leaves a file that
no manifest names; a repeated rename finds the file in place.

Of rows with equal payloads of at least ``min_bytes`` the one with the largest id is a response and
the others revisit it. That is decided on ids and digests alone, by an aggregate joined back, so a
payload that a third of all rows share is split like any skewed join; the decisions then travel with
the payloads, which are shuffled once, and stand just before their rows in the sorted shard.

Edge cases: a null payload is empty; a null URL gives no target header; repeated rows with one id
are written one by one and all with the largest id are responses; null ids sort first and are never
the largest unless alone; an empty table gives an empty archive; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import new_path
from .common import partitions, written

SPAN, ROLL_BYTES, MIN_BYTES = 4096, 64 << 20, 0
_DATE = "2024-01-01T00:00:00Z"  # capture time is not a column of the input
_MANIFEST = "shard long, part int, temporary string, final string, records long, bytes long, sha256 string"
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def bare_digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(record_id: int | None) -> str:
    return f"<urn:page:{'null' if record_id is None else record_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC/1.1 record; the HTTP head keeps the payload's length for revisits, which carry none."""
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = head if is_revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="%/:?#[]@!$&'()*+,;=-._~"))
    if is_revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {_urn(refers_to)}")
    lines += [f"WARC-Payload-Digest: sha1:{bare_digest(payload)}", f"WARC-Block-Digest: sha1:{bare_digest(block)}",
              "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Roller:
    """Files of one task: a new one for every shard and whenever the size is reached."""

    def __init__(self, root: str, roll_bytes: int):
        self.root, self.roll = root, roll_bytes
        self.files, self.base = opened(root)
        self.shard = self.out = None

    def add(self, shard: int, data: bytes) -> Iterator[tuple]:
        if self.out is not None and (shard != self.shard or self.size >= self.roll):
            yield self.close()
        if self.out is None:
            self.part = self.part + 1 if shard == self.shard else 0
            self.shard, self.size, self.records, self.sha = shard, 0, 0, hashlib.sha256()
            self.name = f"_temporary/{uuid.uuid4().hex}.warc.gz"
            self.out = self.files.open_output_stream(f"{self.base}/{self.name}", compression=None)
        packed = _gzip(data)
        self.out.write(packed)
        self.sha.update(packed)
        self.size += len(packed)
        self.records += 1

    def close(self) -> tuple:
        self.out.close()
        self.out = None
        final = f"shard-{self.shard:012d}-{self.part:05d}.warc.gz"
        return self.shard, self.part, self.name, final, self.records, self.size, self.sha.hexdigest()


def write(pages: DataFrame, root: str, span: int = SPAN, roll_bytes: int = ROLL_BYTES, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write (page_id, url, html) under ``root``; the manifest of the files."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    marks = rows.where(F.length("payload") >= min_bytes).select("page_id", F.sha1("payload").alias("sha"))
    chosen = marks.groupBy("sha").agg(F.max("page_id").alias("chosen"), F.count(F.lit(1)).alias("copies"))
    # Written before the join, which can then be split where a payload is hot.
    revisits = marks.join(written(chosen.where("copies > 1").select("sha", "chosen"), "chosen"), "sha")
    revisits = revisits.where("page_id IS DISTINCT FROM chosen").select("page_id", "sha", "chosen").distinct()
    none = F.lit(None).cast
    events = rows.select("page_id", F.lit(1).alias("kind"), "url", "payload", none("string").alias("sha"), none("long").alias("chosen"))
    events = events.unionByName(revisits.select("page_id", F.lit(0).alias("kind"), none("string").alias("url"), none("binary").alias("payload"), "sha", "chosen"))
    events = events.withColumn("shard", F.coalesce(F.expr(f"page_id div {span}"), F.lit(-1).cast("long")))
    files, base = opened(root)
    files.create_dir(f"{base}/_temporary", recursive=True)
    order = ["shard", F.col("page_id").asc_nulls_first(), "kind", "url", "payload"]
    dealt = events.repartition(partitions(pages.sparkSession), "shard").sortWithinPartitions(*order)
    fields = ["shard", "page_id", "kind", "url", "payload", "sha", "chosen"]

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, done, at, refers = _Roller(root, roll_bytes), [], object(), {}
        for batch in batches:
            for values in zip(*(batch[c] for c in fields), strict=True):
                shard, page_id, kind, url, payload, sha, to = (v.as_py() for v in values)
                if page_id != at:
                    at, refers = page_id, {}
                if kind == 0:
                    refers[sha] = to
                    continue
                to = refers.get(hashlib.sha1(payload).hexdigest()) if refers else None
                done += roller.add(shard, record(page_id, url, payload, to, to is not None))
        if roller.out is not None:
            done.append(roller.close())
        columns = [list(c) for c in zip(*done, strict=True)] or [[]] * 7
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                         ["shard", "part", "temporary", "final", "records", "bytes", "sha256"])

    manifest = written(dealt.mapInArrow(save, _MANIFEST), "warc-manifest")
    return commit(manifest, root)


def commit(manifest: DataFrame, root: str) -> DataFrame:
    """Give the files of the manifest their final names and close the archive; safe to repeat."""

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = opened(root)
        for batch in batches:
            for row in batch.to_pylist():
                source, target = f"{base}/{row['temporary']}", f"{base}/{row['final']}"
                if files.get_file_info(source).type == fs.FileType.File:
                    files.move(source, target)
                if files.get_file_info(target).size != row["bytes"]:
                    raise OSError(f"{target} is not the file of the manifest")
            yield batch.select(["final", "bytes"])

    moved = manifest.mapInArrow(rename, "final string, bytes long").agg(F.count(F.lit(1)), F.sum("bytes")).first()
    files, base = opened(root)
    with files.open_output_stream(f"{base}/_COMPLETE") as marker:
        marker.write(f"{moved[0]} files, {moved[1] or 0} bytes\n".encode())
    return manifest


def _members(files: fs.FileSystem, path: str) -> Iterator[bytes]:
    """Gzip members of a file, one at a time."""
    with files.open_input_stream(path, compression=None) as source:
        rest = b""
        while True:
            unpack, out = zlib.decompressobj(31), []
            while not unpack.eof:
                rest = rest or source.read(1 << 20)
                if not rest:
                    if out:
                        raise OSError(f"{path} ends inside a record")
                    return
                out.append(unpack.decompress(rest))
                rest = unpack.unused_data
            yield b"".join(out)


def parse(data: bytes) -> tuple:
    """Id, length and digest of the full payload, type, id referred to, URL and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if "sha1:" + bare_digest(block) != fields["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} does not fit")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or bare_digest(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not fit its headers")

    def number(urn: str | None) -> int | None:
        value = urn and urn.removeprefix("<urn:page:").removesuffix(">")
        return int(value) if value and value != "null" else None

    return (number(fields["WARC-Record-ID"]), size, digest, kind, number(fields.get("WARC-Refers-To")),
            fields.get("WARC-Target-URI"), payload)


def read(manifest: DataFrame, root: str, payloads: bool = True) -> DataFrame:
    """Records of the files of a manifest; every digest is checked."""
    spark = manifest.sparkSession
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in _RECORD.split(", ")]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = opened(root)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for name in batch["final"].to_pylist():
                rows, held = [], 0
                for data in _members(files, f"{base}/{name}"):
                    row = parse(data)
                    rows.append(row if payloads else (*row[:6], None))
                    held += len(data)
                    if held > 8 << 20:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    return manifest.select("final").repartition(partitions(spark), "final").mapInArrow(load, _RECORD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_path(spark, "warc")
    manifest = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), root)
    return read(manifest, root, payloads=False).drop("url", "payload")


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_FIVE = "('0x' || sha[5 * i - 4 : 5 * i])::BIGINT"
SQL = f"""
WITH pages_ AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
marked AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS chosen FROM pages_)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(1, 9), lambda i: array_to_string(list_transform([15, 10, 5, 0],
           lambda s: substr('{_ALPHABET}', ((({_FIVE}) >> s) & 31) + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = chosen THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> chosen THEN chosen END AS refers_to
FROM marked
"""
