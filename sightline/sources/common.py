"""What every portal parser shares."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.location import compile_filter_column, location_match
from ..functions.text import or_null
from ..functions.urls import named
from ..operators.dedupe import first_by
from ..schemas import KEY_FIELDS, LISTING_FIELDS

# More than the rows of one captured page can be: they come from arrays of at most 2^31 entries.
_PAGE_BITS = 32
# Rows that ``flat_map`` turns into Python values at once, and rows of a batch that it gives back.
_PAGES, _ROWS = 32, 1024


def keys_of(df: DataFrame) -> list[str]:
    return [k for k in KEY_FIELDS if k in df.columns]


def source_keys(df: DataFrame) -> list[str]:
    """Keys of one source fetch: everything but the page."""
    return [k for k in keys_of(df) if k != "page_idx"]


def load_companies(catalog: DataFrame, default_location_filter: str) -> DataFrame:
    """Catalog with its effective location filter: the company's own, else the default."""
    own = or_null(F.col("location_filter"))
    return catalog.withColumn("location_filter", F.coalesce(own, F.lit(default_location_filter)))


def attach_companies(captures: DataFrame, companies: DataFrame) -> DataFrame:
    """Captures with their company's settings; the filter is compiled once per company.

    The planner broadcasts a catalog that its size estimate allows; a larger one joins by shuffle,
    where adaptive execution splits a hot company.
    """
    settings = companies.withColumn("places", compile_filter_column(F.col("location_filter")))
    return captures.join(settings, "company_id")


def in_place(*texts: Column) -> Column:
    """Any of the texts matches the company's places."""
    hit = F.lit(False)
    for text in texts:
        hit = hit | location_match(text, F.col("places"))
    return hit


def sequence(pos: Column, df: DataFrame) -> Column:
    """Order of a row inside its source fetch."""
    page = F.col("page_idx").cast("long") if "page_idx" in df.columns else F.lit(0).cast("long")
    return F.shiftleft(page, _PAGE_BITS) + pos.cast("long")


def listings(df: DataFrame, **fields: Column) -> DataFrame:
    """Project to keys, ``seq`` and the listing fields; rows need a title and a URL.

    The row goes through a generator, so a field that parses markup is computed once and not
    again in the filter.
    """
    none = F.lit(None).cast("string")
    row = named(**{n: fields.get(n, none).cast("string") for n in LISTING_FIELDS})
    whole = F.filter(F.array(row), lambda r: (r["title"] != "") & (r["url"] != ""))
    keys = source_keys(df)
    return df.select(*keys, fields["seq"].alias("seq"), F.explode(whole).alias("r")).select(
        *keys, "seq", "r.*"
    )


def once_per(df: DataFrame, *names: str) -> DataFrame:
    """First row per source and the given columns, in page and document order."""
    return first_by(df, [*source_keys(df), *names], ["seq"])


def flat_map(df: DataFrame, carried: list[str], inputs: list[str], fields: T.StructType, read) -> DataFrame:
    """Rows ``read(*inputs)`` yields for each row, with ``carried`` columns repeated beside them.

    The carried columns stay in Arrow; only the inputs become Python values, of a few rows at a time, and
    what they yield leaves in batches of bounded length. So a process holds no more for more rows.
    """
    out = T.StructType([df.schema[c] for c in carried] + fields.fields)
    names, pages, most = fields.names, _PAGES, _ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [to_arrow_type(f.dataType) for f in fields.fields]

        def made(part: pa.RecordBatch, source: list[int], rows: list[tuple]) -> pa.RecordBatch:
            columns = [part.column(c).take(pa.array(source, pa.int64())) for c in carried]
            columns += [pa.array(values, t) for values, t in zip(zip(*rows), types)]
            return pa.RecordBatch.from_arrays(columns, names=[*carried, *names])

        for batch in batches:
            for start in range(0, batch.num_rows, pages):
                part = batch.slice(start, pages)
                source, rows = [], []
                for i, values in enumerate(zip(*[part.column(c).to_pylist() for c in inputs])):
                    for row in read(*values):
                        rows.append(row)
                        source.append(i)
                        if len(rows) == most:
                            yield made(part, source, rows)
                            source, rows = [], []
                if rows:
                    yield made(part, source, rows)

    wanted = [*carried, *[c for c in inputs if c not in carried]]
    return df.select(*wanted).mapInArrow(run, out)
