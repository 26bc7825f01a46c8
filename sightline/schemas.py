"""Row shapes shared by the jobs."""

from pyspark.sql import types as T

LISTING_FIELDS = [
    "title", "url", "location", "department", "job_type", "description", "external_id",
]
LISTING = T.StructType([T.StructField(n, T.StringType()) for n in LISTING_FIELDS])

# Columns that say which fetch a row came from; parsers carry the ones they find.
KEY_FIELDS = ["run_id", "run_date", "company_id", "page_idx"]

CAPTURES = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("run_date", T.DateType()),
        T.StructField("company_id", T.StringType()),
        T.StructField("page_idx", T.IntegerType()),
        T.StructField("request_url", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("body", T.StringType()),
        T.StructField("captured_at", T.TimestampType()),
    ]
)

CATALOG = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in (
            "name", "ats", "greenhouse_id", "lever_id", "careers_url", "job_selector",
            "location_filter", "acciona_division",
        )
    ]
)

STATE = T.StructType(
    [T.StructField("company_id", T.StringType())]
    + LISTING.fields
    + [
        T.StructField("is_active", T.BooleanType()),
        T.StructField("first_seen_at", T.DateType()),
        T.StructField("last_seen_at", T.DateType()),
        T.StructField("ai_keep", T.BooleanType()),
        T.StructField("ai_reason", T.StringType()),
    ]
)
