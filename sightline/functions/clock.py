"""Local hours."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def madrid_hour(utc: Column) -> Column:
    """Hour of the day in Madrid for a UTC time, summer time included."""
    return F.hour(F.convert_timezone(F.lit("UTC"), F.lit("Europe/Madrid"), utc.cast("timestamp_ntz")))
