"""Partition transforms: numbers counted from 1970."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIMES = ("timestamp", "timestamptz", "timestamp_ns")
TRANSFORMS = ("identity", "year", "month", "day", "hour")


def check(transform: str, kind: str) -> None:
    if transform not in TRANSFORMS:
        raise ValueError(f"Unsupported partition transform: {transform}")
    if transform == "hour" and kind not in TIMES or transform in ("year", "month", "day") and kind not in (*TIMES, "date"):
        raise ValueError(f"Transform {transform} requires a date/timestamp column, not {kind}")


def apply(transform: str, column: Column, kind: str = "") -> Column:
    if transform == "year":
        return (F.year(column) - 1970).cast("string")
    if transform == "month":
        return ((F.year(column) - 1970) * 12 + F.month(column) - 1).cast("string")
    if transform == "day":
        return F.unix_date(column.cast("date")).cast("string")
    if transform == "hour":
        return (F.unix_date(column.cast("date")).cast("long") * 24 + F.hour(column)).cast("string")
    if kind == "timestamptz":  # an instant, whatever the session's zone
        return F.concat(F.to_utc_timestamp(column, F.current_timezone()).cast("string"), F.lit("+00"))
    return column.cast("string")


def encoded(value: Column) -> Column:
    """Directory-safe and injective: null and the empty string stay apart."""
    return F.when(value.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), value))
