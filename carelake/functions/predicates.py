"""Filters.  A condition is added only for an argument that is given, so the
scan receives plain predicates it can push down."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.functions.scalars import _c


def optional_filters(df: DataFrame, equals: dict | None = None, at_least: dict | None = None,
                     at_most: dict | None = None) -> DataFrame:
    """``column op value`` for every value that is not None."""
    for name, value in (equals or {}).items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    for name, value in (at_least or {}).items():
        if value is not None:
            df = df.where(F.col(name) >= F.lit(value))
    for name, value in (at_most or {}).items():
        if value is not None:
            df = df.where(F.col(name) <= F.lit(value))
    return df


def as_date(value) -> dt.date | None:
    return dt.date.fromisoformat(value) if isinstance(value, str) else value


def date_range(df: DataFrame, column: str, start=None, end=None, year_column: str | None = None) -> DataFrame:
    """Inclusive date range.  ``year_column`` repeats the bounds on the
    partition column, so files of other years are never opened."""
    start, end = as_date(start), as_date(end)
    df = optional_filters(df, at_least={column: start}, at_most={column: end})
    if year_column:
        df = optional_filters(df, at_least={year_column: start and start.year},
                              at_most={year_column: end and end.year})
    return df


def pending_only(stg: DataFrame) -> DataFrame:
    return stg.where(F.col("stg_status") == "Pending")


def current_only(dim_patient: DataFrame) -> DataFrame:
    return dim_patient.where(F.col("IsCurrent"))


def patient_filter(df: DataFrame, patient_id: str, date_column: str, start=None, end=None,
                   year_column: str | None = None) -> DataFrame:
    return date_range(df.where(F.col("PatientID") == patient_id), date_column, start, end, year_column)


def abnormal_only(labs: DataFrame) -> DataFrame:
    """Flag other than Normal; rows without a flag are left out."""
    return labs.where(F.col("AbnormalFlag") != "Normal")


def unexpired(cache: DataFrame, as_of) -> DataFrame:
    return cache.where(F.col("ExpiresAt") > _instant(as_of))


def slicers(df: DataFrame, choices: dict) -> DataFrame:
    """Multi-select equality per column; an empty choice selects everything."""
    for name, values in choices.items():
        if values:
            df = df.where(F.col(name).isin(list(values)))
    return df


def recent_runs(log: DataFrame, as_of, minutes: int = 5) -> DataFrame:
    since = _instant(as_of) - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    return log.where(F.col("RunStarted") >= since)


def _instant(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("timestamp_ntz")


# --- statement audit -------------------------------------------------------------

# Reasons reported for a logged statement.
NOT_SELECT = "not a SELECT"
STACKED = "stacked statements"
BLOCKED_WORD = "blocked keyword"
DW_WRITE = "direct write to dw"
DELETE_ALL = "DELETE without WHERE"


def statement_reasons(sql) -> Column:
    """Array of reasons why a logged SQL text breaks the read-only rules."""
    bare = F.regexp_replace(F.regexp_replace(_c(sql), "--[^\n]*", ""), r"(?s)/\*.*?\*/", "")
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    body = F.upper(trimmed(F.regexp_replace(trimmed(bare), ";+$", "")))
    return F.array_compact(F.array(
        F.when(~body.startswith("SELECT"), NOT_SELECT),
        F.when(body.contains(";"), STACKED),
        F.when(body.rlike(r"\b(EXEC|EXECUTE|XP_\w+|SP_\w+|OPENROWSET|OPENQUERY)\b"), BLOCKED_WORD),
        F.when(body.rlike(r"\b(INSERT\s+INTO|UPDATE|DELETE\s+FROM|DROP\s+TABLE|ALTER\s+TABLE"
                          r"|TRUNCATE\s+TABLE)\s+DW\."), DW_WRITE),
        F.when(body.rlike(r"\bDELETE\b") & ~body.rlike(r"\bWHERE\b"), DELETE_ALL),
    ))


def statement_guard(df: DataFrame, sql_col: str) -> DataFrame:
    reasons = statement_reasons(sql_col)
    return df.withColumn("reasons", reasons).withColumn("blocked", F.size("reasons") > 0)
