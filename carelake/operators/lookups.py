"""Lookups, existence tests and the smaller joins.

No broadcast hint is given for tables that grow: Catalyst broadcasts a side
only when its statistics are under the configured threshold, adaptive
execution decides again from measured sizes, and it splits hot keys of the
remaining sort-merge joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelake import reference_data as ref
from carelake.functions.scalars import _c
from carelake.session import scratch_dir
from carelake.sources.tables import UNSORTED, settings


def same_text(a, b, ci: bool = False) -> Column:
    """Equality of two strings, ignoring case when ``ci`` is set."""
    if not ci:
        return _c(a) == _c(b)
    return F.collate(_c(a), "UTF8_LCASE") == F.collate(_c(b), "UTF8_LCASE")


def lookup_or_unknown(df: DataFrame, dim: DataFrame, id_col: str, dim_id: str, key: str,
                      out: str | None = None, unknown: int = ref.UNKNOWN_KEY, ci: bool = False) -> DataFrame:
    """Surrogate key of a natural id; the unknown member when there is none."""
    side = dim.select(F.col(dim_id).alias("_lookup_id"), F.col(key).alias("_lookup_key"))
    if ci:
        # ids that differ in case only are one id, and its lowest key stands for it
        side = side.groupBy(F.lower("_lookup_id").alias("_lookup_id")).agg(F.min("_lookup_key").alias("_lookup_key"))
    joined = df.join(side, same_text(id_col, "_lookup_id", ci), "left")
    found = F.coalesce(F.col("_lookup_key"), F.lit(unknown).cast("bigint"))
    return joined.withColumn(out or key, found).drop("_lookup_id", "_lookup_key")


def scalar_lookup(df: DataFrame, dim: DataFrame, id_col: str, dim_id: str, value: str,
                  out: str, default) -> DataFrame:
    """One value per row from a table with a unique id, or the default."""
    side = dim.select(F.col(dim_id).alias("_lookup_id"), F.col(value).alias("_lookup_value"))
    joined = df.join(side, df[id_col] == side["_lookup_id"], "left")
    return joined.withColumn(out, F.coalesce("_lookup_value", F.lit(default))).drop("_lookup_id", "_lookup_value")


def anti_existing(source: DataFrame, target: DataFrame, source_id: str, target_id: str) -> DataFrame:
    known = target.select(F.col(target_id).alias("_known_id"))
    return source.join(known, source[source_id] == known["_known_id"], "left_anti")


def semi_existing(source: DataFrame, target: DataFrame, source_id: str, target_id: str) -> DataFrame:
    known = target.select(F.col(target_id).alias("_known_id"))
    return source.join(known, source[source_id] == known["_known_id"], "left_semi")


def upsert_match(target: DataFrame, source: DataFrame, target_id: str, source_id: str) -> DataFrame:
    """Natural ids of both sides with what a merge would do to them."""
    t = target.select(F.col(target_id).alias("_t"))
    s = source.select(F.col(source_id).alias("_s")).distinct()
    action = (F.when(F.col("_s").isNull(), "keep").when(F.col("_t").isNull(), "insert").otherwise("update"))
    return (t.join(s, t["_t"] == s["_s"], "full_outer")
             .select(F.coalesce("_t", "_s").alias("natural_id"), action.alias("action")))


def keep_latest(df: DataFrame, key: str, order_by: list[str]) -> DataFrame:
    """One row per key, the highest in ``order_by`` order.

    Spark limits each key to one row before the shuffle as well, so a key
    with very many copies does not pile up in one task.
    """
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order_by])
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


#: Rows beyond which ``moved`` keeps a side from being broadcast, and rows of it that a task may hold in a hash table.
BROADCAST_ROWS, HASHED_ROWS = 200_000, 500_000


def moved(side: DataFrame, n: int) -> DataFrame:
    """A join side of about ``n`` rows: many are joined by a shuffle, whatever their size is taken for.

    Statistics of stored tables are those of compressed files, a fortieth of what the rows take up on the driver.
    """
    if n <= BROADCAST_ROWS:
        return side
    tasks = int(side.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return side.hint("shuffle_hash" if n <= tasks * HASHED_ROWS else "merge")


class DuplicateKeys(ValueError):
    """A load batch holds the same natural key more than once."""


def repeated_hashes(df: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(_doubt): hashes that more than one row's key has, stored, and their number."""
    path = scratch_dir(df.sparkSession, "in-doubt")
    repeated = df.groupBy(F.xxhash64(key).alias("_doubt")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_doubt")
    with settings(df.sparkSession, UNSORTED):
        repeated.write.parquet(path)
    stored = df.sparkSession.read.schema("_doubt bigint").parquet(path)
    return stored, stored.count()


def latest_of_batch(df: DataFrame, key: str, order_by: list[str]) -> DataFrame:
    """One row per key of a staging batch: the latest, then by content."""
    return keep_latest(df, key, order_by + [c for c in df.columns if c != key and not c.startswith("stg_")])


def resolve_duplicates(df: DataFrame, key: str, on_duplicate: str, order_by: list[str]) -> DataFrame:
    """``keep_latest`` keeps one row per key, ``error`` refuses the batch, ``keep_all`` leaves it to the caller.

    Keys are counted by hash first, so whole rows are sorted and sent only where a hash repeats.

    Rows loaded at the same time are told apart by their content, so the
    choice does not depend on how the batch was read.  Rows without a key are
    no duplicates of each other and cannot be loaded: they are left out, and
    the load refuses them.
    """
    df = df.where(F.col(key).isNotNull())
    if on_duplicate == "keep_all":
        return df
    if on_duplicate == "keep_latest":
        doubts, n = repeated_hashes(df, key)
        if not n:
            return df
        hashed = df.withColumn("_hash", F.xxhash64(key))
        match = F.col("_hash") == F.col("_doubt")
        single = hashed.join(doubts, match, "left_anti").drop("_hash")
        repeated = hashed.join(doubts, match, "left_semi").drop("_hash")
        return single.unionByName(latest_of_batch(repeated, key, order_by))
    if on_duplicate != "error":
        raise ValueError(f"on_duplicate must be 'error', 'keep_latest' or 'keep_all', not {on_duplicate!r}")
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).limit(1).collect()
    if repeated:
        raise DuplicateKeys(f"{key} {repeated[0][0]!r} occurs {repeated[0][1]} times")
    return df


def role_playing_dates(dim_date: DataFrame, key_name: str, columns: dict[str, str]) -> DataFrame:
    """The date dimension in one role: its key and columns under role names."""
    return dim_date.select(F.col("DateKey").alias(key_name), *[F.col(c).alias(n) for c, n in columns.items()])


def cross_filter(kept: DataFrame, selected: DataFrame, on: str = "PatientID") -> DataFrame:
    """Rows of ``kept`` whose key occurs in the selection of another table.

    The selection is reduced to its distinct keys first, so no pairs arise.
    """
    return kept.join(selected.select(on).distinct(), on, "left_semi")


def date_part_join(df: DataFrame, ts: str, calendar: DataFrame, date_col: str = "Date") -> DataFrame:
    """Attach calendar columns by the date part of a timestamp."""
    return df.join(calendar, F.to_date(df[ts]) == calendar[date_col], "left")


def patient_card(labs: DataFrame, patients: DataFrame) -> DataFrame:
    """Lab rows with the name and birth date printed on a report card."""
    side = patients.select(F.col("patient_id").alias("_pid"), "first_name", "last_name", "date_of_birth")
    return (labs.join(side, labs["patient_id"] == side["_pid"], "left")
            .withColumn("first_name", F.coalesce("first_name", F.lit("Unknown")))
            .withColumn("last_name", F.coalesce("last_name", F.lit("Patient")))
            .withColumn("date_of_birth", F.coalesce("date_of_birth", F.lit("N/A")))
            .drop("_pid"))
