"""Surrogate keys and consecutive numbering without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelake.session import scratch_dir
from carelake.sources.tables import MOVED_ONCE, settings

#: Files whose row counts are summed in one group.
GROUP_FILES = 1024


def _position(df: DataFrame, order_by: list[str]) -> DataFrame:
    """Add ``_pos`` = 0-based rank over the whole frame.

    The rows are range-sorted into files of the shared folder.  A row's rank
    is the rows in all earlier files plus its index inside its own file, which
    the Parquet reader reports.  Rows of earlier files are prefix sums in two
    levels: within groups of GROUP_FILES files, and over one array with a number
    per group.  Writing first fixes the ranges, so a lost executor cannot change
    a number; inside ``scratch_scope`` the folder is removed at its end.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, "ranked")
    with settings(spark, MOVED_ONCE):
        df.repartitionByRange(*order_by).sortWithinPartitions(*order_by).write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path)
    per_file = (rows.groupBy(F.col("_metadata.file_name").alias("_file")).agg(F.count(F.lit(1)).alias("_n"))
                .withColumn("_part", F.regexp_extract("_file", r"part-(\d+)", 1).cast("int"))
                .withColumn("_group", F.floor(F.col("_part") / GROUP_FILES)))
    within = Window.partitionBy("_group").orderBy("_part", "_file").rowsBetween(Window.unboundedPreceding, 0)
    totals = per_file.groupBy("_group").agg(F.sum("_n").alias("_rows")).agg(F.collect_list(F.struct("_group", "_rows")).alias("_groups"))
    earlier = F.aggregate(F.filter("_groups", lambda g: g["_group"] < F.col("_g._group")), F.lit(0).cast("bigint"), lambda n, g: n + g["_rows"])
    groups = totals.select("_groups", F.explode("_groups").alias("_g")).select("_g._group", earlier.alias("_earlier"))
    offsets = (per_file.withColumn("_before", F.sum("_n").over(within) - F.col("_n")).join(groups, "_group")
               .select("_file", (F.col("_before") + F.col("_earlier")).alias("_before")))
    numbered = rows.select("*", F.col("_metadata.file_name").alias("_file"),
                           F.col("_metadata.row_index").alias("_idx"))
    # one row per written file, i.e. at most the number of write tasks
    return (numbered.join(F.broadcast(offsets), "_file")
                    .withColumn("_pos", F.col("_before") + F.col("_idx"))
                    .drop("_file", "_idx", "_before"))


def surrogate_keys(df: DataFrame, key: str, order_by, start: int = 0) -> DataFrame:
    """Dense keys ``start+1, start+2, ...`` in ``order_by`` order."""
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    ranked = _position(df, order)
    return ranked.withColumn(key, F.col("_pos") + F.lit(start + 1).cast("bigint")).drop("_pos")


def one_pass_keys(df: DataFrame, key: str, start: int = 0) -> DataFrame:
    """Unique ascending keys above ``start`` without any shuffle; gaps occur.

    For facts, where the key only has to be unique and a second pass over
    the batch would cost more than dense numbers are worth.
    """
    return df.withColumn(key, F.monotonically_increasing_id() + F.lit(start + 1).cast("bigint"))


def max_key(df: DataFrame, key: str) -> int:
    return df.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]


def batch_numbering(df: DataFrame, order_by, size: int = 1000) -> DataFrame:
    """Consecutive batches of ``size`` rows: ``batch`` from 1, ``no`` within it."""
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    return (_position(df, order)
            .withColumn("batch", F.floor(F.col("_pos") / size) + 1)
            .withColumn("no", F.col("_pos") % size + 1)
            .drop("_pos"))
