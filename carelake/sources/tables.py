"""Parquet tables in the stg / dw / rpt layers.

A rewritten table gets a new version folder and readers use the newest
finished one, so a table may be rewritten from its own content and a failed
write leaves the last good version in place.  Facts are appended to.  A table with
history keeps rows that a load has closed in a folder of that load, which no later
load rewrites; a version sees the closed rows of its own and earlier loads.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.schemas import TABLES, local_rows, table_schema

LAYERS = ("stg", "dw", "rpt")
#: Stored tables are written once and read often, so the denser codec.
CODEC = {"compression": "zstd"}
#: Columns of facts and views whose values hardly repeat inside a file: looking each value up in a dictionary only costs time.
UNREPEATED = ("ClaimKey", "ClaimID", "LabKey", "LabID", "PrescriptionKey", "PrescriptionID", "FinancialKey", "TransactionID",
              "BilledAmount", "AllowedAmount", "PaidAmount", "WriteOffAmount", "CostToPatient", "CostToPayer", "TotalCost", "Amount")
#: Partitions a task may write side by side; beyond it the rest of its rows is sorted by partition first.
WRITERS = 40
#: Set while something is written that is read back from where it was written: the shuffle files of the write go when it has ended.
MOVED_ONCE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Set while a table is written.  Rows go to the files of their partitions as they come, and joins whose smaller side
#: fits into a task, as measured after its shuffle, look rows up in a hash table: neither sorts, and so spills, the larger side.
UNSORTED = {"spark.sql.maxConcurrentOutputFileWriters": str(WRITERS),
            "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB", **MOVED_ONCE}


def append_rows(spark: SparkSession, path: str, schema: str, rows: list[tuple]) -> None:
    """Append a few driver-side rows, such as log lines, as one file."""
    local_rows(spark, rows, schema).coalesce(1).write.mode("append").parquet(path)


def by_partition(df: DataFrame, column: str) -> DataFrame:
    """Rows in the order of their table partition inside each task; no row moves.  ``write_table`` needs it for more than WRITERS
    partitions a task only."""
    return df.sortWithinPartitions(column)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for one action."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _folder(self, layer: str, name: str) -> str:
        if layer not in LAYERS:
            raise ValueError(f"unknown layer {layer!r}")
        return f"{self.root}/{layer}/{name}"

    def _versions(self, layer: str, name: str) -> list[int]:
        """Finished versions, oldest first."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self._folder(layer, name))
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        done = [
            int(s.getPath().getName()[2:]) for s in fs.listStatus(folder)
            if s.getPath().getName().startswith("v=")
            and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
        ]
        return sorted(done)

    def exists(self, layer: str, name: str) -> bool:
        return bool(self._versions(layer, name))

    def path(self, layer: str, name: str) -> str:
        versions = self._versions(layer, name)
        if not versions:
            raise FileNotFoundError(self._folder(layer, name))
        return f"{self._folder(layer, name)}/v={versions[-1]:06d}"

    def _closed(self, layer: str, name: str) -> str | None:
        """The folder of closed rows, if the table has one."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._folder(layer, name)}/closed")
        return str(path) if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path) else None

    def read_current(self, layer: str, name: str) -> DataFrame:
        """Newest version without the rows that loads have closed.  Warehouse tables are read
        with their declared schema; a partition column would otherwise get a guessed type."""
        reader = self.spark.read
        if layer == "dw" and name in TABLES:
            reader = reader.schema(table_schema(name))
        return reader.parquet(self.path(layer, name))

    def read_table(self, layer: str, name: str) -> DataFrame:
        """Newest version, closed rows included."""
        rows, closed = self.read_current(layer, name), self._closed(layer, name)
        if closed is None:
            return rows
        history = self.spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("load", T.IntegerType())])).parquet(closed)
        return rows.unionByName(history.where(F.col("load") <= self._versions(layer, name)[-1]).drop("load"))

    def write_current(self, current: DataFrame, closed: DataFrame, layer: str, name: str) -> None:
        """A new version of the rows that stand; ``closed`` ones are added to the history.

        The closed rows are written first under the number of the coming version, so they show only
        with it, and a load that failed in between overwrites them when it is run again.
        """
        number = ([0] + self._versions(layer, name))[-1] + 1
        with settings(self.spark, MOVED_ONCE):
            closed.write.mode("overwrite").options(**CODEC).parquet(f"{self._folder(layer, name)}/closed/load={number}")
            current.write.mode("overwrite").options(**CODEC).parquet(f"{self._folder(layer, name)}/v={number:06d}")

    def write_table(self, df: DataFrame, layer: str, name: str,
                    partition_by: str | None = None, append: bool = False,
                    options: dict[str, str] | None = None, ordered: bool = False) -> DataFrame:
        """Write and read back.  ``append`` adds to the newest version; ``options`` are the Parquet writer's.

        ``ordered`` rows come by partition and in an order that files are to keep; others are not sorted.
        """
        if self._closed(layer, name):
            raise ValueError(f"{name} keeps closed rows apart: use write_current")
        versions = self._versions(layer, name)
        if append and versions:
            path, mode = self.path(layer, name), "append"
        else:
            path, mode = f"{self._folder(layer, name)}/v={(versions[-1] if versions else 0) + 1:06d}", "overwrite"
        return self._write(df, path, mode, partition_by, options, ordered)

    def replace(self, df: DataFrame, layer: str, name: str, partition_by: str | None = None) -> DataFrame:
        """The next version of a table, made from the last, which stays until it is finished."""
        path = f"{self._folder(layer, name)}/v={self._versions(layer, name)[-1] + 1:06d}"
        return self._write(df, path, "overwrite", partition_by)

    def _write(self, df: DataFrame, path: str, mode: str, partition_by: str | None,
               options: dict[str, str] | None = None, ordered: bool = False) -> DataFrame:
        plain = {f"parquet.enable.dictionary#{c}": "false" for c in df.columns if c in UNREPEATED}
        writer = df.write.mode(mode).options(**{**CODEC, **plain, **(options or {})})
        if partition_by:
            writer = writer.partitionBy(partition_by)
        with settings(self.spark, MOVED_ONCE if ordered else UNSORTED):
            writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def register_views(self, layer: str, names: list[str]) -> None:
        """Temporary views ``<layer>_<name>`` for SQL users."""
        for name in names:
            self.read_table(layer, name).createOrReplaceTempView(f"{layer}_{name}")
