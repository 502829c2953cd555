"""Staging as append-only batches with a status per batch.

A load reads the folders of the pending batches only, and marking them needs
one small row per batch instead of a rewrite of the staged rows.  A batch
that arrives during a load is not touched by it.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.schemas import STAGING_COLUMNS, local_rows
from carelake.sources.tables import CODEC, MOVED_ONCE, append_rows, settings

STATUS_SCHEMA = "entity string, batch string, status string, seq bigint"
REJECT_SCHEMA = "entity string, batch string, source_file string, reason string, raw string"


class StagingArea:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/") + "/stg"
        self._status = f"{self.root}/_batch_status"
        self._rejects = f"{self.root}/_rejected"

    def schema(self, entity: str) -> str:
        columns = ", ".join(f"{c} string" for c in STAGING_COLUMNS[entity])
        return ("stg_load_id bigint, stg_load_date timestamp_ntz, stg_source_file string, "
                f"stg_status string, {columns}")

    def add(self, staged: DataFrame, entity: str, batch: str) -> None:
        """Store a batch as pending; storing it again replaces it, and it will be loaded again."""
        # the batch's own session: streams stage at the same time
        with settings(staged.sparkSession, MOVED_ONCE):
            staged.write.mode("overwrite").options(**CODEC).parquet(f"{self.root}/{entity}/batch={batch}")
        self._record(entity, [batch], "Pending")

    def reject(self, rows: DataFrame, entity: str, batch: str, reason: str) -> int:
        """Keep rows (source_file, raw) that cannot be loaded and count them; a batch's replace its earlier ones."""
        path = f"{self._rejects}/{entity}-{batch}-{reason.replace(' ', '_')}"
        rows.select(F.lit(entity).alias("entity"), F.lit(batch).alias("batch"), "source_file", F.lit(reason).alias("reason"),
                    "raw").write.mode("overwrite").parquet(path)
        return self.spark.read.schema(REJECT_SCHEMA).parquet(path).count()

    def rejected(self) -> DataFrame:
        """All refused rows."""
        path, fs = self._fs(self._rejects)
        if not fs.exists(path):
            return local_rows(self.spark, [], REJECT_SCHEMA)
        return self.spark.read.schema(REJECT_SCHEMA).parquet(f"{self._rejects}/*")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self, entity: str) -> list[str]:
        folder, fs = self._fs(f"{self.root}/{entity}")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(n[len("batch="):] for n in names if n.startswith("batch="))

    def statuses(self, entity: str | None = None) -> DataFrame:
        """Latest status per batch."""
        path, fs = self._fs(self._status)
        if not fs.exists(path):
            return local_rows(self.spark, [], "entity string, batch string, status string")
        log = self.spark.read.schema(STATUS_SCHEMA).parquet(f"{self._status}/*")
        if entity:
            log = log.where(F.col("entity") == entity)
        return log.groupBy("entity", "batch").agg(F.max_by("status", "seq").alias("status"))

    def pending_all(self) -> dict[str, list[str]]:
        """Pending batches of every entity, from one look at the statuses; finished ones are not fetched."""
        waiting = {(r.entity, r.batch) for r in self.statuses().where(F.col("status") == "Pending").collect()}
        return {e: sorted(b for x, b in waiting if x == e) for e in STAGING_COLUMNS}

    def pending(self, entity: str) -> list[str]:
        return self.pending_all()[entity]

    def read_pending(self, entity: str, batches: list[str]) -> DataFrame:
        paths = [f"{self.root}/{entity}/batch={b}" for b in batches]
        return self.spark.read.schema(self.schema(entity)).parquet(*paths)

    def read(self, entity: str) -> DataFrame:
        """All batches, each row with the status of its batch."""
        rows = self.spark.read.schema(self.schema(entity) + ", batch string").parquet(f"{self.root}/{entity}")
        known = self.statuses(entity).select("batch", "status")
        return (rows.join(known, "batch", "left")
                .withColumn("stg_status", F.coalesce("status", "stg_status")).drop("status"))

    def mark(self, entity: str, batches: list[str], ok: bool) -> None:
        if not batches:
            return
        self._record(entity, batches, "Processed" if ok else "Error")

    def _record(self, entity: str, batches: list[str], status: str) -> None:
        """Append statuses; each entity has a folder of its own, as entities are staged at the same time."""
        seq = time.time_ns()
        append_rows(self.spark, f"{self._status}/{entity}", STATUS_SCHEMA, [(entity, b, status, seq) for b in batches])


def mark_processed(stg: DataFrame, ok: bool, load_ids: DataFrame | None = None) -> DataFrame:
    """Pending rows become Processed or Error; with ``load_ids`` only those."""
    new = F.when(F.col("stg_status") == "Pending", "Processed" if ok else "Error").otherwise(F.col("stg_status"))
    if load_ids is None:
        return stg.withColumn("stg_status", new)
    loaded = load_ids.select(F.col("stg_load_id").alias("_loaded")).distinct()
    joined = stg.join(loaded, stg["stg_load_id"] == F.col("_loaded"), "left")
    return joined.withColumn("stg_status", F.when(F.col("_loaded").isNotNull(), new)
                             .otherwise(F.col("stg_status"))).drop("_loaded")
