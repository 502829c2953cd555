"""The load: staging batches to dimensions and facts, with a run log."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from carelake.functions.predicates import recent_runs
from carelake.operators import dimensions as dims
from carelake.operators.facts import fact_index, load_fact
from carelake.operators.keys import max_key
from carelake.schemas import TABLES, empty_table
from carelake.session import scratch_scope
from carelake.sources.landing import without_id
from carelake.sources.staging import StagingArea
from carelake.sources.tables import TableStore, append_rows

# Load order: table -> staging entity.
STEPS = {
    "DimPayer": "payers", "DimFacility": "facilities", "DimProvider": "providers", "DimPatient": "patients",
    "FactClaims": "claims", "FactLabResults": "labs", "FactPrescriptions": "prescriptions",
    "FactFinancials": "financials",
}
STATIC = ("DimDate", "DimDiagnosis", "DimProcedure", "DimDrug")


class EtlLog:
    """Run log: a Running row when a step starts, a final row when it ends.

    Rows are appended under one LogID; readers take the last per LogID.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/dw/ETLLog"
        self._last: int | None = None

    def _rows(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return empty_table(self.spark, "ETLLog")
        return self.spark.read.schema(TABLES["ETLLog"]).parquet(self.path)

    def read(self) -> DataFrame:
        last = F.max_by(F.struct(*[c for c in self._rows().columns if c != "LogID"]),
                        F.when(F.col("Status") == "Running", 0).otherwise(1))
        return self._rows().groupBy("LogID").agg(last.alias("r")).select("LogID", "r.*")

    def append(self, *row) -> None:
        append_rows(self.spark, self.path, TABLES["ETLLog"], [row])

    def next_id(self) -> int:
        """One more than the highest id; looked up once per session."""
        if self._last is None:
            self._last = max_key(self._rows(), "LogID")
        self._last += 1
        return self._last


def etl_log(log: DataFrame) -> DataFrame:
    """Run log with the duration of each step in seconds."""
    return log.withColumn("DurationSec", F.timestamp_diff("SECOND", "RunStarted", "RunFinished"))


def run_summary(log: DataFrame, as_of, minutes: int = 5) -> DataFrame:
    recent = etl_log(recent_runs(log, as_of, minutes))
    return recent.orderBy("LogID").select(
        "LogID", "Entity", "RowsInserted", "RowsUpdated", "RowsSkipped", "Status", "DurationSec")


def rows_affected(log: DataFrame) -> DataFrame:
    """Inserted plus updated, the single count a merge statement reports."""
    return log.withColumn("rows_affected", F.col("RowsInserted") + F.col("RowsUpdated"))


def _utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


class Etl:
    def __init__(self, spark: SparkSession, root: str, calendar: tuple[str, str] = dims.DEFAULT_CALENDAR,
                 on_duplicate: str = "keep_latest", clock: Callable[[], dt.datetime] = _utc_now, id_buckets: int = 64):
        """``id_buckets``: about one per million facts expected; see ``id_index``."""
        self.spark, self.calendar, self.on_duplicate, self.clock, self.id_buckets = spark, calendar, on_duplicate, clock, id_buckets
        self.store, self.staging, self.log = TableStore(spark, root), StagingArea(spark, root), EtlLog(spark, root)

    def table(self, name: str) -> DataFrame:
        """A stored table, or its initial content."""
        if self.store.exists("dw", name):
            return self.store.read_table("dw", name)
        if name == "DimDate":
            return self.store.write_table(dims.build_dim_date(self.spark, *self.calendar), "dw", name)
        if name in STATIC:
            return self.store.write_table(dims.reference_dims(self.spark)[name], "dw", name)
        if name.startswith("Dim"):
            return dims.sentinel_rows(self.spark, name)
        return empty_table(self.spark, name)

    def _load_dim(self, name: str, stg: DataFrame, as_of) -> tuple[int, int]:
        how = self.on_duplicate
        if name == "DimPatient":
            old = self.store.read_current("dw", name) if self.store.exists("dw", name) else self.table(name)
            merge = dims.merge_dim_patient(old, stg, self.table("DimPayer"), self.table("DimProvider"), as_of, how)
            self.store.write_current(merge.standing.unionByName(merge.inserted), merge.closed, "dw", name)
            return merge.n_inserted, merge.n_updated
        old = self.table(name)
        if name == "DimPayer":
            merge = dims.merge_dim_payer(old, stg, as_of, how)
        elif name == "DimFacility":
            merge = dims.merge_dim_facility(old, stg, as_of, how)
        else:
            merge = dims.merge_dim_provider(old, stg, self.table("DimFacility"), as_of, how)
        self.store.write_table(merge.whole(), "dw", name)
        return merge.n_inserted, merge.n_updated

    def _load_fact(self, name: str, stg: DataFrame, as_of) -> tuple[int, int]:
        sides = {t: self.table(t) for t in (*STATIC, "DimPayer", "DimFacility", "DimProvider", "DimPatient")}
        fact, index = self.table(name), fact_index(self.spark, f"{self.store.root}/dw/_ids", name, buckets=self.id_buckets)
        index.catch_up(fact)
        rows = load_fact(name, fact, stg, sides, as_of, on_duplicate=self.on_duplicate, index=index)
        seen = Observation()
        self.store.write_table(rows.observe(seen, F.count(F.lit(1)).alias("ins")), "dw", name,
                               partition_by="PartitionYear", append=True)
        return seen.get["ins"], 0

    def run_step(self, name: str, as_of, batches: list[str] | None = None) -> None:
        """Load the given batches of one table, by default all pending ones."""
        entity, log_id, started = STEPS[name], self.log.next_id(), self.clock()
        batches = self.staging.pending(entity) if batches is None else batches
        if not batches:
            self.log.append(log_id, started, self.clock(), name, 0, 0, 0, "Success", None)
            return
        self.log.append(log_id, started, None, name, 0, 0, 0, "Running", None)
        try:
            stg = self.staging.read_pending(entity, batches)
            refused = self.staging.reject(without_id(stg, entity), entity, f"run-{log_id:06d}", "no id")
            is_fact = name.startswith("Fact")
            with scratch_scope(self.spark):
                inserted, updated = (self._load_fact if is_fact else self._load_dim)(name, stg, as_of)
            skipped = stg.count() - inserted if is_fact else refused
            self.staging.mark(entity, batches, ok=True)
        except Exception as exc:
            self.staging.mark(entity, batches, ok=False)
            self.log.append(log_id, started, self.clock(), name, 0, 0, 0, "Error", str(exc))
            raise
        self.log.append(log_id, started, self.clock(), name, inserted, updated, skipped, "Success", None)

    def run_all(self, as_of) -> DataFrame:
        """All steps in order; a failing step stops the run, earlier ones stay.

        The run works on the batches pending at its start; later ones wait.
        """
        started, pending = self.clock(), self.staging.pending_all()
        for name, entity in STEPS.items():
            self.run_step(name, as_of, pending[entity])
        log = self.log.read()
        return run_summary(log.where(F.col("RunStarted") >= F.lit(str(started)).cast("timestamp_ntz")),
                           self.clock(), minutes=24 * 60)


def etl_run_all(spark: SparkSession, root: str, as_of, **options) -> DataFrame:
    return Etl(spark, root, **options).run_all(as_of)
