"""A warehouse that builds and stores each table when it is first asked for."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from carelake.operators import dimensions as dims
from carelake.operators.facts import LOOKUPS, load_fact, repeated_ids, without_repeats
from carelake.plans.views import VIEW_TABLES, VIEW_YEAR, VIEWS
from carelake.schemas import FACTS, empty_table
from carelake.session import scratch_dir
from carelake.sources import testdata
from carelake.sources.layout import VIEW_LAYOUT, ClusteredTable, cluster
from carelake.sources.tables import TableStore

STAGING_OF = {"FactClaims": "claims", "FactLabResults": "labs", "FactPrescriptions": "prescriptions",
              "FactFinancials": "financials"}
REFERENCE = ("DimDiagnosis", "DimProcedure", "DimDrug")


class Warehouse:
    """Mapping of warehouse table names to data frames over stored Parquet.

    A first load runs against dimensions that hold only their unknown member
    and against empty facts.  ``view`` stores a reporting view, as a report
    tool importing it would; measures and charts then scan a few columns of
    one table and join nothing.
    """

    def __init__(self, spark: SparkSession, staging: Callable[[str], DataFrame], root: str,
                 calendar: tuple[str, str] = dims.DEFAULT_CALENDAR, as_of: str = testdata.LOADED_AT):
        self.spark, self.staging, self.calendar, self.as_of = spark, staging, calendar, as_of
        self.store = TableStore(spark, root)
        self._ready: dict[str, DataFrame] = {}
        self._clustered: dict[str, ClusteredTable] = {}
        self._lock = threading.RLock()

    def __getitem__(self, name: str) -> DataFrame:
        with self._lock:
            if name not in self._ready:
                self._ready[name] = self._stored(name)
            return self._ready[name]

    def tables(self, *names: str) -> dict[str, DataFrame]:
        return {n: self[n] for n in names}

    def view_tables(self, view: str) -> dict[str, DataFrame]:
        return self.tables(*VIEW_TABLES[view])

    def view(self, name: str) -> DataFrame:
        with self._lock:
            if name not in self._ready:
                df = VIEWS[name](self.view_tables(name))
                self._ready[name] = self.store.write_table(df, "rpt", name, partition_by=VIEW_YEAR[name])
            return self._ready[name]

    def patient_rows(self, name: str, patient_id: str | None = None, start=None, end=None) -> DataFrame:
        """Rows of a view for one patient or span of days, from the files that may hold them.

        The first call lays the stored view out by patient and day, as maintenance would after a load.
        """
        with self._lock:
            if name not in self._clustered:
                self._clustered[name] = cluster(self.store, "rpt", name, self.view(name), VIEW_LAYOUT[name])
                self._ready[name] = self._clustered[name].table
        return self._clustered[name].rows(patient_id, start, end)

    def _stored(self, name: str) -> DataFrame:
        if name not in FACTS:
            return self.store.write_table(self._build(name), "dw", name)
        stored = self.store.write_table(self._build(name), "dw", name, partition_by="PartitionYear")
        # repeated ids are looked for in the column as stored: in the batch, all its joins would run once more
        doubts, n = repeated_ids(name, stored)
        if not n:
            return stored
        return self.store.replace(without_repeats(name, stored, doubts, *self._load_of(name)), "dw", name, "PartitionYear")

    def _load_of(self, fact: str) -> tuple[DataFrame, dict[str, DataFrame], str]:
        needed = {d for d, _, _ in LOOKUPS[fact].values()} | {"DimDate"}
        return self.staging(STAGING_OF[fact]), self.tables(*needed), self.as_of

    def _build(self, name: str) -> DataFrame:
        spark, stg, at = self.spark, self.staging, self.as_of
        if name == "DimDate":
            return dims.build_dim_date(spark, *self.calendar)
        if name in REFERENCE:
            return dims.reference_dims(spark)[name]
        if name in FACTS:
            return load_fact(name, empty_table(spark, name), *self._load_of(name), on_duplicate="keep_all")
        start = dims.sentinel_rows(spark, name)
        if name == "DimPayer":
            return dims.load_dim_payer(start, stg("payers"), at)
        if name == "DimFacility":
            return dims.load_dim_facility(start, stg("facilities"), at)
        if name == "DimProvider":
            return dims.load_dim_provider(start, stg("providers"), self["DimFacility"], at)
        if name == "DimPatient":
            return dims.load_dim_patient(start, stg("patients"), self["DimPayer"], self["DimProvider"], at)
        raise KeyError(name)


_open: dict[tuple, Warehouse] = {}
_open_lock = threading.Lock()


def _fingerprint(spark: SparkSession, sf_dir: str) -> tuple:
    """Path, size, file count and time of each input, so new input is noticed at any depth; one look per table."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in fs.listStatus(folder):
        size = fs.getContentSummary(status.getPath())
        found.append((status.getPath().toString(), size.getLength(), size.getFileCount(), status.getModificationTime()))
    return tuple(sorted(found))


def warehouse_for(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The session's warehouse over the given tables in ``sf_dir``."""
    key = (spark.sparkContext.applicationId, sf_dir, _fingerprint(spark, sf_dir))
    with _open_lock:
        if key not in _open:
            _open[key] = Warehouse(spark, lambda e: testdata.staged(spark, sf_dir, e),
                                   scratch_dir(spark, "warehouse"), testdata.CALENDAR)
        return _open[key]
