"""Tables laid out so that queries of one patient or of a span of days open few files.

``cluster`` rewrites a stored table, as a maintenance step after loads.  Inside
each partition of a year, rows follow a key that interleaves the bits of the
patient's hash cell with those of the day of the year, so each file holds a
small rectangle of patients and days.  A patient's rows then lie in about the
square root of a year's files, as do a day's.  The order goes on with patient
and row id, so a hot patient's rows spread over many files.

The rectangle of each file is kept in ``_ranges`` inside the table's version
folder, where scans of the table do not look.  ``ClusteredTable.rows`` names
the files whose rectangle the question meets; the driver gets those names
only, as it does in any listing.  Inside a file, row groups are skipped by the
footer's bounds of the date and by dictionary or Bloom filter of the patient.

A row without patient or date has the cell of the empty text or the first day;
a file's range counts given values only, since no condition meets a missing one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.functions.predicates import as_date, date_range, optional_filters
from carelake.sources.tables import TableStore

CELL_BITS = 9  # 512 patient cells, and days up to the 511th after New Year
_CELLS = 1 << CELL_BITS
RANGES = "_ranges"


@dataclass(frozen=True)
class Layout:
    patient: str
    date: str
    year: str  # the partition column
    row_id: str


#: The reporting views that hold patients.  Results and fills may fall into the year after the partition's.
VIEW_LAYOUT = {
    "vw_ClaimsSummary": Layout("PatientID", "ServiceDate", "ServiceYear", "ClaimID"),
    "vw_LabResults": Layout("PatientID", "ResultDate", "OrderYear", "LabID"),
    "vw_Prescriptions": Layout("PatientID", "FillDate", "PrescribedYear", "PrescriptionID"),
}


def patient_cell(patient: Column) -> Column:
    return F.xxhash64(F.coalesce(patient, F.lit(""))).bitwiseAND(F.lit(_CELLS - 1)).cast("int")


def day_cell(date: Column, year: Column) -> Column:
    """Days since New Year of the partition's year, held inside 0 to 511."""
    days = F.date_diff(date, F.make_date(year, F.lit(1), F.lit(1)))
    return F.coalesce(F.least(F.greatest(days, F.lit(0)), F.lit(_CELLS - 1)), F.lit(0))


def interleaved(a: Column, b: Column) -> Column:
    """One integer of the bits of both, of ``a`` first."""
    bit = lambda c, i, to: F.shiftleft(F.shiftright(c, i).bitwiseAND(F.lit(1)), to)
    key = F.lit(0)
    for i in range(CELL_BITS):
        key = key.bitwiseOR(bit(a, i, 2 * i + 1)).bitwiseOR(bit(b, i, 2 * i))
    return key


def clustered(df: DataFrame, layout: Layout, files: int | None = None) -> DataFrame:
    """Rows in ranges of the key: ``files`` of them, else as many as adaptive execution finds fit."""
    key = interleaved(patient_cell(F.col(layout.patient)), day_cell(F.col(layout.date), F.col(layout.year)))
    order = [F.col(layout.year), key, F.col(layout.patient), F.col(layout.row_id)]
    ranged = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order)


class ClusteredTable:
    def __init__(self, rows: DataFrame, path: str, layout: Layout):
        self.table, self.path, self.layout = rows, path, layout
        self.spark = rows.sparkSession

    def files(self, patient_id: str | None = None, start=None, end=None) -> DataFrame:
        """Paths, below the table's folder, of the files that may hold such rows."""
        met = self.spark.read.parquet(f"{self.path}/{RANGES}")
        if patient_id is not None:
            cell = patient_cell(F.lit(patient_id))
            met = met.where((F.col("first_cell") <= cell) & (F.col("last_cell") >= cell))
        return optional_filters(met, at_least={"last_day": as_date(start)}, at_most={"first_day": as_date(end)})

    def rows(self, patient_id: str | None = None, start=None, end=None) -> DataFrame:
        """The patient's rows in the span, both ends included; None asks for all patients or days."""
        df = self.table
        if not (patient_id is None and start is None and end is None):
            names = [r.file for r in self.files(patient_id, start, end).select("file").toLocalIterator()]
            df = self.spark.read.schema(df.schema).option("basePath", self.path).parquet(
                *[f"{self.path}/{n}" for n in names]) if names else df.where(F.lit(False))
        return date_range(optional_filters(df, equals={self.layout.patient: patient_id}), self.layout.date, start, end)


def cluster(store: TableStore, layer: str, name: str, df: DataFrame, layout: Layout, files: int | None = None,
            patients: int = 1_000_000, row_group_bytes: int | None = None) -> ClusteredTable:
    """Write ``df`` as the table's next version in this layout.

    ``patients`` sizes the Bloom filter of a row group.  Parquet writes one only
    where a group holds too many patients for a dictionary, which skips as well.
    """
    options = {f"parquet.bloom.filter.enabled#{layout.patient}": "true",
               f"parquet.bloom.filter.expected.ndv#{layout.patient}": str(patients)}
    if row_group_bytes:
        options["parquet.block.size"] = str(row_group_bytes)
    rows = store.write_table(clustered(df, layout, files), layer, name, partition_by=layout.year, options=options, ordered=True)
    path = store.path(layer, name)
    given = F.when(F.col(layout.patient).isNotNull(), patient_cell(F.col(layout.patient)))
    inner = F.substring_index(F.col("_metadata.file_path"), f"{path.rsplit('/', 1)[1]}/", -1)
    rows.groupBy(inner.alias("file")).agg(
        F.min(given).alias("first_cell"), F.max(given).alias("last_cell"), F.min(layout.date).alias("first_day"),
        F.max(layout.date).alias("last_day"), F.count(F.lit(1)).alias("n"),
    ).write.mode("overwrite").parquet(f"{path}/{RANGES}")
    return ClusteredTable(rows, path, layout)
