"""The layout by patient and day: files and row groups that a question skips, and equal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from carelake.plans import procedures as proc
from carelake.sources import layout
from carelake.sources.tables import TableStore

LABS = layout.Layout("PatientID", "ResultDate", "OrderYear", "LabID")
ROWS = 60_000


def labs(spark):
    """A third of all rows belongs to one patient; some rows lack patient or date; some results come a year later."""
    i = F.col("LabID")
    ordered = F.date_add(F.lit(dt.date(2023, 1, 1)), (i * 7919 % 730).cast("int"))
    return spark.range(ROWS).withColumnRenamed("id", "LabID").select(
        "LabID", F.when(i % 3 == 0, "hot").when(i % 1000 != 1, F.concat(F.lit("P"), F.pmod(F.xxhash64(i), F.lit(500)).cast("string"))).alias("PatientID"),
        F.when(i % 777 != 5, F.date_add(ordered, F.when(i % 50 == 7, 400).otherwise(3))).alias("ResultDate"),
        F.year(ordered).alias("OrderYear"), F.sha2(i.cast("string"), 256).alias("Note"))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    store = TableStore(spark, str(tmp_path_factory.mktemp("layout")))
    return layout.cluster(store, "rpt", "labs", labs(spark), LABS, files=32, row_group_bytes=64 << 10)


def scanned(df):
    """Rows asked for, files read and rows that left the scan's row groups."""
    n = len(df.collect())
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    metrics = [leaves.apply(k).metrics() for k in range(leaves.size())]
    total = lambda name: sum(m.apply(name).value() for m in metrics if m.contains(name))
    return n, total("numFiles"), total("numOutputRows")


QUESTIONS = [("P17", None, None), ("P17", "2023-03-01", "2023-03-31"), (None, "2024-02-01", "2024-02-05"),
             ("hot", "2023-05-01", "2023-05-10"), ("hot", None, None), ("nobody", None, None),
             (None, "2030-01-01", None), (None, None, "2023-01-20"), (None, None, None)]


@pytest.mark.parametrize("asked", QUESTIONS)
def test_same_rows_as_a_full_scan(spark, table, asked):
    patient, start, end = asked
    plain = labs(spark)
    if patient:
        plain = plain.where(F.col("PatientID") == patient)
    if start:
        plain = plain.where(F.col("ResultDate") >= F.lit(start).cast("date"))
    if end:
        plain = plain.where(F.col("ResultDate") <= F.lit(end).cast("date"))
    got = table.rows(*asked)
    assert sorted(got.columns) == sorted(plain.columns)
    got = got.select(plain.columns)
    assert sorted(got.collect(), key=lambda r: r.LabID) == sorted(plain.collect(), key=lambda r: r.LabID)


def test_files_and_row_groups_are_skipped(spark, table):
    files = table.files().count()
    assert files >= 32 and table.files().agg(F.sum("n")).first()[0] == ROWS
    assert table.files().agg(F.max("n")).first()[0] < 3 * ROWS / 32  # the hot patient spans files
    n, opened, read = scanned(table.rows("P17", "2023-03-01", "2023-04-30"))
    assert 0 < n and opened <= files / 6 and read < ROWS / 30
    n, opened, read = scanned(table.rows("P17"))
    assert 0 < n and opened <= files / 2 and read < ROWS / 5
    n, opened, read = scanned(table.rows(None, "2023-03-01", "2023-03-05"))
    assert 0 < n and opened <= files / 2 and read < ROWS / 3
    # without the file ranges all files are opened, and row groups alone are skipped
    n, opened, read = scanned(table.table.where("PatientID = 'P17'"))
    assert 0 < n and opened == files and read < ROWS / 5


def test_bloom_filter_where_a_dictionary_does_not_fit(spark, tmp_path):
    many = labs(spark).withColumn("PatientID", F.sha2(F.col("LabID").cast("string"), 512))
    table = layout.cluster(TableStore(spark, str(tmp_path)), "rpt", "labs", many, LABS, files=2, patients=100_000)
    # between the bounds of every row group and in none of them: only Bloom filters can rule it out
    n, opened, read = scanned(table.table.where(F.col("PatientID") == "8" * 128))
    assert n == 0 and opened > 0 and read == 0


def test_views_in_the_layout(wh):
    asked = ("C8", "1996-01-01", "2024-01-31")
    names = ("vw_ClaimsSummary", "vw_LabResults", "vw_Prescriptions")
    whole = proc.get_patient_timeline(*[wh.view(v) for v in names], *asked)
    picked = proc.get_patient_timeline(*[wh.patient_rows(v, *asked) for v in names], *asked)
    assert sorted(map(str, picked.collect())) == sorted(map(str, whole.collect())) and picked.count() > 0


def test_key_interleaves_both_cells(spark):
    def key(a, b):
        return spark.range(1).select(layout.interleaved(F.lit(a), F.lit(b))).first()[0]
    assert [key(0, 0), key(0, 1), key(1, 0), key(1, 1), key(0, 2), key(511, 511)] == [0, 1, 2, 3, 4, 2 ** 18 - 1]


def test_empty_table(spark, tmp_path):
    table = layout.cluster(TableStore(spark, str(tmp_path)), "rpt", "labs", labs(spark).limit(0), LABS)
    assert table.rows("P1", "2023-01-01").count() == 0 and table.rows().count() == 0
