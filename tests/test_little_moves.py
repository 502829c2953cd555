"""What loads and views move: ids instead of rows, facts before they are widened, nothing for the partitions of a table."""

import re

import pytest
from pyspark.sql import functions as F

from carelake.operators import id_index
from carelake.operators.lookups import keep_latest, resolve_duplicates
from carelake.plans import views
from carelake.sources.tables import by_partition


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def below(plan, text):
    """The lines of the first node with ``text`` and what is under it."""
    lines = plan.splitlines()
    first = next(i for i, line in enumerate(lines) if text in line)
    depth = lambda line: len(re.match(r"[\s:|+-]*", line).group())
    rest = [line for line in lines[first + 1:]]
    end = next((i for i, line in enumerate(rest) if depth(line) <= depth(lines[first])), len(rest))
    return "\n".join(lines[first:first + 1 + end])


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def batch(spark, rows):
    return spark.createDataFrame(rows, "id string, stg_load_date string, text string")


def test_a_batch_without_repeated_ids_is_not_moved(spark):
    rows = batch(spark, [(str(i), "1", "x") for i in range(50)] + [(None, "1", "y")])
    out = resolve_duplicates(rows, "id", "keep_latest", ["stg_load_date"])
    assert out.count() == 50 and "Window" not in plan_of(out) and "Exchange" not in plan_of(out)


def test_repeated_ids_are_resolved_as_before(spark):
    rows = batch(spark, [(str(i), "1", "x") for i in range(20)] + [("3", "2", "later"), ("4", "1", "z"), ("4", "1", "z"), ("5", None, "w")])
    out = resolve_duplicates(rows, "id", "keep_latest", ["stg_load_date"])
    assert sorted(out.collect()) == sorted(keep_latest(rows, "id", ["stg_load_date", "text"]).collect())


def test_rows_are_ordered_by_table_partition_without_a_shuffle(spark):
    assert "Exchange" not in plan_of(by_partition(spark.range(100).withColumn("year", F.col("id") % 3), "year"))


@pytest.mark.parametrize("view", ["vw_ClaimsSummary", "vw_LabResults", "vw_Prescriptions"])
def test_facts_meet_patients_before_they_are_widened(wh, no_broadcast, view):
    moved = below(plan_of(views.VIEWS[view](wh.view_tables(view))), "Exchange hashpartitioning(PatientKey")
    assert "ProviderKey" in moved and "Specialty" not in moved and "FullDate" not in moved


def test_facts_look_up_patients_last(wh, spark, sf, no_broadcast):
    from carelake.operators.facts import LOOKUPS, new_fact_rows
    from carelake.schemas import empty_table
    from carelake.sources import testdata
    names = {d for d, _, _ in LOOKUPS["FactClaims"].values()} | {"DimDate"}
    rows = new_fact_rows("FactClaims", testdata.staged(spark, sf, "claims"), empty_table(spark, "FactClaims"), wh.tables(*names),
                         "2024-06-01 00:00:00")
    moved = below(plan_of(rows), "Exchange hashpartitioning(patient_id")
    assert "ProviderKey" in moved and "DWLoadedAt" not in moved


def test_rows_known_already_are_left_out_by_their_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(id_index, "BROADCAST_IDS", 5)
    table = spark.range(1, 41).select(F.col("id").cast("string").alias("claim"), F.col("id").alias("k"))
    index = id_index.IdIndex(spark, str(tmp_path), "claim", "k", buckets=4)
    index.catch_up(table)
    asked = spark.range(1, 44).select(F.col("id").cast("string").alias("claim")).unionByName(spark.sql("SELECT CAST(NULL AS string) claim"))
    out = index.unseen(asked, "claim")
    assert sorted(str(r[0]) for r in out.collect()) == ["41", "42", "43", "None"]
    assert "LeftSemi" in plan_of(out)
    many = spark.range(20, 80).select(F.col("id").cast("string").alias("claim"))  # many known, many new
    assert index.unseen(many, "claim").count() == 39


def test_more_partitions_than_writers(spark, tmp_path):
    """A task writes the files of its years side by side, and sorts what lies beyond the number of writers."""
    from carelake.sources.tables import UNSORTED, WRITERS, TableStore
    rows = spark.range(0, 3000, 1, 3).select(F.col("id").alias("v"), (1950 + F.col("id") % (WRITERS + 10)).cast("int").alias("year"))
    before = {k: spark.conf.get(k) for k in UNSORTED}
    out = TableStore(spark, str(tmp_path)).write_table(rows, "rpt", "t", partition_by="year")
    assert out.count() == 3000 and out.exceptAll(rows).isEmpty()
    assert {k: spark.conf.get(k) for k in UNSORTED} == before


@pytest.mark.parametrize("view", ["vw_ClaimsSummary", "vw_Prescriptions"])
def test_views_and_facts_are_stored_without_a_sort(wh, spark, sf, no_broadcast, tmp_path, view, monkeypatch):
    from carelake.plans.warehouse import Warehouse
    from carelake.sources import testdata
    own = Warehouse(spark, lambda e: testdata.staged(spark, sf, e), str(tmp_path), testdata.CALENDAR)
    made, write = {}, own.store.write_table
    monkeypatch.setattr(own.store, "write_table", lambda df, *a, **k: made.setdefault(a[1], (df, write(df, *a, **k)))[1])
    own.view(view)
    fact = next(n for n in made if n.startswith("Fact"))
    for name in (view, fact):
        lines = plan_of(made[name][0]).splitlines()
        joins = next(i for i, x in enumerate(lines) if "Join" in x or "Scan" in x)
        assert not any("Sort [" in x for x in lines[:joins]), name
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(made[view][1]) == rows(wh.view(view).select(*made[view][1].columns))


def own_warehouse(spark, root, staging):
    from carelake.plans.warehouse import Warehouse
    from carelake.sources import testdata
    return Warehouse(spark, staging, str(root), testdata.CALENDAR)


def without_key(df, key):
    return sorted(map(str, df.drop(key).collect()))


@pytest.mark.parametrize("fact,key", [("FactClaims", "ClaimKey"), ("FactPrescriptions", "PrescriptionKey")])
def test_repeated_ids_are_counted_in_the_stored_rows(wh, spark, sf, tmp_path, monkeypatch, fact, key):
    """The batch of the given tables is a join of four of them; it is made once."""
    from carelake.operators import facts, lookups
    from carelake.sources import testdata
    counted, count = [], lookups.repeated_hashes
    monkeypatch.setattr(lookups, "repeated_hashes", lambda df, k: counted.append((k, plan_of(df))) or count(df, k))
    monkeypatch.setattr(facts, "repeated_hashes", lookups.repeated_hashes, raising=False)
    own = own_warehouse(spark, tmp_path, lambda e: testdata.staged(spark, sf, e))
    own._ready.update(wh.tables(*{d for d, _, _ in facts.LOOKUPS[fact].values()} | {"DimDate"}))
    stored = own[fact]
    plans = [plan for k, plan in counted if k in facts.SPECS[fact][:2]]
    assert len(plans) == 1 and "Join" not in plans[0]
    assert without_key(stored, key) == without_key(wh[fact], key)


def test_a_first_load_with_repeated_ids_keeps_the_latest(spark, sf, wh, tmp_path):
    from carelake.operators.facts import LOOKUPS, load_fact
    from carelake.schemas import empty_table
    from carelake.sources import testdata
    batch = testdata.staged(spark, sf, "claims")
    once = [{**r.asDict(), "claim_id": f"id-{i}"} for i, r in enumerate(batch.limit(30).collect())]
    later = [{**r, "claim_status": "Aaa", "stg_load_date": "2024-06-03 00:00:00"} for r in once[:5]]
    other = [{**r, "claim_status": "Zzz"} for r in once[:5]]
    nameless = [{**r, "claim_id": None} for r in once[:3]]
    rows = spark.createDataFrame([{**r, "stg_load_date": str(r["stg_load_date"])} for r in once + later + other + nameless],
                                 ", ".join(f"{f.name} string" for f in batch.schema)).select(
        *[F.col(f.name).cast(f.dataType) for f in batch.schema])
    dims = wh.tables(*{d for d, _, _ in LOOKUPS["FactClaims"].values()} | {"DimDate"})
    own = own_warehouse(spark, tmp_path, lambda e: rows)
    own._ready.update(dims)
    stored = own["FactClaims"]
    right = load_fact("FactClaims", empty_table(spark, "FactClaims"), rows, dims, "2024-06-01 00:00:00")
    assert without_key(stored, "ClaimKey") == without_key(right, "ClaimKey")
    assert stored.select("ClaimKey").distinct().count() == stored.count() == 30
    assert stored.where("ClaimStatus = 'Aaa'").count() == 5 and stored.where("ClaimStatus = 'Zzz'").count() == 0


@pytest.mark.parametrize("fact,entity,column", [("FactClaims", "claims", "WriteOffAmount"), ("FactPrescriptions", "prescriptions", "TotalCost"),
                                                ("FactLabResults", "labs", "DeviationFromMid")])
def test_columns_that_follow_from_others_are_not_moved(wh, spark, sf, no_broadcast, fact, entity, column):
    from carelake.operators.facts import LOOKUPS, new_fact_rows
    from carelake.schemas import empty_table
    from carelake.sources import testdata
    dims = wh.tables(*{d for d, _, _ in LOOKUPS[fact].values()} | {"DimDate"})
    rows = new_fact_rows(fact, testdata.staged(spark, sf, entity), empty_table(spark, fact), dims, "2024-06-01 00:00:00")
    assert column in rows.columns and column not in below(plan_of(rows), "Exchange hashpartitioning(patient_id")


def test_unrepeated_columns_are_written_without_a_dictionary(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    from carelake.sources.tables import TableStore
    rows = spark.range(500).select(F.concat(F.lit("c"), "id").alias("ClaimID"), (F.col("id") % 3).cast("string").alias("ClaimStatus"))
    out = TableStore(spark, str(tmp_path)).write_table(rows.coalesce(1), "rpt", "t")
    group = pq.ParquetFile(glob.glob(f"{tmp_path}/rpt/t/*/*.parquet")[0]).metadata.row_group(0)
    coded = {group.column(i).path_in_schema: any("DICTIONARY" in e for e in group.column(i).encodings) for i in range(2)}
    assert coded == {"ClaimID": False, "ClaimStatus": True} and out.exceptAll(rows).isEmpty()


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().endswith(".data")}


def test_shuffle_files_go_when_a_table_is_written(spark, tmp_path):
    from carelake.operators.dimensions import sentinel_rows
    from carelake.operators.keys import surrogate_keys
    from carelake.sources.staging import StagingArea
    from carelake.sources.tables import MOVED_ONCE, TableStore
    before, kept = shuffle_files(spark), {k: spark.conf.get(k) for k in MOVED_ONCE}
    rows = spark.range(0, 1000, 1, 3).select(F.col("id").cast("string").alias("lab_id")).repartition(5, "lab_id")
    TableStore(spark, str(tmp_path)).write_table(rows, "rpt", "t")
    StagingArea(spark, str(tmp_path)).add(rows, "labs", "1")
    surrogate_keys(rows, "k", "lab_id")
    one = sentinel_rows(spark, "DimPatient").repartition(3)
    TableStore(spark, str(tmp_path)).write_current(one, one, "dw", "DimPatient")
    assert shuffle_files(spark) <= before and {k: spark.conf.get(k) for k in MOVED_ONCE} == kept


def test_a_reloaded_batch_is_made_once(spark, sf):
    """What counts, asks about and loads the batch reads it from where it was staged."""
    import __spark_entry__
    files = __spark_entry__.queries()["reload_by_id_index"](spark, sf).inputFiles()
    assert any("/stg/claims/" in f for f in files) and not any("lineitem" in f for f in files)


@pytest.mark.parametrize("limit", [200_000, 1])
def test_current_versions_are_followed_by_id_without_a_broadcast(wh, spark, monkeypatch, limit):
    """Versions with one, no and two current ones, and without an id, as by two joins; many versions are not broadcast and facts move once."""
    from carelake.operators import lookups
    monkeypatch.setattr(lookups, "BROADCAST_ROWS", limit, raising=False)
    rows = [(1, "A", False), (2, "A", True), (3, "B", False), (4, "C", True), (5, "C", True), (6, "C", False), (7, None, True), (8, "D", None)]
    patients = spark.createDataFrame([(k, i, f"n{k}", f"s{k}", now) for k, i, now in rows],
                                     "PatientKey bigint, PatientID string, FullName string, State string, IsCurrent boolean")
    fact = spark.range(10).select((F.col("id") % 9).alias("PatientKey"), F.col("id").alias("v"))
    columns = ["PatientID", "FullName", "State"]
    got = views._patients({"DimPatient": patients}, fact, columns, "current_by_id").select("v", "PatientKey", *columns)
    current = patients.where("IsCurrent").select(*columns)
    right = fact.join(patients.select("PatientKey", "PatientID"), "PatientKey").join(current, "PatientID").select("v", "PatientKey", *columns)
    assert sorted(got.collect()) == sorted(right.collect()) and got.count() == 8
    plan = plan_of(views.vw_claims_summary(wh.view_tables("vw_ClaimsSummary"), "current_by_id"))
    assert ("ShuffledHashJoin [PatientKey" in plan) == (limit == 1)
    assert "Join [PatientID" not in plan
