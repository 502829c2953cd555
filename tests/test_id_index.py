"""The membership index of natural ids against plain anti joins, plans and failures."""

import random

import pytest

from carelake.operators import facts
from carelake.operators.id_index import IdIndex
from carelake.plans.etl import Etl
from carelake.registry.loads import SECOND_LOAD
from carelake.schemas import ENTITIES
from carelake.session import scratch_dir
from carelake.sources import testdata as td


def table(spark, *keyed):
    return spark.createDataFrame(list(keyed), "id string, key bigint")


def index_of(spark, root=None, **options):
    return IdIndex(spark, root or scratch_dir(spark, "ids"), "id", "key", **options)


def asked(spark, *ids):
    return spark.createDataFrame([(i, 1) for i in ids], "claim string, other int")


def unseen(spark, index, *ids):
    return sorted((r["claim"] for r in index.unseen(asked(spark, *ids), "claim").collect()), key=lambda i: i or "")


def test_empty_index_knows_nothing(spark):
    index = index_of(spark)
    index.catch_up(table(spark))
    assert (index.top, index.size) == (0, 0) and unseen(spark, index, "a", "a", None) == [None, "a", "a"]
    assert index.known(asked(spark, "a").selectExpr("claim AS id")).count() == 0


def test_generations_equal_an_anti_join(spark):
    draw, rows, index = random.Random(4), [], index_of(spark, buckets=5, most=3)
    for load in range(6):
        rows += [(f"C{draw.randrange(2000)}", len(rows) + k + 1) for k in range(300)] + [(None, len(rows) + 301)]
        index.catch_up(table(spark, *rows))
        assert index.top == len(rows) and index.size == sum(i is not None for i, _ in rows)
        ids, held = {f"C{k}" for k in range(2000)}, {i for i, _ in rows}
        assert set(unseen(spark, index, *ids)) == ids - held
        # a session that opens the index anew sees the same
        assert index_of(spark, index.root, buckets=5)._live == index._live and len(index._live) <= 3
    assert index._live[-1][1] == 1


def test_only_new_rows_are_read_and_nothing_twice(spark):
    index = index_of(spark)
    index.catch_up(table(spark, ("a", 1), ("b", 2)))
    index.catch_up(table(spark, ("changed", 1), ("changed", 2), ("c", 3)))
    assert unseen(spark, index, "a", "b", "c", "changed", "d") == ["changed", "d"]
    live = list(index._live)
    index.catch_up(table(spark, ("a", 1), ("b", 2), ("c", 3)))
    assert index._live == live


def test_a_half_written_generation_does_not_count(spark):
    index = index_of(spark, buckets=3)
    index.catch_up(table(spark, ("a", 1)))
    # ids of generation 2 are there, its line is not
    table(spark, ("lost", 2)).selectExpr("id", "0 AS bucket").write.partitionBy("bucket").parquet(index._folder(2, "ids"))
    again = index_of(spark, index.root, buckets=3)
    assert unseen(spark, again, "lost", "a") == ["lost"]
    again.catch_up(table(spark, ("a", 1), ("b", 2)))
    assert unseen(spark, again, "lost", "a", "b") == ["lost"] and again.size == 2


def test_wide_batches_are_joined_by_shuffle(spark, monkeypatch):
    index = index_of(spark)
    index.catch_up(table(spark, *[(f"k{i}", i) for i in range(1, 500)]))
    monkeypatch.setattr("carelake.operators.id_index.BROADCAST_IDS", 10)
    assert len(unseen(spark, index, *[f"k{i}" for i in range(1, 700)])) == 200


def test_new_ids_read_no_ids_and_the_fact_is_not_read(spark, sf, wh):
    stored = Etl(spark, scratch_dir(spark, "etl-ids")).store
    stored.write_table(wh["FactClaims"], "dw", "FactClaims", partition_by="PartitionYear")
    fact = stored.read_table("dw", "FactClaims")
    index = facts.fact_index(spark, scratch_dir(spark, "ids"), "FactClaims")
    index.catch_up(fact)
    assert index.top == fact.agg({"ClaimKey": "max"}).first()[0] and index.size == fact.count()
    names = {d for d, _, _ in facts.LOOKUPS["FactClaims"].values()} | {"DimDate"}

    def plan(batch):
        rows = facts.load_fact("FactClaims", fact, batch, wh.tables(*names), SECOND_LOAD, index=index)
        return rows, rows.inputFiles()

    batch = td.staged(spark, sf, "claims")
    rows, files = plan(batch)
    assert rows.count() == 0 and not any(stored.path("dw", "FactClaims") in f for f in files) and any(f"{index.root}/ids/" in f for f in files)
    new = batch.selectExpr(*["concat('new-', claim_id) AS claim_id" if c == "claim_id" else c for c in batch.columns])
    rows, files = plan(new)
    assert rows.count() == batch.select("claim_id").distinct().count() and rows.agg({"ClaimKey": "min"}).first()[0] > index.top
    assert not any(stored.path("dw", "FactClaims") in f for f in files)
    # one false "maybe" in thousands
    assert index.known(new.selectExpr("claim_id AS id")).count() == 0


def test_old_row_groups_are_skipped_by_their_statistics(spark, wh):
    fact = wh["FactClaims"]
    plan = fact.where(f"ClaimKey > {10**9}").select("ClaimID")._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThan(ClaimKey,{10**9})" in plan


def test_a_load_that_failed_after_the_append_is_made_up_for(spark, sf):
    root = scratch_dir(spark, "etl-failed")
    etl = Etl(spark, root, calendar=("2024-01-01", "2024-12-31"))
    entity = "financials"
    assert entity in ENTITIES
    staged = td.staged(spark, sf, entity).limit(50).persist()
    etl.staging.add(staged, entity, "one")
    etl.run_step("FactFinancials", "2024-06-01 00:00:00")
    first = etl.table("FactFinancials").count()
    # the rows are in the table, but no line of the index tells of them
    assert facts.fact_index(spark, f"{root}/dw/_ids", "FactFinancials").size == 0
    etl.staging.add(staged, entity, "two")
    etl.run_step("FactFinancials", "2024-06-02 00:00:00")
    assert etl.table("FactFinancials").count() == first
    assert facts.fact_index(spark, f"{root}/dw/_ids", "FactFinancials").size == first
    staged.unpersist()


def test_ids_and_filters_of_a_generation_are_written_in_one_pass(spark, monkeypatch):
    moved, gathered = [], IdIndex._gathered
    monkeypatch.setattr(IdIndex, "_gathered", lambda self, ids: moved.append(1) or gathered(self, ids))
    index = index_of(spark, buckets=3)
    index.catch_up(table(spark, *[(f"k{i}", i) for i in range(1, 200)], (None, 200)))
    assert len(moved) == 1 and index.size == 199 and index.top == 200
    assert index._ids([1]).count() == 199 and index._filters().count() == 3


def test_only_ids_that_may_be_known_meet_the_ids_held(spark, monkeypatch):
    monkeypatch.setattr("carelake.operators.id_index.BROADCAST_IDS", 10)
    index = index_of(spark, buckets=3)
    index.catch_up(table(spark, *[(f"k{i}", i) for i in range(1, 500)]))
    maybe, sure, held, n = index._asked(spark.range(400, 5000).selectExpr("concat('k', id) AS id"))
    assert 100 <= n < 110 and maybe.count() == n and sure.count() == 4600 - n
    assert maybe.join(held, "id", "left_semi").count() == 100
    assert unseen(spark, index, "k1", *[f"k{i}" for i in range(490, 520)], None, None) == [None, None] + [f"k{i}" for i in range(500, 520)]


def test_filters_over_steps_equal_one_over_all(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from carelake.operators import id_index
    draw = np.random.default_rng(3).integers(-2**62, 2**62, size=(2, 5000))
    ids = pa.table({"id": [str(i) for i in range(5000)], "bucket": pa.array([1] * 5000, pa.int32()), "h1": draw[0], "h2": draw[1]})
    whole = id_index.bloom_filter(ids.slice(0, 2000))
    asked = id_index.maybe_known(ids, whole)
    monkeypatch.setattr(id_index, "STEP", 64)
    assert id_index.bloom_filter(ids.slice(0, 2000)).equals(whole) and id_index.maybe_known(ids, whole).equals(asked)
    told = asked.column("maybe").to_pylist()
    assert all(told[:2000]) and sum(told[2000:]) < 10
