import numpy as np
import pytest
from pyspark.sql import functions as F

from carelake.operators import access, cache, search, usage
from carelake.schemas import TABLES, empty_table

AS_OF = "2024-01-01 00:20:00"


def cached(spark, *rows):
    """(id, agent, query, expiry minute, vector)"""
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    data = [(i, f"k{i}", a, query, f"r{i}", t0, t0 + dt.timedelta(minutes=m), v) for i, a, query, m, v in rows]
    return spark.createDataFrame(data, TABLES["QueryCache"])


def asked(spark, *rows):
    return spark.createDataFrame(list(rows), "request_id bigint, AgentName string, embedding array<float>")


def test_best_candidate_above_floor(spark):
    store = cached(spark, (1, "Fin", "far", 60, [0.0, 1.0]), (2, "Fin", "close", 60, [0.99, 0.14107]))
    got = cache.semantic_candidate(asked(spark, (7, "Fin", [1.0, 0.0])), store, AS_OF).first()
    assert (got.CacheID, got.MatchedQuery, got.Response) == (2, "close", "r2") and abs(got.Score - 0.99) < 1e-6


@pytest.mark.parametrize("row,enabled", [
    ((1, "Fin", "far", 60, [0.0, 1.0]), True), ((1, "Fin", "same", 60, [1.0, 0.0]), False),
    ((1, "Fin", "expired", 20, [1.0, 0.0]), True), ((1, "Other", "agent", 60, [1.0, 0.0]), True),
    ((1, "Fin", "no vector", 60, None), True)])
def test_no_candidate(spark, row, enabled):
    got = cache.semantic_candidate(asked(spark, (7, "Fin", [1.0, 0.0])), cached(spark, row), AS_OF, enabled=enabled)
    assert got.count() == 0


def test_first_entry_wins_ties(spark):
    store = cached(spark, *[(i, "Fin", f"q{i}", 60, [1.0, 0.0]) for i in (5, 3, 9, 4)])
    got = cache.semantic_candidate(asked(spark, (7, "Fin", [1.0, 0.0])), store, AS_OF, block_rows=1)
    assert [r.CacheID for r in got.collect()] == [3]


def test_candidates_equal_brute_force_with_a_hot_agent(spark):
    rng = np.random.default_rng(1)
    unit = lambda: (lambda v: (v / np.linalg.norm(v)).astype("float32").tolist())(rng.normal(size=8))
    agents = ["hot"] * 200 + [f"a{i % 5}" for i in range(100)]
    store = [(i, agents[i], f"q{i}", 60, unit()) for i in range(300)]
    ask = [(i, agents[(i * 7) % 300], unit()) for i in range(60)]
    got = {r.request_id: r.CacheID for r in cache.semantic_candidate(
        asked(spark, *ask), cached(spark, *store), AS_OF, floor=0.5, block_rows=17).collect()}
    want = {}
    for rid, agent, v in ask:
        scores = [(float(np.dot(np.float64(v), np.float64(s[4]))), -s[0]) for s in store if s[1] == agent]
        top = max(scores)
        if top[0] >= 0.5:
            want[rid] = -top[1]
    assert got == want and len(want) > 20


def test_exact_lookup_ignores_case_and_space_and_honours_expiry(spark):
    entries = spark.createDataFrame([("Claims", "What is X?", "one")], "AgentName string, Query string, Response string")
    store = cache.cache_upsert(empty_table(spark, "QueryCache"), entries, "2024-01-01 00:00:00", ttl_minutes=30)
    ask = spark.createDataFrame([("Claims", "  what IS x? ")], "AgentName string, Query string")
    assert cache.cache_exact_lookup(ask, store, "2024-01-01 00:29:59").first().Response == "one"
    assert cache.cache_exact_lookup(ask, store, "2024-01-01 00:30:00").first().Response is None


def test_upsert_replaces_and_keeps_whole_questions(spark):
    ddl = "AgentName string, Query string, Response string, entry_no int"
    first = spark.createDataFrame([("A", "q", "old", 1), ("A", "q", "new", 2), ("A", "x" * 3000, "long", 1)], ddl)
    store = cache.cache_upsert(empty_table(spark, "QueryCache"), first, AS_OF)
    assert {(r.Response, len(r.Query)) for r in store.collect()} == {("new", 1), ("long", 3000)}
    second = spark.createDataFrame([("A", "Q ", "newest", 1)], ddl)
    assert {r.Response for r in cache.cache_upsert(store, second, AS_OF).collect()} == {"newest", "long"}
    assert cache.cache_invalidate(store, []).count() == 2 and cache.cache_invalidate(store, ["A"]).count() == 0


def log(spark, *rows):
    return spark.createDataFrame([(i, a, s, t, 0) for i, (a, s, t) in enumerate(rows, 1)],
                                 "LogID bigint, AgentName string, SessionID string, InputTokens int, OutputTokens int")


def test_first_call_over_budget_is_marked_once(spark):
    calls = log(spark, *[("A", "s", 300)] * 8, ("B", "s", 1))
    budgets = spark.createDataFrame([("A", 1000)], "AgentName string, token_budget bigint")
    for chunk in (2, 3, 1000):
        rows = usage.budget_crossing(calls, budgets, chunk_rows=chunk).orderBy("LogID").collect()
        assert [r.LogID for r in rows if r.crosses] == [4]
        assert [r.running_tokens for r in rows][:4] == [300, 600, 900, 1200] and rows[-1].token_budget == 20000


def test_remaining_without_usage_is_the_budget(spark):
    pairs = spark.createDataFrame([("A", "s"), ("A", "t")], "AgentName string, SessionID string")
    budgets = spark.createDataFrame([("A", 1000)], "AgentName string, token_budget bigint")
    got = usage.tokens_remaining(log(spark, ("A", "s", 300)), budgets, sessions=pairs)
    assert {(r.SessionID, r.remaining) for r in got.collect()} == {("s", 700), ("t", 1000)}


def test_usage_record_fills_defaults(spark):
    rows = spark.createDataFrame([("A", "s", 5)], "AgentName string, SessionID string, InputTokens int")
    got = usage.usage_record(empty_table(spark, "AgentUsageLog"), rows, AS_OF).first()
    assert (got.InputTokens, got.OutputTokens, got.CachedTokens, got.ToolCalls, got.ModelID) == (5, 0, 0, 0, None)


ALLOWED = [
    ("orchestrator", "rpt.vw_ClaimsSummary", "SELECT"), ("orchestrator", "dw.AgentUsageLog", "SELECT"),
    ("claims", "dw.FactClaims", "SELECT"), ("claims", "dw.DimPayer", "SELECT"),
    ("claims", "dw.usp_GetClaimsSummary", "EXECUTE"), ("clinical", "dw.FactLabResults", "SELECT"),
    ("clinical", "dw.usp_GetPatientTimeline", "EXECUTE"), ("financial", "dw.FactFinancials", "SELECT"),
    ("financial", "rpt.vw_FinancialKPIs", "SELECT"), ("reporting", "dw.usp_GetAgentUsage", "EXECUTE"),
    ("etl", "stg.Claims", "SELECT"), ("etl", "dw.FactClaims", "SELECT"), ("etl", "dw.ETLLog", "INSERT"),
    ("etl", "dw.usp_ETL_RunAll", "EXECUTE"), ("provider", "dw.DimProvider", "SELECT")]
REFUSED = [
    ("orchestrator", "dw.FactClaims", "SELECT"), ("orchestrator", "stg.Claims", "SELECT"),
    ("claims", "dw.FactFinancials", "SELECT"), ("claims", "dw.FactLabResults", "SELECT"),
    ("clinical", "dw.FactClaims", "SELECT"), ("clinical", "stg.Labs", "SELECT"), ("financial", "dw.FactClaims", "SELECT"),
    ("financial", "dw.DimPatient", "SELECT"), ("reporting", "dw.FactClaims", "SELECT"),
    ("etl", "dw.FactClaims", "INSERT"), ("etl", "dw.FactClaims", "DELETE"), ("provider", "dw.FactLabResults", "SELECT")]


def test_access_matrix(spark):
    got = {tuple(r) for r in access.effective_access(*access.policy_tables(spark)).collect()}
    assert all((f"agent_{p}", o, m) in got for p, o, m in ALLOWED)
    assert not any((f"agent_{p}", o, m) in got for p, o, m in REFUSED)


def test_mask_does_not_depend_on_the_row_count(spark):
    df = spark.range(101).select(F.col("id").cast("string").alias("PatientID"))
    assert access.mask_bulk_patient(df, ["PatientID"]).where("length(PatientID) = 64").count() == 101
    assert access.mask_bulk_patient(df.limit(3), ["PatientID"]).where("length(PatientID) = 64").count() == 3


def test_keyword_scores(spark):
    docs = spark.createDataFrame([(1, "Denial"), (2, "the denial rate"), (3, "denials"), (4, "élan-denial"),
                                  (5, "ädenial"), (6, "none"), (7, None)], "id int, text string")
    got = {r.id: r.score for r in search.keyword_scores(docs, ["text"], "denial").collect()}
    assert got == {1: 10, 2: 5, 3: 2, 4: 5, 5: 2}
