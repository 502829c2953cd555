"""Answers kept for a limited time: exact and similarity lookup, upkeep."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake import reference_data as ref
from carelake.functions.predicates import _instant, unexpired
from carelake.functions.scalars import request_key
from carelake.operators.keys import max_key, one_pass_keys
from carelake.operators.lookups import keep_latest
from carelake.operators.similarity import ClusteredCache
from carelake.schemas import conform

# After a load these agents' answers are out of date.
INVALIDATED_BY_LOAD = ("ETLAgent", "ClinicalAgent")


def cache_exact_lookup(requests: DataFrame, cache: DataFrame, as_of) -> DataFrame:
    """Each request with the unexpired answer stored under its key, if any."""
    live = unexpired(cache, as_of).select("CacheKey", "CacheID", "Response")
    keyed = requests.withColumn("CacheKey", request_key("AgentName", "Query"))
    return keyed.join(live, "CacheKey", "left")


def cache_upsert(cache: DataFrame, entries: DataFrame, as_of, ttl_minutes: int | None = None) -> DataFrame:
    """Replace entries with the same key; the embedding may be missing.

    ``entries`` has AgentName, Query, Response and optionally Embedding,
    ``ttl_minutes`` and an ``entry_no`` that says which of several entries
    with one key came last.
    """
    now = _instant(as_of)
    minutes = F.lit(ttl_minutes) if ttl_minutes is not None else F.coalesce(
        F.col("ttl_minutes"), F.lit(ref.DEFAULT_CACHE_MINUTES)) if "ttl_minutes" in entries.columns else F.lit(
        ref.DEFAULT_CACHE_MINUTES)
    embedding = F.col("Embedding") if "Embedding" in entries.columns else F.lit(None).cast("array<float>")
    order = F.col("entry_no") if "entry_no" in entries.columns else F.xxhash64("Query", "Response")
    rows = entries.select(
        request_key("AgentName", "Query").alias("CacheKey"), "AgentName", "Query",
        "Response", now.alias("CreatedAt"), (now + F.make_dt_interval(mins=minutes)).alias("ExpiresAt"),
        embedding.alias("Embedding"), order.alias("_order"))
    latest = keep_latest(rows, "CacheKey", ["_order"]).drop("_order")
    kept = cache.join(latest.select("CacheKey"), "CacheKey", "left_anti")
    added = one_pass_keys(latest, "CacheID", max_key(cache, "CacheID"))
    return conform(kept, "QueryCache").unionByName(conform(added, "QueryCache"))


def cache_invalidate(cache: DataFrame, agents: list[str]) -> DataFrame:
    """Drop the agents' entries; an empty list drops nothing."""
    return cache.where(~F.col("AgentName").isin(list(agents))) if agents else cache


def _blocks(df: DataFrame, name: str, rows: int) -> DataFrame:
    return df.groupBy("AgentName").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))


def score_blocks(requests: DataFrame, cache: DataFrame, floor: float, block_rows: int = 4096) -> DataFrame:
    """Best cached entry of every request within each block of the cache.

    Requests and cache entries of an agent are cut into blocks of bounded
    size and every pair of blocks is one task-sized matrix product, which
    returns a single row per request.  Pairs of vectors never become rows,
    and an agent with very many entries is spread over many blocks.
    """
    sizes = _blocks(requests, "_rn", block_rows).join(_blocks(cache, "_cn", block_rows), "AgentName")
    last = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pick = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = requests.join(sizes, "AgentName").select(
        "AgentName", "request_id", "embedding", pick("request_id", "_rn").alias("_rb"),
        F.explode(last("_cn")).alias("_cb"))
    right = cache.join(sizes, "AgentName").select(
        "AgentName", "CacheID", "Embedding", pick("CacheID", "_cn").alias("_cb"),
        F.explode(last("_rn")).alias("_rb"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = {"request_id": [], "CacheID": [], "Score": []}
        if len(a) and len(b):
            b = b.sort_values("CacheID")
            ids = b["CacheID"].to_numpy()
            entries = np.stack(b["Embedding"].to_numpy()).astype("float64").T
            for at in range(0, len(a), 512):
                part = a.iloc[at:at + 512]
                scores = np.stack(part["embedding"].to_numpy()).astype("float64") @ entries
                top = scores.argmax(axis=1)
                value = scores[np.arange(len(part)), top]
                ok = value >= floor
                found["request_id"].append(part["request_id"].to_numpy()[ok])
                found["CacheID"].append(ids[top[ok]])
                found["Score"].append(value[ok])
        return pd.DataFrame({k: np.concatenate(v) if v else [] for k, v in found.items()})

    keys = ["AgentName", "_rb", "_cb"]
    id_type = requests.schema["request_id"].dataType.simpleString()
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        best, f"request_id {id_type}, CacheID bigint, Score double")


def best_match_per_request(scored: DataFrame) -> DataFrame:
    """Highest score per request; the entry stored first wins ties."""
    rank = F.struct(F.col("Score"), (-F.col("CacheID")).alias("c"))
    return scored.groupBy("request_id").agg(F.max_by("CacheID", rank).alias("CacheID"), F.max("Score").alias("Score"))


def semantic_candidate(requests: DataFrame, cache: DataFrame, as_of, floor: float = ref.SIMILARITY_FLOOR,
                       enabled: bool = True, block_rows: int = 4096, pruned: bool = True) -> DataFrame:
    """Most similar unexpired answer of the same agent, if at least ``floor``.

    ``requests`` has request_id (unique), AgentName and a unit-length embedding.  The
    result is a candidate only; it does not say the answers are equivalent.
    ``pruned`` compares only blocks that may hold a match, with the same result.
    """
    live = unexpired(cache, as_of).where(F.col("Embedding").isNotNull())
    if not enabled:
        live = live.where(F.lit(False))
    vectors = live.select("AgentName", "CacheID", "Embedding")
    asked = requests.select("request_id", "AgentName", "embedding")
    scores = ClusteredCache(vectors, block_rows).lookup(asked, floor) if pruned else score_blocks(asked, vectors, floor, block_rows)
    best = best_match_per_request(scores)
    return best.join(live.select("CacheID", "AgentName", F.col("Query").alias("MatchedQuery"), "Response"), "CacheID")
