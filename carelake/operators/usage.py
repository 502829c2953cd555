"""Token usage, budgets and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carelake import reference_data as ref
from carelake.functions.predicates import optional_filters
from carelake.functions.scalars import total_tokens
from carelake.operators.keys import max_key, one_pass_keys
from carelake.schemas import conform, local_rows


def budget_table(spark: SparkSession) -> DataFrame:
    """Configured token budget and cache minutes per agent."""
    return local_rows(spark, [(n, b, m) for n, _, b, m in ref.AGENTS],
                      "AgentName string, token_budget bigint, cache_ttl_minutes int")


def usage_record(log: DataFrame, rows: DataFrame, as_of: str | None = None) -> DataFrame:
    """Rows to append to the usage log, counters defaulting to 0."""
    now = F.lit(as_of).cast("timestamp_ntz") if as_of else F.localtimestamp()
    defaults = {c: F.lit(0) for c in ("InputTokens", "OutputTokens", "CachedTokens", "ToolCalls")}
    defaults |= {"ModelID": F.lit(None), "Notes": F.lit(None), "RequestTimestamp": now}
    filled = rows.select("AgentName", "SessionID", *[
        (F.coalesce(F.col(c), d) if c in rows.columns else d).alias(c) for c, d in defaults.items()])
    return conform(one_pass_keys(filled, "LogID", max_key(log, "LogID")), "AgentUsageLog")


def _usage_where(usage: DataFrame, agent=None, session=None, start_date=None, end_date=None) -> DataFrame:
    """Date bounds are written on the timestamp itself, so they push down."""
    df = optional_filters(usage, equals={"AgentName": agent, "SessionID": session})
    if start_date is not None:
        df = df.where(F.col("RequestTimestamp") >= F.lit(str(start_date)).cast("date").cast("timestamp_ntz"))
    if end_date is not None:
        after = F.date_add(F.lit(str(end_date)).cast("date"), 1).cast("timestamp_ntz")
        df = df.where(F.col("RequestTimestamp") < after)
    return df


def get_agent_usage(usage: DataFrame, agent=None, start_date=None, end_date=None, session=None,
                    rollup: bool = False) -> DataFrame:
    """Calls, newest first, or one row per session and agent."""
    df = _usage_where(usage, agent, session, start_date, end_date)
    tokens = total_tokens("InputTokens", "OutputTokens")
    if not rollup:
        return df.select("LogID", "AgentName", "SessionID", "InputTokens", "OutputTokens", "CachedTokens",
                         tokens.alias("TotalTokens"), "ToolCalls", "ModelID", "RequestTimestamp",
                         "Notes").orderBy(F.col("RequestTimestamp").desc(), "LogID")
    first, last = F.min("RequestTimestamp"), F.max("RequestTimestamp")
    second = lambda c: F.date_trunc("SECOND", c).cast("timestamp_ntz")
    return df.groupBy("SessionID", "AgentName").agg(
        F.sum("InputTokens").alias("TotalInputTokens"), F.sum("OutputTokens").alias("TotalOutputTokens"),
        F.sum("CachedTokens").alias("TotalCachedTokens"), F.sum(tokens).alias("TotalTokens"),
        F.sum("ToolCalls").alias("TotalToolCalls"), F.count(F.lit(1)).alias("CallCount"),
        first.alias("SessionStart"), last.alias("SessionEnd"),
        F.timestamp_diff("SECOND", second(first), second(last)).alias("DurationSeconds"),
    ).orderBy(F.col("SessionStart").desc(), "SessionID", "AgentName")


def session_summary(usage: DataFrame, session: str | None = None) -> DataFrame:
    df = optional_filters(usage, equals={"SessionID": session})
    return df.groupBy("SessionID", "AgentName").agg(
        F.sum("InputTokens").alias("TotalInput"), F.sum("OutputTokens").alias("TotalOutput"),
        F.sum("ToolCalls").alias("TotalToolCalls"), F.count(F.lit(1)).alias("Calls"),
    ).orderBy("SessionID", "AgentName")


def with_budget(df: DataFrame, budgets: DataFrame, default: int = ref.DEFAULT_TOKEN_BUDGET) -> DataFrame:
    """Attach the agent's budget; agents without one get the default."""
    limits = budgets.select("AgentName", "token_budget")
    joined = df.join(limits, "AgentName", "left")
    return joined.withColumn("token_budget", F.coalesce("token_budget", F.lit(default).cast("bigint")))


def tokens_remaining(usage: DataFrame, budgets: DataFrame, agent=None, session=None,
                     sessions: DataFrame | None = None) -> DataFrame:
    """Budget minus tokens used, per agent and session.

    ``sessions`` lists the pairs asked for; a pair without usage has all of
    its budget left.
    """
    keys = ["AgentName", "SessionID"]
    used = _usage_where(usage, agent, session).groupBy(*keys).agg(
        F.sum(total_tokens("InputTokens", "OutputTokens")).alias("used"))
    if sessions is not None:
        used = sessions.select(*keys).distinct().join(used, keys, "left")
    rows = with_budget(used.withColumn("used", F.coalesce("used", F.lit(0).cast("bigint"))), budgets)
    return rows.withColumn("remaining", F.col("token_budget") - F.col("used"))


def budget_join(usage: DataFrame, budgets: DataFrame, floor: int = ref.MIN_TOKENS_LEFT) -> DataFrame:
    """Remaining tokens and whether the agent must hand over."""
    return tokens_remaining(usage, budgets).withColumn("escalate", F.col("remaining") < floor)


def budget_crossing(usage: DataFrame, budgets: DataFrame, order: str = "LogID",
                    chunk_rows: int = 1_000_000) -> DataFrame:
    """Running tokens per agent and session; marks the call that goes over.

    A session may hold a large part of the log, so its running total is put
    together from chunks of consecutive log ids: totals per chunk, their
    prefix sums, and a window inside each chunk.  ``order`` is a unique
    integer, hence no window group has more than ``chunk_rows`` rows.
    """
    keys = ["AgentName", "SessionID"]
    tokens = total_tokens("InputTokens", "OutputTokens").cast("bigint")
    calls = usage.select(*keys, order, tokens.alias("tokens"),
                         F.floor(F.col(order) / chunk_rows).alias("_chunk"))
    prefix = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    per_chunk = calls.groupBy(*keys, "_chunk").agg(F.sum("tokens").alias("_sum"))
    before = per_chunk.select(*keys, "_chunk", (F.sum("_sum").over(prefix) - F.col("_sum")).alias("_before"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    running = (calls.withColumn("_inside", F.sum("tokens").over(inside))
               .join(before, [*keys, "_chunk"])
               .withColumn("running_tokens", F.col("_before") + F.col("_inside")))
    over = F.col("running_tokens") > F.col("token_budget")
    was_under = F.col("running_tokens") - F.col("tokens") <= F.col("token_budget")
    return with_budget(running, budgets).select(
        *keys, order, "tokens", "running_tokens", "token_budget", (over & was_under).alias("crosses"))
