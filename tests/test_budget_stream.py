"""The stateful budget stream: replayed and late calls, one crossing, idle sessions, compaction."""

import datetime as dt

from carelake.session import scratch_dir
from carelake.streaming.usage import _folders, crossings, current_budgets, usage_budget_stream

CALL = "LogID bigint, AgentName string, SessionID string, InputTokens int, OutputTokens int, RequestTimestamp timestamp_ntz"
START = dt.datetime(2024, 1, 1)


class Stream:
    def __init__(self, spark, **options):
        self.spark, self.root, self.options = spark, scratch_dir(spark, "budget-test"), options
        self.budgets = spark.createDataFrame([("A", 100)], "AgentName string, token_budget bigint")

    def send(self, *calls):
        """(log id, session, tokens, hours after the start); one micro-batch."""
        rows = [(i, "A", s, n, 0, START + dt.timedelta(hours=h)) for i, s, n, h in calls]
        self.spark.createDataFrame(rows, CALL).coalesce(1).write.mode("append").parquet(f"{self.root}/in")
        source = self.spark.readStream.schema(CALL).parquet(f"{self.root}/in")
        usage_budget_stream(source, self.budgets, f"{self.root}/out", f"{self.root}/checkpoint", floor=10, **self.options).awaitTermination()

    def used(self):
        return {r.SessionID: (r.used, r.remaining, r.escalate) for r in current_budgets(self.spark, f"{self.root}/out").collect()}

    def crossed(self):
        return {r.SessionID: r.LogID for r in crossings(self.spark, f"{self.root}/out").collect()}


def test_replayed_calls_count_once_and_the_crossing_is_named_once(spark):
    stream = Stream(spark)
    stream.send((1, "s", 60, 0), (2, "s", 40, 0), (2, "s", 40, 0), (3, "t", 95, 0))
    assert stream.used() == {"s": (100, 0, True), "t": (95, 5, True)} and stream.crossed() == {}
    # 2 and 3 come again; 5 takes s over its budget, 6 comes after it
    stream.send((2, "s", 40, 0), (3, "t", 95, 0), (6, "s", 5, 1), (5, "s", 1, 1))
    assert stream.used() == {"s": (106, -6, True), "t": (95, 5, True)} and stream.crossed() == {"s": 5}
    # a call that comes late, but not too late, counts; the crossing stays
    stream.send((4, "s", 50, 0.5))
    assert stream.used()["s"] == (156, -56, True) and stream.crossed() == {"s": 5}


def test_idle_sessions_are_forgotten_and_outputs_compacted(spark):
    stream = Stream(spark, late="1 hour", idle=dt.timedelta(hours=10), compact_every=3)
    stream.send((1, "s", 101, 0), (2, "t", 5, 0))
    stream.send((3, "t", 5, 9))
    assert stream.crossed() == {"s": 1} and stream.used()["t"][0] == 10
    stream.send((4, "u", 1, 15))  # the watermark passes the timer of s, not the one of t
    stream.send((5, "u", 1, 15))
    base, epochs = _folders(spark, f"{stream.root}/out")
    assert base is not None and len(epochs) < 3
    assert stream.used()["s"][0] == 101 and stream.crossed() == {"s": 1}
    stream.send((6, "s", 7, 15), (7, "t", 5, 15))
    assert stream.used() == {"s": (7, 93, False), "t": (15, 85, False), "u": (2, 98, False)} and stream.crossed() == {}


def test_calls_are_remembered_in_one_message():
    """The state is read and written as a whole, however many calls a session has."""
    import datetime as dt
    import types

    import pandas as pd

    from carelake.streaming.usage import SessionBudget

    class State:
        def __init__(self, value):
            self.value, self.messages = value, 0

        def get(self):
            self.messages += 1
            return iter(self.value) if isinstance(self.value, list) else self.value

        def update(self, value):
            self.messages, self.value = self.messages + 1, value

        def appendList(self, rows):
            self.messages, self.value = self.messages + 1, self.value + rows

        def put(self, rows):
            self.messages, self.value = self.messages + 1, list(rows)

    budget = SessionBudget(dt.timedelta(days=7))
    budget.total, budget.seen = State(None), State([])
    budget.handle = types.SimpleNamespace(listTimers=lambda: iter([]), deleteTimer=lambda t: None, registerTimer=lambda t: None)

    def batch(ids, watermark):
        rows = pd.DataFrame({"LogID": ids, "tokens": 1, "token_budget": 150, "at": [i * 10 for i in ids]})
        return next(budget.handleInputRows(("A", "S"), iter([rows]), types.SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)))

    batch(list(range(100)), 0)
    assert budget.total.value == (100, None) and len(budget.seen.value) == 100 and budget.seen.messages == 2
    out = batch(list(range(50, 200)), 1000)  # 50 come again, those before the watermark are forgotten
    assert out["used"][0] == 200 and out["crossed_by"][0] == 150 and sorted(i for i, _ in budget.seen.value) == list(range(100, 200))
