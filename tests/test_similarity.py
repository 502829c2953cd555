"""The pruned similarity lookup against comparing all pairs."""

import numpy as np
import pytest

from carelake.functions.predicates import unexpired
from carelake.operators import cache
from carelake.operators.similarity import ClusteredCache
from carelake.sources import testdata as td


def best(scores):
    return {r.request_id: (r.CacheID, round(r.Score, 9)) for r in cache.best_match_per_request(scores).collect()}


def frames(spark, ask, store):
    return (spark.createDataFrame(ask, "request_id bigint, AgentName string, embedding array<float>"),
            spark.createDataFrame(store, "AgentName string, CacheID bigint, Embedding array<float>"))


@pytest.mark.parametrize("floor, block_rows", [(0.75, 8), (-2.0, 40)])
def test_equals_all_pairs(spark, floor, block_rows):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 6))

    def near(scale):  # of any length, around some middle
        return (middles[rng.integers(12)] + 0.2 * rng.normal(size=6)) * scale

    store = [("hot" if i % 3 else f"a{i % 4}", i, near(rng.uniform(0.1, 1.5)).astype("float32").tolist()) for i in range(600)]
    store += [("hot", 1000 + i, store[1][2]) for i in range(60)] + [("zero", 5000, [0.0] * 6)]
    ask = [(i, "hot" if i % 2 else "a1", near(0.5).astype("float32").tolist()) for i in range(80)]
    ask += [(900, "nobody", [1.0] * 6), (901, "hot", [0.0] * 6), (902, "zero", [1.0] * 6)]
    asked, held = frames(spark, ask, store)
    clustered = ClusteredCache(held, block_rows)
    assert best(clustered.lookup(asked, floor)) == best(cache.score_blocks(asked, held, floor, 50))
    assert clustered.blocks.agg({"n": "sum"}).first()[0] == len(store) and clustered.blocks.agg({"n": "max"}).first()[0] <= 3 * block_rows
    if floor > 0:
        everything = sum(sum(s[0] == a[1] for s in store) for a in ask)
        assert clustered.pairs_scored() < 0.5 * everything


def test_given_vectors_are_compared_in_part(spark):
    sf = "/root/testdata/sf0.01"
    held = unexpired(td.answer_cache(spark, sf), td.CACHE_AS_OF).select("AgentName", "CacheID", "Embedding")
    asked = td.cache_requests(spark, sf).select("request_id", "AgentName", "embedding")
    clustered = ClusteredCache(held, 8)
    all_pairs = asked.join(held, "AgentName").count()
    for floor in (0.75, 0.9):
        assert best(clustered.lookup(asked, floor)) == best(cache.score_blocks(asked, held, floor))
        print("floor", floor, "scored", clustered.pairs_scored(), "of", all_pairs)
        assert clustered.pairs_scored() < all_pairs


def test_nothing_to_compare(spark):
    asked, held = frames(spark, [(1, "a", [1.0, 0.0])], [("a", 1, [1.0, 0.0])])
    assert best(ClusteredCache(held.limit(0)).lookup(asked, 0.5)) == {}
    assert best(ClusteredCache(held).lookup(asked.limit(0), 0.5)) == {}
    assert best(ClusteredCache(held).lookup(asked, 0.5)) == {1: (1, 1.0)}
