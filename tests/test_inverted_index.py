"""Search over the inverted index against scoring every text."""

import random

import pytest
from pyspark.sql import functions as F

from carelake.operators import search
from carelake.operators.inverted_index import KeywordIndex

QUERIES = [(1, "denial rate"), (2, "the the denial"), (3, "e"), (4, "ab"), (5, "heart-attack, CLINIC!"), (6, ""), (7, "zzzz"),
           (8, "the of and rate"), (9, "élan naïve"), (10, None), (11, "the of and a in denialrate claims x_1"), (12, "den")]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    vocabulary = ["the"] * 30 + ["of"] * 20 + ["and"] * 15 + ["a", "in"] * 6 + [
        "denial", "Denials", "rate", "rated", "claims", "heart", "attack", "clinic", "élan", "ÉLAN", "naïve", "x_1", "cabal"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 25))), f"src{i % 7}") for i in range(900)]
    rows += [(1000, "denial", "denial"), (1001, "Rate", None), (1002, None, None), (1003, "", "the"), (1004, "denial-", "rate"),
             (1005, "the denial" * 2000, "x"), (1006, "ab", "ab")]
    rows += [(1010 + i, "quorum zenith and of" if i % 2 else "zenith of quorum", "src1") for i in range(6)]
    return spark.createDataFrame(rows, "id bigint, text string, source string")


@pytest.fixture(scope="module")
def index(docs):
    return KeywordIndex(docs.withColumn("term", F.lit(1)).withColumn("bucket", F.lit("x")), "id", ["text", "source"], buckets=8)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(QUERIES, "query_id int, query string")


def plain(docs, query):
    if not query:
        return []
    rows = search.keyword_scores(docs, ["text", "source"], query).select("id", "score").collect()
    return sorted(((r.id, r.score) for r in rows), key=lambda r: (-r[1], r[0]))


def results(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r.score))
    return out


def test_equals_scoring_every_text(index, docs, asked):
    everything, best = results(index.search(asked)), results(index.search(asked, 5))
    for number, query in QUERIES:
        expected = plain(docs, query)
        assert everything.get(number, []) == expected, query
        assert best.get(number, []) == expected[:5], query


def test_bounds_leave_out_documents_of_frequent_words(spark, index, asked):
    frequent = spark.createDataFrame([(1, "and quorum of zenith quorum zenith quorum")], "query_id int, query string")
    assert results(index.search(frequent, 3)) == results(index.search(frequent, 3, pruned=False))
    considered = index.candidates.count()
    assert considered == 6 and index.search(frequent).count() > 500


def test_no_text_is_read(spark, index, asked):
    plan = index.search(asked)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert index.folder in "".join(index.postings.inputFiles()) and "text" not in index.postings.columns
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_empty(spark, docs, asked):
    empty = KeywordIndex(docs.limit(0), "id", ["text"], buckets=4)
    assert empty.search(asked, 3).count() == 0 and empty.search(asked).count() == 0
    assert KeywordIndex(docs, "id", ["text"], buckets=4).search(asked.limit(0), 3).count() == 0


def test_frequent_words_do_not_become_rows(index, asked, monkeypatch):
    """A search for the best few looks postings up for rare words only; other words are scored document by document."""
    made, word_points = [], KeywordIndex._word_points
    monkeypatch.setattr(KeywordIndex, "_word_points", lambda self, *a: made.append(word_points(self, *a)) or made[-1])
    index.search(asked, 3).count()
    assert sum(df.count() for df in made) < 300 and index.search(asked).count() > 3000
    made.clear()
    index.search(asked, 3, pruned=False).count()
    assert not made


def test_rows_that_share_an_id_are_one_document(spark):
    docs = spark.createDataFrame([("b", "cab", "x"), ("b", "ab cd", "ab"), ("b", "ab", None), ("a", "ab ab", ""), ("c", "cab", ""),
                                  (None, "ab", "ab")], "id string, text string, source string")
    asked = spark.createDataFrame([("q", "ab"), ("r", "cab ab ab")], "query_id string, query string")
    index = KeywordIndex(docs, "id", ["text", "source"], buckets=4)
    expected = {"q": [("b", 20), ("a", 5), ("c", 2)], "r": [("b", 50), ("c", 14), ("a", 10)]}
    for found in (index.search(asked), index.search(asked, 9), index.search(asked, 9, pruned=False)):
        assert results(found) == expected


def test_many_blocks_of_questions_and_packs(spark, docs, asked, monkeypatch):
    from carelake.operators import inverted_index
    monkeypatch.setattr(inverted_index, "PACK", 50)
    monkeypatch.setattr(inverted_index, "ASKED", 3)
    index = KeywordIndex(docs, "id", ["text", "source"], buckets=4)
    assert results(index.search(asked, 5)) == {q: r[:5] for q, r in results(index.search(asked)).items()}
