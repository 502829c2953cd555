"""Importance resampling, quality rules and the source divergence audit: edges, skew, plain versions."""

import random
import zlib

import numpy as np
import pytest

from carelake.llm import divergence, ngrams, resampling
from carelake.llm.common import fold, table
from carelake.llm.queries import QUERIES
from tests.llm import plain

DOCS = "doc_id long, text string, lang string, source string, score double, rank string, rows int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "x", 1) for r in rows], DOCS)


def some_docs(n, seed=5):
    draw = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma,", "été", "x9", "über-alles", "12", "e-mail", "Ω", "don't"] + [f"w{i}" for i in range(30)]
    rows = []
    for i in range(n):
        lang, source = draw.choice(["en", "fr", None]), draw.choice(["a", "b", "c", None, "é"])
        rows.append((i, draw.choice([" ", "\n", "\t "]).join(draw.choices(vocabulary, k=draw.choice([0, 3, 25, 60]))), lang, source))
    return rows


ODD = [(None, None, None, None), (7, "", "en", "a"), (7, "w1 w2 w1", "en", "a"), (7, "w1 w2 w1", "en", "a"), (8, "w1 " * 30_000, "fr", "b"), (9, "\x00\x01", "en", "new")]


@pytest.mark.parametrize("parts", [1, 7])
def test_resampling_is_the_plain_draw(spark, parts):
    rows = some_docs(600) + ODD
    target = ["w1 w2 été alpha", None, ""]
    got = resampling.resample(frame(spark, rows).repartition(parts), spark.createDataFrame([(t,) for t in target], "text string"), percent=30, samples=50).collect()
    want = plain.draws([(r[0], r[1] or "") for r in rows], [t or "" for t in target], percent=30)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_equal_rows_are_spread_over_segments(spark):
    rows = [(1, "w1 " * 25, "en", "a")] * 4000 + [(i, "w2 " * 25, "en", "a") for i in range(2, 4000)]
    docs = frame(spark, rows).repartition(4)
    drawn = resampling.resample(docs, spark.createDataFrame([("w1",)], "text string"), percent=40)
    ranks = sorted(r["rank"] for r in drawn.where("rank IS NOT NULL").collect())
    assert ranks == list(range(1, 40 * 7998 // 100 + 1)) and drawn.count() == 7998
    runs = resampling.stored(drawn.drop("rank").withColumn("eligible", drawn.score.isNotNull()).sortWithinPartitions(drawn.score.desc(), "doc_id"), "test-runs")
    keyed = resampling._keyed(runs)
    sizes = [r["count"] for r in resampling._in_segments(keyed, resampling._splitters(keyed, 7998, 8, 800)).groupBy("segment").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1500


def test_resampling_of_nothing(spark):
    none = frame(spark, [])
    target = spark.createDataFrame([("w1",)], "text string")
    assert resampling.resample(none, target).count() == 0
    few = resampling.resample(frame(spark, some_docs(30)), target.limit(0), percent=50).collect()
    assert sum(r["rank"] is not None for r in few) == sum(r["n_features"] >= 20 for r in few) // 2
    assert resampling.in_drawn_order(frame(spark, some_docs(30)).drop("rank"), resampling.resample(frame(spark, some_docs(30)), target, percent=50)).count() > 0


def test_longer_features(spark):
    got = resampling.resample(frame(spark, [(1, "a b c", "en", "a"), (2, "", "en", "a"), (3, "a", "en", "a")]), spark.createDataFrame([("b c",)], "text string"), longest=2)
    assert {r["doc_id"]: r["n_features"] for r in got.collect()} == {1: 5, 2: 0, 3: 1}


def test_rule_counts():
    draw = random.Random(1)
    texts = ["", " \n\n ", "a", "a b c a b c a", "x\nx\n x\nx", "été #1 <b>\r\nété #1 <b>\r\n", "a a a a", "    ", "w " * 5000]
    texts += [" \n".join(draw.choices(["a", "b", "c#", "\n", "é"], k=draw.randrange(40))) for _ in range(300)]
    for t in texts:
        assert ngrams.base_counts(t) == plain.rule_counts(t)


def test_hashed_runs_do_not_depend_on_pieces(monkeypatch):
    text = " ".join(random.Random(2).choices(["one", "two", "three", "Été", "x"], k=500))

    def counted():
        hasher = ngrams.Hasher(1 << 14)
        out = np.zeros(1 << 14)
        for _, found in hasher.buckets(text):
            np.add.at(out, found, 1)
        return out

    whole = counted()
    raw = text.encode().lower()
    assert whole[: 1 << 13].sum() == 500 + 499 and whole[1 << 13:].sum() == sum(len(raw) - n + 1 for n in ngrams.BYTE_RUNS)
    monkeypatch.setattr(ngrams, "PIECE", 64)
    assert (counted() == whole).all()
    hasher, weights = ngrams.Hasher(1 << 14), np.random.default_rng(0).normal(size=1 << 14)
    at, x = hasher.shares(text)
    assert hasher.sums(text, weights) == pytest.approx(float((x * weights[at]).sum()))


def test_rules_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = ngrams.fit(docs, labels, lambda i: fold(i, 5) != 0)
    rows = {r["doc_id"]: r for r in ngrams.judge(docs, model, 0.3).collect()}
    held = [(rows[r["doc_id"]], r["quality"]) for r in labels.collect() if r["doc_id"] in rows and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum((r["score"] >= 0.3) == (q == 1) for r, q in held) >= 0.95 * len(held)
    assert sum(r["score"] >= 0.3 for r, q in held if q == 1) >= 0.98 * sum(q for _, q in held)
    # Calibrated: the mean score is the share of label 1.
    assert np.mean([r["score"] for r, _ in held]) == pytest.approx(np.mean([q for _, q in held]), abs=0.05)


def test_rules_query_against_plain_counts(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    rows = QUERIES["op12_quality_rules"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = plain.rule_counts(docs[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= 0.3)


def test_rules_edges(spark):
    docs = frame(spark, some_docs(40) + ODD)
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = ngrams.judge(docs, ngrams.fit(docs, nothing), 0.3)
    assert got.count() == 46 and got.select("score").distinct().count() == 1
    odd = spark.createDataFrame([(None, 1, 0), (7, None, 0), (7, 0, 0), (7, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert ngrams.judge(docs, ngrams.fit(docs, odd), 0.3).where("score IS NULL").count() == 0
    assert ngrams.judge(docs.limit(0), ngrams.fit(docs.limit(0), nothing), 0.3).count() == 0


@pytest.mark.parametrize("block_bytes, entries, pairs", [(24 << 20, 500_000, 1 << 20), (2000, 20, 50)])
def test_divergence_is_the_plain_audit(spark, monkeypatch, block_bytes, entries, pairs):
    monkeypatch.setattr(divergence, "PAIRS", pairs)
    rows = some_docs(400) + ODD
    got = divergence.audit(frame(spark, rows).repartition(3), block_bytes=block_bytes, bucket_entries=entries).collect()
    want = plain.divergences([(r[2] or "", r[3] or "", r[1] or "") for r in rows])
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_divergence_without_kept_terms(spark):
    got = divergence.audit(frame(spark, ODD)).collect()
    assert {(r["lang"], r["source"], r["part"], r["item"], r["value"]) for r in got} == {("en", "a", "pair", "new", 0), ("en", "new", "pair", "a", 0)}
    assert divergence.audit(frame(spark, [])).count() == 0


def test_pieces_end_at_whitespace(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 5)
    for raw in (b"", b"abcdefghijk", b"abc def\nghi jkl mnopqrstu v", b" " * 30):
        parts = list(divergence._pieces(raw))
        assert b"".join(parts) == raw and [w for p in parts for w in p.split()] == raw.split()


def test_shares_beyond_64_bits(spark):
    big = spark.createDataFrame([(10**16, 3 * 10**16, 10**6)], "n long, total long, kept long")
    row = big.select(divergence.share(big.n, big.total, big.kept)).first()
    assert row[0] == 1 + 10**9 * (10**16 + 2) // (3 * 10**16 + 2 * 10**6)
