"""Each registered query over its whole table, against SQL or a plain version."""

import base64
import zlib

import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as spark_entry
import corpus_pipeline
from carelake.llm.common import stored, table
from carelake.llm.queries import ORACLES, QUERIES
from tests.llm import plain
from tools.check import compare, connect


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r["doc_id"], r["text"] or "") for r in table(spark, sf, "documents").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def tokenizer():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_all_are_registered():
    assert [n.split("_")[0] for n in QUERIES] and {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(spark_entry.queries())
    assert set(ORACLES) <= set(spark_entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark, sf):
    assert compare(connect(sf), QUERIES[name](spark, sf), ORACLES[name]) == ""


def test_secrets(spark, sf, docs):
    rows = {r["doc_id"]: r for r in QUERIES["op1_secret_scans"](spark, sf).collect()}
    assert len(rows) == len(docs)
    for doc, text in docs:
        spans = plain.secret_spans(text)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        row = rows[doc]
        assert row["base_sha256"] == plain.sha(listed)
        assert [row[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]
        assert set(listed.split(",")) - {""} <= set(row["spans"].split(","))


def test_substrings(spark, sf, docs):
    rows = {tuple(r) for r in QUERIES["op2_substring_dedup"](spark, sf).collect()}
    assert rows == {(d, n, gone, plain.sha(text)) for d, n, gone, text in plain.kept_words(docs)}


def test_simhash(spark, sf, docs):
    rows = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op3_simhash_golay"](spark, sf).collect()}
    assert rows == {d: (f"{p:016x}", c) for d, (p, c) in plain.near_groups(docs).items()}


def test_bpe(spark, sf, docs, tokenizer):
    rows = {tuple(r) for r in QUERIES["op4_byte_bpe"](spark, sf).collect()}
    want = set()
    for doc, text in docs:
        ids = tokenizer.encode_ordinary(text)
        want.add((doc, len(ids), plain.sha(b"".join(i.to_bytes(4, "little") for i in ids)), plain.sha(text)))
    assert rows == want


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in QUERIES["op5_quality_classifier"](spark, sf).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for d, r in rows.items())
    known = [(rows[r["doc_id"]], r["quality"]) for r in table(spark, sf, "labels").collect() if r["doc_id"] in rows]
    held = [(r["predicted"], q) for r, q in known if r["held_out"]]
    assert sum(p == q for p, q in held) >= 0.93 * len(held)
    assert sum(p for p, q in held if q == 1) >= 0.97 * sum(q for _, q in held)


def test_decontamination(spark, sf, docs):
    rows = {(r["doc_id"], r["item_id"]) for r in QUERIES["op6_template_decontamination"](spark, sf).collect()}
    flat = lambda t: f" {' '.join(t.split())} "
    items = [(r["item_id"], flat(r["text"])) for r in table(spark, sf, "benchmark").collect()]
    whole = {(d, i) for d, t in docs for i, x in items if x in flat(t)}
    assert whole and whole <= rows
    # Whatever else is found shares 13 running words, but for case and punctuation.
    words = lambda t: [w.strip(".,;:!?%*#$&|").lower() for w in t.split()]
    texts, wanted = dict(docs), dict(items)
    for d, i in rows - whole:
        w = words(wanted[i])
        grams = {tuple(w[k:k + 8]) for k in range(len(w) - 7)}
        v = words(texts[d])
        assert sum(tuple(v[k:k + 8]) in grams for k in range(len(v) - 7)) >= min(5, len(grams) // 2)


def test_lm_scores(spark, sf, docs):
    rows = {r["doc_id"]: r for r in QUERIES["op10_ppm_scores"](spark, sf).collect()}
    base = plain.base_scores(docs)
    for d, row in rows.items():
        assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"]) == base[d][:4]
        assert row["base_score"] == pytest.approx(base[d][4])
    short = [(d, t) for d, t in docs if len(t) < 1500]
    for d, value in plain.ppm_scores(docs, short, 5).items():
        assert rows[d]["score"] == pytest.approx(value)


def test_pipeline_stage_by_stage(spark, sf, docs, tokenizer):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    stages, at = dict(corpus_pipeline.STAGES), table(spark, sf, "documents")
    columns = at.columns
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        at = stored(stage(spark, at, sf), name)
        results[name] = at
        assert name == "tokens" or at.columns == columns
    texts = lambda name: {r["doc_id"]: r["text"] for r in results[name].collect()}
    good = texts("quality")
    kept_good = [d for d, q in labels.items() if q == 1 and d in dict(docs)]
    assert sum(d in good for d in kept_good) >= 0.95 * len(kept_good)
    single = texts("near_duplicates")
    groups = plain.near_groups(list(good.items()))
    assert set(single) == {d for d, (_, first) in groups.items() if d == first} and len(single) < len(good)
    assert all(single[d] == good[d] for d in single)
    pure = texts("decontaminate")
    flat = lambda t: f" {' '.join(t.split())} "
    items = [flat(r["text"]) for r in table(spark, sf, "benchmark").collect()]
    assert not {d for d, t in pure.items() if any(i in flat(t) for i in items)}
    assert len(single) - len(pure) <= 2 * sum(any(i in flat(t) for i in items) for t in single.values()) + 3
    safe = texts("without_secrets")
    assert set(safe) == set(pure) and not any(plain.secret_spans(t) for t in safe.values())
    assert all(safe[d] == pure[d] for d in safe if not plain.secret_spans(pure[d]) and "PRIVATE KEY" not in pure[d] and "eyJ" not in pure[d] and "Bearer" not in pure[d])
    for r in results["tokens"].collect():
        assert list(r["ids"]) == tokenizer.encode_ordinary(safe[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == plain.sha(safe[r["doc_id"]])
    assert len(stages) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, sf).count() == len(safe)
