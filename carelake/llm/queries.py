"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.llm import bpe, compression, divergence, ngrams, pivots, ppm, resampling, secrets, simhash, sql, substrings, templates, urltree, warc
from carelake.llm.common import fold, of_documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANKS = "byte_bpe_multi_50k.tiktoken"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_secret_scans")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in secrets.BASE_RULES]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query("op2_substring_dedup", sql.SUBSTRINGS)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.deduplicated(table(spark, sf_dir, "documents"), words=20)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op3_simhash_golay")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


@query("op4_byte_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(RANKS))
    docs = of_documents(table(spark, sf_dir, "documents"))
    return bpe.tokenize(docs, ranks, public_tokenizers.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256")).drop("text")


QUALITY_FOLDS = 5
QUALITY_THRESHOLD = 0.3


def quality_model(docs: DataFrame, labels: DataFrame) -> compression.CompressionModel:
    return compression.fit(docs, labels, lambda i: fold(i, QUALITY_FOLDS) != 0)


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = of_documents(table(spark, sf_dir, "documents"))
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    scored = compression.with_score(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), QUALITY_FOLDS) == 0).alias("held_out"), "score",
                         (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


@query("op6_template_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_pivot_search", sql.TOP_K)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.search(table(spark, sf_dir, "embeddings"), lambda i: F.pmod(i, F.lit(50)) == 0, k=5, scale=256)


@query("op8_url_filter", sql.url_filter(urltree.RULES, urltree.Tree()))
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.judge(table(spark, sf_dir, "pages"))


#: The given pages have no fetch time.
FETCHED = "2024-01-01T00:00:00Z"


@query("op9_warc_derivatives", sql.derivatives(FETCHED))
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = warc.derive(warc.responses(table(spark, sf_dir, "pages"), FETCHED))
    return built.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "content_length",
                        "block_digest", "source_digest", F.array_join(F.transform(
                            F.array_sort(F.map_entries("source_headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n").alias("source_headers"), "block")


LM_FOLDS = 10


@query("op10_ppm_scores")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scores(table(spark, sf_dir, "documents"), ppm.not_in_fold(LM_FOLDS))


@query("op11_importance_resampling", sql.RESAMPLING)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, least_words=20, seed=2024)


RULES_THRESHOLD = 0.3


@query("op12_quality_rules")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ngrams.judge(docs, ngrams.fit(docs, table(spark, sf_dir, "labels")), RULES_THRESHOLD)


@query("op13_source_divergence", sql.DIVERGENCE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=10, top_terms=10)
