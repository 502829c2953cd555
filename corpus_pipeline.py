"""A corpus pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
each result is written as Parquet and read again.  All but the last return the
columns of documents.  SQL can't express the classifier, the fingerprints and the
merges, so ORACLE_SQL is None and tests hold each stage against a plain version.

Rows with a null text count as empty texts; rows with a null id go through each
stage unless the classifier rejects them; rows that repeat an id are one document,
of which the near-duplicate stage keeps the row with the smallest text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.llm import bpe, compression, secrets, simhash, templates
from carelake.llm.common import stored, table
from carelake.llm.queries import QUALITY_THRESHOLD, RANKS, quality_model

#: SQL can't express these stages.
ORACLE_SQL: str | None = None

_SCORE = "_pipeline_score"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below its threshold go."""
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return compression.with_score(docs, model, name=_SCORE).where(F.col(_SCORE) >= QUALITY_THRESHOLD).drop(_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group whose fingerprints (four-word shingles) link at 4 or fewer bits, the document with the smallest id stays."""
    groups = simhash.near_duplicates(docs, width=4)
    gone = groups.where("doc_id != component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    again = stored(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        return kept.select(docs.columns)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    single = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(whole, F.coalesce("text", F.lit(""))).alias("row"))
    chosen = single.select("row.*")
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(chosen.select(docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other numbers and names, go."""
    found = templates.leaks(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; no document goes. n_chars follows the text."""
    out = secrets.redacted(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with digests of the ids and of what they decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path(RANKS))
    return bpe.tokenize(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN,
                        ("n_tokens", "ids", "ids_sha256", "decoded_sha256")).drop("text")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("without_secrets", without_secrets), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
