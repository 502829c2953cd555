"""Keyword search over text tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Points per word, by how the word occurs in the text.
WHOLE_TEXT, WHOLE_WORD, PART_OF_WORD = 10, 5, 2


def query_words(query: str) -> list[str]:
    return [w.lower() for w in re.split(r"\W+", query) if w]


def keyword_score(text: Column, words: list[str]) -> Column:
    """Points of all words over one text; the text must be lower case."""
    score = F.lit(0)
    for w in words:
        alone = rf"(^|[^\p{{L}}\p{{N}}_]){re.escape(w)}($|[^\p{{L}}\p{{N}}_])"
        inside = text.contains(w)
        score = score + (F.when(text == w, WHOLE_TEXT).when(inside & text.rlike(alone), WHOLE_WORD)
                         .when(inside, PART_OF_WORD).otherwise(0))
    return score


def keyword_scores(df: DataFrame, text_cols: list[str], query: str) -> DataFrame:
    """Rows with a positive score, summed over words and columns."""
    words = query_words(query)
    total = F.lit(0)
    for c in text_cols:
        total = total + keyword_score(F.lower(F.coalesce(F.col(c), F.lit(""))), words)
    return df.withColumn("score", total).where(F.col("score") > 0)


def keyword_search(df: DataFrame, text_cols: list[str], query: str, id_col: str, top_n: int) -> DataFrame:
    """The ``top_n`` best rows: id, score."""
    scored = keyword_scores(df, text_cols, query).select(id_col, "score")
    return scored.orderBy(F.col("score").desc(), id_col).limit(top_n)


def list_tables(tables: dict[str, DataFrame]) -> list[tuple[str, int]]:
    """Names and column counts, for browsing."""
    return sorted((name, len(df.columns)) for name, df in tables.items())
