"""Keyword search for many questions at once, over an inverted index.

Scores are those of ``search.keyword_scores``: 10 points where a column's whole
text is the word, 5 where the word stands alone, 2 where it is part of a word,
summed over the question's words (repeats included) and the columns.  A word
has no separators, so it can only lie inside one term of a text; with every
term indexed, postings decide all three cases and no text is read again.

Five tables make the index.  ``documents`` holds each document once, with the
distinct terms of every column.  ``postings`` (term, document, column, whether
the term is the column's whole text) lies in folders by the term's hash, sorted
by term.  ``terms`` counts documents per term and column.  ``grams`` leads from
one, two or three characters to the terms that hold them, and ``gram_counts``
tells the rarest gram of a word, whose terms are then compared with it.

A search for all results reads postings.  A search for the best ``n`` scores
document by document: packs of documents meet blocks of questions, a pack's
points per word are one matrix, the words of a block's questions another, and a
pack passes on its best ``n`` per question only.  So frequent words and parts of
words (one letter lies in most terms) never become rows of word and document.

Bounds say which documents a question has to meet.  Each word's points are
bounded from ``terms`` alone; a word in very many terms has the highest there are.  The
rarest words of a question are scored first, from postings; their n-th best
score is a floor.  The most frequent words whose bounds together stay below the
floor cannot carry a document by themselves.  Where the other words lie in few
documents, the question meets those only; else it meets all.  Results equal
the search without bounds, ties to the smaller id.

Rows without an id are not indexed; rows that share an id are one document.
A null text is empty.  A question without words has no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.operators.lookups import repeated_hashes
from carelake.operators.search import PART_OF_WORD, WHOLE_TEXT, WHOLE_WORD
from carelake.session import scratch_dir

WORD = r"([\p{L}\p{N}_]+)"
GRAM = 3
LEAD = 20  # postings per wanted document that may be scored to find a floor
NARROW = 100  # postings per wanted document of the words that can carry one; a question with more meets all documents
COMPARED = 5000  # terms that a word is compared with for its bound; beyond it the word has the highest bound
PACK, ASKED = 256, 256  # documents and questions that meet in one step
CACHE_TERMS = 400_000  # entries after which a block's look-up of terms starts anew


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 1)


def grams_of(word: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters; none of shorter words."""
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(word) - size + 1, F.lit(1)))
    runs = F.transform(starts, lambda i: F.substring(word, i, F.lit(size)))
    return F.array_distinct(F.filter(runs, lambda g: F.char_length(g) == size))


class _Block:
    """The questions of one block against packs of documents."""

    def __init__(self, queries: pa.Array, words: pa.Array, times: pa.Array):
        asked, held = queries.dictionary_encode(), words.dictionary_encode()
        self.queries, self.size = asked.dictionary, len(held.dictionary)
        self.words = {w: i for i, w in enumerate(held.dictionary.to_pylist())}
        self.lengths = sorted({len(w) for w in self.words})
        self.times = np.zeros((self.size, len(self.queries)))
        self.times[held.indices.to_numpy(), asked.indices.to_numpy()] = times.to_numpy()
        self._parts: dict[str, np.ndarray] = {}

    def _parts_of(self, term: str) -> np.ndarray:
        """Numbers of the words that the term holds."""
        found = self._parts.get(term)
        if found is None:
            if len(self._parts) >= CACHE_TERMS:
                self._parts.clear()
            parts = {self.words.get(term[i:i + k], -1) for k in self.lengths for i in range(len(term) - k + 1)}
            found = self._parts[term] = np.fromiter(parts - {-1}, dtype=np.int64)
        return found

    def _points(self, terms: pa.ListArray, whole: pa.ListArray) -> np.ndarray:
        """Points of each document and word in one column; a document's are put together by ORs of bits per term."""
        coded = terms.flatten().dictionary_encode()
        codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        bits = np.zeros((len(names), -(-self.size // 8)), dtype=np.uint8)
        parts = [self._parts_of(name) for name in names]
        held = np.concatenate([np.zeros(0, dtype=np.int64), *parts])
        place = np.repeat(np.arange(len(names)) * bits.shape[1], [len(p) for p in parts]) + (held >> 3)
        np.bitwise_or.at(bits.reshape(-1), place, (128 >> (held & 7)).astype(np.uint8))
        ends = np.cumsum(pc.list_value_length(terms).to_numpy())
        found = np.zeros((len(terms), bits.shape[1]), dtype=np.uint8)
        for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
            found[i] = np.bitwise_or.reduce(bits[codes[a:b]], axis=0)
        points = np.unpackbits(found, axis=1, count=self.size) * np.uint8(PART_OF_WORD)
        own = np.fromiter((self.words.get(t, -1) for t in names), dtype=np.int64, count=len(names))[codes]
        points[pc.list_parent_indices(terms).to_numpy()[own >= 0], own[own >= 0]] = WHOLE_WORD
        for i, texts in enumerate(whole.to_pylist()):
            for text in texts:
                if text in self.words:
                    points[i, self.words[text]] = WHOLE_TEXT
        return points

    def best(self, ids: pa.Array, columns: list[tuple[pa.ListArray, pa.ListArray]], n: int) -> pa.RecordBatch:
        points = np.zeros((len(ids), self.size))
        for terms, whole in columns:
            points += self._points(terms, whole)
        by_id = pc.sort_indices(ids)
        scores = (points @ self.times)[by_id.to_numpy()]
        top = np.argsort(-scores, axis=0, kind="stable")[:n]
        best = np.take_along_axis(scores, top, axis=0)
        rank, query = np.nonzero(best > 0)
        return pa.RecordBatch.from_arrays(
            [self.queries.take(pa.array(query)), ids.take(by_id.take(pa.array(top[rank, query]))),
             pa.array(best[rank, query].astype(np.int64))], names=["query_id", "id", "score"])


class KeywordIndex:
    def __init__(self, docs: DataFrame, id_col: str, text_cols: list[str], buckets: int = 64):
        """``buckets`` folders hold the postings; one wants a few GB."""
        self.spark, self.buckets = docs.sparkSession, buckets
        self.folder = scratch_dir(self.spark, "keyword-index")
        self._parts, self._n_cols = 0, len(text_cols)
        self.documents = self._build_documents(docs, id_col, text_cols)
        self.postings = self._build_postings()
        self.terms = self._stored(self.postings.groupBy("term", "col").agg(
            F.count(F.lit(1)).alias("n_docs"), F.max("whole").alias("any_whole")), "terms")
        every = F.flatten(F.array(*[grams_of(F.col("term"), k) for k in range(1, GRAM + 1)]))
        grams = self.terms.select("term").distinct().select(F.explode(every).alias("gram"), "term")
        self.grams = self._stored(grams.hint("rebalance", "gram").sortWithinPartitions("gram"), "grams")
        self.gram_counts = self._stored(self.grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n_terms")), "gram-counts")

    def _stored(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        self._parts += 1
        path = f"{self.folder}/{name}-{self._parts}"
        writer = df.write.partitionBy(by) if by else df.write
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _build_documents(self, docs: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
        """id and, for each column, its distinct terms and its whole text where that is one term."""
        texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *[
            F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"text{i}") for i, c in enumerate(text_cols)])
        parts = []
        for i in range(self._n_cols):
            text, terms = F.col(f"text{i}"), F.array_distinct(words_of(F.col(f"text{i}")))
            parts += [terms.alias(f"terms{i}"), F.array_intersect(terms, F.array(text)).alias(f"whole{i}")]
        rows = self._stored(texts.select("id", *parts), "rows")
        doubts, n = repeated_hashes(rows, "id")
        if not n:
            return rows
        hashed, match = rows.withColumn("_hash", F.xxhash64("id")), F.col("_hash") == F.col("_doubt")
        merged = hashed.join(doubts, match, "left_semi").groupBy("id").agg(
            *[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in rows.columns if c != "id"])
        return self._stored(hashed.join(doubts, match, "left_anti").drop("_hash").unionByName(merged), "documents")

    def _build_postings(self) -> DataFrame:
        columns = F.array(*[F.struct(F.lit(i).alias("col"), F.col(f"terms{i}").alias("terms"), F.col(f"whole{i}").alias("whole"))
                            for i in range(self._n_cols)])
        found = self.documents.select("id", F.explode(columns).alias("c"))
        rows = found.select("id", "c.col", F.col("c.whole").alias("texts"), F.explode("c.terms").alias("term")).select(
            "term", "id", "col", F.array_contains("texts", F.col("term")).alias("whole"),
            self._bucket(F.col("term")).alias("bucket"))
        return self._stored(rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term"), "postings", "bucket")

    def _matches(self, words: DataFrame, most_terms: int | None = None) -> DataFrame:
        """word, term, col, n_docs, points: the terms that hold each word, by its rarest gram.

        Words whose rarest gram lies in more than ``most_terms`` terms are left out.
        """
        probe = F.when(F.char_length("word") < GRAM, F.array("word")).otherwise(grams_of(F.col("word"), GRAM))
        probes = words.select("word", F.explode(probe).alias("gram")).join(self.gram_counts, "gram", "left")
        n = F.coalesce(F.col("n_terms"), F.lit(0))
        rarest = probes.groupBy("word").agg(F.min_by("gram", n).alias("gram"), F.min(n).alias("n_terms"))
        rarest = rarest if most_terms is None else rarest.where(F.col("n_terms") <= most_terms)
        rarest = self._stored(rarest.select("word", "gram"), "rarest")  # its size is known then, so the grams need not move for few words
        held = rarest.join(self.grams, "gram").where(F.col("term").contains(F.col("word")))
        points = F.when(F.col("term") != F.col("word"), PART_OF_WORD).when(
            F.col("any_whole"), WHOLE_TEXT).otherwise(WHOLE_WORD)
        return held.join(self.terms, "term").select("word", "term", "col", "n_docs", points.alias("most"))

    def _word_points(self, words: DataFrame, matches: DataFrame) -> DataFrame:
        """word, id, points over all columns, once for all questions that hold the word."""
        wanted = self._stored(matches.join(words.select("word").distinct(), "word", "left_semi")
                              .select("word", "term", self._bucket(F.col("term")).alias("bucket")).distinct(), "wanted")
        buckets = [r.bucket for r in wanted.select("bucket").distinct().collect()]  # as many as there are folders at most
        own = F.col("term") == F.col("word")
        points = F.when(own & F.col("whole"), WHOLE_TEXT).when(own, WHOLE_WORD).otherwise(PART_OF_WORD)
        hits = self.postings.where(F.col("bucket").isin(buckets)).join(wanted, ["bucket", "term"])
        return hits.groupBy("word", "id", "col").agg(F.max(points).alias("points")).groupBy("word", "id").agg(
            F.sum("points").alias("points"))

    def _scores(self, asked: DataFrame, matches: DataFrame) -> DataFrame:
        points = self._word_points(asked, matches)
        return asked.join(points, "word").groupBy("query_id", "id").agg(F.sum(F.col("times") * F.col("points")).alias("score"))

    def search(self, queries: DataFrame, n: int | None = None, pruned: bool = True) -> DataFrame:
        """query_id, id, score, rank of the best ``n`` documents of each question; None gives all.

        ``queries`` holds query_id (unique) and query.
        """
        asked = queries.where(F.col("query_id").isNotNull()).select(
            "query_id", F.explode(words_of(F.lower("query"))).alias("word")).groupBy("query_id", "word").agg(
            F.count(F.lit(1)).alias("times"))
        asked = self._stored(asked, "asked")
        if n is None:
            return _best(self._scores(asked, self._stored(self._matches(asked.select("word").distinct()), "matches")), None)
        if not pruned:
            return _best(self._by_document(asked, self.documents, n), n)
        return _best(self._pruned(asked, n), n)

    def _by_document(self, asked: DataFrame, documents: DataFrame, n: int) -> DataFrame:
        """query_id, id, score: the best ``n`` of each pack of ``documents`` for every question."""
        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, PACK):
                    part = batch.slice(start, PACK)
                    ends = pa.array([0, part.num_rows], pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, c) for c in part.columns], names=names)

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, block = None, None
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {f: batch.column(f).slice(i, 1) for f in batch.schema.names}
                    if row["block"][0].as_py() != number:
                        number, block = row["block"][0].as_py(), _Block(*[row[f].flatten() for f in ("queries", "words", "times")])
                    columns = [(row[f"terms{c}"].flatten(), row[f"whole{c}"].flatten()) for c in range(n_cols)]
                    yield block.best(row["id"].flatten(), columns, n)

        names, n_cols = documents.columns, self._n_cols
        blocks = max(1, -(-asked.select("query_id").distinct().count() // ASKED))
        of = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
        questions = asked.groupBy(of.alias("block")).agg(F.collect_list(F.struct("query_id", "word", "times")).alias("a")).select(
            "block", F.col("a.query_id").alias("queries"), F.col("a.word").alias("words"), F.col("a.times").alias("times"))
        lists = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in documents.schema.fields])
        packs = documents.mapInArrow(packed, lists).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        types = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType),
                              T.StructField("id", documents.schema["id"].dataType), T.StructField("score", T.LongType())])
        return packs.join(questions, "block").mapInArrow(scored, types)

    def _pruned(self, asked: DataFrame, n: int) -> DataFrame:
        """query_id, id, score: documents that may be among the best ``n``, of every question."""
        matches = self._stored(self._matches(asked.select("word").distinct(), COMPARED), "matches")
        per_word = matches.groupBy("word", "col").agg(F.max("most").alias("most"), F.sum("n_docs").alias("size")).groupBy(
            "word").agg(F.sum("most").alias("bound"), F.sum("size").alias("size"))
        # a word that was not compared may have any points in any number of documents, or lie nowhere
        bound, size = F.coalesce("bound", F.lit(WHOLE_TEXT * self._n_cols)), F.coalesce("size", F.lit(1 << 40))
        known = asked.join(per_word, "word", "left").withColumn("bound", bound * F.col("times")).withColumn("size", size)
        rising = Window.partitionBy("query_id").orderBy("size", "word")
        falling = Window.partitionBy("query_id").orderBy(F.col("size").desc(), F.col("word").desc())
        upto = (Window.unboundedPreceding, 0)
        known = self._stored(known.withColumn("lead", F.sum("size").over(rising.rowsBetween(*upto)) <= LEAD * n)
                             .withColumn("weight", F.sum("bound").over(falling.rowsBetween(*upto))), "known")
        first = self._stored(self._scores(known.where("lead"), matches), "lead-scores")
        floors = _best(first, n).where(F.col("rank") == n).select("query_id", F.col("score").alias("floor"))
        rest = known.where("NOT lead").join(floors, "query_id", "left")
        rest = self._stored(rest.withColumn("extra", F.coalesce(F.col("weight") < F.col("floor"), F.lit(False))), "rest")
        carrying = rest.where("NOT extra").groupBy("query_id").agg(F.sum("size").alias("size"))
        narrow = self._stored(floors.join(carrying, "query_id", "left").where(
            F.coalesce("size", F.lit(0)) <= NARROW * n).select("query_id"), "narrow")
        few = rest.where("NOT extra").join(narrow, "query_id", "left_semi")
        needed = first.join(narrow, "query_id", "left_semi").unionByName(self._scores(few, matches))
        self.candidates = self._stored(needed.select("query_id", "id").distinct(), "candidates")
        met = self.documents.join(self.candidates.select("id").distinct(), "id", "left_semi")
        return self._by_document(asked.join(narrow, "query_id", "left_semi"), met, n).unionByName(
            self._by_document(asked.join(narrow, "query_id", "left_anti"), self.documents, n))


def _best(scores: DataFrame, n: int | None) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = scores.withColumn("rank", F.row_number().over(order))
    return ranked if n is None else ranked.where(F.col("rank") <= n)
