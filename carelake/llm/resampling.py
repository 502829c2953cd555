"""Importance resampling towards a target distribution.

Documents are drawn so that their words are spread like those of the target texts.
Features are runs of 1 to ``longest`` words, hashed to ``buckets`` counters.  A
bucket's gain is the log ratio of its smoothed share in the target and in the
documents, in thousandths; a document's weight is the sum of gains over its
features, looked up in one array.  A Gumbel draw, fixed by seed and doc_id, is added,
and the highest scores are a weighted draw without replacement.

The order comes from parallel sorting by regular sampling.  Scored rows are written
as locally sorted runs, one per file.  Every ``stride``-th row of each run, by its
place in the file, is a sample; the sorted samples give splitters; each run is cut
at the splitters, which gives the rows per segment.  Prefix counts then say at which
rank each segment starts, and only segments that hold drawn ranks are exchanged,
each to be merged on its own.  Rows below the last drawn segment never move.

Bounds: the gains are one array of ``buckets`` numbers; at most ``samples`` rows and
one more per run are collected for the splitters, at most ``segments`` of which are
kept.  The last keys of the order are a row's run and place, so that equal rows, however
many, are cut as well.  A text is featurised whole.

A null or empty text has no features and weight 0.  Repeated rows are counted,
scored and drawn each.  A null doc_id draws like the empty id and comes last among
ties.  Ties go to the smaller doc_id, then to fewer features.  An empty target has 0
everywhere: gains then only favour rare buckets.  An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import bisect
import math
import zlib
from hashlib import sha256
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.llm.common import CACHE_ENTRIES, of_documents, steps, stored, texts_of

#: A-Z becomes a-z; ASCII other than digits and letters separates words; bytes beyond ASCII are kept.
_WORD_BYTES = bytes.maketrans(ascii_uppercase.encode() + bytes(c for c in range(128) if not chr(c).isalnum()),
                              ascii_lowercase.encode() + b" " * sum(not chr(c).isalnum() for c in range(128)))
#: Descending score, then doc_id, then what else tells rows apart.
KEY = ("down", "id", "n_features", "run", "place")


def words(text: str) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split()


class Buckets(dict):
    """crc32 of a feature modulo ``n``, kept for the features seen last."""

    def __init__(self, n: int) -> None:
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[feature] = zlib.crc32(feature) % self.n
        return value

    def of(self, text: str, longest: int) -> tuple[int, np.ndarray]:
        """Number of words, and the bucket of every run of 1 to ``longest`` words."""
        found = words(text)
        parts = [np.fromiter(map(self.__getitem__, found), np.int64, len(found))]
        for n in range(2, longest + 1):
            runs = [b" ".join(found[i:i + n]) for i in range(len(found) - n + 1)]
            parts.append(np.fromiter(map(self.__getitem__, runs), np.int64, len(runs)))
        return len(found), np.concatenate(parts)


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """Features per bucket over all texts."""
    def run(batches):
        known, sums = Buckets(buckets), np.zeros(buckets, dtype=np.int64)
        for batch in steps(batches):
            for text in texts_of(batch):
                sums += np.bincount(known.of(text, longest)[1], minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n))))
                     for a, b in zip(source.astype(float).tolist(), target.astype(float).tolist())], dtype=np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    drawn = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((drawn + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches):
        array = shared.value
        known = Buckets(len(array))
        for batch in steps(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                n, found = known.of(text, longest)
                weight = int(array[found].sum())
                rows.append((n, len(found), weight, weight + noise(doc_id, seed)))
            made = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def _keyed(runs: DataFrame) -> DataFrame:
    """The rows of written runs with the columns of KEY; ``place`` is the rank within the run."""
    at = F.col("_metadata.row_index")
    return runs.select("doc_id", "n_features", "weight", "score", (-F.col("score")).alias("down"),
                       F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), F.xxhash64("_metadata.file_path").alias("run"), at.alias("place"), "eligible")


def _splitters(rows: DataFrame, n: int, segments: int, samples: int) -> list[tuple]:
    """At most ``segments`` - 1 keys that part ``n`` rows about evenly, from every ``stride``-th row of each run."""
    stride = max(1, -(-n // samples))
    first = F.pmod("run", F.lit(stride))
    picked = rows.where(F.pmod(F.col("place") + first, F.lit(stride)) == 0).select(*KEY).toArrow()
    keys = sorted(zip(*[picked.column(c).to_pylist() for c in KEY]))
    step = max(1, -(-len(keys) // segments))
    return keys[step - 1:-1:step]


def _in_segments(rows: DataFrame, splitters: list[tuple]) -> DataFrame:
    """The rows with the number of their segment: runs are sorted, so each splitter is sought once in a batch."""
    shared = rows.sparkSession.sparkContext.broadcast(splitters)  # at most ``segments`` keys
    schema = T.StructType([*rows.schema.fields, T.StructField("segment", T.LongType())])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*[batch.column(c).to_pylist() for c in KEY]))
            # A batch may hold the end of one run and the start of the next.
            starts = [0, *(i for i in range(1, len(keys)) if keys[i][3] != keys[i - 1][3]), len(keys)]
            segment = np.empty(len(keys), dtype=np.int64)
            for a, b in zip(starts, starts[1:]):
                at, number = a, bisect.bisect_left(shared.value, keys[a])
                while at < b:
                    end = bisect.bisect_right(keys, shared.value[number], at, b) if number < len(shared.value) else b
                    segment[at:end] = number
                    at, number = end, number + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment)], names=[*batch.schema.names, "segment"])

    return rows.mapInArrow(run, schema)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000,
             seed: int = 2024, segments: int = 4096, samples: int = 1 << 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank (null where not drawn).

    Of the N documents of ``least_words`` words or more, floor(percent * N / 100) are drawn.
    """
    read = of_documents(docs, doc_id, text)
    gain = gains(bucket_counts(read, buckets, longest), bucket_counts(target.select(F.coalesce(F.col(text), F.lit("")).alias("text")), buckets, longest))
    made = scored(read, gain, longest, seed).withColumn("eligible", F.col("n_words") >= least_words)
    runs = stored(made.sortWithinPartitions(F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id"), "n_features"), "runs", "zstd")
    keyed = _keyed(runs)
    able = keyed.where("eligible").drop("eligible")
    n = able.count()
    drawn = percent * n // 100
    parted = _in_segments(able, _splitters(able, n, max(1, min(segments, -(-n // 1000))), samples))
    sizes = dict(map(tuple, parted.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()))  # at most ``segments`` rows
    before, start = [], 0
    for segment in sorted(sizes):
        if start < drawn:
            before.append((segment, start))
        start += sizes[segment]
    starts = docs.sparkSession.createDataFrame(before, "segment long, start long")
    last = before[-1][0] if before else -1
    order = Window.partitionBy("segment").orderBy(*KEY)
    place = F.col("start") + F.row_number().over(order)
    moved = (parted.where(F.col("segment") <= last).join(F.broadcast(starts), "segment")  # at most ``segments`` rows
             .withColumn("rank", place.cast("long")).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))))
    columns = ("doc_id", "n_features", "weight", "score", "rank")
    rest = parted.where(F.col("segment") > last).unionByName(keyed.where("NOT eligible").drop("eligible").withColumn("segment", F.lit(-1).cast("long")))
    return moved.select(*columns).unionByName(rest.withColumn("rank", F.lit(None).cast("long")).select(*columns))


def in_drawn_order(docs: DataFrame, drawn: DataFrame) -> DataFrame:
    """The drawn rows of ``docs`` (unique doc_id) with their rank."""
    return docs.join(drawn.where("rank IS NOT NULL").select("doc_id", "rank"), "doc_id")
