"""What the operators share: tables, written intermediate tables, Arrow batches of texts, word hashes."""

from __future__ import annotations

import contextlib
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one step inside a task works on at once; a longer text is a step of its own.
STEP_BYTES = 8 << 20
#: Entries after which a task's look-up cache starts anew.
CACHE_ENTRIES = 400_000

_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share: under ``spark.checkpoint.dir``, else the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/llm/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """``df`` written once and read back, so its lineage ends here and lost executors lose nothing.

    The shuffle files of the write go when it has ended.  ``codec``: zstd for large tables of numbers.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(_CLEAN_SHUFFLES, None)
    spark.conf.set(_CLEAN_SHUFFLES, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if before is not None:
            spark.conf.set(_CLEAN_SHUFFLES, before)
        else:
            spark.conf.unset(_CLEAN_SHUFFLES)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove tables of ``stored`` that no later step reads."""
    for df in tables:
        path = getattr(df, "_llm_path", None)
        if path:
            jvm = df.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            with contextlib.suppress(OSError):
                place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as remainder 0 (held out)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n)), F.lit(0))


def of_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator works on, so that others can't clash; a null text is empty."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def steps(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in slices of about STEP_BYTES of ``column``."""
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        part = np.cumsum(lengths) // STEP_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t if t is not None else "" for t in batch.column(column).to_pylist()]


def append_columns(df: DataFrame, fields: list[T.StructField], make: Callable, column: str = "text") -> DataFrame:
    """``df`` with columns computed from its texts, in one pass without a shuffle.

    ``make()`` runs once per task and returns a function from a list of texts to
    one Arrow array (or list) per field.  Columns of ``df`` named like a new one are replaced.
    """
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    schema = T.StructType(kept + fields)
    from pyspark.sql.pandas.types import to_arrow_schema
    types = [f.type for f in to_arrow_schema(T.StructType(fields))]
    names = [f.name for f in kept] + [f.name for f in fields]

    def run(batches):
        function = make()
        for batch in steps(batches, column):
            made = function(texts_of(batch, column))
            arrays = [a if isinstance(a, pa.Array) else pa.array(a, type=t) for a, t in zip(made, types)]
            own = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays(own + arrays, names=names)

    # The text may itself be replaced only by leaving it in the input.
    needed = df.select(*[F.col(f"`{f.name}`") for f in kept]) if column in {f.name for f in kept} else df
    return needed.mapInArrow(run, schema)


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept for the words seen last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


class Windows:
    """64-bit hashes of all windows of ``n`` values, by prefix sums of a polynomial modulo 2^64."""

    def __init__(self) -> None:
        self._up = self._down = np.ones(1, dtype=np.uint64)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def of(self, values: np.ndarray, n: int) -> np.ndarray:
        size = len(values)
        if size < n:
            return np.zeros(0, dtype=np.uint64)
        if len(self._up) < size:
            self._up = self._powers(_MULTIPLIER, max(size, 2 * len(self._up)))
            self._down = self._powers(_INVERSE, len(self._up))
        with np.errstate(over="ignore"):
            sums = np.zeros(size + 1, dtype=np.uint64)
            np.cumsum(values * self._up[:size], out=sums[1:])
            return mixed((sums[n:] - sums[:-n]) * self._down[: size - n + 1])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a bijection)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    """Runs of bytes other than space and 0x09 to 0x0D."""
    return text.encode().split()


def crc_fold(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n
