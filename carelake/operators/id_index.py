"""Membership index of natural ids, so that a load need not read its whole fact table.

The index of a table is a list of generations.  A generation holds the ids of the
rows added since the one before: Parquet files parted by the hash of the id into
``buckets`` and sorted inside, and one Bloom filter per bucket.  Both are made in one
pass, so an id moves once.  A load asks the filters of the buckets its
batch falls into, and reads ids only from buckets in which a filter says "maybe".
A batch of new ids thus reads filters (``BITS`` bits per known id) and next to no ids.
Ids that no filter lets through are new without a look at any id, so only those that
may be known meet the ids held, once.

The index follows the table: its last line says up to which surrogate key it knows
the table, and ``catch_up`` adds what lies above.  Keys ascend from load to load,
so the statistics of Parquet row groups skip all older rows.  A load that failed
between the table and the index is therefore made up for by the next one, and
nothing is lost if the index is deleted.  One line per generation is the only
metadata; the highest key comes from there.  More than ``most`` generations are
merged into one.  One writer at a time, like the table itself.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from carelake.operators.keys import max_key
from carelake.schemas import local_rows
from carelake.session import scratch_dir
from carelake.sources.tables import CODEC, MOVED_ONCE, append_rows, settings

#: Bits per id and probes per id: one false "maybe" in some 7,000.
BITS, PROBES = 20, 8
#: Ids that may be broadcast; beyond it they are joined by a shuffle, with the same result.
BROADCAST_IDS = 200_000
GENERATIONS = "generation int, first int, ids bigint, top bigint"
FILTERS = "bucket int, slots bigint, bits binary"
ENTRIES = "what string, bucket int, id string, slots bigint, bits binary"
ASKED = "id string, bucket int, maybe boolean"
#: Ids whose positions are computed at a time.
STEP = 1 << 18
#: How sorted ids are stored: what an id shares with the one before it is not repeated.
SORTED_IDS = {**CODEC, "parquet.writer.version": "v2", "parquet.enable.dictionary#id": "false"}


def _positions(table: pa.Table, slots: int) -> np.ndarray:
    h1, h2 = (table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
    with np.errstate(over="ignore"):
        return (h1[:, None] + np.arange(PROBES, dtype=np.uint64) * (h2[:, None] | np.uint64(1))) % np.uint64(slots)


def _steps(table: pa.Table) -> list[pa.Table]:
    return [table.slice(at, STEP) for at in range(0, table.num_rows, STEP)]


def bloom_filter(table: pa.Table) -> pa.Table:
    """The filter over the ids (h1, h2) of one bucket."""
    slots = max(64, -(-table.num_rows * BITS // 8) * 8)
    held = np.zeros(slots, dtype=bool)
    for part in _steps(table):
        held[_positions(part, slots).ravel()] = True
    return pa.table({"bucket": table.column("bucket").slice(0, 1), "slots": pa.array([slots], pa.int64()),
                     "bits": pa.array([np.packbits(held).tobytes()], pa.binary())})


def entries(table: pa.Table) -> pa.Table:
    """What a generation stores of one bucket: its ids (id, h1, h2), sorted, and their filter."""
    made, n = bloom_filter(table), table.num_rows
    ids = table.select(["bucket", "id"]).sort_by("id")
    none = lambda kind, n: pa.nulls(n, kind)
    schema = pa.schema([("what", pa.string()), ("bucket", pa.int32()), ("id", pa.string()), ("slots", pa.int64()), ("bits", pa.binary())])
    parts = [{"what": pa.repeat("ids", n), "bucket": ids.column("bucket"), "id": ids.column("id"), "slots": none(pa.int64(), n), "bits": none(pa.binary(), n)},
             {"what": pa.repeat("filters", 1), "bucket": made.column("bucket"), "id": none(pa.string(), 1), "slots": made.column("slots"),
              "bits": made.column("bits")}]
    return pa.concat_tables([pa.table(p, schema=schema) for p in parts])


def maybe_known(ids: pa.Table, filters: pa.Table) -> pa.Table:
    """The ids of one bucket, and whether one of its filters may hold them."""
    held = [(slots, np.frombuffer(bits, dtype=np.uint8))
            for slots, bits in zip(filters.column("slots").to_pylist(), filters.column("bits").to_pylist())]
    maybe = np.zeros(ids.num_rows, dtype=bool)
    for k, part in enumerate(_steps(ids)):
        for slots, bits in held:
            at = _positions(part, slots)
            found = (bits[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1
            maybe[k * STEP:k * STEP + part.num_rows] |= found.all(axis=1)
    return ids.select(["id", "bucket"]).append_column("maybe", pa.array(maybe))


class IdIndex:
    """``root``: a folder of its own; ``natural`` and ``key``: columns of the indexed table."""

    def __init__(self, spark: SparkSession, root: str, natural: str, key: str, buckets: int = 64, most: int = 16):
        self.spark, self.root, self.natural, self.key = spark, root.rstrip("/"), natural, key
        self.buckets, self.most = buckets, most
        self._live = self._read_live()

    def _read_live(self) -> list[tuple[int, int, int, int]]:
        """The generations in use, newest first; a merged one stands for those from its ``first`` on."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/generations")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return []
        lines = self.spark.read.schema(GENERATIONS).parquet(f"{self.root}/generations").collect()  # a line per load
        live, below = [], None
        for line in sorted(map(tuple, lines), reverse=True):
            if below is None or line[0] < below:
                live.append(line)
                below = line[1]
        return live

    @property
    def top(self) -> int:
        """The highest surrogate key indexed."""
        return max((g[3] for g in self._live), default=0)

    @property
    def size(self) -> int:
        return sum(g[2] for g in self._live)

    def _bucket(self, column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _hashed(self, ids: DataFrame) -> DataFrame:
        return ids.select("id", "bucket", F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit("second")).alias("h2"))

    def _gathered(self, ids: DataFrame) -> DataFrame:
        """``ids`` (id, bucket) with their hashes, a bucket in one place; the hashes are taken there, so only ids move."""
        return self._hashed(ids.select("id", "bucket").repartition("bucket"))

    def _folder(self, generation: int, what: str) -> str:
        return f"{self.root}/ids/{generation:06d}/what={what}"

    def _add(self, ids: DataFrame, first: int | None, top: int) -> None:
        """Write a generation; it counts once its line is there, so a half-written one is written anew."""
        generation = self._live[0][0] + 1 if self._live else 1
        gathered = self._gathered(ids.select("id", self._bucket(F.col("id")).alias("bucket")))
        rows, seen = gathered.groupBy("bucket").applyInArrow(entries, ENTRIES), Observation()
        with settings(self.spark, MOVED_ONCE):
            (rows.observe(seen, F.count("id").alias("ids")).write.mode("overwrite").options(**SORTED_IDS)
             .partitionBy("what", "bucket").parquet(f"{self.root}/ids/{generation:06d}"))
        line = (generation, first or generation, seen.get["ids"], top)
        append_rows(self.spark, f"{self.root}/generations", GENERATIONS, [line])
        self._live = [line] + [g for g in self._live if g[0] < line[1]]

    def _ids(self, generations: list[int]) -> DataFrame:
        """(id, bucket) of the generations, read from their folders by bucket."""
        parts = [self.spark.read.schema("id string, bucket int").parquet(self._folder(g, "ids")) for g in generations]
        return reduce(DataFrame.unionByName, parts)

    def _filters(self) -> DataFrame:
        parts = [self.spark.read.schema(FILTERS).parquet(self._folder(g[0], "filters")) for g in self._live]
        return reduce(DataFrame.unionByName, parts)

    def catch_up(self, table: DataFrame) -> None:
        """Index the rows of ``table`` above the highest key indexed."""
        new = table.where(F.col(self.key) > F.lit(self.top)).select(F.col(self.natural).alias("id"), self.key)
        top = max_key(new, self.key)
        if top > self.top:
            self._add(new.where("id IS NOT NULL").select("id"), None, top)
        if len(self._live) > self.most:
            self._add(self._ids([g[0] for g in self._live]).select("id"), self._live[-1][1], self.top)

    def known(self, ids: DataFrame) -> DataFrame:
        """(id): those of ``ids`` (id) that the table holds."""
        if not self._live:
            return ids.select("id").limit(0)
        maybe, _, held, n = self._asked(ids)
        return held.join(F.broadcast(maybe) if n <= BROADCAST_IDS else maybe, "id")

    def _asked(self, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
        """Those of ``ids`` that the filters let through, the others, the ids held where the first ones are, and how many those are."""
        path = scratch_dir(self.spark, "asked")
        asked = self._gathered(ids.where("id IS NOT NULL").select("id", self._bucket(F.col("id")).alias("bucket")))
        told = asked.groupBy("bucket").cogroup(self._filters().groupBy("bucket")).applyInArrow(maybe_known, ASKED)
        with settings(self.spark, MOVED_ONCE):
            told.write.options(**CODEC).partitionBy("maybe").parquet(path)
        told = self.spark.read.schema(ASKED).parquet(path)
        maybe, sure = told.where("maybe").select("id", "bucket"), told.where("NOT maybe").select("id")
        touched = {r["bucket"]: r["n"] for r in maybe.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``buckets`` rows
        there = F.col("bucket").isin(sorted(touched)) if touched else F.lit(False)
        held = self._ids([g[0] for g in self._live]).where(there).select("id")
        return maybe.select("id"), sure, held, sum(touched.values())

    def unseen(self, batch: DataFrame, column: str) -> DataFrame:
        """The rows of ``batch`` whose ``column`` the table does not hold."""
        if not self._live:
            return batch
        maybe, sure, held, n = self._asked(batch.select(F.col(column).cast("string").alias("id")))
        if n > BROADCAST_IDS:
            # ids meet ids; the rows themselves need not move where few of them are new.  A row without an id is new
            new = self._stored(maybe.join(held, "id", "left_anti"), "new").unionByName(sure).unionByName(
                local_rows(self.spark, [(None,)], "id string")).select(F.col("id").alias("_new_id"))
            few = new.count() <= BROADCAST_IDS
            return batch.join(F.broadcast(new) if few else new, F.col(column).eqNullSafe(F.col("_new_id")), "left_semi")
        known = held.join(F.broadcast(maybe), "id")
        return batch.join(known.select(F.col("id").alias("_known_id")), F.col(column) == F.col("_known_id"), "left_anti")

    def _stored(self, ids: DataFrame, label: str) -> DataFrame:
        path = scratch_dir(self.spark, label)
        with settings(self.spark, MOVED_ONCE):
            ids.write.options(**CODEC).parquet(path)
        return self.spark.read.schema("id string").parquet(path)
