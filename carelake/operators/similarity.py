"""Similarity lookup that meets only blocks of the cache in which a match may be.

The entries of an agent are grouped around centres (some of its entries, chosen by
hash), and a group is cut by angle and size into blocks of at most ``block_rows`` entries or so.
A block keeps, for each centre, the range of its entries' angles to it.  The angle
between a request and an entry is at least the gap between the request's angle
and that range, so the cosine of the widest gap bounds every score in the block.
A request first meets its most promising block, then those whose bound reaches
both the floor and the best score so far.  The result is the one of comparing all.

Nothing grows in one task: entries are assigned in shards, blocks have a bounded
size, requests of a block are sharded as well, and pairs of vectors never
become rows.  Centres and ranges are a fixed number per agent and block.  Vectors
need not have unit length; their lengths enter the bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelake.session import scratch_dir

#: Centres per agent, at most.
CENTRES = 64
#: Width of the rings into which a group is cut, in radians.
RING = np.pi / 48
#: Room for rounding; a bound only rules blocks out.
SLACK = 1e-6
PLACED = ("AgentName string, CacheID bigint, Embedding array<float>, centre int, ring int, length double, angles array<float>")
REACH = "request_id {id}, AgentName string, block bigint, bound double"


def _matrix(column) -> np.ndarray:
    """Rows of equally long lists."""
    rows = column.to_pylist()
    return np.array(rows, dtype=np.float64).reshape(len(rows), -1)


def _angles(vectors: np.ndarray, lengths: np.ndarray, centres: np.ndarray) -> np.ndarray:
    norm = np.outer(np.maximum(lengths, 1e-100), np.maximum(np.linalg.norm(centres, axis=1), 1e-100))
    return np.arccos(np.clip(vectors @ centres.T / norm, -1.0, 1.0))


def _placed(entries: pa.Table, centres: pa.Table) -> pa.Table:
    points, vectors = np.array(centres.column("centres")[0].as_py(), dtype=np.float64), _matrix(entries.column("Embedding"))
    lengths = np.linalg.norm(vectors, axis=1)
    angles = _angles(vectors, lengths, points)
    nearest = angles.argmin(axis=1)
    ring = (angles[np.arange(len(nearest)), nearest] / RING).astype(np.int32)
    flat = pa.array(angles.astype(np.float32).ravel())
    offsets = pa.array(np.arange(len(nearest) + 1, dtype=np.int32) * len(points))
    return pa.table({"AgentName": entries.column("AgentName"), "CacheID": entries.column("CacheID"), "Embedding": entries.column("Embedding"),
                     "centre": pa.array(nearest.astype(np.int32)), "ring": pa.array(ring), "length": pa.array(lengths),
                     "angles": pa.ListArray.from_arrays(offsets, flat)})


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sharded(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df`` with ``_shard``: parts of at most ``rows`` rows or so per agent."""
    sizes = df.groupBy("AgentName").agg(F.ceil(F.count(F.lit(1)) / rows).alias("_shards"))
    return df.join(sizes, "AgentName").withColumn("_shard", F.pmod(F.xxhash64(key), F.col("_shards")).cast("int"))


def _together(left: DataFrame, right: DataFrame, keys: list[str]):
    """Both frames by the same keys, under other names at the right, since one may stem from the other."""
    other = right.withColumnsRenamed({k: f"of{k}" for k in keys})
    return left.groupBy(*keys).cogroup(other.groupBy(*[f"of{k}" for k in keys]))


class ClusteredCache:
    """Vectors (AgentName, CacheID, Embedding) laid out in blocks."""

    def __init__(self, vectors: DataFrame, block_rows: int = 4096):
        self.block_rows = block_rows
        by_hash = Window.partitionBy("AgentName").orderBy(F.xxhash64("CacheID"), "CacheID")
        picked = vectors.withColumn("_n", F.row_number().over(by_hash)).where(F.col("_n") <= CENTRES)
        self.centres = _written(picked.groupBy("AgentName").agg(F.collect_list("Embedding").alias("centres")), "centres")
        shards = _sharded(vectors, "CacheID", 16 * block_rows)
        of = shards.select("AgentName", "_shard").distinct().join(self.centres, "AgentName")
        keys = ["AgentName", "_shard"]
        placed = _written(_together(shards, of, keys).applyInArrow(_placed, PLACED), "placed")
        where = ["AgentName", "centre", "ring"]
        parts = placed.groupBy(*where).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("parts"))
        part = F.pmod(F.xxhash64("CacheID"), F.col("parts"))
        self.entries = _written(placed.join(parts, where).withColumn("block", F.xxhash64(*where, part)).drop("parts"), "entries")
        at = F.posexplode("angles").alias("at", "angle")
        ranges = (self.entries.select("AgentName", "block", at).groupBy("AgentName", "block", "at")
                  .agg(F.min("angle").alias("low"), F.max("angle").alias("high"))
                  .groupBy("AgentName", "block").agg(F.array_sort(F.collect_list(F.struct("at", "low", "high"))).alias("r")))
        lengths = self.entries.groupBy("AgentName", "block").agg(
            F.count(F.lit(1)).alias("n"), F.min("length").alias("shortest"), F.max("length").alias("longest"))
        self.blocks = _written(lengths.join(ranges, ["AgentName", "block"]).select(
            "AgentName", "block", "n", "shortest", "longest", F.col("r.low").alias("low"), F.col("r.high").alias("high")), "blocks")

    def reached(self, requests: DataFrame, floor: float) -> DataFrame:
        """(request_id, AgentName, block, bound): the blocks in which a request may score ``floor`` or more."""
        def bound(asked: pa.Table, given: pa.Table) -> pa.Table:
            out = {"request_id": [], "block": [], "bound": []}
            if asked.num_rows and given.num_rows:
                points = np.array(given.column("centres")[0].as_py(), dtype=np.float64)
                vectors = _matrix(asked.column("embedding"))
                size = np.linalg.norm(vectors, axis=1)
                angles = _angles(vectors, size, points)
                blocks, low, high, shortest, longest = given.column("block").to_numpy(), *(_matrix(given.column(c)) for c in ("low", "high")), *(
                    given.column(c).to_numpy() for c in ("shortest", "longest"))
                ids = np.arange(asked.num_rows)
                step = max(1, (1 << 21) // max(1, len(blocks)))
                for a in range(0, len(ids), step):
                    gap = np.zeros((len(ids[a:a + step]), len(blocks)))
                    for k in range(len(points)):
                        theta = angles[a:a + step, k:k + 1]
                        np.maximum(gap, np.maximum(low[:, k] - theta, theta - high[:, k]), out=gap)
                    cosine = np.cos(np.maximum(gap - SLACK, 0.0))
                    value = size[a:a + step, None] * np.where(cosine >= 0, cosine * longest, cosine * shortest) + SLACK
                    row, column = np.nonzero(value >= floor)
                    out["request_id"].append(ids[a:a + step][row])
                    out["block"].append(blocks[column])
                    out["bound"].append(value[row, column])
            whole = {k: np.concatenate(v) if v else np.zeros(0, dtype=np.int64 if k != "bound" else np.float64) for k, v in out.items()}
            at = pa.array(whole["request_id"])
            return pa.table({"request_id": asked.column("request_id").take(at), "AgentName": asked.column("AgentName").take(at),
                             "block": pa.array(whole["block"]), "bound": pa.array(whole["bound"])})

        asked, keys = _sharded(requests, "request_id", self.block_rows), ["AgentName", "_shard"]
        given = asked.select(*keys).distinct().join(self.blocks.join(self.centres, "AgentName"), "AgentName")
        schema = REACH.format(id=requests.schema["request_id"].dataType.simpleString())
        return _together(asked, given, keys).applyInArrow(bound, schema)

    def scored(self, requests: DataFrame, met: DataFrame, floor: float) -> DataFrame:
        """(request_id, CacheID, Score): the best entry of each block that a request meets, if at least ``floor``."""
        def best(asked: pa.Table, entries: pa.Table) -> pa.Table:
            ids, order = entries.column("CacheID").to_numpy(), np.argsort(entries.column("CacheID").to_numpy(), kind="stable")
            at, top, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            if asked.num_rows and len(ids):
                vectors, against = _matrix(asked.column("embedding")), _matrix(entries.column("Embedding"))[order].T
                parts = [vectors[i:i + 512] @ against for i in range(0, len(vectors), 512)]
                top = np.concatenate([p.argmax(axis=1) for p in parts])
                value = np.concatenate([p.max(axis=1) for p in parts])
                at = np.flatnonzero(value >= floor)
            return pa.table({"request_id": asked.column("request_id").take(pa.array(at)), "CacheID": pa.array(ids[order][top[at]], pa.int64()),
                             "Score": pa.array(value[at], pa.float64())})

        shards = met.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / self.block_rows).cast("int").alias("_n"))
        part = F.pmod(F.xxhash64("request_id"), F.col("_n")).cast("int").alias("_part")
        asked = met.join(shards, "block").join(requests.select("request_id", "embedding"), "request_id").select("request_id", "embedding", "block", part)
        entries = self.entries.join(shards, "block").select("block", "CacheID", "Embedding", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_part"))
        id_type = requests.schema["request_id"].dataType.simpleString()
        return _together(asked, entries, ["block", "_part"]).applyInArrow(
            best, f"request_id {id_type}, CacheID bigint, Score double")

    def lookup(self, requests: DataFrame, floor: float) -> DataFrame:
        """Best entries (request_id, CacheID, Score) of the two rounds; ``met`` of it keeps the pairs of request and block."""
        reach = _written(self.reached(requests, floor), "reached")
        first = reach.groupBy("request_id", "AgentName").agg(F.max_by(F.struct("block", "bound"), F.struct("bound", "block")).alias("x")).select(
            "request_id", "AgentName", "x.*")
        found = _written(self.scored(requests, first, floor), "first-scores")
        left = reach.join(first.select("request_id", "block"), ["request_id", "block"], "left_anti")
        later = left.join(found.groupBy("request_id").agg(F.max("Score").alias("so_far")), "request_id", "left").where(
            F.col("bound") >= F.coalesce("so_far", F.lit(floor))).drop("so_far")
        later = _written(later, "later")
        self.met = first.unionByName(later)
        return found.unionByName(self.scored(requests, later, floor))

    def pairs_scored(self) -> int:
        """Pairs of request and entry that the last lookup compared."""
        return self.met.join(self.blocks.select("block", "n"), "block").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
