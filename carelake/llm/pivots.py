"""Exact top-k inner-product search over a pivot-distance index.

Vectors are lifted by one coordinate to equal length, so that the largest inner
product is the smallest Euclidean distance.  Each is keyed by its nearest pivot and
its distance to it; a pivot's distances are cut into annuli (rings) at quantiles.
For a query, the triangle inequality bounds every inner product within a ring
from the ring's inner and outer distance.  Queries expand rings in the order of
that bound: first the best one, then a few, then all whose bound still reaches
the query's k-th best score; the others are never read for it.

Rings are stored in packed blocks of about ``block_rows`` vectors (a ring with
more, such as one of many equal vectors, has several) and queries meet a block in
groups of about ``group_rows``; each pair is one matrix product.  Only pivots and
the ring table (pivots x rings rows) are held by driver and tasks.

Components become floor(scale * x).  Vectors that are null or hold null or
non-finite components, and rows with a null id, take no part.  Each row is a vector
of its own: rows that share an id are all candidates, also of each other, and each a
query where the id is one.  Equal scores go to the smaller id.  Vectors of fewer
components count as padded with zeros.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carelake.llm.common import dropped, stored

#: Inner products up to here are exact in double precision.
EXACT = 2.0 ** 53


def clean(vectors: DataFrame, scale: int, vec_id: str, embedding: str) -> DataFrame:
    """(row, vec_id, v): whole-number vectors, with a number for each row."""
    x = F.col(embedding)
    usable = x.isNotNull() & F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")))
    whole = F.transform(x, lambda a: F.floor(a.cast("double") * F.lit(float(scale))).cast("long"))
    return (vectors.where(F.coalesce(usable, F.lit(False)) & F.col(vec_id).isNotNull())
            .select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v")))


def matrix(column, dim: int) -> np.ndarray:
    """Arrow lists as rows of ``dim`` doubles, padded with zeros."""
    sizes = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    flat = np.asarray(column.flatten(), dtype=np.float64)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0.0))
    return np.column_stack([x, rest])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact whole-number inner products."""
    most = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * a.shape[1]
    if most < EXACT:
        return np.rint(a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


class Rings:
    """The ring table: per ring its pivot, inner and outer distance, and number of blocks."""

    def __init__(self, pivots: np.ndarray, rows: list, longest: float) -> None:
        self.pivots, self.longest = pivots, longest
        self.pivot = np.array([r["pivot"] for r in rows], dtype=np.int64)
        self.ring = np.array([r["ring"] for r in rows], dtype=np.int64)
        self.inner = np.array([r["inner"] for r in rows])
        self.outer = np.array([r["outer"] for r in rows])
        self.blocks = np.array([r["blocks"] for r in rows], dtype=np.int64)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Per query and ring, the most that an inner product can be."""
        length = (q * q).sum(axis=1)
        d = distances(np.column_stack([q, np.zeros(len(q))]), self.pivots)[:, self.pivot]
        gap = np.maximum(np.maximum(self.inner[None, :] - d, d - self.outer[None, :]), 0.0)
        # Distances carry rounding errors far below a millionth of the largest one.
        slack = 1e-6 * (np.sqrt(self.longest) + np.sqrt(length)[:, None] + 1.0)
        gap = np.maximum(gap - slack, 0.0)
        return (length[:, None] + self.longest - gap * gap) / 2.0 + 1.0


def _ring_id(pivot: Column, ring: Column, block: Column) -> Column:
    return F.shiftleft(pivot.cast("long"), 48).bitwiseOR(F.shiftleft(ring.cast("long"), 32)).bitwiseOR(block.cast("long"))


def search(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, pivots: int = 32, rings: int = 16, sample: int = 2048,
           block_rows: int = 4096, group_rows: int = 1024, steps: tuple[int, ...] = (1, 8), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: per query the k best of all other rows.

    ``is_query``: a function of the id column.  ``sample``: rows (by a hash of the id) that the pivots are chosen from.
    """
    spark = vectors.sparkSession
    known = stored(clean(vectors, scale, vec_id, embedding), "vectors")
    length = F.aggregate("v", F.lit(0.0), lambda s, a: s + a.cast("double") * a.cast("double"))
    top = known.agg(F.max(F.size("v")).alias("dim"), F.max(length).alias("longest")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if top["dim"] is None:
        return spark.createDataFrame([], schema)
    dim, longest = max(1, top["dim"]), top["longest"]
    chosen = known.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).select("v").toArrow()
    pool = lifted(matrix(pa.chunked_array(chosen.column("v")).combine_chunks(), dim), longest)
    centres = _spread_out(pool, pivots)

    def keyed(batches):
        for b in batches:
            d = distances(lifted(matrix(b.column("v"), dim), longest), centres)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), b.column("v"), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])],
                                             names=["row", "vec_id", "v", "pivot", "distance"])

    placed = stored(known.mapInArrow(keyed, "row long, vec_id long, v array<bigint>, pivot int, distance double"), "placed")
    cuts = placed.groupBy("pivot").agg(F.percentile_approx("distance", [i / rings for i in range(1, rings)]).alias("cuts"))
    ringed = placed.join(F.broadcast(cuts), "pivot").withColumn(  # one row per pivot
        "ring", F.size(F.filter("cuts", lambda c: c < F.col("distance"))).cast("int")).drop("cuts")
    table = ringed.groupBy("pivot", "ring").agg(
        F.min("distance").alias("inner"), F.max("distance").alias("outer"), F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks")).collect()
    shape = Rings(centres, sorted(table, key=lambda r: (r["pivot"], r["ring"])), longest)
    sizes = spark.createDataFrame([(r["pivot"], r["ring"], r["blocks"]) for r in table], "pivot int, ring int, blocks long")  # pivots x rings rows
    block = _ring_id(F.col("pivot"), F.col("ring"), F.pmod(F.xxhash64("row"), F.col("blocks")))
    blocks = stored(ringed.join(F.broadcast(sizes), ["pivot", "ring"]).groupBy(block.alias("block")).agg(
        F.collect_list(F.struct("row", "vec_id", "v")).alias("members")).select("block", "members.row", "members.vec_id", "members.v"), "index")
    dropped(placed)

    state = stored(known.where(is_query(F.col("vec_id"))).select(
        F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.lit(None).cast("long").alias("floor"),
        F.array().cast("array<struct<score:bigint,vec_id:bigint>>").alias("found")), "queries")
    begin = 0
    for end in (*steps, len(shape.pivot)):
        state, begin = _round(state, blocks, shape, begin, end, k, dim, group_rows), max(begin, end)
    ranked = state.select("query_id", F.posexplode("found").alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def _spread_out(pool: np.ndarray, n: int) -> np.ndarray:
    """Pivots: the sample's means of groups around far-apart rows."""
    picked = pool[:1]
    near = distances(pool, picked)[:, 0]
    while len(picked) < min(n, len(pool)) and near.max() > 0:
        picked = np.vstack([picked, pool[near.argmax()]])
        near = np.minimum(near, distances(pool, picked[-1:])[:, 0])
    for _ in range(5):
        own = distances(pool, picked).argmin(axis=1)
        picked = np.array([pool[own == i].mean(axis=0) if (own == i).any() else p for i, p in enumerate(picked)])
    return picked


def _round(state: DataFrame, blocks: DataFrame, shape: Rings, begin: int, end: int, k: int, dim: int, group_rows: int) -> DataFrame:
    """The queries' best k after their rings number ``begin`` to ``end`` in the order of the bound."""
    def expand(batches):
        for b in batches:
            bounds = shape.bounds(matrix(b.column("q"), dim))
            floor = np.array([-np.inf if x is None else float(x) for x in b.column("floor").to_pylist()])
            order = np.argsort(-bounds, axis=1, kind="stable")[:, begin:end]
            reach = np.take_along_axis(bounds, order, axis=1) >= floor[:, None]
            row, col = np.nonzero(reach)
            ring = order[row, col]
            times = shape.blocks[ring]
            row, ring = np.repeat(row, times), np.repeat(ring, times)
            part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            block = shape.pivot[ring] << 48 | shape.ring[ring] << 32 | part
            for i in range(0, len(row), 1 << 14):
                yield pa.RecordBatch.from_arrays([b.column("query").take(pa.array(row[i:i + (1 << 14)])), b.column("q").take(pa.array(row[i:i + (1 << 14)])),
                                                  pa.array(block[i:i + (1 << 14)])], names=["query", "q", "block"])

    def compare(batches):
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                queries, rows, ids = (np.asarray(one.column(c).flatten()) for c in ("query", "row", "vec_id"))
                scores = products(matrix(one.column("q").flatten(), dim), matrix(one.column("v").flatten(), dim))
                out = []
                for q, own in zip(queries, scores):
                    others = np.flatnonzero(rows != q)
                    at = others[best(own[others], ids[others], k)]
                    out.append((np.full(len(at), q), ids[at], own[at]))
                q, v, s = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], names=["query", "vec_id", "score"])

    # About group_rows queries meet a block at once, however many there are.
    count = state.count()
    chunk = F.pmod(F.xxhash64("query"), F.lit(max(1, -(-count // group_rows))))
    asked = state.select("query", "q", "floor").mapInArrow(expand, "query long, q array<bigint>, block long")
    groups = stored(asked.groupBy("block", chunk.alias("chunk")).agg(F.collect_list(F.struct("query", "q")).alias("x")).select("block", "x.query", "x.q"), "asked")
    hits = groups.join(blocks, "block").select("query", "q", "row", "vec_id", "v").mapInArrow(compare, "query long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = (hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
           .groupBy("query").agg(F.collect_list(F.struct("score", "vec_id")).alias("new")))
    merged = F.slice(F.array_sort(F.concat("found", F.coalesce("new", F.array().cast("array<struct<score:bigint,vec_id:bigint>>"))),
                                  lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1))
                                  .when(a["vec_id"] < b["vec_id"], -1).when(a["vec_id"] > b["vec_id"], 1).otherwise(0)), 1, k)
    joined = state.drop("floor").join(top, "query", "left").select("query", "query_id", "q", merged.alias("found"))
    out = stored(joined.withColumn("floor", F.when(F.size("found") >= k, F.element_at("found", k)["score"])), "queries")
    dropped(groups, state)
    return out
