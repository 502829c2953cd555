"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled text. A
text is compressed block by block under both; the difference of its two
compressed sizes, per byte of text and per compressed byte, becomes a score by a
logistic calibration on labelled rows that built neither dictionary.

Learning takes a sample of ``sample_rows`` labelled rows per class and purpose
(dictionary, calibration), the first by a hash of doc_id, of at most ``longest``
characters each: that bounds what the driver holds.  Scoring covers every whole
text.  An empty or null text has difference 0 and so the calibrated score of
that.  Repeated rows score alike; of several labels of one id the smallest
counts; null ids and null labels teach nothing.  If either class has no learning
row, every score is the smoothed share of label 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.llm.common import append_columns


@dataclass(frozen=True)
class CompressionModel:
    good: bytes | None
    bad: bytes | None
    weights: tuple[float, float, float]  # intercept, per byte, per compressed byte
    block: int
    level: int


class Sizes:
    """Differences of compressed sizes (good minus bad) of whole texts."""

    def __init__(self, model: CompressionModel) -> None:
        self.block, self.pair = model.block, []
        for raw in (model.good, model.bad):
            dictionary = zstandard.ZstdCompressionDict(raw)
            dictionary.precompute_compress(level=model.level)
            self.pair.append(zstandard.ZstdCompressor(
                level=model.level, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False))

    def of(self, text: str) -> tuple[float, float]:
        raw = text.encode()
        if not raw:
            return 0.0, 0.0
        blocks = [raw[i:i + self.block] for i in range(0, len(raw), self.block)]
        good, bad = (sum(len(c.compress(b)) for b in blocks) for c in self.pair)
        return (good - bad) / len(raw), (good - bad) / (good + bad)


def probability(weights, x) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64).reshape(-1, 2)
    return 1.0 / (1.0 + np.exp(-np.clip(weights[0] + x @ np.asarray(weights[1:]), -500, 500)))


def _calibrated(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float, float]:
    """Weighted logistic regression by Newton steps; the classes weigh as they are frequent among all labels."""
    w = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    a = np.column_stack([np.ones(len(y)), x / scale])
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        hessian = (a * (w * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(3)
        step = np.linalg.solve(hessian, a.T @ (w * (y - p)) - 1e-2 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1] / scale[0]), float(beta[2] / scale[1])


def fit(docs: DataFrame, labels: DataFrame, learn=None, sample_rows: int = 1500, longest: int = 20_000,
        dictionary_bytes: int = 112 << 10, block: int = 512, level: int = 3) -> CompressionModel:
    """``labels``: doc_id, quality.  ``learn``: which doc_ids may teach, a function of the id column."""
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    if learn is not None:
        known = known.where(learn(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    chosen = []
    for quality in (0, 1):
        rows = known.where(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample_rows).collect()
        chosen += [(r["doc_id"], quality, k % 2) for k, r in enumerate(rows)]
    texts: dict[tuple[int, int], list[bytes]] = {(q, part): [] for q in (0, 1) for part in (0, 1)}
    if chosen:
        sample = spark.createDataFrame(chosen, "doc_id long, quality int, part int")  # at most 4 * sample_rows rows
        found = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
                 .where(F.length("text").between(1, longest)).join(F.broadcast(sample), "doc_id")
                 .groupBy("doc_id", "quality", "part").agg(F.min("text").alias("text")))
        for r in sorted(found.collect(), key=lambda r: r["doc_id"]):
            texts[r["quality"], r["part"]].append(r["text"].encode())
    if not all(texts[q, part] for q in (0, 1) for part in (0, 1)):
        return CompressionModel(None, None, (float(np.log(prior / (1 - prior))), 0.0, 0.0), block, level)
    good, bad = (_dictionary(texts[q, 0], dictionary_bytes, block) for q in (1, 0))
    model = CompressionModel(good, bad, (0.0, 0.0, 0.0), block, level)
    sizes = Sizes(model)
    x = np.array([sizes.of(t.decode()) for q in (0, 1) for t in texts[q, 1]])
    y = np.array([q for q in (0, 1) for _ in texts[q, 1]])
    return CompressionModel(good, bad, _calibrated(x, y, prior), block, level)


def _dictionary(texts: list[bytes], size: int, block: int) -> bytes:
    blocks = [t[i:i + block] for t in texts for i in range(0, len(t), block)]
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: all of it serves as it is
        return b"".join(texts)[:size]


def with_score(docs: DataFrame, model: CompressionModel, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1, higher where label 1 is likelier; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size

    def make():
        sizes = Sizes(shared.value) if shared.value.good is not None else None

        def run(texts):
            x = [sizes.of(t) if sizes else (0.0, 0.0) for t in texts]
            return [probability(shared.value.weights, x).tolist()]

        return run

    return append_columns(docs, [T.StructField(name, T.DoubleType())], make, text)
