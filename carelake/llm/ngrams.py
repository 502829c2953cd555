"""Quality rules: base rules and a hashed n-gram classifier.

Base rules judge counts of the whole text.  The classifier is a logistic regression
over hashed n-grams of words (1 and 2) and of characters (UTF-8 bytes, 3 to 5, within
the lower-cased text), each kind with its own half of ``dims`` weights.  A feature is
the share of a text's n-grams of that kind that fall into a bucket, so a text is scored
by the mean weight of its n-grams, in one pass over its bytes, in Arrow batches.  A
second logistic regression over the raw score, on rows that taught no weights, turns it
into a probability (Platt scaling), which is held against a fixed threshold.

Learning takes at most ``sample_rows`` labelled rows per class, the first by a hash
of doc_id, four of five for the weights and one for the calibration; they are hashed
inside tasks, and the driver gets at most ``dims`` numbers for each.  Scoring covers every
row and every whole text; a long text is hashed piece by piece.

A null or empty text has no n-grams and scores the calibrated value of 0; it fails the
base rules.  Repeated rows are judged alike; of several labels of one id the smallest
counts; null ids and null labels teach nothing.  If either class has no learning row,
every score is the smoothed share of label 1.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import WordHashes, of_documents, steps, texts_of

WORD_RUNS = (1, 2)
BYTE_RUNS = (3, 4, 5)
#: Bytes (and words) hashed at once.
PIECE = 1 << 20
_SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Odd multipliers of the hashes.
_UP = np.uint64(0x9E3779B97F4A7C15)
_BYTE = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    raw = text.encode()
    words = raw.split()
    chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
    seen, again = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip():
            seen.add(line)
    return len(words), chars, len(_SYMBOLS.findall(text)), again, repeated_words(words)


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words inside windows of words that occur twice or more in the text."""
    if len(words) < window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    keys = ids[: len(ids) - window + 1]
    for k in range(1, window):  # numbered anew at each step, so that no product overflows
        keys = np.unique(keys, return_inverse=True)[1] * len(number) + ids[k:len(ids) - window + 1 + k]
    _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
    starts = np.concatenate([(n[back] > 1).astype(np.int64), np.zeros(window - 1, np.int64)])
    return int((np.convolve(starts, np.ones(window, np.int64))[: len(words)] > 0).sum())


class Hasher:
    """Buckets of the n-grams of texts: words in the first half of ``dims``, bytes in the second."""

    def __init__(self, dims: int) -> None:
        self.shift = np.uint64(64 - (dims // 2).bit_length() + 1)
        self.half, self.words = dims // 2, WordHashes()

    def _runs(self, values: np.ndarray, lengths: tuple[int, ...]):
        hashes = values
        with np.errstate(over="ignore"):
            for n in range(1, lengths[-1] + 1):
                if n > 1:
                    if len(hashes) < 2:
                        return
                    hashes = (hashes[:-1] * _UP) ^ values[n - 1:]
                if n in lengths:
                    yield ((hashes * _UP) >> self.shift).astype(np.int64)

    def buckets(self, text: str):
        """(kind, buckets): kind 0 for words, 1 for bytes; in pieces that overlap so far that each n-gram comes once."""
        raw = text.encode().lower()
        for kind, all_values, lengths in ((0, raw.split(), WORD_RUNS), (1, raw, BYTE_RUNS)):
            for at in range(0, len(all_values), PIECE):
                part = all_values[at:at + PIECE + lengths[-1] - 1]
                values = self.words.of(part) if kind == 0 else _BYTE[np.frombuffer(part, np.uint8)]
                # n-grams that start in the overlap belong to the next piece.
                for found in self._runs(values, lengths):
                    yield kind, found[:PIECE] + kind * self.half

    def sums(self, text: str, weights: np.ndarray) -> float:
        """Mean weight of the word n-grams plus that of the byte n-grams."""
        total, n = [0.0, 0.0], [0, 0]
        for kind, found in self.buckets(text):
            total[kind] += float(weights[found].sum())
            n[kind] += len(found)
        return sum(t / m for t, m in zip(total, n) if m)

    def shares(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of a text and their shares of its n-grams of the same kind."""
        counts = np.zeros(2 * self.half)
        for _, found in self.buckets(text):
            counts += np.bincount(found, minlength=len(counts))
        for half in (counts[: self.half], counts[self.half:]):
            half /= max(1.0, half.sum())
        at = np.flatnonzero(counts)
        return at, counts[at]


@dataclass(frozen=True)
class Classifier:
    weights: np.ndarray | None
    intercept: float  # of the calibration
    slope: float
    dims: int

    def probability(self, raw) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.intercept + self.slope * np.asarray(raw, dtype=np.float64), -500, 500)))


def _weights(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dims: int, decay: float, rounds: int) -> np.ndarray:
    """Logistic regression, both classes of equal weight, by Nesterov steps on features scaled by their spread."""
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(at) for at, _ in rows])
    at, x = np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows])
    mean = np.bincount(at, x, dims) / len(rows)
    scale = (1.0 / np.sqrt(mean + 1.0 / dims)).astype(np.float32)
    scale /= np.sqrt(np.bincount(row, (x * scale[at]) ** 2, len(rows)).mean())
    x = x * scale[at]
    norm = np.bincount(row, x * x, len(rows)).max()
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, ahead, bias, bias_ahead, step = np.zeros(dims), np.zeros(dims), 0.0, 0.0, 4.0 / (norm + 1.0)
    for k in range(rounds):
        error = share * (1 / (1 + np.exp(-np.clip(np.bincount(row, x * ahead.astype(np.float32)[at], len(rows)) + bias_ahead, -30, 30))) - y)
        new = ahead - step * (np.bincount(at, x * error.astype(np.float32)[row], dims) + decay * ahead)
        new_bias = bias_ahead - step * error.sum()
        momentum = k / (k + 3)
        ahead, bias_ahead = new + momentum * (new - w), new_bias + momentum * (new_bias - bias)
        w, bias = new, new_bias
    return w * scale


def _calibrated(raw: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Platt scaling by Newton steps; the classes weigh as they are frequent among all labels."""
    w = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
    scale = max(float(np.abs(raw).max()), 1e-12)
    a, beta = np.column_stack([np.ones(len(y)), raw / scale]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2), a.T @ (w * (y - p)) - 1e-2 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1] / scale)


def fit(docs: DataFrame, labels: DataFrame, learn: Callable[[Column], Column] | None = None, sample_rows: int = 1000,
        dims: int = 1 << 14, decay: float = 1e-5, rounds: int = 120) -> Classifier:
    """``labels``: doc_id, quality (0 or 1).  ``learn``: which doc_ids may teach, a function of the id column."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    if learn is not None:
        known = known.where(learn(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    chosen = []
    for quality in (0, 1):
        rows = known.where(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).collect()
        chosen += [(r["doc_id"], quality, k % 5 == 0) for k, r in enumerate(rows)]
    found = []
    if chosen:
        sample = docs.sparkSession.createDataFrame(chosen, "doc_id long, quality int, held boolean")  # at most 2 * sample_rows rows
        texts = of_documents(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality", "held").agg(F.min("text").alias("text"))

        def run(batches):
            hasher = Hasher(dims)
            for batch in steps(batches):
                made = [hasher.shares(t) for t in texts_of(batch)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("doc_id", "quality", "held")),
                     pa.array([a.astype(np.int32).tobytes() for a, _ in made], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in made], pa.binary())],
                    names=["doc_id", "quality", "held", "at", "x"])

        found = texts.mapInArrow(run, "doc_id long, quality int, held boolean, at binary, x binary").toArrow().to_pylist()
        found = [r for r in sorted(found, key=lambda r: r["doc_id"]) if r["at"]]
    rows = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32)) for r in found]
    y, held = np.array([r["quality"] for r in found]), np.array([r["held"] for r in found], dtype=bool)
    if not all(((y == q) & (held == h)).any() for q in (0, 1) for h in (True, False)):
        return Classifier(None, float(np.log(prior / (1 - prior))), 0.0, dims)
    weights = _weights([r for r, h in zip(rows, held) if not h], y[~held], dims, decay, rounds)
    raw = np.array([float((x * weights[at]).sum()) for (at, x), h in zip(rows, held) if h])
    return Classifier(weights, *_calibrated(raw, y[held], prior), dims)


#: Base rules: fewer words, or a larger share of repeated words, fail.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50


def judge(docs: DataFrame, model: Classifier, threshold: float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score of every row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ``dims`` weights
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"]

    def run(batches):
        model = shared.value
        hasher = Hasher(model.dims)
        for batch in steps(batches):
            texts = texts_of(batch)
            counts = [base_counts(t) for t in texts]
            raw = [0.0 if model.weights is None else hasher.sums(t, model.weights) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(5)),
                                              pa.array(model.probability(raw))], names=names)

    made = of_documents(docs, doc_id, text).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names[1:-1]) + ", score double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return made.select(*names[:-1], failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"), "score")
