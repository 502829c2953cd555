"""Substring dedup by level-wise doubling.

The question is which windows of ``words`` words occur again.  It is asked for
short windows first: at each length of a ladder (5, 10, 20 for 20 words) every
long window still in play is represented by the short window of least hash that
it holds; equal long windows have equal representatives.  Where a representative
occurs once in the corpus, its long windows are out; the others alone are
extended to twice the length, until the full length is reached or no candidate
survives.  Only about one window in nine is a representative at the first level,
so the first shuffle is a fraction of the corpus.

At the full length each document sends each hash once; the smallest doc_id of a
hash, found by partial aggregation, is where it stays.  A document removes its
words under windows that a smaller doc_id holds or that started earlier in itself.

A document's windows are the unit that meets in one task, never a passage's
copies: the semi join on hashes has written tables on both sides, so AQE can
split a hot passage.  A null or empty text has no words; rows with the same id
are each judged against smaller ids and against themselves; a row with a null id
keeps all its words and makes none go.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import WordHashes, Windows, dropped, of_documents, steps, stored, texts_of, words_of


def ladder(words: int, least: int = 5) -> list[int]:
    """Lengths that double up to ``words``, the first at least ``least``."""
    lengths = [words]
    while lengths[0] // 2 >= least:
        lengths.insert(0, -(-lengths[0] // 2))
    return lengths


def runs_of(hashes: np.ndarray, length: int, words: int, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Representatives' hashes with the runs (start, n) of long windows they stand for, of those in ``live`` (sorted starts)."""
    span = words - length + 1
    least = np.lib.stride_tricks.sliding_window_view(hashes, span).argmin(axis=1)[live] + live
    new = np.ones(len(live), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (live[1:] != live[:-1] + 1)
    at = np.flatnonzero(new)
    return hashes[least[at]], live[at], np.diff(np.concatenate([at, [len(live)]]))


class Runs:
    """The runs of each row of a batch, without a Python object per run."""

    def __init__(self, column: pa.ListArray) -> None:
        self.cuts = np.asarray(column.offsets).tolist()
        values = column.values
        self.start, self.n = (np.asarray(values.field(c), dtype=np.int64) for c in ("start", "n"))

    def starts(self, k: int) -> np.ndarray:
        """Sorted starts of all windows in row ``k``'s runs; none where it has no runs."""
        a, b = self.cuts[k], self.cuts[k + 1]
        start, n = self.start[a:b], self.n[a:b]
        if a == b:
            return start
        order = np.argsort(start, kind="stable")
        start, n = start[order], n[order]
        out = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return out if (np.diff(out) > 0).all() else np.unique(out)  # rows with one id share their runs


def _level(docs: DataFrame, length: int, words: int) -> DataFrame:
    """(hash, doc_id, start, n) of the representatives of windows in play; ``docs`` has ``runs`` after the first level."""
    known = "runs" in docs.columns

    def run(batches):
        words_hash, windows = WordHashes(), Windows()
        for batch in steps(batches):
            ids = batch.column("doc_id").to_pylist()
            live = Runs(batch.column("runs")) if known else None
            out: list[tuple] = []
            for k, text in enumerate(texts_of(batch)):
                tokens = words_of(text)
                count = len(tokens) - words + 1
                if count < 1:
                    continue
                starts = np.arange(count) if live is None else live.starts(k)
                starts = starts[starts < count]  # of another row with this id
                if len(starts):
                    h, s, n = runs_of(windows.of(words_hash.of(tokens), length), length, words, starts)
                    out.append((h, np.full(len(h), ids[k], dtype=np.int64), s, n))
            if out:
                h, d, s, n = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(d), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))],
                                                 names=["hash", "doc_id", "start", "n"])

    return docs.mapInArrow(run, "hash long, doc_id long, start int, n int")


def _full(docs: DataFrame, words: int) -> DataFrame:
    """(hash, doc_id) of each document's full windows in play, each hash once."""
    def run(batches):
        words_hash, windows = WordHashes(), Windows()
        for batch in steps(batches):
            ids, live = batch.column("doc_id").to_pylist(), Runs(batch.column("runs"))
            out = []
            for k, text in enumerate(texts_of(batch)):
                all_of = windows.of(words_hash.of(words_of(text)), words)
                starts = live.starts(k)
                own = np.unique(all_of[starts[starts < len(all_of)]])
                out.append((own, np.full(len(own), ids[k], dtype=np.int64)))
            h, d = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(d)], names=["hash", "doc_id"])

    return docs.mapInArrow(run, "hash long, doc_id long")


def removed_mask(tokens: int, starts: np.ndarray, words: int) -> np.ndarray:
    """Words under windows that begin at ``starts``."""
    edge = np.zeros(tokens + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + words, -1)
    return np.cumsum(edge)[:tokens] > 0


def deduplicated(docs: DataFrame, words: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (its other words, joined by one space)."""
    read = of_documents(docs, doc_id, text)
    named = read.where("doc_id IS NOT NULL")
    live = None
    for length in ladder(words)[:-1] or [words]:
        tables = [] if live is None else [live]
        source = named if live is None else named.join(live, "doc_id")
        marks = stored(_level(source, length, words), "marks")
        again = stored(marks.groupBy("hash").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("hash"), "again")
        kept = marks.join(again, "hash", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
        live = stored(kept, "runs")
        dropped(marks, again, *tables)
        if live.isEmpty():
            break
    places = _full(named.join(live, "doc_id"), words).groupBy("hash").agg(F.min("doc_id").alias("doc_id"))
    firsts = stored(places.groupBy("doc_id").agg(F.collect_list("hash").alias("firsts")), "firsts")
    return _cut(read.join(live, "doc_id", "left").join(firsts, "doc_id", "left"), words)


def _cut(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        words_hash, windows = WordHashes(), Windows()
        for batch in steps(batches):
            live, firsts = Runs(batch.column("runs")), batch.column("firsts")
            cuts, first_hashes = np.asarray(firsts.offsets).tolist(), np.asarray(firsts.values, dtype=np.int64).view(np.uint64)
            n_words, n_removed, kept = [], [], []
            for k, text in enumerate(texts_of(batch)):
                tokens = words_of(text)
                gone = 0
                starts = live.starts(k)
                starts = starts[starts <= len(tokens) - words]
                if len(starts):
                    hashes = windows.of(words_hash.of(tokens), words)[starts]
                    own = first_hashes[cuts[k]:cuts[k + 1]]
                    stays = np.zeros(len(hashes), dtype=bool)
                    stays[np.unique(hashes, return_index=True)[1]] = True  # the earliest here
                    mask = removed_mask(len(tokens), starts[~(stays & np.isin(hashes, own))], words)
                    gone = int(mask.sum())
                    if gone:
                        rest = [t for t, m in zip(tokens, mask.tolist()) if not m]
                n_words.append(len(tokens))
                n_removed.append(gone)
                kept.append(b" ".join(rest if gone else tokens).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                                             names=["doc_id", "n_words", "n_removed", "kept"])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
