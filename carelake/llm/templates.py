"""Benchmark decontamination by template canonicalisation.

Words become templates: numbers, names (capitalised words inside a sentence) and
units (after a number) turn into typed placeholders, other words lose case and
outer punctuation.  Windows of ``width`` template words of documents and benchmark
items are hash-joined; each window carries its slots' values.  An item leaks into
a document in one of two ways:

* ``verbatim``: enough of its windows are there with equal slots, or enough of its
  windows of plain words (without case, of any kind, also where most are slots);
* ``reparameterised``: along one alignment of item and document enough windows are
  there that agree on one value of the document for each value of the item: the
  one it stands for most often.  Windows with another value don't count.  No two
  values of the item may stand for the same one of the document.

Enough is ``coverage`` of the item's windows, or a run's worth of ``run`` words.
Items with fewer words than a window count as one window of their own length.  As
templates, texts under ``least`` words and windows that are mostly slots say too
little and are left out on both sides; as plain words, none are.

Documents send on only windows whose hash is in the benchmark. Up to
``most_hashes`` hashes (8 bytes each) those are known to each task from a
broadcast; a larger benchmark meets all windows of the documents in a shuffled
join, with the same result.  A hot passage is many rows of one hash, which AQE
splits in the join, and ends in groups of one document and item.

Null or empty texts and null ids leak nothing; rows with the same id count as one
document or item, equal rows once.  A very long text is read whole, in one task.  Other
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import CACHE_ENTRIES, Windows, mixed, of_documents, steps, stored, texts_of

#: Words that are units after a number.
UNITS = frozenset("""
    % percent km m cm mm mile miles meter meters metre metres foot feet ft inch inches yard yards
    kg g mg lb lbs oz pound pounds gram grams kilogram kilograms ton tons
    s sec second seconds min minute minutes h hour hours day days week weeks month months year years
    l ml liter liters litre litres gallon gallons cup cups
    dollar dollars cent cents euro euros usd eur mph kmh degree degrees
""".split())
_CORE = re.compile(r"^[\W_]+|[\W_]+$")
_ENDS = re.compile(r"[.!?:][\"'”’)\]]*$")
PLAIN, NUMBER, NAME, UNIT = range(4)
_LINE = "\x00"


class Lexicon(dict):
    """Word to a place in two arrays, its hash and its marks; new words are learnt as they come."""

    MARKS = NUMERIC, CAPITAL, IS_UNIT, ENDING, BREAK = 1, 2, 4, 8, 16

    def __init__(self) -> None:
        super().__init__()
        self.slots = np.array([xxhash.xxh64_intdigest(x) for x in (b"", b"<number>", b"<name>", b"<unit>")], dtype=np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.size, self.hashes, self.marks = 0, np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint8)
        self.new: tuple[list[int], list[int]] = ([], [])

    def __missing__(self, word: str) -> int:
        plain = word.isalnum()
        core = word if plain else _CORE.sub("", word) or word
        low, first = core.lower(), core[0]
        marks = self.NUMERIC if first.isdigit() else self.CAPITAL if first.isupper() and len(core) > 1 else 0
        if low in UNITS:
            marks |= self.IS_UNIT
        if not plain:
            if word == _LINE:
                marks |= self.ENDING | self.BREAK
            elif _ENDS.search(word):
                marks |= self.ENDING
        self.new[0].append(xxhash.xxh64_intdigest(low.encode()))
        self.new[1].append(marks)
        at = self[word] = len(self)
        return at

    def _learn(self) -> None:
        count = len(self.new[0])
        while self.size + count > len(self.hashes):
            self.hashes, self.marks = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hashes, self.marks))
        self.hashes[self.size:self.size + count], self.marks[self.size:self.size + count] = self.new
        self.size, self.new = self.size + count, ([], [])

    def read(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words, places of those that are no line break, the hash of each one's template, its kind, and the hash of the plain word."""
        if len(self) > CACHE_ENTRIES:
            self._forget()
        words = text.replace(_LINE, " ").replace("\n", f" {_LINE} ").split()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new[0]:
            self._learn()
        hashes, marks = self.hashes[at], self.marks[at]
        first, after = np.ones(len(words), dtype=bool), np.zeros(len(words), dtype=bool)
        first[1:] = marks[:-1] & self.ENDING
        after[1:] = marks[:-1] & self.NUMERIC
        kind = np.where(marks & self.NUMERIC, NUMBER, np.where((marks & self.IS_UNIT).astype(bool) & after, UNIT,
                                                              np.where((marks & self.CAPITAL).astype(bool) & ~first, NAME, PLAIN)))
        shown = np.flatnonzero((marks & self.BREAK) == 0)
        kind = kind[shown]
        return words, shown, np.where(kind == PLAIN, hashes[shown], self.slots[kind]), kind, hashes[shown]


#: Part of the hash of plain windows, so that they never meet windows of templates.
_PLAIN_MARK = np.uint64(1 << 32)


def windows_of(windows: Windows, read: tuple, width: int, least: int, short: bool):
    """Template windows that say enough: hashes, starts, and a function to a window's slots; then the width, and hashes of all plain windows.

    ``read``: a text read by the lexicon.  ``short``: a text under ``width`` words is one window of its own length; the plain one may have under ``least``.
    """
    words, shown, hashes, kinds, plain = read
    if short and 0 < len(shown) < width:
        width = len(shown)
    found = windows.of(hashes, width) if width >= least else hashes[:0]
    filled = np.cumsum(np.concatenate([[0], kinds != PLAIN]))
    at = np.flatnonzero(2 * (filled[width:] - filled[:-width]) <= width) if len(found) else np.zeros(0, np.int64)

    def slots(start: int) -> list[str]:
        values = [(kinds[i], words[shown[i]]) for i in range(start, start + width) if kinds[i] != PLAIN]
        return [f"{kind}:{_CORE.sub('', word) or word}" for kind, word in values]

    # The length is part of the hash, so that windows of several lengths can share a table.
    return mixed(found[at] ^ np.uint64(width)), at, slots, width, mixed(windows.of(plain, width) ^ np.uint64(width) ^ _PLAIN_MARK)


def _no_slots(start: int) -> list[str]:
    return []


def _every(hashes: np.ndarray, at: np.ndarray, slots) -> list[tuple[int, int, list[str]]]:
    """(hash, start, slots) at every start."""
    return [(h, start, slots(start)) for h, start in zip(hashes.view(np.int64).tolist(), at.tolist())]


def _first_of(hashes: np.ndarray, at: np.ndarray, slots) -> list[tuple[int, int, list[str]]]:
    """(hash, start, slots), each pair of hash and slots once, where it is first."""
    seen, out = set(), []
    for h, start in zip(hashes.view(np.int64).tolist(), at.tolist()):
        values = slots(start)
        if (key := (h, *values)) not in seen:
            seen.add(key)
            out.append((h, start, values))
    return out


def item_windows(items: DataFrame, width: int, least: int) -> DataFrame:
    """(item_id, hash, item_at, item_slots, length, plain) of benchmark items; ``plain``: a window of words as they are, without slots."""
    def run(batches):
        lexicon, windows = Lexicon(), Windows()
        for batch in steps(batches):
            rows = []
            for item, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                hashes, at, slots, length, plain = windows_of(windows, lexicon.read(text), width, least, True)
                rows += [(item, h, start, values, length, False) for h, start, values in _first_of(hashes, at, slots)]
                rows += [(item, h, start, values, length, True) for h, start, values in _first_of(plain, np.arange(len(plain)), _no_slots)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.bool_()))],
                names=["item_id", "hash", "item_at", "item_slots", "length", "plain"])

    return items.mapInArrow(run, "item_id long, hash long, item_at int, item_slots array<string>, length int, plain boolean")


def document_windows(docs: DataFrame, width: int, lengths: list[int], least: int, known=None) -> DataFrame:
    """(doc_id, hash, at, slots) of documents' windows of the given lengths; ``known``: a broadcast of the only hashes wanted, sorted."""
    def run(batches):
        lexicon, windows = Lexicon(), Windows()
        for batch in steps(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                read = lexicon.read(text)
                for length in lengths:
                    hashes, at, slots, _, plain = windows_of(windows, read, length, least, False)
                    for found, starts, values_of in ((hashes, at, slots), (plain, np.arange(len(plain)), _no_slots)):
                        if known is not None and len(found):
                            values = known.value
                            place = np.minimum(np.searchsorted(values, found), len(values) - 1)
                            there = values[place] == found
                            found, starts = found[there], starts[there]
                        rows += [(doc, *r) for r in _every(found, starts, values_of)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string())))],
                names=["doc_id", "hash", "at", "slots"])

    return docs.mapInArrow(run, "doc_id long, hash long, at int, slots array<string>")


def _longest_run(starts: list[int]) -> int:
    """Most consecutive numbers among ``starts``."""
    at = np.unique(np.array(starts, dtype=np.int64))
    ends = np.flatnonzero(np.append(np.diff(at) != 1, True))
    return int(np.diff(np.concatenate([[-1], ends])).max()) if len(at) else 0


def agreeing(aligned: DataFrame) -> DataFrame:
    """(doc_id, item_id, n, run, changed): how many windows of an alignment agree with what each item value mostly stands for (ties:
    the smallest), how many of them follow each other at most, and how many values differ."""
    def run(batches):
        for batch in batches:
            counts, runs, changes = [], [], []
            for windows in batch.column("windows").to_pylist():
                seen = [(w["item_at"], [(p["item_slots"], p["slots"]) for p in w["pairs"]]) for w in windows]
                chosen: dict[str, str] = {}
                for (value, other), _ in sorted(Counter(p for _, w in seen for p in w).items(), key=lambda x: (-x[1], x[0])):
                    chosen.setdefault(value, other)
                kept = [(at, w) for at, w in seen if all(chosen[value] == other for value, other in w)]
                counts.append(len(kept))
                runs.append(_longest_run([at for at, _ in kept]))
                changes.append(len({p for _, w in kept for p in w if p[0] != p[1]}))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "item_id")], *(pa.array(x, pa.int64()) for x in (counts, runs, changes))],
                names=["doc_id", "item_id", "n", "run", "changed"])

    return aligned.mapInArrow(run, "doc_id long, item_id long, n long, run long, changed long")


def _runs(met: DataFrame, n: str, run: str) -> DataFrame:
    """(doc_id, item_id, n, run): how many windows of the item occur, and how many of them follow each other in both texts at most."""
    step = F.aggregate(
        F.array_sort(F.collect_set("item_at")), F.struct(F.lit(-2).alias("last"), F.lit(0).alias("length"), F.lit(0).alias("best")),
        lambda a, x: F.struct(x.alias("last"), F.when(x == a["last"] + 1, a["length"] + 1).otherwise(1).alias("length"),
                              F.greatest(a["best"], F.when(x == a["last"] + 1, a["length"] + 1).otherwise(1)).alias("best")), lambda a: a["best"])
    longest = met.groupBy("doc_id", "item_id", "shift").agg(step.alias("best")).groupBy("doc_id", "item_id").agg(F.max("best").cast("long").alias(run))
    held = met.select("doc_id", "item_id", "item_at").distinct().groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias(n))
    return held.join(longest, ["doc_id", "item_id"])


def leaks(docs: DataFrame, items: DataFrame, width: int = 8, least: int = 4, coverage: float = 0.5, run: int = 13,
          most_hashes: int = 2_000_000, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row per document and item that leaks: doc_id, item_id, n_windows, n_same, n_consistent, changed_slots, kind."""
    # Rows that repeat an id count as one text.
    wanted = stored(item_windows(of_documents(items, item_id, text).where("doc_id IS NOT NULL"), width, least).distinct(), "item-windows")
    lengths = sorted(r["length"] for r in wanted.select("length").distinct().collect())  # at most ``width`` rows
    distinct = wanted.select("hash").distinct()
    known = None
    if distinct.count() <= most_hashes:
        hashes = np.sort(np.array([r["hash"] for r in distinct.collect()], dtype=np.int64).view(np.uint64))
        known = docs.sparkSession.sparkContext.broadcast(hashes) if len(hashes) else None
    named = of_documents(docs, doc_id, text).where("doc_id IS NOT NULL")
    found = stored(document_windows(named, width, lengths, least, known).distinct(), "document-windows")
    template = F.when(~F.col("plain"), 1)
    sizes = wanted.groupBy("item_id").agg(F.count(template).alias("n_templates"), F.count(F.when(F.col("plain"), 1)).alias("n_plain"), F.max("length").alias("length"))
    met = found.join(wanted.drop("length"), "hash").select(
        "doc_id", "item_id", "plain", "item_at", (F.col("at") - F.col("item_at")).alias("shift"), (F.col("slots") == F.col("item_slots")).alias("same"),
        F.arrays_zip("item_slots", "slots").alias("pairs"))
    met = stored(met, "met-windows")
    aligned = met.where(~F.col("plain")).groupBy("doc_id", "item_id", "shift").agg(F.collect_list(F.struct("item_at", "pairs")).alias("windows"))
    best = agreeing(aligned).groupBy("doc_id", "item_id").agg(
        F.max("n").alias("n_consistent"), F.max("run").alias("run_consistent"), F.max(F.struct("n", "changed")).alias("chosen"))
    keys = ["doc_id", "item_id"]
    counted = [f"{c}_{x}" for x in ("same", "words", "consistent") for c in ("n", "run")]
    judged = (best.join(_runs(met.where(~F.col("plain") & F.col("same")), "n_same", "run_same"), keys, "full")
              .join(_runs(met.where("plain"), "n_words", "run_words"), keys, "full").na.fill(0, counted).join(sizes, "item_id"))
    enough = lambda x, of: (F.col(f"n_{x}") > 0) & ((F.col(f"n_{x}") >= coverage * F.col(of)) | (F.col(f"run_{x}") + F.col("length") - 1 >= run))
    verbatim = enough("same", "n_templates") | enough("words", "n_plain")
    return (judged.where(verbatim | enough("consistent", "n_templates"))
            .select("doc_id", "item_id", F.greatest("n_templates", "n_plain").alias("n_windows"), F.greatest("n_same", "n_words").alias("n_same"), "n_consistent",
                    F.when(verbatim, F.lit(0)).otherwise(F.col("chosen.changed")).cast("long").alias("changed_slots"),
                    F.when(verbatim, "verbatim").otherwise("reparameterised").alias("kind")))
