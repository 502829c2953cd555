"""SimHash near-duplicates through Golay-code fuzzy hashing.

A document's fingerprint is the bitwise majority of its shingles' 64-bit hashes.
Fingerprints link at 4 or fewer differing bits.  Bits 0-22 are segment A, bits
23-45 segment B, bits 46-63 segment C.  A segment's Golay keys meet those of any
segment up to 2 bits away (``golay``).  By the pigeonhole principle, 4 errors
leave at least one of these keys in common:

* at most 2 errors in each segment: Golay keys of A and of B with one of the
  three 6-bit parts of C, since 2 errors leave one part as it was;
* 3 or 4 errors in one segment, so at most 1 in the others: one of these two
  exactly, with the Golay keys of the other.

Distinct fingerprints are dealt by key and sorted; a task walks through its
buckets and verifies with a bit count.  From each bucket come star edges of its
links' components, never all pairs, so that a large group of near copies yields
as many edges as members.  A key has 30 bits or more: a bucket holds 8 bytes per
distinct fingerprint that shares them.  Edges are joined up by ``components``.

A null or empty text has fingerprint zero and links like any other.  Repeated
rows share a component.  A row with a null id links nothing by itself and gets
the component of its fingerprint (null if no row with an id has the same one).
Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.llm import golay
from carelake.llm.common import append_columns, dropped, of_documents, stored
from carelake.llm.components import components

SEED = 42  # Fixed value.
DISTANCE = 4
#: Fingerprints whose keys are made at once, and members of a bucket compared with the rest at once.
KEYED, COMPARED = 4096, 256
#: Buckets up to this size are compared together, larger ones one by one.
SMALL = 48


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words (of all words, if fewer)."""
    words = text.encode().lower().split()  # bytes: only A-Z change
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    ends = (ends - 1).tolist()
    width = min(width, len(words))
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1:])], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is in over half of the hashes."""
    if not len(hashes):
        return 0
    count = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i:i + (1 << 16)]).astype("<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, width: int = 4, text: str = "text", name: str = "print") -> DataFrame:
    """``docs`` with the fingerprint as a signed long; nothing is shuffled."""
    def make():
        return lambda texts: [np.array([fingerprint(shingle_hashes(t, width)) for t in texts], dtype=np.uint64).view(np.int64).tolist()]

    return append_columns(docs, [T.StructField(name, T.LongType())], make, text)


def bucket_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (key, position) of unsigned fingerprints; the key's upper bits tell the kind of key."""
    low = np.uint64((1 << 23) - 1)
    a, b, c = prints & low, (prints >> np.uint64(23)) & low, prints >> np.uint64(46)
    fuzzy = {n: golay.keys(x, bits) for n, x, bits in (("a", a, 23), ("b", b, 23), ("c", c, 18))}
    out_keys, out_at = [], []

    def add(kind: int, keys: np.ndarray, at: np.ndarray) -> None:
        out_keys.append(np.uint64(kind << 48) | keys)
        out_at.append(at)

    keys_a, new_a = fuzzy["a"]
    keys_b, new_b = fuzzy["b"]
    at, i, j = np.nonzero(new_a[:, :, None] & new_b[:, None, :])
    ab = (keys_a[at, i].astype(np.uint64) << np.uint64(18)) | (keys_b[at, j].astype(np.uint64) << np.uint64(6))
    for k in range(3):
        add(k, ab | ((c[at] >> np.uint64(6 * k)) & np.uint64(63)), at)
    for kind, exact, other in ((3, a, "b"), (4, b, "a"), (5, b, "c"), (6, c, "b"), (7, a, "c"), (8, c, "a")):
        found, new = fuzzy[other]
        at, i = np.nonzero(new)
        add(kind, (exact[at] << np.uint64(12)) | found[at, i].astype(np.uint64), at)
    return np.concatenate(out_keys), np.concatenate(out_at)


def _pieces(keys: np.ndarray, prints: np.ndarray):
    """Star edges of the links within each run of equal keys."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
    sizes = ends - starts
    small = np.repeat(sizes <= SMALL, sizes)
    for step in range(1, min(SMALL, int(sizes.max(initial=1)))):
        near = (keys[step:] == keys[:-step]) & small[step:]
        at = np.flatnonzero(near)
        if not len(at):
            break
        x, y = prints[at], prints[at + step]
        linked = np.bitwise_count(x ^ y) <= DISTANCE
        yield x[linked], y[linked]
    for s, e in zip(starts[sizes > SMALL], ends[sizes > SMALL]):
        rest = prints[s:e]
        while len(rest) > 1:
            root, front, rest = rest[0], rest[:1], rest[1:]
            while len(front) and len(rest):
                now, front = front[:COMPARED], front[COMPARED:]
                near = np.zeros(len(rest), dtype=bool)
                for one in now:
                    near |= np.bitwise_count(rest ^ one) <= DISTANCE
                new, rest = rest[near], rest[~near]
                yield np.full(len(new), root), new
                front = np.concatenate([front, new])


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly what is connected by links; ``prints``: distinct fingerprints, column ``print``."""
    spark = prints.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes make many keys: no fewer tasks than that

    def keyed(batches):
        for batch in batches:
            values = np.asarray(batch.column(0)).view(np.uint64)
            for i in range(0, len(values), KEYED):
                part = values[i:i + KEYED]
                keys, at = bucket_keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(part[at].view(np.int64))], names=["key", "print"])

    def linked(batches):
        keys, values = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, np.asarray(batch.column(0))])
            values = np.concatenate([values, np.asarray(batch.column(1)).view(np.uint64)])
            whole = np.searchsorted(keys, keys[-1]) if len(keys) else 0  # the last bucket may go on
            yield from edges(keys[:whole], values[:whole])
            keys, values = keys[whole:], values[whole:]
        yield from edges(keys, values)

    def edges(keys, values):
        if len(keys):
            for x, y in _pieces(keys, values):
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    dealt = prints.select("print").repartition(tasks).mapInArrow(keyed, "key long, print long").repartition(tasks, "key")
    return dealt.sortWithinPartitions("key").mapInArrow(linked, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, print (signed long), component_id (smallest doc_id reachable)."""
    prints = stored(with_fingerprint(of_documents(docs, doc_id, text), width).drop("text"), "prints")
    firsts = stored(prints.where("doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("first")), "firsts")
    found = stored(links(firsts), "links")
    name = lambda c: firsts.select(F.col("print").alias(c), F.col("first").alias(f"{c}_id"))
    named = found.join(name("a"), "a").join(name("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    reached = components(named)
    groups = firsts.join(reached, firsts["first"] == reached["node"], "left").select("print", F.coalesce("component", "first").alias("component_id"))
    dropped(found)
    return prints.join(groups, "print", "left").select("doc_id", "print", "component_id")
