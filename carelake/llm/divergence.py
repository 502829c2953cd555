"""Source divergence audit by chunk factorization.

A document is a multiset of whitespace-separated chunks.  Chunks are counted per
document, each globally distinct chunk is split into terms once, its terms are
joined back, and distinct documents and occurrences are summed per term.  From the
sums every source of a language is compared with each other source (part ``pair``)
and with its language (part ``term``); all arithmetic is on integers.

How the work is spread: documents are packed into blocks of ``block_bytes``.  A
block keeps (document, chunk, count) as numbers and sends each of its distinct
chunks once, to the bucket of its hash; there it is split, and its terms come back to
the block, so documents never meet in one task by chunk, term or source, and a hot
chunk is one entry per block.  The block's sums go to the buckets of their terms.
There are as many buckets as hold about ``bucket_entries`` chunks each.  A very
long text is a block of its own and is split piece by piece.  Pairs of sources exist only
as sums: with count 0 in a source a term adds a constant, so terms of one source are
taken by their histogram of values, and only terms that two sources share are
multiplied out, as numpy arrays inside a task.

Null text, lang and source are ''.  Repeated rows (also of one doc_id) count as
documents of their own.  Ties in value are ranked by item in UTF-8 order.  A language
without kept terms has pairs of value 0 and no terms.  An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelake.llm.common import dropped, steps, stored, texts_of

#: Terms are runs of ASCII letters (lower-cased) and bytes beyond ASCII; all other bytes part them.
_LETTERS = bytes.maketrans(ascii_uppercase.encode() + bytes(c for c in range(128) if not chr(c).isalpha()),
                           ascii_lowercase.encode() + b" " * sum(not chr(c).isalpha() for c in range(128)))
#: Parts of one in which shares are counted.
UNIT = 1_000_000_000
#: Bytes of a long text split at once.
PIECE = 4 << 20
#: Pairs of sources multiplied out at once.
PAIRS = 1 << 20
_SPACE = b" \t\n\r\x0b\x0c"
#: Lists of chunks, terms and numbers travel as one value each.
REQUEST = [("bucket", "long"), ("block", "long"), ("at", "binary"), ("chunks", "binary")]
REPLY = [("to", "long"), ("at", "binary"), ("terms", "binary"), ("lang", "string"), ("gid", "long")]
SUMS = [("bucket", "long"), ("lang", "string"), ("gids", "binary"), ("terms", "binary"), ("docs", "binary"), ("n", "binary")]


class Numbers(dict):
    """Numbers things in the order they come."""

    def __missing__(self, key) -> int:
        value = self[key] = len(self)
        return value


def _pieces(raw: bytes):
    """``raw`` cut at whitespace to pieces of about PIECE bytes."""
    at = 0
    while len(raw) - at > PIECE:
        ends = [e for e in (raw.find(s, at + PIECE) for s in (bytes([c]) for c in _SPACE)) if e >= 0]
        if not ends:
            break
        end = min(ends)
        yield raw[at:end]
        at = end
    yield raw[at:] if at else raw


class Block:
    """Chunks of some documents as numbers."""

    def __init__(self) -> None:
        self.groups, self.chunks, self.size = Numbers(), Numbers(), 0
        self.group_of, self.lengths, self.held, self.counts = [], [], [], []

    def add(self, group: tuple[str, str], text: str) -> None:
        raw = text.encode()
        found = [np.fromiter(map(self.chunks.__getitem__, w), np.int32, len(w)) for w in (p.split() for p in _pieces(raw))]
        held, counts = np.unique(np.concatenate(found) if len(found) > 1 else found[0], return_counts=True)
        self.group_of.append(self.groups[group])
        self.lengths.append(len(held))
        self.held.append(held)
        self.counts.append(counts.astype(np.int32))
        self.size += len(raw) + 16

    def batch(self, number: int) -> pa.RecordBatch:
        joined = lambda parts: np.concatenate(parts).tobytes() if parts else b""
        whole = lambda values: np.array(values, dtype=np.int32).tobytes()
        groups = list(self.groups)
        named = [pa.array([[g[k] for g in groups]], pa.list_(pa.string())) for k in (0, 1)]
        blobs = (b" ".join(self.chunks), whole(self.group_of), whole(self.lengths), joined(self.held), joined(self.counts))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *named, pa.array([len(self.chunks)], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs)],
                                          names=["block", "langs", "sources", "n_chunks", "chunks", "group_of", "lengths", "held", "counts"])


def packed(docs: DataFrame, block_bytes: int) -> DataFrame:
    """A row per block: its groups, its distinct chunks, and per document the numbers and counts of its chunks."""
    def run(batches):
        task, number, block = TaskContext.get().partitionId(), 0, Block()
        for batch in steps(batches):
            for lang, source, text in zip(texts_of(batch, "lang"), texts_of(batch, "source"), texts_of(batch)):
                block.add((lang, source), text)
                if block.size >= block_bytes:
                    yield block.batch(task << 32 | number)
                    number, block = number + 1, Block()
        if block.lengths:
            yield block.batch(task << 32 | number)

    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return read.mapInArrow(run, "block long, langs array<string>, sources array<string>, n_chunks long, chunks binary, "
                                "group_of binary, lengths binary, held binary, counts binary")


def requests(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, at, chunks): the chunks of a block, parted by hash, and their places in it."""
    def run(batches):
        for batch in batches:
            for block, chunks in zip(batch.column("block").to_pylist(), batch.column("chunks").to_pylist()):
                rows = [(bucket, block, at.astype(np.int32).tobytes(), b" ".join(held)) for bucket, at, held in _by_hash(chunks.split(b" ") if chunks else [], buckets)]
                yield _batch(rows, REQUEST)

    return blocks.select("block", "chunks").mapInArrow(run, _ddl(REQUEST))


def _by_hash(keys: list[bytes], buckets: int):
    """(bucket, places, keys) for each bucket that has a key."""
    number = np.fromiter(map(crc32, keys), np.int64, len(keys)) % buckets
    order = np.argsort(number, kind="stable")
    first = _firsts(number[order])
    for a, b in zip(first, np.append(first[1:], len(order))):
        at = order[a:b]
        yield int(number[at[0]]), at, [keys[i] for i in at.tolist()]


def split_once(table: pa.Table) -> pa.Table:
    """Replies (to, at, terms) to the requests of one bucket; each distinct chunk is split into its terms once."""
    terms: dict[bytes, bytes] = {}
    rows = []
    for block, at, chunks in zip(*(table.column(c).to_pylist() for c in ("block", "at", "chunks"))):
        out = []
        for chunk in chunks.split(b" "):
            found = terms.get(chunk)
            if found is None:
                found = terms[chunk] = b" ".join(chunk.translate(_LETTERS).split())
            out.append(found)
        rows.append((block, at, b"\n".join(out), None, None))
    return pa.Table.from_batches([_batch(rows, REPLY)])


def term_sums(left: pa.Table, right: pa.Table, buckets: int) -> pa.Table:
    """(bucket, lang, gids, terms, docs, n) of one block from the terms of its chunks; term lists are parted by hash."""
    langs, gids, replies = {}, {}, []
    for at, terms, lang, gid in zip(*(right.column(c).to_pylist() for c in ("at", "terms", "lang", "gid"))):
        at = np.frombuffer(at, dtype=np.int32)
        if gid is None:
            replies.append((at, terms.split(b"\n")))
        else:
            langs[int(at[0])], gids[int(at[0])] = lang, gid
    rows = []
    for row in left.to_pylist():
        group_of, lengths, held, counts = (np.frombuffer(row[c], dtype=np.int32) for c in ("group_of", "lengths", "held", "counts"))
        number, codes = Numbers(), []
        size = sum(len(at) for at, _ in replies)
        start, many = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for at, answers in replies:
            for i, answer in zip(at.tolist(), answers):
                found = answer.split(b" ") if answer else ()
                start[i], many[i] = len(codes), len(found)
                codes.extend(map(number.__getitem__, found))
        codes, names, width = np.array(codes, dtype=np.int64), list(number), max(1, len(number))
        n = many[held]
        entry = np.repeat(np.arange(len(held)), n)
        term = codes[start[held][entry] + np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)]
        # Terms of a document once each, then documents and occurrences per group.
        keys, times = _summed(np.repeat(np.arange(len(lengths)), lengths)[entry] * width + term, counts[entry].astype(np.int64))
        doc, term = np.divmod(keys, width)
        by_group = group_of[doc].astype(np.int64) * width + term
        order = np.argsort(by_group, kind="stable")
        first = _firsts(by_group[order])
        group, term = np.divmod(by_group[order][first], width)
        docs, times = np.diff(np.append(first, len(order))), np.add.reduceat(times[order], first) if len(first) else times
        lang_of = np.array([langs[g] for g in range(len(langs))], dtype=object)[group]
        gid_of = np.array([gids[g] for g in range(len(gids))], dtype=np.int64)[group]
        for lang in sorted(set(lang_of)):
            own = np.flatnonzero(lang_of == lang)
            for bucket, at, found in _by_hash([names[i] for i in term[own].tolist()], buckets):
                at = own[at]
                rows.append((bucket, lang, gid_of[at].tobytes(), b"\n".join(found), docs[at].astype(np.int64).tobytes(), times[at].tobytes()))
    return pa.Table.from_batches([_batch(rows, SUMS)])


def frequent_terms(key, table: pa.Table, least_docs: int) -> pa.Table:
    """The terms of one language and bucket that are in ``least_docs`` documents or more, with their occurrences per group."""
    number, codes = Numbers(), []
    for terms in table.column("terms").to_pylist():
        found = terms.split(b"\n")
        codes.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
    gids, docs, times = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=np.int64) for c in ("gids", "docs", "n"))
    known, gid = np.unique(gids, return_inverse=True)
    code = np.concatenate(codes)
    total = np.zeros(len(number), np.int64)
    np.add.at(total, code, docs)
    kept = total[code] >= least_docs
    keys, times = _summed(code[kept] * len(known) + gid[kept], times[kept])
    code, gid = np.divmod(keys, len(known))
    first = _firsts(code)
    names = list(number)
    present = pa.StructArray.from_arrays([pa.array(known[gid]), pa.array(times)], names=["gid", "n"])
    whole = np.add.reduceat(times, first) if len(first) else times
    return pa.table({"lang": pa.array([key[1].as_py()] * len(first), pa.string()), "term": pa.array([names[c].decode() for c in code[first].tolist()], pa.string()),
                     "whole": pa.array(whole, pa.int64()), "present": pa.ListArray.from_arrays(pa.array(np.append(first, len(code)), pa.int32()), present)})


def _batch(rows: list[tuple], fields: list[tuple[str, str]]) -> pa.RecordBatch:
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[t]) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _ddl(fields: list[tuple[str, str]]) -> str:
    return ", ".join(f"{n} {t}" for n, t in fields)


def _firsts(ordered: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1]) if len(ordered) else np.zeros(0, np.int64)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    first = _firsts(keys[order])
    return keys[order][first], np.add.reduceat(values[order], first) if len(first) else values


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * kept)), exact beyond 64 bits."""
    return F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)"), (total + 2 * kept).cast("decimal(20,0)"))


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def shared_terms(batches):
    """From rows (present: array of gid, p, base) the sums of what shared terms add to pairs, both ways."""
    for batch in batches:
        lists = batch.column("present")
        flat = lists.flatten()
        gid, p, base = (pc.struct_field(flat, k).to_numpy() for k in range(3))
        lengths = pc.list_value_length(lists).to_numpy()
        after = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(gid)) - 1  # entries after it in its row
        made = np.cumsum(after)
        at = 0
        while at < len(gid):
            to = max(at + 1, int(np.searchsorted(made, (made[at - 1] if at else 0) + PAIRS, side="right")))
            n = after[at:to]
            left = np.repeat(np.arange(at, to), n)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
            value = _gap(p[left], p[right]) - _gap(p[left], base[right]) - _gap(base[left], p[right]) + _gap(base[left], base[right])
            known, code = np.unique(gid, return_inverse=True)
            keys, sums = _summed(code[left] * len(known) + code[right], value)
            a, b = (known[x] for x in np.divmod(keys, max(1, len(known))))
            for x, y in ((a, b), (b, a)):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(sums, pa.int64())], names=["gid", "other", "value"])
            at = to


def kept_terms(docs: DataFrame, least_docs: int = 10, block_bytes: int = 24 << 20, bucket_entries: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """(lang, source, gid) of every group, and (lang, term, whole, present) of each term in ``least_docs`` documents of a
    language: its occurrences, also per group."""
    blocks = stored(packed(docs, block_bytes), "chunk-blocks", "zstd")
    entries = blocks.agg(F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, -(-entries // bucket_entries))
    local = blocks.select("block", F.posexplode(F.arrays_zip("langs", "sources")).alias("at", "g")).select(
        "block", "at", F.col("g.langs").alias("lang"), F.col("g.sources").alias("source"))
    groups = stored(local.select("lang", "source").distinct().withColumn("gid", F.monotonically_increasing_id()), "groups")
    own = local.join(groups, ["lang", "source"]).select(
        F.col("block").alias("to"), F.reverse(F.unhex(F.lpad(F.hex("at"), 8, "0"))).alias("at"), F.lit(None).cast("binary").alias("terms"), "lang", "gid")
    replies = requests(blocks, buckets).groupBy("bucket").applyInArrow(split_once, _ddl(REPLY))
    sums = (blocks.select("block", "group_of", "lengths", "held", "counts").groupBy("block").cogroup(replies.unionByName(own).groupBy("to"))
            .applyInArrow(lambda left, right: term_sums(left, right, buckets), _ddl(SUMS)))
    kept = sums.groupBy("bucket", "lang").applyInArrow(
        lambda key, table: frequent_terms(key, table, least_docs), "lang string, term string, whole long, present array<struct<gid: long, n: long>>")
    kept = stored(kept, "kept-terms", "zstd")
    dropped(blocks)
    return groups, kept


def audit(docs: DataFrame, least_docs: int = 10, top_terms: int = 10, block_bytes: int = 24 << 20, bucket_entries: int = 500_000) -> DataFrame:
    """lang, source, part, item, value, rank; see the module."""
    groups, kept = kept_terms(docs, least_docs, block_bytes, bucket_entries)
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("whole").alias("lang_n"))
    held = kept.select("lang", "term", "whole", F.explode("present").alias("x")).select("lang", "term", "whole", "x.gid", "x.n")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    sized = groups.join(held.groupBy("gid").agg(F.sum("n").alias("group_n")), "gid", "left").join(langs, "lang", "left").select(
        "gid", "lang", "source", zero("group_n"), zero("v"), zero("lang_n"))
    sized = stored(sized.withColumn("base", F.when(F.col("v") > 0, share(F.lit(0), F.col("group_n"), F.col("v"))).otherwise(F.lit(1))), "sized-groups")
    entries = held.join(sized.drop("lang"), "gid").withColumn("p", share(F.col("n"), F.col("group_n"), F.col("v")))
    entries = stored(entries.withColumn("q", share(F.col("whole"), F.col("lang_n"), F.col("v"))), "entries", "zstd")

    item = lambda w: F.row_number().over(w.orderBy(F.desc("value"), "item"))
    own = Window.partitionBy("gid")
    terms = (entries.where("p > q").select("gid", "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
             .withColumn("rank", item(own)).where(F.col("rank") <= top_terms))

    other = sized.select("lang", F.col("gid").alias("other"), F.col("base").alias("other_base"), "v")
    both = sized.drop("v").join(other, "lang").where("gid <> other")
    never = both.select("gid", "other", (F.col("v") * gap(F.col("base"), F.col("other_base"))).alias("value"))
    seen = entries.groupBy("gid", "p").agg(F.count(F.lit(1)).alias("terms")).join(both, "gid").select(
        "gid", "other", (F.col("terms") * (gap(F.col("p"), F.col("other_base")) - gap(F.col("base"), F.col("other_base")))).alias("value"))
    shared = entries.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("gid", "p", "base"))).alias("present")).select("present")
    sums = (never.unionByName(seen).unionByName(seen.select(F.col("other").alias("gid"), F.col("gid").alias("other"), "value"))
            .unionByName(shared.mapInArrow(shared_terms, "gid long, other long, value long"))
            .groupBy("gid", "other").agg(F.sum("value").alias("value")))
    named = sums.join(sized.select("gid", "lang", "source"), "gid").join(sized.select(F.col("gid").alias("other"), F.col("source").alias("item")), "other")
    pairs = named.select("gid", "lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", item(own))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
