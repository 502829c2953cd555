"""Byte-level BPE encoding and decoding.

A text is split by the vocabulary's pattern; each match is merged by itself.  A
segment tree with a leaf per byte position holds, at each live position, the
rank of the pair that starts there; its root is the leftmost minimum.  A merge
changes three leaves (the merged pair, its left neighbour, the consumed
neighbour), each with a logarithmic walk to the root.

Texts are mapped without a shuffle.  A null or empty text has no ids and decodes
to the empty string; repeated rows give one result each; a null id stays null.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from carelake.llm.common import CACHE_ENTRIES, append_columns

#: Longer matches are merged anew each time they occur.
CACHED_BYTES = 64
_NONE = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file has one token (base64) and its rank per line; its size bounds what is sent to the executors."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one match."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    bits = max(1, (n - 1).bit_length())
    mask = (1 << bits) - 1
    end = list(range(1, n + 2))  # of the part that starts at a live position: also the next live position
    before = list(range(-1, n))
    get, none = ranks.get, _NONE
    tree = [none] * (2 * n)
    for i in range(n - 1):
        rank = get(piece[i:i + 2])
        if rank is not None:
            tree[n + i] = rank << bits | i
    for k in range(n - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    while (least := tree[1]) != none:
        i = least & mask
        j = end[i]
        end[i] = stop = end[j]
        before[stop] = i
        left = before[i]
        tree[n + j] = none
        rank = get(piece[i:end[stop]]) if stop < n else None
        tree[n + i] = none if rank is None else rank << bits | i
        if left >= 0:
            rank = get(piece[left:stop])
            tree[n + left] = none if rank is None else rank << bits | left
            changed = (n + j, n + i, n + left)
        else:
            changed = (n + j, n + i)
        for k in changed:  # a walk ends where a node keeps its value; those above it hold for it
            value = tree[k]
            while k > 1:
                other = tree[k ^ 1]
                if other < value:
                    value = other
                k >>= 1
                if tree[k] == value:
                    break
                tree[k] = value
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:end[i]]])
        i = end[i]
    return ids


class Encoder(dict):
    """Ids of matches as little-endian unsigned 32-bit integers, kept for the matches seen last."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        super().__init__()
        self.ranks, self.pattern, self.split = ranks, pattern, regex.compile(pattern).findall

    def __missing__(self, match: str) -> bytes:
        raw = match.encode()
        ids = array("I", merge(raw, self.ranks)).tobytes()
        if len(raw) <= CACHED_BYTES:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[match] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))


_encoder: Encoder | None = None


def encoder_of(ranks: dict[bytes, int], pattern: str) -> Encoder:
    """The worker's encoder: its tasks one after another share what it keeps, within the same bound."""
    global _encoder
    if _encoder is None or _encoder.ranks is not ranks or _encoder.pattern != pattern:
        _encoder = Encoder(ranks, pattern)
    return _encoder


class Decoder:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.tokens = {i: t for t, i in ranks.items()}

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


FIELDS = {
    "ids": T.ArrayType(T.IntegerType(), False), "n_tokens": T.LongType(), "decoded": T.StringType(),
    "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(),
}


def tokenize(docs: DataFrame, ranks: dict[bytes, int], pattern: str, columns: tuple[str, ...] = ("ids", "n_tokens"),
             text: str = "text") -> DataFrame:
    """``docs`` with the columns asked for: ids, n_tokens, decoded (from the ids) and the digests of both."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    decodes = any("decoded" in c for c in columns)

    def make():
        encoder, decoder = encoder_of(shared.value, pattern), Decoder(shared.value)

        def run(texts):
            packed = [encoder.encode(t) for t in texts]
            ids = [np.frombuffer(p, dtype="<u4") for p in packed]
            decoded = [decoder.decode(x) for x in ids] if decodes else None
            made = {
                "ids": lambda: pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0] + [len(x) for x in ids]), pa.int32()),
                    pa.array(np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32))),
                "n_tokens": lambda: [len(x) for x in ids],
                "decoded": lambda: [d.decode("utf-8", "replace") for d in decoded],
                "ids_sha256": lambda: [hashlib.sha256(p).hexdigest() for p in packed],
                "decoded_sha256": lambda: [hashlib.sha256(d).hexdigest() for d in decoded],
            }
            return [made[c]() for c in columns]

        return run

    return append_columns(docs, [T.StructField(c, FIELDS[c], c != "n_tokens") for c in columns], make, text)


def detokenize(tokens: DataFrame, ranks: dict[bytes, int], ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``tokens`` with the text of an array of ids; null ids give null, an unknown id ends the job."""
    shared = tokens.sparkSession.sparkContext.broadcast(ranks)
    kept = [f for f in tokens.schema.fields if f.name.lower() != name.lower()]
    schema = T.StructType(kept + [T.StructField(name, T.StringType())])

    def run(batches):
        decoder = Decoder(shared.value)
        for b in batches:
            texts = [None if v is None else decoder.decode(np.asarray(v)).decode("utf-8", "replace") for v in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in kept] + [pa.array(texts, pa.string())], names=[f.name for f in schema])

    return tokens.mapInArrow(run, schema)
