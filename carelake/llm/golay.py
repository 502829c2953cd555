"""Fuzzy hashing by the binary Golay code (23, 12, 7).

The code is perfect: every 23-bit word lies within 3 bits of exactly one
codeword.  A word's keys are the codeword indices (12 bits) that the word and its
one-bit neighbours decode to.  Two words at most 2 bits apart have a word within
one bit of both, and so share a key.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0xC75
BITS, CHECKS = 23, 11


def _remainder(word: int) -> int:
    for i in range(BITS - 1, CHECKS - 1, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - CHECKS)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainder of the upper 12 bits; the error of each syndrome; the syndrome of each single bit."""
    upper = np.array([_remainder(m << CHECKS) for m in range(1 << (BITS - CHECKS))], dtype=np.uint32)
    single = np.array([_remainder(1 << i) for i in range(BITS)], dtype=np.uint32)
    error = np.zeros(1 << CHECKS, dtype=np.uint32)
    for weight in (1, 2, 3):
        for bits in combinations(range(BITS), weight):
            error[np.bitwise_xor.reduce(single[list(bits)])] = sum(1 << i for i in bits)
    return upper, error, single


def keys(words: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Per word of at most ``bits`` bits: a row of codeword indices, and a mask that shows each index once."""
    upper, error, single = _tables()
    words = words.astype(np.uint32)
    syndrome = (upper[words >> np.uint32(CHECKS)] ^ (words & np.uint32((1 << CHECKS) - 1)))[:, None]
    flips = np.concatenate([np.zeros(1, np.uint32), np.uint32(1) << np.arange(bits, dtype=np.uint32)])[None, :]
    moved = np.concatenate([np.zeros(1, np.uint32), single[:bits]])[None, :]
    found = np.sort((words[:, None] ^ flips ^ error[syndrome ^ moved]) >> np.uint32(CHECKS), axis=1)
    new = np.ones(found.shape, dtype=bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    return found, new
