"""The binary Golay code of length 23: every word is at most 3 bits from exactly one codeword."""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH, CHECK_BITS = 23, 11
# Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK_BITS)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of each word, and the error of at most 3 bits that leaves a remainder."""
    single = [_remainder(1 << i) for i in range(LENGTH)]
    remainders = np.zeros(1 << LENGTH, dtype=np.uint16)
    for i, r in enumerate(single):
        remainders[1 << i : 2 << i] = remainders[: 1 << i] ^ np.uint16(r)
    errors = np.zeros(1 << CHECK_BITS, dtype=np.uint32)
    for n in (1, 2, 3):
        for bits in combinations(range(LENGTH), n):
            r = 0
            for i in bits:
                r ^= single[i]
            errors[r] = sum(1 << i for i in bits)
    return remainders, errors


_made: list = []


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    if not _made:
        _made.extend(_tables())
    remainders, errors = _made
    return (words ^ errors[remainders[words]]) >> CHECK_BITS


def near_indices(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords nearest to a word and to each word that differs in one of its low
    ``bits``, as one row per word, and which of them are the first of their kind in the row.

    Two words that differ in at most two bits have a word between them that differs from each in
    at most one, so they have an index in common.
    """
    masks = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.uint32)
    found = np.sort(decode(words.astype(np.uint32)[:, None] ^ masks), axis=1)
    first = np.ones(found.shape, dtype=bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    return found, first
