"""The binary Golay code (23, 12): nearest codewords, and keys that near vectors share.

Every 23-bit word lies within 3 bits of exactly one codeword; decode() gives its index.

near2(u): indices of u and of u with any one bit flipped. Two words at 2 bits or fewer have a word at one bit or
fewer from each, so they share an index. At most 6 differ.
near1(u): decode(u), and those of near2(u) that are smaller. Words at one bit or fewer share an index: where their
own indices differ, each has the other's in near2, so both keep the smaller one.
"""

from __future__ import annotations

from functools import cache

import numpy as np

GENERATOR, BITS, DATA_BITS = 0xAE3, 23, 12


@cache
def decode_table() -> np.ndarray:
    code = np.zeros(1 << DATA_BITS, np.uint32)
    for i in range(DATA_BITS):
        code[1 << i : 2 << i] = code[: 1 << i] ^ np.uint32(GENERATOR << i)
    errors = [0] + [1 << a for a in range(BITS)]
    errors += [1 << a | 1 << b for a in range(BITS) for b in range(a)]
    errors += [1 << a | 1 << b | 1 << c for a in range(BITS) for b in range(a) for c in range(b)]
    table = np.full(1 << BITS, 0xFFFF, np.uint16)
    index = np.arange(1 << DATA_BITS, dtype=np.uint16)
    for e in errors:
        table[code ^ np.uint32(e)] = index
    return table


def near(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of ``bits`` bits: near2 as rows of distinct indices padded by 0xFFFF, a mask of what near1 keeps, and its own index."""
    table = decode_table()
    flips = np.array([0, *(1 << b for b in range(bits))], np.uint32)
    found = table[words.astype(np.uint32)[:, None] ^ flips]
    own = found[:, 0].copy()
    found.sort(axis=1)
    repeated = np.zeros(found.shape, bool)
    repeated[:, 1:] = found[:, 1:] == found[:, :-1]
    found[repeated] = 0xFFFF
    found.sort(axis=1)
    width = max(1, int((found != 0xFFFF).sum(axis=1).max(initial=1)))
    found = found[:, :width]
    return found, found <= own[:, None], own
