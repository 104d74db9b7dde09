"""MD5 of many short texts that share their beginnings, in numpy."""

from __future__ import annotations

import hashlib
import math
import sys

import numpy as np
from pyspark import cloudpickle

# executors get these functions with the task that calls them, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_ADDED = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
#: Heads whose digests are taken at once, so that the words stay in a core's cache.
TOGETHER = 16
_FIRST = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _leading_word(words: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The first word of the digests of one-block messages; words: 16 of them, each broadcast to the shape.

    Step i makes the word that is the first of the state after step i + 3, so 61 of the 64 steps are taken.
    """
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _FIRST)
    mixed, high = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(61):
        if i < 16:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, out=mixed)
            mixed &= b
            mixed ^= d
            at = i
        elif i < 32:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, out=mixed)
            mixed &= d
            mixed ^= c
            at = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=mixed)
            mixed ^= d
            at = (3 * i + 5) % 16
        else:  # c ^ (b | ~d)
            np.invert(d, out=mixed)
            mixed |= b
            mixed ^= c
            at = 7 * i % 16
        mixed += a
        mixed += words[at] + _ADDED[i]
        shift = np.uint32(_SHIFTS[i])
        np.right_shift(mixed, np.uint32(32) - shift, out=high)
        mixed <<= shift
        mixed |= high
        mixed += b
        # the oldest word's memory takes the next sums
        a, b, c, d, mixed = d, mixed, b, c, a
    return b + _FIRST[0]


def leading_md5(heads: list[bytes], tails: list[bytes]) -> np.ndarray:
    """uint32 (heads, tails): the number that the first 8 hex digits of md5(head + tail) write."""
    out = np.empty((len(heads), len(tails)), np.uint32)
    longest, by_length = max(map(len, tails), default=0), {}
    for i, head in enumerate(heads):
        by_length.setdefault(len(head), []).append(i)
    for n, at in by_length.items():
        if n + longest > 55:  # more than one block
            for i in at:
                out[i] = [int.from_bytes(hashlib.md5(heads[i] + tail).digest()[:4], "big") for tail in tails]
            continue
        ends = b"".join((b"\0" * n + tail + b"\x80").ljust(56, b"\0") + (8 * (n + len(tail))).to_bytes(8, "little") for tail in tails)
        ends = np.frombuffer(ends, "<u4").reshape(-1, 16).T.astype(np.uint32)
        for some in (at[k : k + TOGETHER] for k in range(0, len(at), TOGETHER)):
            starts = np.frombuffer(b"".join(heads[i].ljust(64, b"\0") for i in some), "<u4").reshape(-1, 16).T.astype(np.uint32)
            words = [s[:, None] | e[None, :] if e.any() else s[:, None] for s, e in zip(starts, ends)]
            out[some] = _leading_word(words, (len(some), len(tails))).byteswap()
    return out
