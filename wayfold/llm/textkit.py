"""Word streams and 64-bit hashes of words and word windows, vectorised over whole batches of text.

A word is a maximal run of bytes outside space and \\t \\n \\v \\f \\r (``bytes.split()`` on UTF-8
cuts at the same places).  No Python object is made per word: a batch is one byte buffer, a word's
hash runs over its eight-byte lanes with a bijective finaliser after each (words of over 32 bytes
take XXH3), and a window's hash is a sum of word hashes with one multiplier per place.
"""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
_random = np.random.default_rng(0x5EED_0F7A)
#: Odd multipliers for the place in a window and for the eight-byte lanes of a word; fixed, so that
#: hashes stored by an earlier run stay comparable.
_PLACES = _random.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
_LANES = _random.integers(1, 2**63, 4, dtype=np.uint64) * U64(2) + U64(1)
_LENGTH = U64(0x9E3779B97F4A7C15)
_KEEP = np.array([2 ** (8 * k) - 1 for k in range(9)], dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes hashed at a time; a piece ends at white space, and only a longer word makes a longer piece.
_PIECE = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and odd multiplications)."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def _lane(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place, out of a buffer read as 64-bit words."""
    i, bits = at >> 3, (at & 7).astype(U64) << U64(3)
    return words[i] >> bits | words[i + 1] << U64(1) << (U64(63) - bits)


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 0x20) | (data - np.uint8(9) < 5)


def word_edges(space: np.ndarray):
    """(start, end) of every run of places that are no white space."""
    if not len(space):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    turns = np.empty(len(space) + 1, bool)
    turns[0], turns[-1] = not space[0], not space[-1]
    np.not_equal(space[1:], space[:-1], out=turns[1:-1])
    edge = np.flatnonzero(turns)
    return edge[::2], edge[1::2]


def hash_words(piece: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hashes of some words of a piece, given by their places."""
    n = ends - starts
    words = np.zeros(len(piece) // 8 + 3, U64)
    words.view(np.uint8)[: len(piece)] = piece
    # each lane goes through the finaliser before the next is added, so no sum of bytes can cancel
    h = mix((_lane(words, starts) & _KEEP[np.minimum(n, 8)]) + n.astype(U64) * _LENGTH)
    for k in range(1, len(_LANES)):
        more = np.flatnonzero(n > 8 * k)
        if not len(more):
            break
        lane = _lane(words, starts[more] + 8 * k) & _KEEP[np.minimum(n[more] - 8 * k, 8)]
        h[more] = mix(h[more] ^ (lane + U64(k)) * _LANES[k])
    for i in np.flatnonzero(n > 8 * len(_LANES)).tolist():
        h[i] = xxhash.xxh3_64_intdigest(piece[starts[i] : ends[i]].tobytes(), 0x5EED)
    return h


def word_hashes(buffer: bytes, lower: bool = False):
    """(hash, start byte, end byte) of every word of a buffer, in order; A-Z count as a-z if lower."""
    data = np.frombuffer(buffer, np.uint8)
    if lower:
        data = _LOWER[data]
    space = is_space(data)
    found, at = [], 0
    while at < len(data):
        end = min(at + _PIECE, len(data))
        if end < len(data):
            cut = np.flatnonzero(space[at:end])
            if len(cut):
                end = at + int(cut[-1]) + 1
            else:
                rest = np.flatnonzero(space[end:])
                end = end + int(rest[0]) + 1 if len(rest) else len(data)
        starts, ends = word_edges(space[at:end])
        found.append((hash_words(data[at:end], starts, ends), starts + at, ends + at))
        at = end
    if not found:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def window_hashes(word_hashes_: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive entries (empty if there are fewer); width up to 64."""
    n = len(word_hashes_) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, U64)
    for place in range(width):
        total += word_hashes_[place : place + n] * _PLACES[place]
    return mix(total)


class Batch:
    """The words of many texts: ``hashes``, ``starts``, ``ends`` over ``buffer``; text i has words
    ``offsets[i]`` to ``offsets[i + 1]``."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.buffer = b"\n".join(texts)
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(lengths)]) if len(texts) else np.zeros(1, np.int64)
        self.hashes, self.starts, self.ends = word_hashes(self.buffer, lower)
        self.offsets = np.searchsorted(self.starts, self.begin)

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.offsets[i] : self.offsets[i + 1]]


def to_bytes(column) -> list[bytes]:
    """Texts of an Arrow column as UTF-8 bytes; null is empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(batch, limit: int = 4_000_000):
    """An Arrow batch in slices of about ``limit`` bytes at most (one row at least)."""
    rows = batch.num_rows
    step = max(1, int(rows * limit / max(1, batch.nbytes)))
    for at in range(0, rows, step):
        yield batch.slice(at, step)
