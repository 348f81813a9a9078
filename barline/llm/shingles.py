"""Sets of word shingles as sorted 64-bit hashes, for whole batches of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from barline.llm.common import utf8

#: Words in a shingle.
WIDTH = 5
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of each text, A-Z lower-cased, and where each text's words start."""
    raw, at = utf8(column)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    solid = ~_SPACE[raw]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    inner = at[(at > 0) & (at < len(raw))]
    start[inner] |= solid[inner]  # a text ends its last word
    where = np.flatnonzero(start)
    place = np.append(np.cumsum(solid)[where] - 1, int(solid.sum())).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(where), [None, pa.py_buffer(place), pa.py_buffer(_LOWER[raw[solid]])])
    coded = words.dictionary_encode()
    own = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return own[coded.indices.to_numpy()] if len(where) else np.zeros(0, np.uint64), np.searchsorted(where, at)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles, ascending, and where each text's start. Fewer words than WIDTH make one shingle, none none."""
    words, at = word_hashes(column)
    count = np.diff(at)
    n = np.where(count >= WIDTH, count - WIDTH + 1, np.minimum(count, 1))
    upto = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(at[:-1] - upto[:-1], n) + np.arange(upto[-1])
    size = np.repeat(np.minimum(count, WIDTH), n)
    x = np.full(len(first), 1, np.uint64) * size.astype(np.uint64)
    for k in range(WIDTH):
        has = size > k
        if has.all():
            x = mixed(x * _A + words[first + k])
        else:
            x[has] = mixed(x[has] * _A + words[first[has] + k])
    for s, e in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
        if e - s > 1:
            x[s:e].sort()
    fresh = np.ones(len(x), bool)
    fresh[1:] = x[1:] != x[:-1]
    starts = upto[:-1][n > 0]
    fresh[starts] = True
    return x[fresh], np.concatenate([[0], np.cumsum(fresh)])[upto]


def set_name(tokens: np.ndarray, seed: int) -> tuple[int, int]:
    """128 bits of hash of a set as two of Spark's signed bigints: its number, and what tells sets with one number apart."""
    x = xxhash.xxh3_128_intdigest(tokens.tobytes(), seed)
    return (x & (1 << 64) - 1) - (1 << 63), (x >> 64) - (1 << 63)
