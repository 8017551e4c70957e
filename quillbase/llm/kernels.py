"""Array kernels over the UTF-8 bytes of many documents at once.

A kernel takes ``data`` (uint8) and ``ends`` (n + 1 offsets); no text becomes a
Python string. Memory is a small multiple of the bytes handed in.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: ASCII white space, the only thing between words.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that begin a code point.
LEADS = (np.arange(256) & 0xC0) != 0x80

#: Masks that leave the first 0 to 8 bytes of a little-endian number.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Eights of bytes that are hashed at a time: bounds what a long text takes.
EIGHTS = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes, equal for equal bytes wherever they stand.

    A range is read eight bytes at a time. Each eight are mixed with their place, which no
    polynomial does, so unequal ranges are equal by chance only, whatever their pattern.
    """
    size = stops - starts
    pieces = -(-size // 8)
    full = np.flatnonzero(pieces)
    first = np.cumsum(pieces[full]) - pieces[full]
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    sums = np.zeros(len(size), np.uint64)
    for low in range(0, int(pieces.sum()), EIGHTS):
        turn = np.arange(low, min(low + EIGHTS, int(pieces.sum())))
        of = np.searchsorted(first, turn, "right") - 1
        turn -= first[of]
        cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        owner, of = full[of], full[of[cuts]]
        value = eight[starts[owner] + 8 * turn].view("<u8").ravel()
        value &= _MASKS[np.minimum(size[owner] - 8 * turn, 8)]
        value = mix(value ^ mix(turn.astype(np.uint64) + U(1)))
        sums[of] += np.add.reduceat(value, cuts)
    return mix(sums + size.astype(np.uint64) * U(0x9E3779B97F4A7C15))


def spans(inside: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal ranges of True bytes that cross no document's end: starts, stops, document."""
    n = len(inside)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(ends, starts, "right") - 1


def totals(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` in each document."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[ends[1:]] - sums[ends[:-1]]


def windows(hashes: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, hash) of each run of ``width`` words within one document."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[:n] == doc[width - 1 :])
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= U(0xD6E8FEB86659FD93)
        out += hashes[k : k + n]
    return at, mix(out[at])


def shingles(data: np.ndarray, ends: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each document: (hashes, n + 1 offsets), sorted within a document.

    Words are lower-cased in A-Z. A document of fewer words than ``width`` has its
    whole sequence as one shingle; one without words has none.
    """
    low = LOWER[data]
    starts, stops, doc = spans(~SEPARATOR[data], ends)
    n = len(ends) - 1
    counts = np.bincount(doc, minlength=n)
    hashes = span_hashes(low, starts, stops)
    at, keys = windows(hashes, doc, width)
    owner = doc[at]
    first = np.concatenate([[0], np.cumsum(counts)])
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            whole[has] = mix(whole[has] * U(0xD6E8FEB86659FD93) + hashes[first[short[has]] + k] + U(k + 1))
        keys, owner = np.concatenate([keys, whole]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        keys, owner = keys[order], owner[order]
    sizes = np.bincount(owner, minlength=n)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    for i in np.flatnonzero(sizes > 1):
        keys[bounds[i] : bounds[i + 1]].sort()
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return keys[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=n))])


def repeated(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(any, later): whether an equal key of the same owner exists, and whether one stands before it."""
    tagged = mix(keys + owner.astype(np.uint64) * U(0x9FB21C651E98DF25))
    order = np.argsort(tagged, kind="stable")
    same = tagged[order[1:]] == tagged[order[:-1]]
    anyone, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    anyone[order[1:][same]] = True
    anyone[order[:-1][same]] = True
    later[order[1:][same]] = True
    return anyone, later
