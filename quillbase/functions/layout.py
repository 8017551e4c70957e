"""Sizes of fixed-length records, and how many buffers sorting and products use."""

from __future__ import annotations

from dataclasses import dataclass

#: Fixed values, in bytes: the slot flag, an integer, the length before a string, a block.
FLAG, INTEGER, LENGTH, BLOCK = 4, 4, 4, 4096
#: Buffers that are left for others.
RESERVED_BUFFERS = 2


@dataclass(frozen=True)
class Layout:
    """Offsets of the fields, in order, and the size of a slot."""

    offsets: dict[str, int]
    slot_size: int

    @property
    def slots_per_block(self) -> int:
        return max(1, BLOCK // self.slot_size)


def layout(fields: list[tuple[str, int | None]]) -> Layout:
    """Of fields (name, length): a length for a varchar, None for an int."""
    offsets, at = {}, FLAG
    for name, length in fields:
        offsets[name] = at
        at += INTEGER if length is None else LENGTH + length
    return Layout(offsets, at)


def _root(size: int, degree: int) -> int:
    """The least integer whose power reaches ``size``."""
    r = max(1, int(round(size ** (1 / degree))) - 1)
    while r**degree < size:
        r += 1
    return r


def best_root(available: int, size: int) -> int:
    """The greatest root of ``size``, the square root or a higher one, rounded up, that fits the buffers: the fan-in that merges runs in equal passes."""
    room = available - RESERVED_BUFFERS
    if room <= 1:
        return 1
    degree = 2
    while _root(size, degree) > room:
        degree += 1
    return _root(size, degree)


def best_factor(available: int, size: int) -> int:
    """The greatest part of ``size``, a half or less, rounded up, that fits the buffers: chunks of equal length."""
    room = available - RESERVED_BUFFERS
    if room <= 1:
        return 1
    return -(-size // max(2, -(-size // room)))
