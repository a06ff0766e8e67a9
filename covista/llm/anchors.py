"""Windows of symbols and where they may repeat: identifiers by doubling, and windows grouped by content-chosen anchors.

A document is an array of symbols, each a 64-bit identifier (of a byte or of a word). The identifier of a run of 2k
symbols is made of those of its halves, id(i, 2k) = join(id(i, k), id(i + k, k)), so equal runs have equal identifiers.

Each window of `size` symbols picks as its anchor the q-gram within it that has the least identifier (the leftmost of
equal ones). Equal windows pick the same anchor at the same place, so a window can repeat only where its anchor's q-gram
does. Consecutive windows mostly share their anchor; such a run of windows is one row, 2 in size - q + 2 symbols on
average. No window is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_A, _C = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
#: Windows of a document that are looked at together; a longer document is cut, which leaves its windows as they are.
TILE = 1 << 17
_PLACE = U((1 << 20) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: Identifiers of the 256 bytes.
BYTES = mixed(np.arange(1, 257, dtype=U) * _A)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The identifier of a run from those of its two parts."""
    x = a * _A
    x ^= b
    x ^= x >> U(32)
    x *= _C
    return x


def byte_symbols(text: bytes) -> np.ndarray:
    return BYTES[np.frombuffer(text, np.uint8)]


def word_symbols(text: bytes, tile: int = 1 << 20) -> np.ndarray:
    """The identifiers of the words (runs of bytes that are no white space), in order."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + tile)
        b = np.frombuffer(text, np.uint8, end - at, at)
        if end < len(text):  # the tile ends at white space; a word longer than a tile makes the tile longer
            spaces = np.flatnonzero(_IS_SPACE[b])
            if not len(spaces):
                tile *= 2
                continue
            end = at + int(spaces[-1]) + 1
            b = b[: end - at]
        out.append(_words(b))
        at = end
    return np.concatenate(out) if out else np.empty(0, U)


def _words(b: np.ndarray) -> np.ndarray:
    solid = ~_IS_SPACE[b]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, U)
    at = np.flatnonzero(solid)
    nth = np.cumsum(first)[at] - 1  # the word of each byte
    place = at - starts[nth]
    powers = np.multiply.accumulate(np.concatenate(([U(1)], np.full(int(place.max()), _C, U))))
    sums = np.add.reduceat(BYTES[b[at]] * powers[place], np.searchsorted(at, starts))
    return mixed(sums + np.bincount(nth).astype(U) * _A)


class Ids:
    """Identifiers of runs of `length` symbols at every place, by doubling."""

    def __init__(self, symbols: np.ndarray, *lengths: int):
        self.of: dict[int, np.ndarray] = {}
        x, k = symbols, 1
        while True:
            for n in lengths:
                if k == n:
                    self.of[n] = x
                elif k < n < 2 * k:
                    self.of[n] = join(x[: len(x) - (n - k)], x[n - k :]) if len(x) > n - k else x[:0]
            if 2 * k > max(lengths) or len(x) <= k:
                break
            x, k = join(x[:-k], x[k:]), 2 * k
        for n in lengths:
            self.of.setdefault(n, symbols[:0])


@dataclass(frozen=True)
class Shape:
    """Windows of `size` symbols with anchors of `gram` symbols; `half` is the largest power of 2 up to size."""

    size: int
    gram: int

    @property
    def half(self) -> int:
        return 1 << (self.size.bit_length() - 1)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` consecutive elements."""
    k = 1
    while 2 * k <= width:
        x, k = np.minimum(x[:-k], x[k:]), 2 * k
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if width > k else x


def half_ids(symbols: np.ndarray, shape: Shape) -> np.ndarray:
    return Ids(symbols, shape.half).of[shape.half]


def window_ids(halves: np.ndarray, shape: Shape, starts: np.ndarray) -> np.ndarray:
    """The identifiers of the windows that begin at starts, from half_ids()."""
    return join(halves[starts], halves[starts + shape.size - shape.half])


def context_ids(halves: np.ndarray, shape: Shape, starts: np.ndarray, counts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The identifiers of runs of counts windows that begin at starts: of all the symbols they cover, and of counts and places.

    A run has size - gram + 1 windows at most, so three half-windows cover it.
    """
    end = starts + counts + shape.size - 1 - shape.half
    return join(join(halves[starts], halves[(starts + end) // 2]), join(halves[end], mixed((counts << 32 | places).astype(U))))


def runs(symbols: np.ndarray, shape: Shape, alive: np.ndarray | None = None):
    """Runs of windows with one anchor: arrays start, count, key (the anchor's identifier), context, place.

    alive tells of each window whether it is looked at; all are where it is None.

    place is the anchor's distance from the run's first window; context identifies the run's count, its place and all
    the symbols its windows cover. A window begins at the symbol of its number.
    """
    total = len(symbols) - shape.size + 1
    parts = []
    for at in range(0, max(0, total), TILE):
        n = min(TILE, total - at)
        part = _runs(symbols[at : at + n + shape.size - 1], shape, at, None if alive is None else alive[at : at + n])
        if len(part[0]):
            parts.append(part)
    if not parts:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _runs(symbols: np.ndarray, shape: Shape, at: int, alive: np.ndarray | None):
    ids = Ids(symbols, shape.gram, shape.half)
    grams, halves = ids.of[shape.gram], ids.of[shape.half]
    place = (grams & ~_PLACE) | np.arange(len(grams), dtype=U)
    anchor = (_least(place, shape.size - shape.gram + 1) & _PLACE).astype(np.int64)
    if alive is not None:
        anchor = np.where(alive, anchor, -1)
    first = np.concatenate(([0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1))
    count = np.diff(np.concatenate((first, [len(anchor)])))
    anchor = anchor[first]
    if alive is not None:
        first, count, anchor = (x[anchor >= 0] for x in (first, count, anchor))
    context = context_ids(halves, shape, first, count, anchor - first)
    return first + at, count, grams[anchor].view(np.int64), context.view(np.int64), anchor - first
