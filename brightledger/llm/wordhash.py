"""Words of many texts at once, as 64-bit hashes, for operators that run inside Arrow batches.

A text is its UTF-8 bytes with A-Z lowered; words lie between ASCII white space. Two words have one hash only if they are
equal, but for a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ODD = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(ODD, -1, 1 << 64)
#: Bytes of text that are worked on at once; a longer text is one part.
PART = 1 << 19
#: Powers that are kept for the next texts: for parts, and for chunks of a megabyte.
KEPT = (1 << 20) + 2


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; those of usual parts and chunks are kept."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(n if n > KEPT else KEPT if n > PART + 2 else PART + 2, base, dtype=np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if n <= KEPT:
            _POWERS[base] = known
    return known[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits, one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Of the texts first ... first+n-1 of a batch: the words' hashes, their text's number in the part, and the words' places."""

    first: int
    n: int
    hashes: np.ndarray
    of: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    sums: np.ndarray
    back: np.ndarray

    def bounds(self) -> np.ndarray:
        """Where each text's words begin and, last, their number."""
        return np.searchsorted(self.of, np.arange(self.n + 1))

    def prefix(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first bytes of the words longer than that, and which words they are."""
        which = np.flatnonzero(self.ends - self.starts > size)
        at = self.starts[which]
        return mixed((self.sums[at + size] - self.sums[at]) * self.back[at] + np.uint64(size)), which


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of a string column; nulls are empty."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return at - at[0], raw


def parts(offsets: np.ndarray, most: int = PART) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, min(to, n)
        at = to


def words(column: pa.Array, most: int = PART) -> Iterator[Words]:
    """The words of a string column, part by part."""
    offsets, raw = buffers(column)
    for first, last in parts(offsets, most):
        at = offsets[first : last + 1] - offsets[first]
        text = LOWER[raw[offsets[first] : offsets[last]]]
        n = len(text)
        inside = ~BLANK[text]
        cut = np.zeros(n + 1, dtype=bool)
        cut[at] = True
        before = np.concatenate([[False], inside])[:n]
        after = np.concatenate([inside, [False]])[1:]
        starts = np.flatnonzero(inside & (~before | cut[:n]))
        ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers(ODD, n), out=sums[1:])
        back = powers(INVERSE, n + 1)
        hashes = mixed((sums[ends] - sums[starts]) * back[starts])
        of = np.searchsorted(at, starts, side="right") - 1
        yield Words(first, last - first, hashes, of, starts, ends, sums, back)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words and their texts' numbers; a text of fewer words is one run, one without words none."""
    bounds = w.bounds()
    count = np.diff(bounds)
    wide = np.maximum(count - size + 1, np.minimum(count, 1))
    of = np.repeat(np.arange(w.n), wide)
    start = bounds[:-1][of] + np.arange(len(of)) - np.repeat(np.cumsum(wide) - wide, wide)
    length = np.minimum(count[of], size)
    out = length.astype(np.uint64)
    for k in range(size):
        here = length > k
        at = start[here] + k
        out[here] = mixed(out[here] * np.uint64(ODD) + w.hashes[at])
    return out, of
