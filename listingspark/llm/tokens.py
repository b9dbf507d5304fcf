"""Words of Arrow string columns as flat numpy arrays, without a Python object for each word.

UTF-8 keeps ASCII separators and other bytes apart, so words are found and hashed on the column's own buffer. Work is done
in blocks of about ``BLOCK`` bytes, which bounds memory for texts of any length.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x + _U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(max(0, n - 1), base, _U)]))


class Alphabet:
    """Which bytes are in words, and a random number for each as it counts (A-Z as a-z if ``lower``)."""

    def __init__(self, separators: bytes, lower: bool):
        self.inside = np.ones(256, bool)
        self.inside[list(separators)] = False
        self.fold = np.arange(256, dtype=np.uint8)
        if lower:
            self.fold[ord("A") : ord("Z") + 1] += 32
        self.inside = self.inside[self.fold]
        self.value = np.where(self.inside, mix(self.fold.astype(_U), 1) | _U(1), _U(0))


#: Words end at ASCII white space.
SPACED = Alphabet(b"\x20\x09\x0a\x0b\x0c\x0d", False)
SPACED_LOWER = Alphabet(b"\x20\x09\x0a\x0b\x0c\x0d", True)
#: Words are of digits, letters and anything beyond ASCII.
ALNUM_LOWER = Alphabet(bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122)), True)


class Words(NamedTuple):
    hashes: np.ndarray  # of each word
    docs: np.ndarray  # row of each word
    starts: np.ndarray  # byte offsets in buf
    ends: np.ndarray
    first: np.ndarray  # for each row, its first word's number; one more at the end
    buf: np.ndarray


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets; null counts as empty."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data and len(column) else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def tokenize(column: pa.Array, alphabet: Alphabet) -> Words:
    buf, offsets = flat(column)
    inside = alphabet.inside[buf]
    before = np.zeros(len(buf) + 1, bool)
    before[1:] = inside
    cut = offsets[:-1][np.diff(offsets) > 0]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(buf) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    first = np.searchsorted(starts, offsets)
    docs = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    hashes = np.empty(len(starts), _U)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + BLOCK)))
        a, b = int(starts[at]), int(ends[to - 1])
        own = starts[at:to] - a
        place = np.arange(b - a) - np.repeat(own, np.diff(np.append(own, b - a)))
        with np.errstate(over="ignore"):
            terms = alphabet.value[buf[a:b]] * powers(int(_BASE), int(place.max()) + 1)[place]
            hashes[at:to] = mix(np.add.reduceat(terms, own), 2)
        at = to
    return Words(hashes, docs, starts, ends, first, buf)


def windows(w: Words, size: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(Rabin-Karp hash of the ``size`` words from each word on, whether they lie in one row). Rolled by prefix sums
    of powers, so a window costs the same at any size."""
    n = len(w.hashes) - size + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, bool)
    base = int(mix(np.array([salt + 3], _U))[0]) | 1
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(w.hashes, salt) * powers(base, len(w.hashes)), dtype=_U)])
        hashes = (sums[size:] - sums[:-size]) * powers(pow(base, -1, 1 << 64), n)
    return mix(hashes, salt + 4), w.docs[size - 1 :] == w.docs[:n]


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each ``size`` consecutive numbers, by doubling."""
    out, span = x, 1
    while 2 * span <= size:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(x) - size + 1], out[size - span :]) if size > span else out
