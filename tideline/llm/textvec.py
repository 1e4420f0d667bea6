"""Hashed token features of Arrow string columns, in numpy over whole buffers.

A token is a run of bytes of one class; in scripts that write without spaces each
sign is one. Prefix sums of byte * R**i (modulo 2**64)
give the hash of any token, or of its first bytes, without a Python object for
it. Texts are worked on in slices of bounded size; a longer text is cut between
tokens (inside one only if it alone is longer than a slice), so whole texts count
and memory does not grow with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

R = 0x9E3779B97F4A7C15
SLICE = 1 << 18
SPACE, LETTER, DIGIT, MARK = 0, 1, 2, 3


#: First UTF-8 bytes of scripts that write without spaces (Thai and its neighbours; Chinese, Japanese, Korean).
SIGN_LEADS = np.array([0xE0, *range(0xE3, 0xEE)], np.uint8)


def _classes() -> np.ndarray:
    table = np.full(256, MARK, np.uint8)
    table[:33] = SPACE
    table[[ord(c) for c in "0123456789"]] = DIGIT
    table[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
    return table


CLASS = _classes()


@lru_cache(1)
def _powers(n: int = SLICE + 64) -> tuple[np.ndarray, np.ndarray]:
    def powers(x: int) -> np.ndarray:
        a = np.full(n, x, np.uint64)
        a[0] = 1
        return np.cumprod(a, dtype=np.uint64)

    return powers(R), powers(pow(R, -1, 1 << 64))


def mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt * 0xBF58476D1CE4E5B9 & (1 << 64) - 1)) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and len + 1 offsets into them; nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


class Slice:
    """Tokens of a stretch of bytes: start, end, kind, doc; and hashes of any of their prefixes."""

    def __init__(self, raw: np.ndarray, doc_of_byte: np.ndarray):
        accent = np.r_[False, raw[:-1] == 0xC3] & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)
        upper = (raw >= 65) & (raw <= 90)
        folded = raw + np.where(upper | accent, 32, 0).astype(np.uint8)
        kind = CLASS[raw]
        self.upper = np.r_[0, np.cumsum(upper)]
        new = np.r_[True, (kind[1:] != kind[:-1]) | (doc_of_byte[1:] != doc_of_byte[:-1]) | np.isin(raw[1:], SIGN_LEADS)]
        start = np.flatnonzero(new)
        end = np.r_[start[1:], len(raw)]
        real = kind[start] != SPACE
        self.start, self.end = start[real], end[real]
        self.kind, self.doc = kind[self.start], doc_of_byte[self.start]
        power, self.inverse = _powers()
        self.sums = np.r_[np.uint64(0), np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], dtype=np.uint64)]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def slices(column: pa.Array) -> Iterator[Slice]:
    """The column's tokens in slices; `doc` counts rows of the column. A text may go over several slices."""
    data, offsets = buffers(column)
    at, stop = int(offsets[0]), int(offsets[-1])
    while at < stop:
        end = min(stop, at + SLICE)
        if end < stop:
            doc = int(np.searchsorted(offsets, end, side="right")) - 1
            if offsets[doc] > at:
                end = int(offsets[doc])
            else:  # one text fills the slice: cut before its last token
                gaps = np.flatnonzero(CLASS[data[at:end]] == SPACE)
                end = at + int(gaps[-1]) if len(gaps) and gaps[-1] > 0 else end
        first = int(np.searchsorted(offsets, at, side="right")) - 1
        last = int(np.searchsorted(offsets, end, side="left"))
        cuts = np.clip(offsets[first : last + 1], at, end)
        yield Slice(data[at:end], np.repeat(np.arange(first, last), np.diff(cuts)))
        at = end
