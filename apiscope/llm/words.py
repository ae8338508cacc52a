"""Words of whole texts as arrays: places and 64-bit hashes, no object per word.

A word is a run of digits, ASCII letters and any characters beyond ASCII, the
pattern ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.
All bytes of a character beyond ASCII are 0x80 or more, so the rule holds byte
by byte in UTF-8.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

_byte = np.arange(256)
_LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte)
_IS_WORD = ((_byte >= 48) & (_byte <= 57)) | ((_LOWER >= 97) & (_LOWER <= 122)) | (_byte >= 128)
_VALUE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=_U)[_LOWER]
_powers: dict[int, np.ndarray] = {}


class Words(NamedTuple):
    doc: np.ndarray    # number of the text
    start: np.ndarray  # first byte, within all bytes of the slice
    end: np.ndarray    # byte after the last
    hash: np.ndarray   # of the lower-cased bytes
    first: np.ndarray  # number of the first word of each text, and of all words at the end


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value of each 64-bit value (SplitMix64's finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest of usual lengths is kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1), base, dtype=_U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 1 << 22:
            _powers[base] = have
    return have[:n]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array (null: none) and where each text begins and ends."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def words(texts: pa.Array) -> Words:
    """Words of a string array, text by text (null and empty texts have none)."""
    raw, at = utf8(texts)
    n = len(raw)
    inside = _IS_WORD[raw]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[at[:-1][at[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    total = np.zeros(n + 1, _U)
    np.cumsum(_VALUE[raw] * _power(_BASE, n), out=total[1:])
    value = mixed((total[end] - total[start]) * _power(_INVERSE, n)[start]
                  + (end - start).astype(_U))
    first = np.searchsorted(start, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return Words(doc, start, end, value, first)
