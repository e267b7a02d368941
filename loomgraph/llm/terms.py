"""Terms of texts, for Arrow batches: runs of ASCII letters, of digits too if asked, and of all that is not ASCII; lower-cased
in A to Z only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .shared import steps, words

#: Bytes of text that one step takes at once, some 30 times that in memory; a longer document is one step of its own.
STEP = 1 << 21

_CODES = np.arange(256)
_UPPER = (_CODES >= 0x41) & (_CODES <= 0x5A)
_LOWER = (np.where(_UPPER, _CODES + 32, _CODES)).astype(np.uint8)
_DIGIT = (_CODES >= 0x30) & (_CODES <= 0x39)
_OTHER = ~(_UPPER | (_CODES >= 0x61) & (_CODES <= 0x7A) | (_CODES >= 0x80))


def terms(texts: pa.Array, digits: bool):
    """(first row, number of terms of each row, all terms one after another) of consecutive rows; null has none.

    digits: whether digits belong to terms."""
    between = _OTHER & ~_DIGIT if digits else _OTHER
    for at, offsets, data in steps(texts, STEP):
        starts, ends, first = words(offsets, data, between)
        ends_at = np.concatenate(([0], np.cumsum(ends - starts)))
        letters = _LOWER[data[~between[data]]]  # without what is between, the terms stand side by side
        flat = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends_at.astype(np.int64)), pa.py_buffer(letters))
        yield at, np.diff(first), flat


def counted(sizes: np.ndarray, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, occurrences) of rows of `sizes` codes each, all below n; negative codes are left out."""
    at = np.repeat(np.arange(len(sizes)), sizes)
    seen = codes >= 0
    key, times = np.unique(at[seen] * n + codes[seen], return_counts=True)
    return key // max(n, 1), key % max(n, 1), times
