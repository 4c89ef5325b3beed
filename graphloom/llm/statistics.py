"""Statistics of a text's form, for classifiers: no identifiers, labels, languages or sources among them."""

from __future__ import annotations

import numpy as np

from .kernels import LOWER, SPACE, U64, Words

_CLASS = np.zeros((256, 7), dtype=bool)
_CLASS[0x41:0x5B, 0] = True  # upper
_CLASS[0x61:0x7B, 1] = True  # lower
_CLASS[0x30:0x3A, 2] = True  # digit
_CLASS[:, 3] = SPACE
_CLASS[[ord(c) for c in ".,;:!?'\"()-"], 4] = True
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-"], 5] = True
_CLASS[0x80:, 6] = True
NAMES = [
    "log_bytes", "log_words", "mean_word", "upper", "lower", "digit", "space", "punctuation", "symbol", "high", "lines",
    "distinct_words", "top_repeat", "shouted", "marked", "stopped", "single",
]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each document; an empty one has zeros throughout."""
    n = np.diff(offsets).astype(float)
    words = Words(data, offsets)
    count = np.diff(words.bounds).astype(float)
    out = np.zeros((len(n), len(NAMES)))

    def per_byte(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(n, 1)

    def per_word(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(flags)))
        return (total[words.bounds[1:]] - total[words.bounds[:-1]]) / np.maximum(count, 1)

    length = words.stop - words.start
    out[:, 0], out[:, 1] = np.log1p(n), np.log1p(count)
    out[:, 2] = np.minimum(per_word(length), 50) / 10
    for j in range(7):
        out[:, 3 + j] = per_byte(_CLASS[data, j])
    out[:, 10] = np.minimum(per_byte(data == 10) * 20, 1)
    doc = np.repeat(np.arange(len(n)), np.diff(words.bounds))
    order = np.lexsort((words.hash, doc))
    d, h = doc[order], words.hash[order]
    fresh = np.ones(len(d), dtype=bool)
    fresh[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    out[:, 11] = np.bincount(d[fresh], minlength=len(n)) / np.maximum(count, 1)
    again = np.zeros(len(words.hash), dtype=bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])
    out[:, 12] = per_word(again)
    if len(data):
        first, last = data[words.start], data[words.stop - 1]
        second = data[np.minimum(words.start + 1, words.stop - 1)]
        out[:, 13] = per_word(_CLASS[first, 0] & _CLASS[second, 0] & (length > 1))
        out[:, 14] = per_word(_CLASS[last, 5])
        out[:, 15] = per_word(_CLASS[last, 4])
        out[:, 16] = per_word((length == 1) & _CLASS[first, 5])
    return out


def folded_words(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words of lower-cased documents in which bytes that are neither letters, digits nor parts of them count as blanks."""
    low = LOWER[data]
    letters = _CLASS[low, 1] | _CLASS[low, 2] | _CLASS[low, 6]
    low = np.where(letters, low, np.uint8(32))
    return Words(low, offsets), low


__all__ = ["NAMES", "U64", "folded_words", "statistics"]
