"""Words of Arrow text columns as 64-bit hashes, without a Python object per word.

Works on the column's bytes in blocks of about a megabyte, cut between words, so the memory beside
the column itself does not depend on how long a text is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: separators of words made of ASCII letters, digits and all characters beyond ASCII
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]], ends - ends[0]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(BLOCK + 4096, 1 << (n - 1).bit_length())
    if size not in _powers:
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers.clear()
        _powers[size] = tuple(out)
    return _powers[size]


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES, heads: int = 0) -> tuple[np.ndarray, ...]:
    """(hash of every word, first word of every text and the end).  A-Z count as a-z.

    With ``heads``, also a hash of each word's first so many bytes, 0 for words that are not longer.
    """
    n = len(data)
    hashes, head_hashes, first_words = [], [], np.zeros(len(offsets), np.int64)
    start, words, text = 0, 0, 0
    while start < n:
        end = min(start + BLOCK, n)
        if end < n:
            nearest = int(np.searchsorted(offsets, end, side="right")) - 1
            if offsets[nearest] > start:
                end = int(offsets[nearest])
            else:  # inside one text: go on to its next separator
                while end < n and not separators[data[end]]:
                    end += 1
                end = min(end, int(offsets[np.searchsorted(offsets, start, side="right")]))
        block = data[start:end]
        inside = ~separators[block]
        inner = offsets[(offsets > start) & (offsets < end)] - start
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        before[inner] = False
        begins = inside & ~before
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        after[inner - 1] = False
        s, e = np.flatnonzero(begins), np.flatnonzero(inside & ~after) + 1
        powers, inverses = _power_tables(len(block) + 1)
        total = np.zeros(len(block) + 1, np.uint64)
        np.cumsum((LOWER[block].astype(np.uint64) + np.uint64(1)) * powers[:len(block)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * inverses[s] + (e - s).astype(np.uint64)))
        if heads:
            code, folded = np.zeros(len(s), np.uint64), LOWER[block]
            for k in range(heads):
                code = code << np.uint64(8) | folded[np.minimum(s + k, len(block) - 1)].astype(np.uint64)
            head_hashes.append(np.where(e - s > heads, mix(code + np.uint64(1)), np.uint64(0)))
        while text < len(offsets) and offsets[text] < end:
            first_words[text] = words + int(np.searchsorted(s, offsets[text] - start)) if offsets[text] >= start else first_words[text]
            text += 1
        words += len(s)
        start = end
    first_words[text:] = words
    joined = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return (joined(hashes), first_words, joined(head_hashes)) if heads else (joined(hashes), first_words)
