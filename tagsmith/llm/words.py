"""Words of a whole Arrow batch as numpy arrays: bounds, 64-bit hashes and owners, without a Python string per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tagsmith.llm.common import mix64

_RNG = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, and an odd base with its inverse: hash = sum of value[byte] * base**place.
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}

#: Texts are taken together until they hold this many bytes; a longer text is a chunk of its own.
CHUNK_BYTES = 400_000


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.ones(size, np.uint64)
        have[1:] = np.uint64(base)
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        if size <= 1 << 23:
            _POWERS[base] = have
    return have


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        end = min(end, len(texts))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_table(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash, owner) of each maximal run of word bytes within a text.

    is_word: 256 booleans; fold: 256 bytes to hash instead, or bytes already folded, as long as data.
    """
    inside = is_word[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    cut = offsets[1:-1]
    edge = before != after
    starts_here, ends_here = edge & after, edge & before
    joined = cut[before[cut] & after[cut]]  # a text ends in a word and the next begins with one
    starts_here[joined] = True
    ends_here[joined] = True
    start, end = np.flatnonzero(starts_here), np.flatnonzero(ends_here)
    folded = data if fold is None else fold[data] if len(fold) == 256 and fold is not data else fold
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[folded] * _powers(_BASE, len(data) + 1)[: len(data)], out=total[1:])
        h = (total[end] - total[start]) * _powers(_INVERSE, len(data) + 1)[start]
        h = mix64(h ^ (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    owner = np.searchsorted(offsets, start, "right") - 1
    return start, end, h, owner


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes, by the place of the first."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            out = out * np.uint64(0xC2B2AE3D27D4EB4F) + h[i : len(h) - k + 1 + i]
        return mix64(out)
