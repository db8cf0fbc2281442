"""Vectorised access to the UTF-8 bytes of Arrow text columns.

Everything here works on slices of bounded size, so that a batch of many rows
or one very long text costs memory in proportion to the text, not a multiple
of the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step takes.
SLICE_BYTES = 1 << 20

_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: ASCII white space: space and the code points 9 to 13.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words (two multiply and shift rounds)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SLICE_BYTES + 1, n + 1)
    if size not in _powers:
        up, down = np.full(size, _BASE), np.full(size, _BASE_INVERSE)
        up[0] = down[0] = _U(1)
        tables = np.cumprod(up), np.cumprod(down)
        if size > SLICE_BYTES + 1:
            return tables
        _powers[size] = tables
    return _powers[size]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; a null has no bytes."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows with about SLICE_BYTES of text; a longer row is alone."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def _hash_piece(data: np.ndarray, row_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of ``data``; words end at white space and at row starts."""
    inside = ~WHITE[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    cut = row_starts[row_starts < len(data)]
    before[cut] = False
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[cut[cut > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = _power_tables(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    return mix(hashes + (ends - starts).astype(np.uint64)), starts, ends


def hash_words(data: np.ndarray, offsets: np.ndarray, *, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some rows, and the n + 1 word offsets of the rows.

    Words are maximal runs without ASCII white space; ``lower`` folds A-Z.
    A text longer than SLICE_BYTES is taken in pieces that end at white space.
    """
    if lower:
        data = LOWER[data]
    hashes, starts, done = [], [], 0
    while done < len(data):
        end = len(data)
        if end - done > 2 * SLICE_BYTES:
            window = done + SLICE_BYTES
            gap = np.flatnonzero(WHITE[data[window:]][: 64 * SLICE_BYTES])
            end = window + int(gap[0]) if len(gap) else end
        piece = data[done:end]
        rows = offsets[(offsets >= done) & (offsets < end)] - done
        h, s, _ = _hash_piece(piece, rows)
        hashes.append(h)
        starts.append(s + done)
        done = end
    all_hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    all_starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return all_hashes, np.searchsorted(all_starts, offsets)


_SHINGLE_FACTORS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of one row.

    Fewer than ``n`` words make one shingle of the whole row, none make no shingle.
    """
    if not len(words):
        return np.zeros(0, np.uint64)
    width = min(n, len(words))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        total += words[i : len(words) - width + 1 + i] * _SHINGLE_FACTORS[i]
    return np.unique(mix(total + _U(width)))
