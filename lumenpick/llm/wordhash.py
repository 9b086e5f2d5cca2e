"""64-bit hashes of words and of runs of words.

A run of words hashes to the sum of word hash times an odd base to the power of
its place, modulo 2^64, shifted back to the start of the run.  So the hash of
any run comes from two prefix sums, equal runs agree wherever they stand, and a
word can be left out of a run in constant time.  A word in turn hashes to such a
sum over its bytes, so whole columns are cut and hashed without a loop over
rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(kind: str, n: int) -> np.ndarray:
    known = _POWERS[kind]
    if len(known) < n:
        factor = np.full(max(n, 2 * len(known)), _BASE if kind == "up" else _INVERSE, np.uint64)
        factor[0] = 1
        known = _POWERS[kind] = np.multiply.accumulate(factor)
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _powers("up", len(hashes)), out=out[1:])
    return out


def run_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unmixed hashes of the runs [start, end)."""
    return (sums[ends] - sums[starts]) * _powers("down", len(sums))[starts]


def window_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """Unmixed hashes of all windows of `width` words."""
    n = max(0, len(sums) - width)
    return (sums[width:] - sums[:n]) * _powers("down", len(sums))[:n]


def joined(left: np.ndarray, right: np.ndarray, left_len: np.ndarray) -> np.ndarray:
    """Unmixed hashes of left runs followed by right runs, as if they stood in one text."""
    top = int(left_len.max()) + 1 if len(left_len) else 1
    return left + right * _powers("up", top)[left_len]


# --- whole Arrow columns at once ------------------------------------------------

#: Bytes of text that are cut into words together.
_PIECE = 1 << 18
_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False
_ALNUM = np.array([bytes([b]).isalnum() for b in range(256)])
_LOWER = np.arange(256)
_LOWER[65:91] += 32
#: A 64-bit value per byte.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


@dataclass(frozen=True)
class Words:
    """The words of some neighbouring rows of a column; places are bytes of `data`."""

    first_row: int
    data: np.ndarray
    row_starts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    #: Row r (counted from first_row) has the words bounds[r] to bounds[r + 1].
    bounds: np.ndarray
    hashes: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        """Per word its row in the column."""
        return np.repeat(np.arange(self.first_row, self.first_row + len(self.bounds) - 1), np.diff(self.bounds))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the places where its rows begin, the end included; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def row_pieces(offsets: np.ndarray, size: int = _PIECE):
    """Ranges of rows of about `size` bytes, at least one row each."""
    at, n = 0, len(offsets) - 1
    while at < n:
        until = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, until
        at = until


def _hashes_of(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        until = max(at + 1, int(np.searchsorted(starts, starts[at] + _PIECE)))
        low = starts[at]
        sums = prefix_sums(bytes_[part[low : ends[until - 1]]])
        out[at:until] = run_hashes(sums, starts[at:until] - low, ends[at:until] - low)
        at = until
    return mix(out + (ends - starts).astype(np.uint64))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of single words, as column_words gives them."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    return _hashes_of(np.frombuffer(b"".join(words), np.uint8), ends - np.diff(ends, prepend=0), ends, _BYTE)


def token_column(column: pa.Array):
    """The same for runs of ASCII letters and digits, A-Z hashed like a-z."""
    yield from column_words(column, True, _ALNUM)


def column_words(column: pa.Array, lower: bool = False, solid_bytes: np.ndarray = _SOLID):
    """The words of a column, some hundred KB of rows at a time; lower: hash A-Z like a-z."""
    data, offsets = text_bytes(column)
    bytes_ = _BYTE[_LOWER] if lower else _BYTE
    for first, last in row_pieces(offsets):
        part, edges = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        solid = solid_bytes[part]
        begins, finish = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        finish[:-1] &= ~solid[1:]
        inner = edges[(edges > 0) & (edges < len(part))]
        begins[inner] = solid[inner]
        finish[inner - 1] = solid[inner - 1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(finish) + 1
        yield Words(first, part, edges[:-1], starts, ends, np.searchsorted(starts, edges), _hashes_of(part, starts, ends, bytes_))


def offsets_array(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """Lists of the given lengths over flat values."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one range after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)
