"""Vectorised views of text as UTF-8 bytes, shared by the operators that read every word.

Arrow hands a task its strings as one byte buffer; here that buffer is cut into words and hashed with
numpy, so no Python object is made per word. Memory is bounded by SLICE bytes of text at a time (or by one
document, where a document is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.
SLICE = 1 << 18

#: The white space of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
#: Lower case for A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.default_rng(20240229)
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = 1 << int(n - 1).bit_length()
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            table = np.full(size, np.uint64(base))
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, bytes, starts): consecutive rows of about `limit` bytes together.

    bytes holds the rows' UTF-8 with one newline before each row and one at the very end; row i's text is
    bytes[starts[i] + 1 : starts[i + 1]]. Nulls read as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        local = offsets[lo : hi + 1] - offsets[lo]
        starts = local + np.arange(hi - lo + 1)
        out = np.empty(int(local[-1]) + hi - lo + 1, np.uint8)
        holds = np.ones(len(out), bool)
        holds[starts] = False
        out[starts] = 10
        out[holds] = raw[offsets[lo] : offsets[hi]]
        yield lo, hi, out, starts
        lo = hi


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end positions of the words [^\x20\x09-\x0D]+; data must begin and end with white space."""
    inside = ~SPACE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return edges[0::2], edges[1::2]


def span_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[first:end]: differences of a running polynomial, brought to a common power and mixed."""
    up, down = _power_tables(len(data) + 1)
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=running[1:])
    return mix((running[end] - running[first]) * down[first])
