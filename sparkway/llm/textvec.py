"""Vectorised work on the UTF-8 bytes of Arrow string columns.

Word classes that are defined by ASCII characters can be read off the bytes:
each byte of a multi-byte character is 0x80 or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are worked on at once: some ten arrays of eight bytes a byte stand beside them.
CHUNK = 1 << 18
_U = np.uint64
_MUL = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MUL, -1, 1 << 64)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    lut = np.zeros(256, bool)
    for lo, hi in ranges:
        lut[lo : hi + 1] = True
    return lut


#: Everything but white space 0x20, 0x09-0x0D.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Digits, letters (A-Z to be lower-cased) and all non-ASCII.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection, so distinct values stay distinct."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def byte_keys(lower: bool) -> np.ndarray:
    """A 64-bit value for each byte; A-Z share those of a-z if `lower`."""
    keys = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))
    if lower:
        keys[0x41:0x5B] = keys[0x61:0x7B]
    return keys


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row starts; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    wide = pa.types.is_large_string(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array, size: int = CHUNK, rows: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of at most `rows` whole rows of about `size` bytes, a longer row alone."""
    body, offs = buffers(column)
    row, n = 0, len(offs) - 1
    while row < n:
        end = min(max(row + 1, int(np.searchsorted(offs, offs[row] + size, "right")) - 1), row + rows)
        yield row, end, body[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


class Powers:
    """Powers of the multiplier and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _MUL), ("down", _INV)):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up, self.down


POWERS = Powers()


def words(body: np.ndarray, offs: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row its first word's number (one more at the end)."""
    w = lut[body]
    n = len(body)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    begin, stop = w.copy(), w.copy()
    begin[1:] &= ~w[:-1]
    stop[:-1] &= ~w[1:]
    cut = offs[(offs > 0) & (offs < n)]
    begin[cut] = w[cut]
    stop[cut - 1] = w[cut - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offs)


def span_hash(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from one pass of prefix sums."""
    n = len(body)
    up, down = POWERS.get(n + 1)
    acc = np.zeros(n + 1, np.uint64)
    np.cumsum(keys[body] * up[:n], out=acc[1:])
    return mix((acc[ends] - acc[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(0xA24BAED4963EE407))


def runs_of(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i : i+k] for each i (len(h)-k+1 of them), order-sensitive."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(k):
        out = out * _U(_MUL) + h[j : j + m]
    return mix(out)
