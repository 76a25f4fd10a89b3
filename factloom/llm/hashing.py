"""Vectorised hashing of words, shingles and byte runs over Arrow batches (numpy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of ASCII that are neither letters nor digits: white space, control characters, punctuation.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[b for b in range(128) if not chr(b).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that are hashed at once.
SLICE = 1 << 21


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    up = np.ones(1, U)
    down = np.ones(1, U)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                x = np.full(size, base, U)
                x[0] = 1
                setattr(cls, name, np.multiply.accumulate(x))
        return cls.up[:n], cls.down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums of bytes: what run_hash takes."""
    up, _ = _Powers.to(len(buf) + 1)
    out = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * up[: len(buf)], out=out[1:])
    return out


def run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes start to end; the same bytes give the same hash wherever they stand."""
    _, down = _Powers.to(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))


def text_slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, their bytes, offsets) of a string or binary array, in slices of about SLICE bytes."""
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        to = min(to, n)
        yield at, to - at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(buf: np.ndarray, offsets: np.ndarray, lower: bool = True, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, hash) of every word of a slice, in order."""
    if lower:
        buf = LOWER[buf]
    inside = ~space[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]  # a row's first byte starts a word, its last byte ends one
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return row, start, end, run_hash(prefix_sums(buf), start, end)


def shingles(row: np.ndarray, h: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of k words; a row of fewer words, but one at least, gives its whole sequence as one run."""
    n = np.bincount(row, minlength=rows) if len(row) else np.zeros(rows, np.int64)
    roll = h.copy()
    for j in range(1, k):
        roll[: len(h) - j] = mix(roll[: len(h) - j] * U(0x2545F4914F6CDD1D) + h[j:]) if len(h) > j else roll[:0]
    full = np.zeros(len(h), bool)
    if len(h) >= k:
        full[: len(h) - k + 1] = row[: len(h) - k + 1] == row[k - 1 :]
    short = np.flatnonzero((n > 0) & (n < k))
    if not len(short):
        return row[full], roll[full]
    begin = np.concatenate([[0], np.cumsum(n)])
    extra = []
    for r in short:  # at most k - 1 words each
        x = h[begin[r] : begin[r] + 1].copy()
        for w in h[begin[r] + 1 : begin[r + 1]]:
            x = mix(x * U(0x2545F4914F6CDD1D) + w)
        extra.append(mix(x + U(int(n[r]))))
    at = np.concatenate([row[full], short])
    order = np.argsort(at, kind="stable")
    return at[order], np.concatenate([roll[full], *extra])[order]
