"""Text as numbers: words, pre-tokens and shingles of many texts at once, straight from Arrow's buffers.

Texts of one slice lie one after another in a byte array. The hash of a span of up to ``SHORT`` bytes is a polynomial over its
bytes modulo 2**64, taken from prefix sums, so its cost doesn't depend on Python's objects, and mixed. Such a polynomial
is blind to some long spans, whatever its base (those of 1024 bytes and more that differ by the Thue-Morse sequence), so
longer spans, which are few, have a keyed BLAKE2b of 64 bits. Equal spans have equal hashes; where a collision would give
wrong results and not only a missed or spare candidate, ``distinct_spans`` compares the bytes as well.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

SHORT = 32

#: ASCII white space: 9 to 13 and 32.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, from 0 to n at least."""
    if len(_POWERS[0]) <= n:
        for k, b in enumerate((_BASE, _INVERSE)):
            _POWERS[k] = np.concatenate([np.ones(1, U64), np.cumprod(np.full(n, b, U64))])
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit moves every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _digest(data: np.ndarray, start: int, end: int, turn: int = 0) -> int:
    return int.from_bytes(hashlib.blake2b(data[start:end].tobytes(), digest_size=8, key=b"span%d" % turn).digest(), "little")


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    out = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))
    for i in np.flatnonzero(ends - starts > SHORT).tolist():
        out[i] = _digest(data, starts[i], ends[i])
    return out


def _unlike(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, like: np.ndarray, at_once: int = 1 << 16) -> np.ndarray:
    """The spans whose bytes aren't those of the span ``like`` them."""
    size = ends - starts
    odd = [np.flatnonzero(size != size[like])]
    same = np.flatnonzero((size == size[like]) & (like != np.arange(len(like))))
    for at in range(0, len(same), at_once):
        some = same[at : at + at_once]
        n = size[some]
        differ = data[ranges(starts[some], n)] != data[ranges(starts[like[some]], n)]
        if differ.any():
            odd.append(some[np.unique(np.repeat(np.arange(len(some)), n)[differ])])
    return np.concatenate(odd)


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, first span of each, which of them each span has): equal if and only if the bytes are.

    Spans that share a hash but not the bytes get another one, the same wherever those spans occur in this order.
    """
    hashes, turn = hashes.copy(), 0
    while True:
        distinct, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        odd = _unlike(data, starts, ends, where[which])
        if not len(odd):
            return distinct, where, which
        turn += 1
        for i in odd.tolist():
            hashes[i] = _digest(data, starts[i], ends[i], turn)


def view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array without copying; a null is empty."""
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if large else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null(b"" if "binary" in str(texts.type) else "")
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Gives freed memory back, as Python workers are kept for other tasks while new ones start beside them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do without
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of at most ``limit`` bytes of text or a single row; in the end, memory is given back."""
    for batch in batches:
        texts = batch.column(column)
        _, offsets = view(texts)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    release()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and after the last) of the runs without ASCII white space."""
    n = len(data)
    inside = np.ones(n + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct k-word shingles, of lower-cased A-Z; a text of fewer words has all of them as one."""
    low = LOWER[data]
    starts, ends, bound = words(low, offsets)
    one = span_hashes(low, starts, ends)
    total = np.zeros(max(len(one) - k + 1, 0), U64)
    for i in range(k):
        total = total * U64(0xD6E8FEB86659FD93) + one[i : len(one) - k + 1 + i]
    total = mix(total)
    out = []
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(total[a : b - k + 1]))
        elif b > a:
            whole = np.array([b - a], U64)
            for i in range(a, b):
                whole = mix(whole * U64(3) ^ one[i : i + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, U64))
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of each range, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)
