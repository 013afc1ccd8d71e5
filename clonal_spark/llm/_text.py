"""Vectorised text primitives that the operators share: slabs of documents as byte arrays."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer document makes a slab of its own.
SLAB_BYTES = 2 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.default_rng(20240517)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_WORD_VALUE = np.where(_SEPARATOR, np.uint64(0), _VALUE)
_BASE = 0x9E3779B97F4A7C15 | 1


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(pow(base, done, 1 << 64))
        done += take
    return out[:n]


_POWERS = powers(_BASE, SLAB_BYTES + 1)


_INVERSES = powers(pow(_BASE, -1, 1 << 64), SLAB_BYTES + 1)


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    if n <= len(_POWERS):
        return _POWERS, _INVERSES
    return powers(_BASE, n), powers(pow(_BASE, -1, 1 << 64), n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (splitmix's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Slab:
    """first: the batch's row of the slab's first document. offsets: of documents in data."""

    first: int
    data: np.ndarray
    offsets: np.ndarray


def slabs(text: pa.Array, limit: int = SLAB_BYTES) -> Iterator[Slab]:
    """A null counts as an empty text."""
    text = text.fill_null("") if text.null_count else text
    if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type):
        kind = np.int64
    else:
        kind = np.int32
    buffers = text.buffers()
    at = np.frombuffer(buffers[1], kind)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i, n = 0, len(text)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield Slab(i, data[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def segment_sum(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[start:end]; empty ranges give 0."""
    total = np.zeros(len(values) + 1, np.uint64 if values.dtype == np.uint64 else np.int64)
    np.cumsum(values, out=total[1:])
    return total[ends] - total[starts]


@dataclass
class Words:
    """Of a slab: byte ranges and hashes of words, and the first word of each document."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray


def ranges_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] of non-empty ranges."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    weights, inverse = _upto(len(data) + 1)
    weighed = value[data]
    weighed *= weights[: len(data)]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(weighed, out=total[1:])
    out = total[ends] - total[starts]
    out *= inverse[starts]
    out += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(out)


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words [^\\x20\\x09-\\x0D]+ of each document of a slab."""
    apart = _SEPARATOR[data]
    inside = ~apart
    begins = inside.copy()
    begins[1:] &= apart[:-1]
    stops = inside.copy()
    stops[:-1] &= apart[1:]
    cut = offsets[:-1][offsets[:-1] < offsets[1:]]  # a word never crosses documents
    begins[cut] = inside[cut]
    stops[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = inside[offsets[1:][offsets[:-1] < offsets[1:]] - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(starts, ends, ranges_hash(data, starts, ends, _WORD_VALUE), np.searchsorted(starts, offsets))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each word on (the last n - 1 are missing), whatever document they are of."""
    count = max(0, len(hashes) - n + 1)
    out = np.zeros(count, np.uint64)
    for j in range(n):
        out += hashes[j : j + count] * np.uint64(pow(0xC2B2AE3D27D4EB4F, j, 1 << 64))
    return mix(out)


def release() -> None:
    """Gives memory that a task no longer needs back to the system: a worker lives on for tasks of other kinds."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)
