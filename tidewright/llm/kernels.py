"""Vectorised hashing of the words of many texts: numpy passes over the bytes of an Arrow batch.

A word's hash is a polynomial over its bytes, modulo 2**64, with a random odd factor per byte value, then mixed; equal
words have equal hashes on every machine. Separators are ASCII bytes, so cutting UTF-8 bytes cuts whole characters.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240607))
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def _powers(base: np.uint64, first: np.uint64, n: int) -> np.ndarray:
    """first, first * base, first * base**2, ..., n of them."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = first
    return np.cumprod(out)


#: Powers of _BASE from the first on and of its inverse from the zeroth on, for runs of texts as parts() makes them.
_UP, _DOWN = _powers(_BASE, _BASE, 1 << 18), _powers(_INVERSE, np.uint64(1), 1 << 18)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, set for the byte values in the inclusive ranges."""
    found = np.zeros(256, dtype=bool)
    for a, b in ranges:
        found[a : b + 1] = True
    return found


#: Words are runs of anything but ASCII white space.
WHITE = separators((0x20, 0x20), (0x09, 0x0D))
#: Words are runs of digits, letters and non-ASCII characters, after A-Z are lower-cased.
MARKS = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def parts(texts: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of texts of about `most` bytes in all; a longer text is a run of its own. Null is empty.

    Passes over the bytes make a dozen numbers of eight bytes for each: small runs keep these in the cache and workers small."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if n == 0:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64, count=n + 1, offset=texts.offset * 8)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, start, end) of every word, in order; A-Z are lower-cased before hashing."""
    if not len(data):
        z = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), z, z, z
    blank = sep[_lower][data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    begins = ~blank
    begins[1:] &= blank[:-1] | cut[1:-1]
    ends = ~blank
    ends[:-1] &= blank[1:] | cut[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        return np.zeros(0, dtype=np.uint64), start, start, start
    # each byte times a power of its place in all bytes; a word's sum is then moved to the word's start
    up, down = (_UP, _DOWN) if len(data) <= len(_UP) else (_powers(_BASE, _BASE, len(data)), _powers(_INVERSE, np.uint64(1), len(data)))
    value = np.where(sep[_lower], np.uint64(0), _VALUE[_lower])[data] * up[: len(data)]
    hashed = mix(np.add.reduceat(value, start) * down[start] + (end - start).astype(np.uint64) * _BASE)
    return hashed, np.searchsorted(offsets, start, "right") - 1, start, end


def shingles(hashed: np.ndarray, text: np.ndarray, n_texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct k-word shingles of every text, sorted; a text of fewer words is one shingle."""
    if not len(hashed):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    n = np.bincount(text, minlength=n_texts)
    g = hashed.copy()
    for step in range(1, min(k, len(g))):
        g[: len(g) - step] = mix(g[: len(g) - step] * _BASE + hashed[step:])
    whole = np.zeros(len(g), dtype=bool)
    whole[: max(0, len(g) - k + 1)] = text[: max(0, len(g) - k + 1)] == text[k - 1 :] if len(g) >= k else False
    at, hash_ = text[whole], g[whole]
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        first = np.concatenate([[0], np.cumsum(n)])[few]
        short = hashed[first].copy()
        for step in range(1, k - 1):
            more = n[few] > step
            short[more] = mix(short[more] * _BASE + hashed[first[more] + step])
        at, hash_ = np.concatenate([at, few]), np.concatenate([hash_, mix(short + n[few].astype(np.uint64))])
    order = np.lexsort((hash_, at))
    at, hash_ = at[order], hash_[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (hash_[1:] != hash_[:-1])
    return at[new], hash_[new]


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers by byte place, so that the zeros of small ones lie together and compress."""
    return x.astype(np.uint32).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pack_parts(kind: bytes, check: int, *parts: bytes) -> bytes:
    """A packet: its kind, a checksum of what it came from, and the parts."""
    return b"".join([kind, np.array([check, *map(len, parts)], dtype="<u8").tobytes(), *parts])


def unpack_parts(raw: bytes, n: int) -> tuple[int, list[bytes]]:
    """The checksum and the n parts."""
    check, *sizes = np.frombuffer(raw, "<u8", n + 1, 1).tolist()
    stops = np.cumsum([9 + 8 * n, *sizes]).tolist()
    return check, [raw[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)]


def trim() -> None:
    """Give memory that is free back to the system: workers live on from task to task, and would keep their largest task's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(f: Callable) -> Callable:
    """f, of one table or an iterator of batches, with trim() once its result is made."""

    def each(found: Iterator) -> Iterator:
        try:
            yield from found
        finally:
            trim()

    @wraps(f)
    def run(rows):
        found = f(rows)
        if isinstance(found, Iterator):
            return each(found)
        trim()
        return found

    return run
