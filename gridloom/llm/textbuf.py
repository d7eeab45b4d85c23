"""Vectorised word handling on Arrow string columns.

Works on the UTF-8 bytes of many texts at once: word borders by a byte table, two independent
64-bit hashes of each word, and hashes of windows of consecutive words. Every function takes
``buf`` (uint8, the texts end to end) and ``off`` (int64, n + 1 borders).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: The white space of the contracts: space and \\t \\n \\v \\f \\r.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: What ends a word of digits, letters a-z and anything beyond ASCII.
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[ord("0") : ord("9") + 1] = NOT_ALNUM[ord("a") : ord("z") + 1] = NOT_ALNUM[128:] = False
#: ASCII letters A-Z to a-z; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15
#: The word hash: two primes below 2**32 with bases of their own, for each of the independent hashes.
_PRIMES = ((4294967291, 4294967279), (4294967231, 4294967197))
_BASES = ((0x6A09E667, 0xBB67AE85), (0x3C6EF372, 0x510E527F))
#: Words of more bytes take a cryptographic hash.
_LONG = 64
_CHUNK = 1 << 18
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    h = h + np.uint64((salt * _BASE + 0x632BE59BD9B4E019) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a task's worker gives freed memory back to the system: workers go on to other stages, and what one
    stage has freed but kept would count against the next."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def give_back() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """``buf`` and ``off`` of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and len(off) else np.zeros(0, np.uint8)
    return buf, off - off[0] if len(off) else np.zeros(1, np.int64)


def pieces(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with about ``most`` bytes of text each; a longer text stands alone."""
    _, off = texts_of(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(buf: np.ndarray, off: np.ndarray, ends: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the row it lies in. ``ends``: the bytes outside words."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~ends[buf]
    first = off[:-1][off[:-1] < len(buf)]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[first] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[first[first > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def _power(base: int, prime: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of a base and of its inverse, modulo a prime."""
    if (base, prime) not in _powers:
        both = []
        for x in (base, pow(base, -1, prime)):
            out = np.ones(1, np.uint64)
            while len(out) < _CHUNK + _LONG:
                out = np.concatenate([out, out * np.uint64(pow(x, len(out), prime)) % np.uint64(prime)])
            both.append(out)
        _powers[base, prime] = (both[0], both[1])
    return _powers[base, prime]


def spans_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and do not overlap. ``salt``: 0 or 1, for two hashes that
    do not depend on each other. The working memory is bound by a chunk of text.

    A span is a polynomial of its bytes modulo two primes of 32 bits, so two unlike spans of L bytes share a hash with a chance
    of at most (L / 2**32)**2; spans of over 64 bytes take 64 bits of a keyed blake2b."""
    out = np.empty(len(start), np.uint64)
    long = end - start > _LONG
    if long.any():
        raw, key = memoryview(np.ascontiguousarray(buf)), b"words%d" % salt
        at = np.flatnonzero(long)
        found = (blake2b(raw[a:b], digest_size=8, key=key).digest() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True))
        out[at] = np.frombuffer(b"".join(found), np.uint64)
        rest = np.flatnonzero(~long)
        out[rest] = spans_hash(buf, start[rest], end[rest], salt)
        return out
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + _CHUNK, side="right")))
        lo, hi = int(start[at]), int(end[to - 1])
        own = buf[lo:hi].astype(np.uint64) + np.uint64(1)
        s, e = start[at:to] - lo, end[at:to] - lo
        h = np.zeros(to - at, np.uint64)
        for base, prime in zip(_BASES[salt], _PRIMES[salt], strict=True):
            up, down = _power(base, prime)
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(own * up[: hi - lo], out=total[1:])  # under 2**59
            h = (h << np.uint64(32)) | ((total[e] - total[s]) % np.uint64(prime) * down[s] % np.uint64(prime))
        out[at:to] = h
        at = to
    return mix(out)


def same_bytes(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each span of a (of ``size`` bytes, one at least) has the bytes of the span of b."""
    out = np.ones(len(size), bool)
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), side="right")))
        n = size[at:to]
        begin = np.cumsum(n) - n
        within = np.arange(n.sum()) - np.repeat(begin, n)
        unlike = a[within + np.repeat(a_start[at:to], n)] != b[within + np.repeat(b_start[at:to], n)]
        out[at:to] = ~np.logical_or.reduceat(unlike, begin)
        at = to
    return out


def windows(h: np.ndarray, row: np.ndarray, size: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each window of ``size`` consecutive words of one row, and the index of its first word."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    own = mix(h, salt) if salt else h
    by = np.uint64((0xD6E8FEB86659FD93 + 2 * salt) % 2**64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * by + own[j : n + j]
    at = np.flatnonzero(row[:n] == row[size - 1 :])
    return mix(out[at]), at


def covered(n: int, at: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Which of n words lie in a window that starts at one of ``at``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + size, -1)
    return np.cumsum(change[:-1]) > 0


def per_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """The sum of the values of each row, as long."""
    return np.bincount(row, weights=values, minlength=n)[:n].astype(np.int64)
