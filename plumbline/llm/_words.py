"""Words, word hashes and shingles of Arrow text columns, computed with numpy over whole texts."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True
#: All but ASCII letters and the bytes of non-ASCII characters.
_NO_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_GRAM = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit matters."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, CHUNK)
        made = []
        for base in (_BASE, _INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        if size > 4 * CHUNK:  # one very long text: not worth keeping
            return made[0], made[1]
        _powers = made[0], made[1]
    return _powers


def raw(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and each text's first byte (one more entry than texts). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    got = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return got, at - at[0]


class Words:
    """start, end: byte places of each word; first: index of each text's first word, one more entry than texts; hash.

    Words are what white space leaves, or with letters runs of letters. stems: for each n given, a hash of the first n
    bytes of each longer word, and 0 for the others.
    """

    def __init__(self, column: pa.ChunkedArray | pa.Array, lower: bool = False, letters: bool = False, stems: tuple[int, ...] = ()):
        self.data, self.at = raw(column)
        n = len(self.at) - 1
        starts, ends, codes, counts = [], [], [], np.zeros(n + 1, np.int64)
        parts: list[list[np.ndarray]] = [[] for _ in stems]
        for a, b in self._chunks():
            lo, hi = self.at[a], self.at[b]
            part = self.data[lo:hi]
            ink = ~(_NO_LETTER if letters else _IS_SPACE)[part]
            cut = np.zeros(len(part) + 1, bool)
            cut[self.at[a : b + 1] - lo] = True
            fresh = ink.copy()
            fresh[1:] &= ~ink[:-1] | cut[1:-1]
            last = ink
            last[:-1] &= ~ink[1:] | cut[1:-1]
            s, e = np.flatnonzero(fresh), np.flatnonzero(last) + 1
            counts[a + 1 : b + 1] = np.diff(np.searchsorted(s, self.at[a : b + 1] - lo))
            starts.append(s + lo)
            ends.append(e + lo)
            up, down = _power(len(part) + 1)
            table = _BYTE[_LOWER] if lower else _BYTE
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(table[part] * up[: len(part)], out=total[1:])
            codes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
            for k, n in enumerate(stems):
                long = np.flatnonzero(e - s > n)
                code = np.zeros(len(s), np.uint64)
                code[long] = mix((total[s[long] + n] - total[s[long]]) * down[s[long]] + np.uint64(n << 32))
                parts[k].append(code)
        cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
        self.start, self.end = cat(starts, np.int64), cat(ends, np.int64)
        self.hash = cat(codes, np.uint64)
        self.stems = [cat(x, np.uint64) for x in parts]
        self.first = np.cumsum(counts)

    def _chunks(self) -> Iterator[tuple[int, int]]:
        a, n = 0, len(self.at) - 1
        while a < n:
            b = max(a + 1, int(np.searchsorted(self.at, self.at[a] + CHUNK, "right")) - 1)
            yield a, b
            a = b

    @property
    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and 64-bit hash of every run of n words of one text."""
        if len(self.hash) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        size = len(self.hash) - n + 1
        total = np.zeros(size, np.uint64)
        for k in range(n):
            total += self.hash[k : k + size] * _GRAM[k % 64]
        left = np.repeat(self.first[1:], np.diff(self.first))[:size]
        at = np.flatnonzero(np.arange(size) + n <= left)
        return at, mix(total[at])


def freeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob, for exchange between tasks of one job. Bytes of one rank lie together: sorted hashes
    and small numbers then compress."""
    planes = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes.append((a.dtype.str, a.shape, a.reshape(-1).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()))
    return zstandard.compress(pickle.dumps(planes, 5), 1)


def thaw(blob: bytes) -> list[np.ndarray]:
    out = []
    for kind, shape, planes in pickle.loads(zstandard.decompress(blob)):
        dtype = np.dtype(kind)
        raw_ = np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, -1)
        out.append(np.ascontiguousarray(raw_.T).view(dtype).reshape(shape))
    return out


def short(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 on in as few bytes as hold the largest."""
    most = int(x.max(initial=0))
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..counts[0]-1, 0..counts[1]-1 and so on, end to end."""
    total = int(counts.sum())
    out = np.arange(total, dtype=np.int64)
    return out - np.repeat(np.cumsum(counts) - counts, counts)
