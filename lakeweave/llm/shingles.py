"""Sets of word shingles as sorted arrays of 64-bit hashes, and compact forms of such arrays for shuffles."""

from __future__ import annotations

import numpy as np
import xxhash
import zstandard

_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_33 = np.uint64(33)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _33)) * _C1
    x = (x ^ (x >> _33)) * _C2
    return x ^ (x >> _33)


def _odd(n: int) -> np.ndarray:
    """``n`` odd 64-bit constants."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


class Shingler:
    """Texts to sets of shingles of ``width`` words. A word is a run of anything but ASCII white space, A-Z lower-cased.
    A text with fewer words is one shingle of all of them; a text without words, or null, is the empty set."""

    def __init__(self, width: int = 5):
        self.width, self.hashes = width, _WordHashes()
        self.factors, self.ends = _odd(width), _odd(width + 1)

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        held: list[list[bytes]] = []
        n = 0
        for text in texts:
            words = (text or "").encode().lower().split()  # bytes.split() knows ASCII white space only
            held.append(words)
            n += len(words)
            if n > 400_000:
                out += self._sets(held)
                held, n = [], 0
        return out + self._sets(held)

    def _sets(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        k = self.width
        sizes = [len(d) for d in docs]
        flat = np.fromiter((h for d in docs for h in map(self.hashes.__getitem__, d)), np.uint64, sum(sizes))
        whole = np.zeros(max(0, len(flat) - k + 1), np.uint64)
        for i in range(k):
            whole += flat[i : i + len(whole)] * self.factors[i]
        whole = mixed(whole + self.ends[k])
        out, at = [], 0
        for n in sizes:
            if n >= k:
                s = np.sort(whole[at : at + n - k + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif n:
                out.append(mixed((flat[at : at + n] * self.factors[:n]).sum(dtype=np.uint64, keepdims=True) + self.ends[n]))
            else:
                out.append(np.empty(0, np.uint64))
            at += n
        return out


def min_hashes(sets: list[np.ndarray], count: int) -> np.ndarray:
    """``count`` 32-bit minima of each non-empty set under different orders."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    out = np.empty((len(sets), count), np.int32)
    for i, factor in enumerate(_odd(count)):
        out[:, i] = (np.minimum.reduceat(flat * factor, starts) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


class Parities:
    """Of each set some eight bits an element: whether an odd number of elements have that remainder.

    What two sets have in common cancels out, so they differ in as many elements as bits, or more. Bits are a power of
    two; the longer bits of two sets are folded to the length of the shorter ones.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.level = np.array([(max(0, len(s) - 1) >> 3).bit_length() for s in sets], np.int64)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        above, bits = np.empty(0, np.int64), np.empty((0, 2 << int(self.level.max(initial=0))), np.uint64)
        for level in range(int(self.level.max(initial=0)), -1, -1):
            width = 1 << level
            new = np.flatnonzero(self.level == level)
            own = [self._bits(sets[i], width) for i in new.tolist()]
            bits = np.concatenate([bits[:, :width] ^ bits[:, width:], np.array(own, np.uint64).reshape(len(own), width)])
            above = np.concatenate([above, new])
            at = np.zeros(len(sets), np.int64)
            at[above] = np.arange(len(above))
            self.tables[level] = at, bits

    @staticmethod
    def _bits(values: np.ndarray, width: int) -> np.ndarray:
        odd = np.bincount((values % np.uint64(64 * width)).astype(np.int64), minlength=64 * width) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.uint64)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs of sets, in how many elements they differ at least."""
        out, level = np.zeros(len(i), np.int64), np.minimum(self.level[i], self.level[j])
        for one in np.unique(level).tolist():
            at, bits = self.tables[one]
            these = np.flatnonzero(level == one)
            step = max(1, 500_000 >> one)
            for k in range(0, len(these), step):
                p = these[k : k + step]
                out[p] = np.bitwise_count(bits[at[i[p]]] ^ bits[at[j[p]]]).sum(axis=1, dtype=np.int64)
        return out


def squeeze(values: np.ndarray) -> bytes:
    """Compressed 64-bit integers: byte planes of the values, so that equal high bytes cost nothing."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def squeeze_sorted(values: np.ndarray) -> bytes:
    return squeeze(np.diff(values, prepend=values.dtype.type(0)))


def expand_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data), dtype=np.uint64)
