"""Words, shingles and their hashes as numpy arrays, inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered for up to ``most`` words."""

    def __init__(self, most: int = 400_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the words of a text, A-Z lower-cased, split at ASCII white space."""
        words = (text or "").encode("utf-8", "replace").lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Numbers of XXH3: of words of 1 to 3 bytes, of 4 to 8, of 9 to 16.
FLIP3, FLIP8, FLIP_LO, FLIP_HI = (np.uint64(v) for v in (0x87275A9B, 0xC73AB174C5ECD5A2, 0x6782737BEA4239B9, 0xAF56BC3B0996523A))
BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _folded(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Upper and lower half of the 128-bit products, combined by exclusive or."""
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    a, b, c, d = x & low, x >> half, y & low, y >> half
    ac, bc, ad = a * c, b * c, a * d
    cross = (ac >> half) + (bc & low) + ad
    return ((bc >> half) + (cross >> half) + b * d) ^ ((cross << half) | (ac & low))


def word_hashes(texts: list, words: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes ``words.of`` each text, one text after another, and the offsets of the texts; words of up to 16 bytes by columns (XXH3)."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    joined = b" ".join([b"", *raw, b" " * 16]).lower()
    byte = np.frombuffer(joined, np.uint8)
    edges = np.flatnonzero(np.diff(BLANK[byte].view(np.int8))) + 1
    start, n = edges[::2], edges[1::2] - edges[::2]
    begins = 1 + np.cumsum([0, *(len(r) + 1 for r in raw)])
    four, eight = (np.ndarray((len(byte) - k + 1,), f"<u{k}", joined, strides=(1,)) for k in (4, 8))
    out, wide = np.empty(len(start), np.uint64), np.uint64
    with np.errstate(over="ignore"):
        i = np.flatnonzero(n <= 3)
        s, m = start[i], n[i]
        h = ((byte[s].astype(wide) << wide(16)) | (byte[s + (m >> 1)].astype(wide) << wide(24)) | byte[s + m - 1].astype(wide) | (m.astype(wide) << wide(8))) ^ FLIP3
        h = (h ^ (h >> wide(33))) * wide(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> wide(29))) * wide(0x165667B19E3779F9)
        out[i] = h ^ (h >> wide(32))
        i = np.flatnonzero((n > 3) & (n <= 8))
        s, m = start[i], n[i]
        h = (four[s + m - 4].astype(wide) + (four[s].astype(wide) << wide(32))) ^ FLIP8
        h = (h ^ _turned(h, 49) ^ _turned(h, 24)) * wide(0x9FB21C651E98DF25)
        h = (h ^ ((h >> wide(35)) + m.astype(wide))) * wide(0x9FB21C651E98DF25)
        out[i] = h ^ (h >> wide(28))
        i = np.flatnonzero((n > 8) & (n <= 16))
        s, m = start[i], n[i]
        lo, hi = eight[s] ^ FLIP_LO, eight[s + m - 8] ^ FLIP_HI
        h = m.astype(wide) + lo.byteswap() + hi + _folded(lo, hi)
        h = (h ^ (h >> wide(37))) * wide(0x165667919E3779F9)
        out[i] = h ^ (h >> wide(32))
    i = np.flatnonzero(n > 16)
    out[i] = np.fromiter((words[joined[a:b]] for a, b in zip(start[i].tolist(), (start[i] + n[i]).tolist())), wide, len(i))
    return out, np.searchsorted(start, begins)


def shingles_of(words: np.ndarray, offsets: np.ndarray, least: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of several texts, one text after another, and the offsets of the texts; texts of fewer than ``least`` >= width words have none."""
    sizes = np.diff(offsets)
    n = np.where(sizes >= least, sizes - width + 1, 0)
    out = np.concatenate([[0], np.cumsum(n)])
    if not out[-1]:
        return words[:0], out
    every = shingles(words, width)
    return every[np.arange(out[-1]) + np.repeat(offsets[:-1] - out[:-1], n)], out


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """One hash per window of ``width`` words; fewer words, but not none, are one shingle."""
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    out = np.full(n, np.uint64(len(words[:width])))
    with np.errstate(over="ignore"):
        for k in range(min(width, len(words))):
            out = mix(out * GOLDEN + words[k : k + n])
    return out
