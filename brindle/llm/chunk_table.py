"""Token ids of space-separated chunks, looked up for many texts at once.

A byte-level pattern always starts a new word at a single space between two other characters, so a text is split there and
each distinct chunk is encoded once. The table is a few flat arrays: sorted chunk hashes, and where each chunk's ids lie."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from brindle.llm.fingerprints import mix

#: Chunks longer than this are hashed one by one.
LONG_BYTES = 256
_A = np.uint64(0x9E3779B97F4A7C15)
#: Keeps the first 1 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(1, 9)], np.uint64)


def chunk_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each raw[start:end], eight bytes at a time."""
    from xxhash import xxh3_64_intdigest

    padded = raw + bytes(8)
    lanes = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    size = ends - starts
    out = mix(size.astype(np.uint64) * _A)
    left, at, short = size.copy(), starts.copy(), np.flatnonzero((size > 0) & (size <= LONG_BYTES))
    while len(short):
        out[short] = mix((out[short] ^ (lanes[at[short]] & _FIRST[np.minimum(left[short], 8) - 1])) * _A)
        left[short] -= 8
        at[short] += 8
        short = short[left[short] > 0]
    for i in np.flatnonzero(size > LONG_BYTES).tolist():
        out[i] = xxh3_64_intdigest(raw[starts[i] : ends[i]])
    return out


class ChunkTable:
    """learn gets distinct chunks and returns one array of ids, and where in it each chunk's ids start and how many they are."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]], most: int):
        self.learn, self.most = learn, most
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.start, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool, self.used = np.empty(1 << 16, "<u4"), 0

    def _add(self, keys: np.ndarray, at: np.ndarray, chunks: list[str]) -> None:
        ids, start, size = self.learn(chunks)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(max(len(self.pool), len(ids)), "<u4")])
        self.pool[self.used : self.used + len(ids)] = ids
        self.keys = np.insert(self.keys, at, keys)
        self.start = np.insert(self.start, at, self.used + start)
        self.size = np.insert(self.size, at, size)
        self.used += len(ids)

    def split(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """ids of raw split at spaces, and the number of ids of each chunk."""
        if len(self.keys) > self.most:  # a full table is emptied, so its size does not grow with the input
            self.clear()
        spaces = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
        starts, ends = np.append(0, spaces + 1), np.append(spaces, len(raw))
        key, first, back = np.unique(chunk_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, key)
        new = np.append(self.keys, np.uint64(0))[at] != key
        new |= at == len(self.keys)
        if new.any():
            self._add(key[new], at[new], [raw[s:e].decode("utf-8", "surrogatepass") for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            at = np.searchsorted(self.keys, key)
        size = self.size[at][back]
        after = np.cumsum(size)
        return self.pool[np.repeat(self.start[at][back] - (after - size), size) + np.arange(after[-1])], size

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """ids of each text split at spaces."""
        if not texts:
            return []
        ids, size = self.split(b" ".join(texts))
        chunks = np.cumsum([t.count(b" ") + 1 for t in texts])
        return np.split(ids, np.cumsum(size)[chunks - 1][:-1])
