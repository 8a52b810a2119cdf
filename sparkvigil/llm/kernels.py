"""Vectorised word, shingle and window hashes over Arrow text columns.

Words are runs of bytes outside 0x20 and 0x09 to 0x0D, which is the class ``[^\\x20\\x09-\\x0D]+`` on UTF-8.
All hashes are 64-bit and the same in every batch, task and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text worked on at once; a longer document is a piece of its own.
CHUNK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = U(0x9E3779B97F4A7C15 | 5)
SALT = U(0xD6E8FEB86659FD93)
_powers = np.ones(1, U)
_inverse = np.ones(1, U)


def powers(n: int) -> np.ndarray:
    """BASE ** 0 .. BASE ** (n - 1) modulo 2 ** 64."""
    global _powers
    if len(_powers) < n:
        made = np.full(max(n, 1024), BASE, U)
        made[0] = 1
        _powers = np.cumprod(made)
    return _powers[:n]


def inverse_powers(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        made = np.full(max(n, 1024), U(pow(int(BASE), -1, 1 << 64)), U)
        made[0] = 1
        _inverse = np.cumprod(made)
    return _inverse[:n]


def _tag(n: int) -> U:
    return U(n * int(SALT) & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def chunks(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of bounded bytes; null is empty."""
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    n = len(col)
    if not n:
        return
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + CHUNK, "right")) - 1)
        to = min(to, n)
        yield at, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


class Words:
    """Words of a run of documents: byte spans, hashes, and the first word of each document."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False):
        solid = ~SPACE[data]
        before = np.empty_like(solid)
        before[:1] = False
        before[1:] = solid[:-1]
        cuts = offs[:-1][offs[:-1] < len(data)]
        before[cuts] = False
        self.starts = np.flatnonzero(solid & ~before)
        after = np.empty_like(solid)
        after[-1:] = False
        after[:-1] = solid[1:]
        ends_at = offs[1:][offs[1:] > 0] - 1
        after[ends_at] = False
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.starts, offs)
        self.count = np.diff(self.first)
        lens = self.ends - self.starts
        if len(lens):
            inner = LOWER[data[solid]] if lower else data[solid]
            heads = np.cumsum(lens) - lens
            place = np.arange(len(inner)) - np.repeat(heads, lens)
            value = inner.astype(U)
            value += U(1)
            value *= powers(int(lens.max()) + 1)[place]
            self.hashes = mix(np.add.reduceat(value, heads) + lens.astype(U) * SALT)
        else:
            self.hashes = np.zeros(0, U)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on (of any document; see ``starting``)."""
        h, n = self.hashes, len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, U)
        out = np.full(n, _tag(k), U)
        for j in range(k):
            out += h[j : j + n] * U(pow(int(BASE), j + 1, 1 << 64) | 1)
        return mix(out)

    def windows(self, k: int, salt: int = 0) -> np.ndarray:
        """As grams, for large k: from prefix sums."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, U)
        sums = np.zeros(len(self.hashes) + 1, U)
        np.cumsum((mix(self.hashes + U(salt)) if salt else self.hashes) * powers(len(self.hashes)), out=sums[1:])
        return mix((sums[k:] - sums[:n]) * inverse_powers(n) + _tag(k))


def shingle_sets(words: Words, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each document; with fewer words the whole sequence is one; without, none."""
    grams, out = words.grams(k), []
    for at, n in zip(words.first[:-1].tolist(), words.count.tolist(), strict=True):
        if n >= k:
            s = np.sort(grams[at : at + n - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif n:
            h = words.hashes[at : at + n]
            out.append(mix(np.sum(h * powers(n + 1)[1:], keepdims=True) + _tag(n + 77)))
        else:
            out.append(np.zeros(0, U))
    return out


def deal(part: np.ndarray, n_parts: int, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """(part, the columns' bytes) for each part that has rows."""
    order = np.argsort(part.astype(np.uint16) if n_parts < 65536 else part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(n_parts + 1))
    columns = tuple(c[order] for c in columns)
    for p in range(n_parts):
        a, b = ends[p], ends[p + 1]
        if b > a:
            yield p, [c[a:b].tobytes() for c in columns]


def joined(blobs: list[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)
