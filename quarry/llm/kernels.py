"""Byte-level word hashing over Arrow text columns, in numpy: no Python object per word.

Hashes find words and never prove that two are equal: where that matters, same_bytes compares the words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
CHUNK = 1 << 19  # bytes of text cut at once
PIECE = 1 << 22  # a longer single text is cut in pieces at separators
LONG = 256  # bytes of a word that are read eight by eight; a longer one is digested as a whole
MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], U)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift and multiply), a bijection."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def folded(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z, and eight zeros behind, so that eight bytes can be read from any place."""
    z = np.zeros(len(data) + 8, np.uint8)
    np.take(FOLD, data, out=z[: len(data)], mode="clip")
    return z


def eights(z: np.ndarray, start: np.ndarray, size: np.ndarray, c: int) -> np.ndarray:
    """Bytes 8c to 8c + 8 of the stretches of z as one number each, zero beyond their end."""
    every = np.ndarray((len(z) - 7,), "<u8", z, strides=(1,))
    return every[start + 8 * c] & MASKS[np.minimum(size - 8 * c, 8)]


def word_hashes(z: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each stretch of z that chains a finaliser over its bytes eight by eight, from its length on."""
    if not len(start):
        return np.empty(0, U)
    h = mix(mix(size.astype(U) * ODD) ^ (eights(z, start, size, 0) * ODD))
    more, c = np.flatnonzero((size > 8) & (size <= LONG)), 1
    while len(more):
        h[more] = mix(h[more] ^ (eights(z, start[more], size[more], c) * ODD))
        c += 1
        more = more[size[more] > 8 * c]
    for i in np.flatnonzero(size > LONG):
        h[i] = np.frombuffer(hashlib.blake2b(z[start[i] : start[i] + size[i]].tobytes(), digest_size=8).digest(), U)[0]
    return h


def same_bytes(z: np.ndarray, start: np.ndarray, size: np.ndarray, z2: np.ndarray, start2: np.ndarray, size2: np.ndarray) -> np.ndarray:
    """Whether stretches of z and of z2 have the very same bytes, pair by pair."""
    out = size == size2
    more, c = np.flatnonzero(out & (size <= LONG)), 0
    while len(more):
        ok = eights(z, start[more], size[more], c) == eights(z2, start2[more], size[more], c)
        out[more[~ok]] = False
        c += 1
        more = more[ok & (size[more] > 8 * c)]
    for i in np.flatnonzero(out & (size > LONG)):
        out[i] = np.array_equal(z[start[i] : start[i] + size[i]], z2[start2[i] : start2[i] + size[i]])
    return out


class Cut:
    """Words of some texts: their hashes, offsets of each text's words, and where in z (folded) each stands."""

    __slots__ = ("at", "h", "size", "start", "z")

    def __init__(self, h: np.ndarray, at: np.ndarray, z: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.h, self.at, self.z, self.start, self.size = h, at, z, start, size

    def heads(self, k: int) -> np.ndarray:
        """Hashes of the words' first k bytes, k at most 8; shorter words whole."""
        size = np.minimum(self.size, k)
        return mix(mix(size.astype(U) * ODD) ^ (eights(self.z, self.start, size, 0) * ODD))

    def word(self, i: int) -> bytes:
        return self.z[self.start[i] : self.start[i] + self.size[i]].tobytes()


def joined(cuts: list[Cut]) -> Cut:
    """Pieces of one text as one."""
    if len(cuts) == 1:
        return Cut(cuts[0].h, np.array([0, len(cuts[0].h)]), cuts[0].z, cuts[0].start, cuts[0].size)
    base = np.cumsum([0, *(len(c.z) for c in cuts)])
    h, z, size = (np.concatenate([getattr(c, k) for c in cuts]) for k in ("h", "z", "size"))
    return Cut(h, np.array([0, len(h)]), z, np.concatenate([c.start + b for c, b in zip(cuts, base, strict=False)]), size)


class Words:
    """Which bytes make words; A-Z count as a-z. kinds: a number for each byte; apart: which kinds are cut between, too."""

    def __init__(self, separators: list[tuple[int, int]], kinds: np.ndarray | None = None, apart: np.ndarray | None = None):
        self.word, self.kinds, self.apart = np.ones(256, bool), kinds, apart
        for low, high in separators:
            self.word[low : high + 1] = False

    def of(self, data: np.ndarray, offsets: np.ndarray) -> Cut:
        """The words of the texts data[offsets[i]:offsets[i+1]]."""
        base, n = int(offsets[0]), int(offsets[-1] - offsets[0])
        x = data[base : base + n]
        if n == 0:
            none = np.empty(0, np.int64)
            return Cut(np.empty(0, U), np.zeros(len(offsets), np.int64), folded(x), none, none)
        isw = self.word[x]
        first = isw.copy()
        first[1:] &= ~isw[:-1]
        last = isw.copy()
        last[:-1] &= ~isw[1:]
        cuts = (offsets[1:-1] - base).astype(np.int64)
        cuts = cuts[(cuts > 0) & (cuts < n)]
        first[cuts] = isw[cuts]
        last[cuts - 1] = isw[cuts - 1]
        if self.kinds is not None:
            kind = self.kinds[x]
            apart = self.apart[(kind[:-1] << 3) | kind[1:]]
            first[1:] |= apart
            last[:-1] |= apart
        start, size = np.flatnonzero(first), np.flatnonzero(last) + 1
        size -= start
        z = folded(x)
        return Cut(word_hashes(z, start, size), np.searchsorted(start, offsets - base), z, start, size)

    def texts(self, column: pa.Array) -> Iterator[tuple[int, int, Cut]]:
        """(first row, end row, their words) for runs of rows of about CHUNK bytes; null is empty."""
        data, offsets = buffers(column)
        i, rows = 0, len(offsets) - 1
        while i < rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
            if offsets[j] - offsets[i] > PIECE:
                yield i, j, joined([self.of(data, np.array([a, b])) for a, b in self.pieces(data, int(offsets[i]), int(offsets[j]))])
            else:
                yield i, j, self.of(data, offsets[i : j + 1])
            i = j

    def pieces(self, data: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int]]:
        """Cuts one long text at separators; a word longer than a piece stays whole."""
        while a < b:
            end = min(a + PIECE, b)
            while end < b and self.word[data[end]]:
                gap = np.flatnonzero(~self.word[data[end : end + PIECE]])
                end = end + int(gap[0]) if len(gap) else min(end + PIECE, b)
            yield a, end
            a = end


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a text column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, off, body = column.buffers()
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)), offsets


#: Words of `[^\x20\x09-\x0D]+` and of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z.
SPACED = Words([(0x20, 0x20), (0x09, 0x0D)])
LETTERS = Words([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


def _runs() -> Words:
    """Words cut into runs of ASCII letters, single digits and runs of other ASCII characters; an apostrophe stays with what
    follows, and nothing is cut next to a byte beyond ASCII.
    """
    kinds = np.zeros(256, np.uint8)  # 0: never cut at
    for c in range(0x21, 0x7F):
        kinds[c] = 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 4 if c == 0x27 else 3
    apart = np.zeros(64, bool)
    for a, b in ((1, 2), (1, 3), (1, 4), (2, 1), (2, 2), (2, 3), (2, 4), (3, 1), (3, 2), (4, 2)):
        apart[a << 3 | b] = True
    return Words([(0x20, 0x20), (0x09, 0x0D)], kinds, apart)


RUNS = _runs()


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive hashes (len - k + 1 of them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U)
    out = np.zeros(n, U)
    for j in range(k):
        out = out * U(0xD6E8FEB86659FD93) + words[j : j + n]
    return mix(out + U(k))


def binary(values: list[np.ndarray]) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())
