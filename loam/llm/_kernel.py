"""Vectorised text kernels shared by the corpus operators.

A word is a maximal run of ASCII letters, digits, ``_`` and non-ASCII bytes.
Words are compared after lower-casing ASCII and Latin-1 letters.  Every kernel
works on the UTF-8 buffer of an Arrow string column, so no Python string is
made for a word: bytes are only classified, and words are hashed eight bytes
at a time over all words at once.
Nulls are treated as empty texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MUL = U64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 18

_WORD = np.zeros(256, bool)
_WORD[0x80:] = True
for _c in b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_":
    _WORD[_c] = True
_SPACE = np.zeros(256, bool)
for _c in b" \t\n\r\x0b\x0c":
    _SPACE[_c] = True
#: 0 space, 1 word, 2 anything else: tokens of words() by class are runs of one kind
CLASSES = np.where(_WORD, 1, 2).astype(np.uint8)
CLASSES[_SPACE] = 0
_WORDS = _WORD.astype(np.uint8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (splitmix64's)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    """Another hash function of the same values for each salt."""
    return mix(x ^ U64((salt * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF))


class Words:
    """The words of some texts: hash, byte bounds, and each text's slice of them."""

    __slots__ = ("ends", "hashes", "offsets", "starts")

    def __init__(self, hashes, starts, ends, offsets):
        self.hashes, self.starts, self.ends, self.offsets = hashes, starts, ends, offsets

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether they lie in one text."""
        h, m = self.hashes, len(self.hashes)
        ok = np.ones(m, bool)
        if n == 1 or not m:
            return h, ok
        out = h.copy()
        for j in range(1, n):
            out *= U64(0x9FB21C651E98DF25)
            out[: m - j] += h[j:]
            last = self.offsets[1:] - j
            ok[last[last >= 0]] = False
        return mix(out), ok


def _piece(buf: np.ndarray, offs: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(buf)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.zeros(n + 8, np.uint8)
    np.take(_LOWER, buf, out=low[:n])
    c3 = np.flatnonzero(buf[:-1] == 0xC3) + 1
    if len(c3):
        nxt = buf[c3]
        low[c3[(nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)]] += 0x20
    kind = kinds[buf]
    word = kind > 0
    first, last = word.copy(), word.copy()
    turn = kind[1:] != kind[:-1]
    first[1:] &= turn
    last[:-1] &= turn
    full = offs[1:] > offs[:-1]
    at = offs[:-1][full]
    first[at] = word[at]
    at = offs[1:][full] - 1
    last[at] = word[at]
    st, en = np.flatnonzero(first), np.flatnonzero(last) + 1
    eight = np.ndarray((n + 1,), U64, low, strides=(1,))  # the 8 bytes from each byte on
    size = en - st
    h = eight[st] & _MASK[np.minimum(size, 8)]
    h = (h ^ (h >> U64(29))) * _MUL
    more, k = np.flatnonzero(size > 8), 8
    while len(more):
        x = eight[st[more] + k] & _MASK[np.minimum(size[more] - k, 8)]
        h[more] = (mix(h[more]) ^ x) * _MUL
        k += 8
        more = more[size[more] > k]
    h += size.astype(U64) * U64(0xC2B2AE3D27D4EB4F)
    return mix(h), st, en


def words(buf: np.ndarray, offs: np.ndarray, kinds: np.ndarray = _WORDS) -> Words:
    """Words of the texts buf[offs[i]:offs[i+1]]; long inputs go in pieces cut between words.

    With kinds=CLASSES, runs of other signs than spaces are tokens too."""
    parts, lo, n = [], 0, len(buf)
    while True:
        hi = min(n, lo + 4 * _CHUNK)
        while hi < n and kinds[buf[hi]] and kinds[buf[hi]] == kinds[buf[hi - 1]]:
            hi += 1
        parts.append((*_piece(buf[lo:hi], np.clip(offs, lo, hi) - lo, kinds), lo))
        if hi >= n:
            break
        lo = hi
    st = np.concatenate([s + o for _, s, _, o in parts])
    return Words(np.concatenate([p[0] for p in parts]), st, np.concatenate([e + o for _, _, e, o in parts]), np.searchsorted(st, offs))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column, nulls as empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, o, d = col.buffers()
    offs = np.frombuffer(o, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(d, np.uint8) if d is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(col: pa.Array, size: int = _CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of whole texts of about size bytes; a longer text is its own run."""
    data, offs = buffers(col)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over [offsets[i], offsets[i+1]), empty ones 0."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """63 bits of a hash as int64, so that order is the same in numpy and the JVM."""
    return (x >> U64(1)).view(np.int64)


#: The same words by plain string operations, for tests and for small side inputs.
_SLOW = re.compile("[0-9A-Za-z_\x80-\U0010ffff]+")
_FOLD = {c: c + 32 for c in (*range(65, 91), *range(0xC0, 0xDF)) if c != 0xD7}


def slow_words(text: str | None) -> list[str]:
    return [w.translate(_FOLD) for w in _SLOW.findall(text or "")]


def hash_words(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return words(raw, np.array([0, len(raw)])).hashes
