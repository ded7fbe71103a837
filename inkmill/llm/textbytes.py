"""Word and window hashes of Arrow string batches, in numpy over the UTF-8 bytes.

A word is a run of bytes other than space and \\t to \\r, as in `[^\\x20\\x09-\\x0D]+`. A word's hash
sums one random 64-bit number for each byte and its place in the word, read off prefix sums, then
mixed; all words of a stretch of about a megabyte are hashed at once. The numbers of different places
are independent, so no arrangement of a word's bytes gives two words one hash by construction, as
it would with a polynomial modulo 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

STRETCH = 1 << 20
U64 = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD = ~_SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLACES = 64
#: One number for each of the first places in a word and each byte; later places mix theirs again.
_TERM = np.random.default_rng(20240229).integers(0, 1 << 64, _PLACES * 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Words:
    """Words of some consecutive texts: hash and byte range of each, and each text's first word.

    bounds has one more entry than texts; data holds the texts' bytes, text i from starts[i] on.
    """

    def __init__(self, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, bounds: np.ndarray, data: np.ndarray, starts: np.ndarray, first: int):
        self.hashes, self.begin, self.end, self.bounds = hashes, begin, end, bounds
        self.data, self.starts, self.first = data, starts, first

    @property
    def texts(self) -> int:
        return len(self.bounds) - 1

    def owner(self) -> np.ndarray:
        """The text (counted from 0 here) of each word."""
        return np.repeat(np.arange(self.texts), np.diff(self.bounds))


def _stretch(data: np.ndarray, starts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end of the words in data; starts: where texts begin in it."""
    if not len(data):
        return np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    word = _WORD[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[starts] = True
    before = np.zeros(len(data), bool)
    before[1:] = word[:-1]
    before &= ~cut[:-1]
    begin = np.flatnonzero(word & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = word[1:] & ~cut[1:-1]
    end = np.flatnonzero(word & ~after) + 1
    length = end - begin
    place = np.flatnonzero(word) - np.repeat(begin, length)
    letters = data[word]
    terms = _TERM[(place & (_PLACES - 1)) * 256 + (_LOWER[letters] if lower else letters)]
    if (far := np.flatnonzero(place >= _PLACES)).size:
        terms[far] = mix(terms[far] ^ mix((place[far] // _PLACES).astype(U64)))
    sums = np.append(U64(0), np.cumsum(terms))
    last = np.cumsum(length)
    return mix(sums[last] - sums[last - length] + length.astype(U64)), begin, end


def words_of(texts: pa.Array, lower: bool, most_bytes: int = STRETCH) -> Iterator[Words]:
    """The words of a string array, some texts at a time; null counts as empty.

    Consecutive texts come together up to most_bytes; a longer text comes alone, hashed in stretches.
    """
    col = texts.cast(pa.large_string()).fill_null("")
    n = len(col)
    if not n:
        return
    bounds = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + most_bytes, "right")) - 1)
        data, starts = raw[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        if hi == lo + 1 and len(data) > 2 * most_bytes:
            parts = list(_long(data, lower, most_bytes))
            hashes, begin, end = (np.concatenate([p[i] for p in parts]) for i in range(3))
        else:
            hashes, begin, end = _stretch(data, starts, lower)
        yield Words(hashes, begin, end, np.searchsorted(begin, starts), data, starts, lo)
        lo = hi


def _long(data: np.ndarray, lower: bool, step: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """One long text in stretches that end at white space, however far that is."""
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + step)
        while hi < len(data):
            gap = np.flatnonzero(_SPACE[data[hi : hi + step]])
            if len(gap):
                hi += int(gap[0])
                break
            hi = min(len(data), hi + step)
        hashes, begin, end = _stretch(data[lo:hi], np.array([0]), lower)
        yield hashes, begin + lo, end + lo
        lo = hi


def all_words(texts: pa.Array, lower: bool) -> Words:
    """The words of a whole (bounded) string array at once."""
    parts = list(words_of(texts, lower))
    if not parts:
        none = np.empty(0, np.int64)
        return Words(np.empty(0, U64), none, none, np.zeros(1, np.int64), np.empty(0, np.uint8), np.zeros(1, np.int64), 0)
    bytes_at = np.cumsum([0, *(len(p.data) for p in parts)])
    words_at = np.cumsum([0, *(len(p.hashes) for p in parts)])
    joined = lambda get: np.concatenate([get(p) for p in parts])
    shifted = lambda get, at: np.concatenate([get(p) + o for p, o in zip(parts, at)])
    return Words(
        joined(lambda p: p.hashes), shifted(lambda p: p.begin, bytes_at), shifted(lambda p: p.end, bytes_at),
        np.append(shifted(lambda p: p.bounds[:-1], words_at), words_at[-1]), joined(lambda p: p.data),
        np.append(shifted(lambda p: p.starts[:-1], bytes_at), bytes_at[-1]), 0,
    )


def windows(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """The hash of every `size` consecutive words (of one array, text borders not heeded)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.full(n, seed + size, U64)
    for k in range(size):
        out ^= out >> U64(29)
        out *= U64(_BASE)
        out += hashes[k : k + n]
    return mix(out)


def shingle_sets(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): each text's distinct shingles in rising order.

    A text of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    counts = np.diff(words.bounds)
    every = windows(words.hashes, size)
    owner = words.owner()[: len(every)]
    at = np.arange(len(every)) + size <= words.bounds[1:][owner] if len(every) else np.empty(0, bool)
    hashes, owner = every[at], owner[at]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        own = np.array([windows(words.hashes[words.bounds[i] : words.bounds[i + 1]], int(counts[i]))[0] for i in short], U64)
        hashes, owner = np.concatenate([hashes, own]), np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))
        hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(words.texts + 1))
