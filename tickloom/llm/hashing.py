"""Vectorised word hashing for operators that run numpy inside tasks.

A word's hash is the sum of (byte + 1) times a fixed random 64-bit number for its place, mixed; words of
a text are found and hashed with array operations over blocks of about ``BLOCK`` bytes, so memory
stays bounded however long a text is (a single word longer than a block is taken whole).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 19
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: For words of letters and digits: every other ASCII byte separates; bytes of other characters belong to words.
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[48:58] = _SEPARATOR[65:91] = _SEPARATOR[97:123] = False
_SEPARATOR[128:] = False


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, a bijection on 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def place_numbers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed((np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_PLACES = place_numbers(256)


def hash_words(data: bytes, prefixes: tuple[int, ...] = (), plain: bool = False):
    """(hashes, starts, ends in bytes) of the words of ``data``, A-Z lower-cased.

    With ``plain`` words are runs of letters and digits. For each of ``prefixes`` another array
    follows: the hashes of the words' first bytes, 0 for shorter words.
    """
    blank = _SEPARATOR if plain else _BLANK
    b = np.frombuffer(data, np.uint8)
    none = np.empty(0, np.uint64)
    if not len(b):
        return none, np.empty(0, np.int64), np.empty(0, np.int64), *(none for _ in prefixes)
    inside = ~blank[b]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return none, starts, ends, *(none for _ in prefixes)
    longest = int((ends - starts).max())
    numbers = _PLACES if longest <= len(_PLACES) else place_numbers(longest)
    at = np.flatnonzero(inside)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(at), dtype=np.int64) - np.repeat(first, lengths)
    values = (_LOWER[b[at]].astype(np.uint64) + np.uint64(1)) * numbers[place]
    heads = []
    for p in prefixes:
        part = mixed(np.add.reduceat(np.where(place < p, values, np.uint64(0)), first) + np.uint64(p))
        heads.append(np.where(lengths >= p, part, np.uint64(0)))
    return mixed(np.add.reduceat(values, first)), starts, ends, *heads


def blocks(text: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, piece) of a text in pieces of about ``BLOCK`` bytes that end between words."""
    at = 0
    while at < len(text):
        end = at + BLOCK
        while end < len(text) and not _BLANK[text[end]]:
            end += 1
        yield at, text[at:end]
        at = end


def text_words(texts: list[bytes]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For consecutive texts (first index, [hashes of each text's words])."""
    k = 0
    while k < len(texts):
        if len(texts[k]) > BLOCK:
            yield k, [long_text(texts[k])]
            k += 1
            continue
        end, size = k, 0
        while end < len(texts) and size + len(texts[end]) <= BLOCK:
            size += len(texts[end]) + 1
            end += 1
        hashes, starts, *_ = hash_words(b" ".join(texts[k:end]))
        borders = np.cumsum([len(t) + 1 for t in texts[k:end]])
        yield k, np.split(hashes, np.searchsorted(starts, borders[:-1]))
        k = end


def long_text(text: bytes) -> np.ndarray:
    parts = [hash_words(piece)[0] for _, piece in blocks(text)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def batches_of(texts: list[bytes]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first, end, joined bytes, border of each text) for runs of texts of about ``BLOCK`` bytes."""
    k = 0
    while k < len(texts):
        end, size = k, 0
        while end < len(texts) and (end == k or size + len(texts[end]) <= BLOCK):
            size += len(texts[end]) + 1
            end += 1
        yield k, end, b"\n".join(texts[k:end]), np.cumsum([len(t) + 1 for t in texts[k:end]])
        k = end


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct signed hashes of the k-word shingles; fewer words give one for all of them."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.int64)
    width = min(k, n)
    salts = place_numbers(k + 8)
    out = np.full(n - width + 1, np.uint64(width), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out += words[i : n - width + 1 + i] * salts[i + 3]
    return np.unique(mixed(out).view(np.int64))
