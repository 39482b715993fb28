"""Words and shingles of many texts at once, as 64-bit hashes, by array operations on their bytes."""

from __future__ import annotations

import numpy as np

from .golomb import mix

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Bytes that begin a letter.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(192, 256)]] = True
#: A random 64-bit number for every byte, and an odd multiplier for places within a word.
_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED270B9F4C1A37))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_PLACE = np.ones(1, np.uint64)
_SHINGLE = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def _places(n: int) -> np.ndarray:
    out = np.full(n, _STEP)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def cut_words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words [^\\x20\\x09-\\x0D]+ one after another, the words' offsets in them (one more than words), and words by text."""
    off = np.asarray(off, np.int64)
    inside = ~_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = off[1:-1]
    edges = edges[edges < len(raw)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    chars = raw[inside]
    gone = np.cumsum(~inside)
    return chars, np.append(starts - gone[starts], len(chars)), np.searchsorted(starts, off)


def lower_ascii(chars: np.ndarray) -> np.ndarray:
    return _LOWER[chars]


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words [^\\x20\\x09-\\x0D]+, A-Z in lower case, and their offsets by text."""
    chars, first, by_text = cut_words(raw, off)
    if len(first) == 1:
        return np.zeros(0, np.uint64), by_text
    length = np.diff(first)
    power = _places(int(length.max()))
    sums = np.add.reduceat(_BYTE[_LOWER[chars]] * power[np.arange(len(chars)) - np.repeat(first[:-1], length)], first[:-1])
    return mix(sums + length.astype(np.uint64) * _SHINGLE[0]), by_text


def letters_and_words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By text: letters (characters above ASCII are counted as such), other characters that are no white space, and words."""
    inside = ~_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = off[:-1][off[:-1] < len(raw)]
    begins[edges] = inside[edges]

    def by_text(marks: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(marks, dtype=np.int64))[off])

    letters = by_text(_LETTER[raw])
    return letters, by_text(inside & ((raw & 0xC0) != 0x80)) - letters, by_text(begins)


def shingles(hashes: np.ndarray, by_text: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words (of fewer words, the whole text as one run) with repeats, and offsets by text."""
    count = np.diff(by_text)
    runs = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(runs)])
    at = np.arange(first[-1]) + np.repeat(by_text[:-1] - first[:-1], runs)
    short = np.repeat(count < k, runs)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    out = np.zeros(len(at), np.uint64)
    left = np.repeat(count, runs)
    for j in range(k):
        part = mix(padded[at + j] + np.uint64(int(_SHINGLE[j % 5]) * (j + 1) % 2**64)) * _SHINGLE[(j + 1) % 5]
        out += np.where(short & (left <= j), np.uint64(0), part)
    return mix(out), first
