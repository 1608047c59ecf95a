"""Vectorised hashes of words, shingles and sets.

Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased. Hashes have 64 bits
and depend on nothing but the bytes, so every task and every run agrees. Memory beside the
text itself is bounded by `WINDOW` bytes (or one word, if a single word is longer).
"""

from __future__ import annotations

import numpy as np

WINDOW = 1 << 20
_SPACES = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(_SPACES)] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, count: int) -> np.ndarray:
    """`count` fixed pseudo-random 64-bit numbers."""
    golden = np.uint64(0x9E3779B97F4A7C15)
    return mix64((np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed << 32)) * golden)


_BYTE = stream(1, 256)
_CYCLE = 4096
_POWER = np.cumprod(np.full(_CYCLE, 0xD6E8FEB86659FD93, dtype=np.uint64))
_PLACE = stream(2, 64) | np.uint64(1)
_LENGTH = stream(3, 1)[0]


def _windows(text: bytes):
    """Slices of about WINDOW bytes, cut at spaces."""
    at, end = 0, len(text)
    while end - at > WINDOW:
        cut = max(text.rfind(s, at, at + WINDOW) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= at:
            later = [p for p in (text.find(bytes([s]), at + WINDOW) for s in _SPACES) if p >= 0]
            if not later:
                break
            cut = min(later)
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def _word_hashes(piece: bytes) -> np.ndarray:
    raw = np.frombuffer(piece.lower(), dtype=np.uint8)
    solid = ~_IS_SPACE[raw]
    padded = np.zeros(len(raw) + 2, dtype=np.int8)
    padded[1:-1] = solid
    edges = np.flatnonzero(np.diff(padded))
    lengths = edges[1::2] - edges[::2]
    if not len(lengths):
        return np.empty(0, dtype=np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    values = _BYTE[raw[solid]] * _POWER[place % _CYCLE]
    if lengths.max() > _CYCLE:
        values = values * (2 * (place // _CYCLE) + 1).astype(np.uint64)
    return mix64(np.add.reduceat(values, first) + lengths.astype(np.uint64) * _LENGTH)


def word_hashes(text: bytes | None) -> np.ndarray:
    """One hash per word, in order; none for a null or blank text."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    if len(text) <= WINDOW:
        return _word_hashes(text)
    return np.concatenate([_word_hashes(piece) for piece in _windows(text)])


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """One hash per run of `width` words, in order; a shorter text is one run."""
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    width = min(width, len(words))
    count = len(words) - width + 1
    total = np.full(count, width, dtype=np.uint64) * _LENGTH
    for j in range(width):
        total += words[j : j + count] * _PLACE[j]
    return mix64(total)


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted; a plain sort beats the general routine here."""
    if len(values) < 2:
        return values
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))]


def contains(sorted_keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the values are among the sorted keys."""
    if not len(sorted_keys):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)
    return sorted_keys[at] == values


def set_hashes(members: np.ndarray) -> tuple[int, int]:
    """Two independent order-free 64-bit hashes of a set of distinct hashes, as signed numbers."""
    one = mix64(members + _LENGTH).sum(dtype=np.uint64)
    two = mix64(members ^ _PLACE[63]).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))
