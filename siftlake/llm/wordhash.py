"""64-bit hashes of words and of runs of words, by numpy over whole batches of texts."""

from __future__ import annotations

import numpy as np

from siftlake.llm.common import BLANKS

_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS.encode())] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX_A, _MIX_B, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)
#: Bytes that are hashed at once; one text at least.
SLICE_BYTES = 1 << 21


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x; one to one."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


_LETTER = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _words_of(raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(raw, np.uint8)
    solid = ~_BLANK[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = np.cumsum(sizes) - sizes
    edges = begins[(sizes > 0)]
    first[edges] = solid[edges]  # a word ends with its text
    starts = np.flatnonzero(first)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(sizes), np.int64)
    letters = np.flatnonzero(solid)
    heads = np.searchsorted(letters, starts)
    lengths = np.diff(np.append(heads, len(letters)))
    place = (np.arange(len(letters)) - np.repeat(heads, lengths)).astype(np.uint64)
    value = mixed(_LETTER[data[letters]] + place * _STEP)
    hashes = mixed(np.add.reduceat(value, heads) + lengths.astype(np.uint64))
    counts = np.searchsorted(starts, begins + sizes) - np.searchsorted(starts, begins)
    own = np.repeat(begins, counts)
    return hashes, starts - own, starts - own + lengths, counts


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of all texts: hash, first byte and end in the text; and the words of each text."""
    parts, begin = [], 0
    while begin < len(texts):
        end, total = begin, 0
        while end < len(texts) and (end == begin or total + len(texts[end]) <= SLICE_BYTES):
            total += len(texts[end])
            end += 1
        sizes = np.fromiter(map(len, texts[begin:end]), np.int64, end - begin)
        parts.append(_words_of(b"".join(texts[begin:end]), sizes))
        begin = end
    if not parts:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def runs_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of size neighbouring words; the first len - size + 1 words begin one."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]))
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, inverse)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[:n])])
    return mixed((sums[size:] - sums[: n - size + 1]) * back[: n - size + 1])


def lowest_of(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each width neighbouring values."""
    have, low = 1, values
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    return low


def chosen(values: np.ndarray, width: int) -> np.ndarray:
    """Marks each value that is the smallest of some width neighbouring values; equal ones are all marked."""
    if len(values) < width:
        return np.zeros(len(values), bool)
    low = lowest_of(values, width)
    most = np.iinfo(np.uint64).max
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    highest = most - lowest_of(most - padded, width)
    return highest == values
