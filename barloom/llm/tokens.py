"""Words and their hashes for a batch of texts at once, in numpy.

A text is handled as UTF-8. Word boundaries are single bytes (the space and 09 to 0D), so no
character is ever cut.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import xxhash

#: Bytes of text that are handled at once; one longer text is handled alone.
BLOCK = 1 << 19
#: Bytes of words that are hashed at once; a longer word is hashed on its own.
PIECE = 1 << 16

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    inverse = pow(int(_BASE), -1, 1 << 64)
    out = []
    for base in (int(_BASE), inverse):
        x = np.full(size, np.uint64(base))
        x[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def blocks(texts: Sequence[str | None], size: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about size bytes: the place of the first one, and all as UTF-8; null is empty."""
    first, held, total = 0, [], 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if held and total + len(b) > size:
            yield first, held
            first, held, total = i, [], 0
        held.append(b)
        total += len(b) + 1
    if held:
        yield first, held


@dataclass
class Words:
    data: np.ndarray  #: all texts, each followed by a space
    text_start: np.ndarray  #: where each text starts; one more entry marks the end
    start: np.ndarray  #: of each word
    end: np.ndarray
    first: np.ndarray  #: each text's first word; one more entry marks the end
    hash: np.ndarray  #: of each word


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes. Words are taken by runs of about PIECE bytes, so that long texts need no more memory for it."""
    out = np.empty(len(start), np.uint64)
    power, inverse = _powers(PIECE)
    at = 0
    while at < len(start):
        low = start[at]
        to = int(np.searchsorted(end, low + PIECE, side="right"))
        if to <= at:
            out[at] = xxhash.xxh3_64_intdigest(data[low : end[at]].tobytes())
            at += 1
            continue
        a, b = start[at:to] - low, end[at:to] - low
        with np.errstate(over="ignore"):
            total = np.zeros(b[-1] + 1, np.uint64)
            np.cumsum((data[low : low + b[-1]].astype(np.uint64) + np.uint64(1)) * power[: b[-1]], out=total[1:])
            out[at:to] = mix64((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = to
    return out


def find_words(texts: list[bytes], lower: bool = False) -> Words:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        data = _LOWER[data]
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    text_start = np.concatenate([[0], np.cumsum(lengths)])
    space = _SPACE[data]
    edge = np.diff(space.view(np.int8), prepend=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    first = np.searchsorted(start, text_start)
    return Words(data, text_start, start, end, first, word_hashes(data, start, end))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, by its first word; runs over a text's end are for the caller to leave out."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(0xC2B2AE3D27D4EB4F) + words[k : len(words) - n + 1 + k]
    return mix64(out)
