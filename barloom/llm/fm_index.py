"""A compressed FM-index over word sequences: backward search through a wavelet tree, for many queries at once, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first depth symbols, by doubling prefixes. Deeper ones may stand in any order, which no shorter query can tell."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank, order, k = rank.astype(np.int64), np.argsort(symbols, kind="stable"), 1
    while k < depth and n > 1:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        k *= 2
    return order


class WaveletTree:
    """Symbols of a sequence by levels of bits, each level packed into 64-bit words with a count before each word."""

    def __init__(self, sequence: np.ndarray, symbols: int) -> None:
        self.size, self.depth = len(sequence), max(1, int(symbols - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        own = sequence.astype(np.int64)
        for level in range(self.depth - 1, -1, -1):
            bit = ((own >> level) & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate([bit, np.zeros(64 - len(bit) % 64, np.uint8)]), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])[:-1].astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            own = np.concatenate([own[bit == 0], own[bit == 1]])
        self.base = self._descend(np.arange(symbols), np.zeros(symbols, np.int64))

    def _descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where the symbols before place end up on the last level."""
        for i in range(self.depth):
            word = place >> 6
            low = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[i][word] + np.bitwise_count(self.words[i][word] & low)
            place = np.where((symbol >> (self.depth - 1 - i)) & 1, self.zeros[i] + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before place."""
        return self._descend(symbol, place) - self.base[symbol]


@dataclass
class Matches:
    """query, and from where to where (end excluded) in it."""

    query: np.ndarray
    start: np.ndarray
    end: np.ndarray


class FMIndex:
    """An index of sequences, each with an owner. Symbol 0 parts the sequences and is never asked for."""

    def __init__(self, sequences: np.ndarray, lengths: np.ndarray, owner: np.ndarray) -> None:
        """sequences: symbols from 1 on, one sequence after the other; owner: a number from 0 on for each sequence."""
        n = len(sequences) + len(lengths)
        at = np.arange(len(sequences)) + np.repeat(np.arange(len(lengths)), lengths)
        text = np.zeros(n, np.int64)
        text[at] = sequences
        whose = np.repeat(owner, lengths + 1)
        order = suffix_order(text, int(lengths.max(initial=0)) + 1)
        self.size, symbols = n, int(text.max(initial=0)) + 1
        self.tree = WaveletTree(text[order - 1], symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.least = [whose[order].astype(np.int32)]  # of runs of 1, 2, 4, ... suffixes
        while len(self.least[-1]) > 1 << (len(self.least) - 1):
            half, last = 1 << (len(self.least) - 1), self.least[-1]
            self.least.append(np.minimum(last[:-half], last[half:]))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that start with symbol and go on as those from low to high do."""
        k = len(symbol)
        ranks = self.first[np.concatenate([symbol, symbol])] + self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return ranks[:k], ranks[k:]

    def least_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least owner of suffixes from low to high, which must not be equal."""
        out = np.empty(len(low), np.int32)
        step = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(step):
            i = np.flatnonzero(step == k)
            out[i] = np.minimum(self.least[k][low[i]], self.least[k][high[i] - (1 << int(k))])
        return out

    def repeats(self, sequences: np.ndarray, lengths: np.ndarray, owner: np.ndarray, least: int) -> Matches:
        """Parts of least symbols or more of the streamed sequences that also occur in one with a smaller owner.

        Matching statistics are worked out where they matter, for all sequences at once: a search
        runs backwards from an end until what it has read has no such occurrence. From a window of
        least symbols that fails, the next one is the first that leaves out what failed. After a
        window that holds, the search tries the whole rest, and halves the way back while that
        fails. Every window of least symbols is decided, and those that hold are covered.
        """
        offset = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        live = np.flatnonzero(lengths >= least)
        a = np.zeros(len(live), np.int64)  # first start that isn't decided
        total = lengths[live]
        cap, skip = total.copy(), np.zeros(len(live), np.int64)  # ends beyond cap fail with starts before skip
        end = a + least
        place, low, high = end.copy(), np.zeros(len(live), np.int64), np.full(len(live), self.size)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(live):
            low, high = self.extend(sequences[offset[live] + place - 1], low, high)
            holds = high > low
            holds[holds] = self.least_owner(low[holds], high[holds]) < owner[live[holds]]
            place = np.where(holds, place - 1, place)
            done, failed = holds & (place == a), ~holds
            if done.any():
                found.append((live[done], a[done], end[done]))
            turn = done | failed
            if not turn.any():
                continue
            single = failed & (end == a + least)
            wide = failed & ~single
            a = np.where(done, end - least + 1, np.where(single, place, a))
            cap = np.where(wide, end - 1, cap)
            skip = np.where(wide, np.maximum(place, end - least), skip)
            past = turn & ~wide & (a > cap - least)
            a = np.where(past, np.maximum(a, skip), a)
            cap, skip = np.where(past, total, cap), np.where(past, 0, skip)
            end = np.where(done, cap, np.where(single, a + least, np.where(wide, np.maximum(a + least, (a + least + end) // 2), end)))
            place, low, high = np.where(turn, end, place), np.where(turn, 0, low), np.where(turn, self.size, high)
            on = a <= total - least
            if not on.all():
                live, a, total, cap, skip, end, place, low, high = (x[on] for x in (live, a, total, cap, skip, end, place, low, high))
        parts = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*found) if found else ([], [], []))]
        return Matches(*parts)
