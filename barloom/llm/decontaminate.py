"""Benchmark decontamination by CGK embedding and bit sampling.

Texts and benchmark items are sequences of words, lower-cased and without punctuation. A document
is contaminated by an item if a run of its words is within `tolerance` of the item's length in
word edits.

The embedding by Chakraborty, Goldenberg and Koucky walks over a sequence: at each of 3 L steps it
writes the current word, and a random bit that depends on the step and the word decides whether it
moves on. Two sequences with few edits between them meet again soon after each edit and then walk
together, so their embeddings have a small Hamming distance. Samples of a few places of the
embedding are the keys of a locality-sensitive hash, repeated often enough for the wanted recall:
WALKS walks with SAMPLES samples of PLACES places each.

Windows are as long as the items and start at every word. Of two sequences within k edits, one has
at least L - 1 - 2 k of the other's pairs of neighbouring words, so windows with fewer pairs that
occur in items of their size are left out before they are embedded, which loses nothing. What shares a key
with an item is verified by the exact edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut
from .tokens import blocks, find_words, mix64, window_hashes

WALKS, SAMPLES, PLACES = 4, 16, 4
#: Steps of a walk, times L: with so many all but a few walks have reached the end, as the paper has it.
STEPS = 3
#: Words of windows that are embedded at once.
CELLS = 1 << 18

_DROP = np.zeros(256, bool)
_DROP[[b for b in range(33, 128) if not chr(b).isalnum()]] = True
_DROP[list(range(0, 9)) + list(range(14, 32))] = True
_NONE = np.uint64(0)


def plain(text: bytes) -> bytes:
    """The text without ASCII punctuation and controls, with accented Latin capitals in lower case; ASCII is lowered with the words."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return text
    high = np.concatenate([[False], data[:-1] == 0xC3]) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    return (data + np.where(high, 32, 0).astype(np.uint8))[~_DROP[data]].tobytes()


@lru_cache(maxsize=64)
def _turns(walk: int, steps: int) -> np.ndarray:
    """An odd number for each step of a walk; the top bit of its product with a word's hash tells whether the walk moves on."""
    return np.random.default_rng(walk + 1).integers(0, 1 << 63, steps, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def embed(windows: np.ndarray, walk: int) -> np.ndarray:
    """CGK embedding of each row of words, a column each; what follows the end is the word 0."""
    n, length = windows.shape
    flat = np.hstack([windows, np.zeros((n, 1), np.uint64)]).ravel()
    base = np.arange(n) * (length + 1)
    at, last = base.copy(), base + length
    out = np.empty((STEPS * length, n), np.uint64)
    for step, turn in enumerate(_turns(walk, 1 << (STEPS * length).bit_length())[: STEPS * length]):
        now = out[step]
        np.take(flat, at, out=now)
        at += ((now * turn) >> np.uint64(63)).astype(np.int64)
        np.minimum(at, last, out=at)
    return out


@lru_cache(maxsize=1024)
def _places(size: int, walk: int) -> np.ndarray:
    return np.random.default_rng(1000 * size + walk).integers(0, STEPS * size, (SAMPLES, PLACES))


def keys(windows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The LSH keys of each row of words; the first `size` words of a row are its sequence, and word 0 fills the rest."""
    out = np.empty((len(windows), WALKS * SAMPLES), np.uint64)
    groups = [(int(size), np.flatnonzero(sizes == size)) for size in np.unique(sizes)]
    for walk in range(WALKS):
        embedded = embed(windows, walk)
        for size, own in groups:
            read = embedded[_places(size, walk)[:, :, None], own[None, None, :]]
            key = np.uint64((size * WALKS + walk) * SAMPLES + 1) + np.arange(SAMPLES, dtype=np.uint64)[:, None]
            for p in range(PLACES):
                key = mix64(key ^ read[:, p])
            out[own, walk * SAMPLES : (walk + 1) * SAMPLES] = np.where((read != 0).any(1), key, _NONE).T  # what has read no word is no key
    return out


def portions(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of the sorted sizes that differ by a third at the most and have about CELLS words."""
    at = 0
    while at < len(sizes):
        to = int(np.searchsorted(sizes, max(sizes[at] + 1, sizes[at] * 4 // 3), side="right"))
        to = min(to, at + max(1, CELLS // int(sizes[to - 1])))
        yield slice(at, to)
        at = to


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Fewest word edits between item and any run of text, and where the first best run ends."""
    j = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, w in enumerate(item):
        step = np.empty_like(row)
        step[0] = i + 1
        step[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != w))
        row = np.minimum.accumulate(step - j) + j
    return int(row.min()), int(row.argmin())


@dataclass
class Items:
    """Benchmark items as words; what a search needs is built where it runs."""

    ids: list
    words: list[np.ndarray]
    tolerance: float
    built: dict = field(default_factory=dict)

    def slack(self, item: int) -> int:
        return int(self.tolerance * len(self.words[item]) + 1e-9)

    def build(self) -> dict:
        if self.built:
            return self.built
        exact: dict[int, dict[int, list[int]]] = {}
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            if len(w) and not self.slack(i):
                exact.setdefault(len(w), {}).setdefault(int(window_hashes(w, len(w))[0]), []).append(i)
            elif len(w):
                by_size.setdefault(len(w), []).append(i)
        found, owner, pair_of, size_of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for size, own in sorted(by_size.items()):
            for part in portions(np.full(len(own), size)):
                ks = keys(np.stack([self.words[i] for i in own[part]]), np.full(len(own[part]), size))
                found.append(ks.ravel())
                owner.append(np.repeat(np.array(own[part], np.int32), ks.shape[1]))
            pairs = np.unique(np.concatenate([window_hashes(self.words[i], 2) for i in own]))
            pair_of.append(pairs)
            size_of.append(np.full(len(pairs), size))
        all_keys, all_owners = np.concatenate(found), np.concatenate(owner)
        order = np.argsort(all_keys, kind="stable")
        order = order[all_keys[order] != 0]
        pairs_of, sizes = np.concatenate(pair_of), np.concatenate(size_of)
        by_pair = np.lexsort((sizes, pairs_of))
        pairs, first = np.unique(pairs_of[by_pair], return_index=True)
        seen = np.zeros(1 << 20, bool)
        seen[(pairs & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        # the items of keys[i] are owners[i]; sizes of the items that hold pairs[i] are sizes[first[i]:first[i + 1]]
        self.built = {
            "exact": exact, "short": {s: np.array(sorted(k), np.uint64) for s, k in exact.items()}, "keys": all_keys[order], "owners": all_owners[order],
            "pairs": pairs, "first": np.append(first, len(pairs_of)), "sizes": sizes[by_pair], "seen": seen,
        }
        return self.built


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def hits_in(texts: list[bytes], items: Items) -> Iterator[tuple[int, int, int, int]]:
    """Place of the text, place of the item, word edits, and the first word of the first window found."""
    built = items.build()
    found = find_words([plain(t) for t in texts], lower=True)
    words, n = found.hash, len(found.hash)
    if not n:
        return
    text_of = np.repeat(np.arange(len(texts)), np.diff(found.first))
    for size, known in built["short"].items():
        windows = window_hashes(words, size)
        for i in np.flatnonzero(_among(windows, known)) if len(windows) else ():
            if text_of[i] == text_of[i + size - 1]:
                for item in built["exact"][size][int(windows[i])]:
                    yield int(text_of[i]), item, 0, int(i - found.first[text_of[i]])
    if not len(built["pairs"]) or n < 2:
        return
    pairs = window_hashes(words, 2)
    maybe = np.flatnonzero(built["seen"][(pairs & np.uint64((1 << 20) - 1)).astype(np.int64)])
    maybe = maybe[_among(pairs[maybe], built["pairs"])]
    which = np.searchsorted(built["pairs"], pairs[maybe])
    many = built["first"][which + 1] - built["first"][which]
    place = np.repeat(maybe, many)
    entry = np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(built["first"][which], many)
    size_at = built["sizes"][entry]
    starts, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in np.unique(size_at):
        own, slack = place[size_at == size], int(items.tolerance * size + 1e-9)
        need = max(1, int(size) - 1 - 2 * slack)
        if len(own) < need:
            continue
        # a window with enough pairs holds `need` known ones in a row, so it starts between the last one's reach and the first
        first, last = own[: len(own) - need + 1], own[need - 1 :]
        fits = last - first <= size - 2
        low, high = np.maximum(0, last[fits] - (size - 2)), np.minimum(first[fits], n - 1)
        width = high - low + 1
        found_at = np.unique(np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(low, width))
        starts.append(found_at)
        sizes.append(np.full(len(found_at), size))
    start, size_of = np.concatenate(starts), np.concatenate(sizes)
    near: dict[tuple[int, int], list[int]] = {}
    for part in portions(size_of):
        begin, size = start[part], size_of[part]
        inside = begin[:, None] + np.arange(size.max())
        end = np.minimum(begin + size, found.first[text_of[begin] + 1])  # a window ends with its text
        ks = keys(np.where(inside < end[:, None], words[np.minimum(inside, n - 1)], _NONE), size)
        flat = ks.ravel()
        low = np.searchsorted(built["keys"], flat)
        met = np.flatnonzero((low < len(built["keys"])) & (built["keys"][np.minimum(low, len(built["keys"]) - 1)] == flat) & (flat != 0))
        high = np.searchsorted(built["keys"], flat[met], side="right")
        for k, a, b in zip((met // ks.shape[1]).tolist(), low[met].tolist(), high.tolist()):
            for item in built["owners"][a:b].tolist():
                near.setdefault((int(text_of[begin[k]]), item), []).append(int(begin[k]))
    for (text, item), places in near.items():
        size = len(items.words[item])
        slack, best = items.slack(item), None
        places = np.unique(places)
        for run in np.split(places, np.flatnonzero(np.diff(places) > size) + 1):
            a, b = max(found.first[text], run[0] - slack - 1), min(found.first[text + 1], run[-1] + size + slack + 1)
            d, _ = edit_distance(items.words[item], words[a:b])
            if d <= slack and (best is None or d < best[0]):
                best = (d, int(run[0] - found.first[text]))
        if best:
            yield text, item, best[0], best[1]


def contaminated(docs: DataFrame, benchmark: DataFrame, tolerance: float = 0.2, block_bytes: int = 1 << 23) -> DataFrame:
    """doc_id, item_id, edits and first_word of each document and item within tolerance of a run of its words.

    docs needs doc_id and text, benchmark item_id and text. The benchmark is the set of queries: it
    is sent to all documents in blocks of about block_bytes of text, each checked in size before, so
    that a larger benchmark costs more passes and not more memory: one block is held at a time. first_word counts the document's
    words that hold a letter or digit. Null texts and items, and those without such words, hit
    nothing; equal items hit alike; repeated documents give repeated rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    held = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    size = held.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // block_bytes))
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    out = None
    for k in range(n_blocks):
        rows = held.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect()
        texts = [plain(r["text"].encode()) for r in rows]
        found = find_words(texts, lower=True) if texts else None
        items = Items([r["item_id"] for r in rows], [found.hash[a:b] for a, b in zip(found.first[:-1], found.first[1:])] if found else [], tolerance)
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            for batch in batches:
                ids = batch["doc_id"].tolist()
                for first, part in blocks(batch["text"].tolist()):
                    hit = [(ids[first + t], sent.value.ids[i], d, w) for t, i, d, w in hits_in(part, sent.value)]
                    if hit:
                        yield pd.DataFrame(hit, columns=["doc_id", "item_id", "edits", "first_word"])

        # one block after the other: its hits are written, and then it leaves the executors
        part = cut(docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, item_id {item_kind}, edits int, first_word long"))
        sent.destroy()
        out = part if out is None else out.unionByName(part)
    return out
