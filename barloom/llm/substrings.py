"""Removal of long passages that a document with a smaller doc_id has too.

A window is LEAST consecutive words. A word is removed if it is covered by a window whose words also
start somewhere in a document with a smaller doc_id. Only windows that may repeat are looked at:

1. The least hash among a window's runs of GRAM words is its anchor. Equal windows have the same
   anchor at the same place, so only anchors that occur in documents of different ids matter. They
   are counted by partial aggregates, about one row for 20 words.
2. Consecutive windows with the same anchor are one segment. Segments of anchors that repeat are cut
   out of the texts and grouped by their words, so that copies in any number are one segment that
   belongs to the least doc_id. All later ones of those are repeats as a whole.
3. Segments are dealt over shards by their anchor. Each shard is indexed by an FM-index over a
   wavelet tree (`fm_index`), through which its segments are streamed: backward search gives their
   matching statistics against segments of smaller ids, and parts of LEAST words or more come out.
4. An anchor with more than MOST different segments would make a shard too large. Those segments are
   cut down to single windows, which are grouped by their words: of any number of copies one is left.

Words are told apart by 64-bit hashes, windows of hot anchors by 128 bits. Null texts have no words.
A null doc_id comes after all others. Rows that repeat a doc_id don't remove each other's words.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, join_small, release, scratch
from .fm_index import FMIndex
from .tokens import blocks, find_words, mix64, window_hashes

#: Words of a window, and of the runs that are its anchor's candidates.
LEAST, GRAM = 50, 12
#: Words of a shard, about, and different segments of an anchor up to which they share one.
SHARD_WORDS, MOST = 300_000, 500

_WHITE = bytes.maketrans(b"\t\n\v\f\r", b"     ")


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of width values the place of its least one, the first of equals."""
    best, place, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        a, b = best[:-step], best[step:]
        later = b < a
        best, place, have = np.where(later, b, a), np.where(later, place[step:], place[:-step]), have + step
    return place


def segments(words: np.ndarray, first: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same anchor: text, first word in it, number of windows, hash of the anchor. first: each text's first word and the end."""
    gram = min(gram, least)
    if len(words) < least:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    grams = window_hashes(words, gram)
    anchor = leftmost_least(grams, least - gram + 1)
    text = np.searchsorted(first, np.arange(len(anchor)), side="right") - 1
    valid = np.arange(len(anchor)) + least <= first[text + 1]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    count = np.add.reduceat(valid, start, dtype=np.int64) if len(start) else np.zeros(0, np.int64)
    return text[start], start - first[text[start]], count, grams[anchor[start]]


def _columns(b: pa.RecordBatch, *names: str) -> list[list]:
    return [b.column(c).to_pylist() for c in names]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, its order (nulls last), a hash of the text, and the text."""
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    return docs.select("doc_id", order.alias("order"), F.xxhash64("text").alias("th"), "text")


def anchors(texts: DataFrame, least: int, gram: int) -> DataFrame:
    """order, th, h (anchor), at (first word) and n (windows) of each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order, th = (b.column(c).to_numpy() for c in ("order", "th"))
            for i, group in blocks(b.column("text").to_pylist()):
                found = find_words(group)
                text, at, n, h = segments(found.hash, found.first, least, gram)
                yield pa.RecordBatch.from_pydict({"order": order[i + text], "th": th[i + text], "h": h.view(np.int64), "at": at.astype(np.int32), "n": n.astype(np.int32)})

    return texts.select("order", "th", "text").mapInArrow(run, "order long, th long, h long, at int, n int")


def words_of(text: str | None) -> list[bytes]:
    return [w for w in text.encode("utf-8", "surrogatepass").translate(_WHITE).split(b" ") if w] if text else []


def cut_out(texts: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """order, th, at, n, h and content (words joined by a space) of the wanted segments of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[str, list] = {k: [] for k in ("order", "th", "at", "n", "h", "content")}
            held = 0
            for order, th, text, parts in zip(*_columns(b, "order", "th", "text", "parts")):
                words = words_of(text)
                for p in parts:
                    content = b" ".join(words[p["at"] : p["at"] + p["n"] + least - 1])
                    for k, v in zip(rows, (order, th, p["at"], p["n"], p["h"], content)):
                        rows[k].append(v)
                    held += len(content)
                    if held > 1 << 22:
                        yield _segment_batch(rows)
                        rows, held = {k: [] for k in rows}, 0
            if held:
                yield _segment_batch(rows)

    lists = wanted.groupBy("order", "th").agg(F.collect_set(F.struct("at", "n", "h")).alias("parts"))
    held = texts.select("order", "th", "text").join(lists, ["order", "th"])
    return held.mapInArrow(run, "order long, th long, at int, n int, h long, content binary")


def _segment_batch(rows: dict[str, list]) -> pa.RecordBatch:
    kinds = {"order": pa.int64(), "th": pa.int64(), "at": pa.int32(), "n": pa.int32(), "h": pa.int64(), "content": pa.binary()}
    return pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in rows.items()})


def search_shard(rows: pa.Table, least: int) -> pa.Table:
    """ch and parts (struct a, e) of the segments of a shard that have windows in one with a smaller owner."""
    contents = rows.column("content").to_pylist()
    hashes, lengths = [], np.zeros(len(contents), np.int64)
    for i, group in _groups(contents):
        found = find_words(group)
        hashes.append(found.hash)
        lengths[i : i + len(group)] = np.diff(found.first)
    symbols = np.unique(np.concatenate(hashes), return_inverse=True)[1] + 1 if hashes else np.zeros(0, np.int64)
    owner = np.unique(rows.column("owner").to_numpy(), return_inverse=True)[1]
    hits = FMIndex(symbols, lengths, owner).repeats(symbols, lengths, owner, least)
    order = np.lexsort((hits.start, hits.query))
    query, start, end = (x[order] for x in (hits.query, hits.start, hits.end))
    own, first = np.unique(query, return_index=True)
    parts = pa.ListArray.from_arrays(pa.array(np.append(first, len(query)), pa.int32()), pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["a", "e"]))
    return pa.table({"ch": rows.column("ch").combine_chunks().take(pa.array(own)), "h": rows.column("h").combine_chunks().take(pa.array(own)), "parts": parts})


def _groups(contents: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    for i in range(0, len(contents), 4096):
        yield i, contents[i : i + 4096]


def search_windows(hot: DataFrame, least: int) -> DataFrame:
    """As search_shard, for segments of hot anchors: every window on its own, grouped by its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ch, h, owner, n = (b.column(c).to_numpy() for c in ("ch", "h", "owner", "n"))
            found = find_words(b.column("content").to_pylist())
            w1 = window_hashes(found.hash, least)
            w2 = window_hashes(mix64(found.hash ^ np.uint64(0x9FB21C651E98DF25)), least)
            row = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            place = found.first[:-1][row] + at
            yield pa.RecordBatch.from_pydict({"ch": ch[row], "h": h[row], "owner": owner[row], "a": at.astype(np.int32), "w1": w1[place].view(np.int64), "w2": w2[place].view(np.int64)})

    windows = cut(hot.select("ch", "h", "owner", "n", "content").mapInArrow(run, "ch long, h long, owner long, a int, w1 long, w2 long"))
    first = windows.groupBy("w1", "w2").agg(F.min("owner").alias("least"), F.max("owner").alias("most")).where("least < most").drop("most")
    hits = windows.join(first, ["w1", "w2"]).where("least < owner")
    return hits.groupBy("ch", "h").agg(F.collect_list(F.struct("a", (F.col("a") + least).alias("e"))).alias("parts"))


def repeated_parts(docs: DataFrame, least: int = LEAST, gram: int = GRAM, shard_words: int = SHARD_WORDS, most: int = MOST) -> DataFrame:
    """order, th and parts (arrays of a, e: first word and the one after the last) of the texts that have something to remove."""
    texts = keyed(docs)
    with scratch() as keep:
        found = cut(anchors(texts, least, gram))
        shared = found.groupBy("h").agg(F.min("order").alias("low"), F.max("order").alias("high")).where("low < high").select("h")
        pieces = cut(cut_out(texts, found.join(shared, "h"), least).withColumn("ch", F.xxhash64("h", "content")))
        release(found)
        # copies of a segment are one, of the least doc_id; a segment of one document alone may still share windows with another
        distinct = cut(pieces.groupBy("h", "ch", "content", "n").agg(F.min("order").alias("owner")))
        crowded = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > most).select("h", F.lit(True).alias("hot"))
        told = join_small(distinct, cut(crowded), ["h"])
        cool, hot = told.where(F.col("hot").isNull()), told.where("hot")
        total = cool.agg(F.sum(F.col("n") + least - 1)).first()[0] or 0
        shard = F.pmod(F.xxhash64(F.col("h"), F.lit(7)), F.lit(1 + total // shard_words))
        kind = "ch long, h long, parts array<struct<a: int, e: int>>"
        by_index = cool.select("h", "ch", "content", "owner", shard.alias("shard")).groupBy("shard").applyInArrow(lambda rows: search_shard(rows, least), kind)
        inner = cut(by_index.unionByName(search_windows(hot, least)))
        owners = distinct.select("h", "ch", "owner").join(inner, ["h", "ch"], "left")
        at = F.col("at")
        whole = F.array(F.struct(at.alias("a"), (at + F.col("n") + least - 1).alias("e")))
        own = F.transform("parts", lambda p: F.struct((p["a"] + at).alias("a"), (p["e"] + at).alias("e")))
        placed = pieces.drop("content").join(owners, ["h", "ch"]).withColumn("gone", F.when(F.col("order") > F.col("owner"), whole).otherwise(own)).where(F.col("gone").isNotNull())
        out = cut(placed.groupBy("order", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("parts")))
        keep.append(out)
    return out


def drop_repeats(docs: DataFrame, least: int = LEAST, **options: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by a space) of each row of docs (doc_id, text; other columns are left out)."""
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for text, parts in zip(*_columns(b, "text", "parts")):
                words, to, left = words_of(text), 0, []
                for p in parts or ():
                    left += words[to : max(to, p["a"])]
                    to = max(to, p["e"])
                left += words[to:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary())})

    texts = keyed(docs)
    return texts.join(repeated_parts(docs, least, **options), ["order", "th"], "left").select("doc_id", "text", "parts").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept binary")

