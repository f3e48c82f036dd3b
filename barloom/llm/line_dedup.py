"""Line deduplication by a segment-partition edit join.

Lines are compared within as many edits as their length allows: one for every `chars` characters
of the shorter one, `most` at the most (Edits). Two lines within t edits of each other share one of
t + 1 segments into which the shorter one is cut, at nearly the same place: t edits can't touch all
segments. Every line is filed under its own segments, and probes, for each length that a shorter
partner may have, the substrings that may stand where that partner's segments are; only starts that
the edits left and right of a segment still allow are probed. Lines that share a key, one of them
filed under it, are verified by the banded bit-parallel edit distance.

Lines that share a key are not expanded into all pairs: they are first compared with two of them,
and what is linked becomes one class. Lines of different classes are then compared each with each
if they are at most SMALL. More get finer keys: what is left of two lines without the segment that
they share is within t edits too, so it is cut into segments in turn, and a key and one of these
are a new key. What still shares a key with many is cut into blocks, and pairs of blocks are
compared where they are read, so that only links are ever written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, cut, join_small, release, scratch
from .components import components
from .near_dup import mixed_keys, with_component

SMALL = 32
BLOCK = 64
#: What is worth a task: rows without texts, rows with texts, characters of pairs to compare, pairs of blocks.
ROWS = 20_000
TEXTS = 2_000
CHARS = 1 << 20
PAIRS = 64
#: Lines that a task remembers to have keyed.
SEEN = 1 << 17
SPACE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Edits:
    """The edits within which two lines are one: one for every `chars` characters of the shorter line, `most` at the most."""

    chars: int = 12
    most: int = 2

    def of(self, length: int) -> int:
        return min(self.most, length // self.chars)


def lines_of(text: Column) -> Column:
    """A text's lines without white space at their ends; none of a null text."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)))


def line_id(line: bytes) -> int:
    """The same as xxhash64() gives in lines' expressions."""
    return xxhash.xxh64_intdigest(line, 42)


def segments(length: int, n: int) -> list[tuple[int, int]]:
    """Start and size of each of n segments of a line; later ones are the longer ones."""
    short, longer = divmod(length, n)
    sizes = [short + (i >= n - longer) for i in range(n)]
    return [(sum(sizes[:i]), size) for i, size in enumerate(sizes)]


@lru_cache(maxsize=1 << 14)
def probes(length: int, t: int, extra: int) -> list[tuple[int, int, int, bool]]:
    """Start, end, seed and whether it is an own segment, of each substring that may be a segment of a partner that is `extra` characters shorter and has t edits."""
    out = []
    for i, (start, size) in enumerate(segments(length - extra, t + 1)):
        low, high = max(0, start + max(-i, extra - (t - i))), min(length - size, start + min(i, extra + (t - i)))
        out += [(at, at + size, ((length - extra) * (t + 1) + i) * 4 + t, not extra and at == start) for at in range(low, high + 1)]
    return out


@lru_cache(maxsize=1 << 13)
def line_probes(length: int, edits: Edits) -> list[tuple[int, int, int, bool, int, int]]:
    """probes() for all lengths that a partner of the line may have, with t and extra."""
    return [(*x, t, extra) for extra in range(edits.most + 1) if extra <= length for t in [edits.of(length - extra)] if t >= max(1, extra) for x in probes(length, t, extra)]


def hashes(line: str, places: list[tuple], key: int = 0) -> list[int]:
    try:
        return [xxhash.xxh3_64_intdigest(line[p[0] : p[1]], p[2] ^ key) for p in places]
    except UnicodeEncodeError:
        return [xxhash.xxh3_64_intdigest(line[p[0] : p[1]].encode("utf-8", "surrogatepass"), p[2] ^ key) for p in places]


def line_keys(line: str, edits: Edits = Edits()) -> list[int]:  # noqa: B008
    """Keys, without sign, under which a line is filed or looked for."""
    return hashes(line, line_probes(len(line), edits))


#: place: twice the number of the key among the line's, and one if the line is filed under it.
KEYED = "sid long, key long, place int"


def _rows(sids: list[int], keys: list[list[int]], places: list[np.ndarray]) -> pd.DataFrame:
    flat = np.fromiter(chain.from_iterable(keys), np.uint64)
    return pd.DataFrame({"sid": np.repeat(np.array(sids, np.uint64).view(np.int64), [len(k) for k in keys]), "key": flat.view(np.int64), "place": np.concatenate([np.zeros(0, np.int32), *places])})


def key_lines(docs: DataFrame, edits: Edits) -> DataFrame:
    """KEYED for lines that may differ from another one. A task keys a line once, but for every SEEN lines that it has seen since."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        place_of: dict[int, np.ndarray] = {}
        for batch in batches:
            sids, keys, places = [], [], []
            for t in batch["text"].tolist():
                for x in split_lines(t):
                    if len(x) < edits.chars:
                        continue
                    b = x.encode("utf-8", "surrogatepass")
                    h = line_id(b)
                    if h in seen:
                        continue
                    seen.add(h)
                    own = line_probes(len(x), edits)
                    if len(x) not in place_of:
                        place_of[len(x)] = np.array([2 * i + p[3] for i, p in enumerate(own)], np.int32)
                    sids.append(h)
                    keys.append(hashes(x, own))
                    places.append(place_of[len(x)])
            if len(seen) > SEEN:
                seen.clear()
            yield _rows(sids, keys, places)

    return docs.select("text").mapInPandas(run, KEYED)


def finer_keys(held: DataFrame, edits: Edits) -> DataFrame:
    """KEYED for what lines leave of themselves without the segment that they share under a key. held: sid, key, place, content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, places = [], []
            for key, place, x in zip(batch["key"].tolist(), batch["place"].tolist(), batch["content"].tolist()):
                a, b, _, _, t, extra = line_probes(len(x), edits)[place // 2]
                rest = x[:a] + x[b:]
                # a line filed under the key is a partner of its own length, and one that is longer by `extra` looks for it
                own = probes(len(rest), t, extra)
                keys.append(hashes(rest, own, key & ((1 << 62) - 1)))
                places.append(np.array([2 * i + p[3] for i, p in enumerate(own)], np.int32))
            yield _rows([x & ((1 << 64) - 1) for x in batch["sid"].tolist()], keys, places)

    return held.select("sid", "key", "place", "content").mapInPandas(run, KEYED)


def shared_keys(keyed: DataFrame) -> DataFrame:
    """KEYED, own and size (rows of the key) of keys of several lines, one of them filed under it."""
    by_key = Window.partitionBy("key")
    filed = F.col("place").bitwiseAND(F.lit(1))
    some = keyed.withColumns({"low": F.min("sid").over(by_key), "high": F.max("sid").over(by_key), "filed": F.max(filed).over(by_key)}).where("low <> high and filed = 1")
    once = some.select("sid", "key", "place").distinct()
    return once.withColumns({"own": filed == 1, "size": F.count("*").over(by_key)})


def _common(a: str, b: str) -> int:
    """Characters that a and b have in common at the start."""
    n, step = min(len(a), len(b)), 0
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low + 1 < high:
        step = (low + high) // 2
        if a[low:step] == b[low:step]:
            low = step
        else:
            high = step
    return low


def within_edits(a: str, b: str, most: int = Edits.most) -> bool:
    """Whether a and b are within `most` edits: a bit-parallel column of 2 most + 1 cells moves along the diagonal.

    The vertical differences in the band are two bit vectors; each character of the longer text
    updates them in a few operations on whole words.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return False
    k = _common(a, b)
    a, b = a[k:], b[k:]
    k = _common(a[::-1], b[::-1])
    a, b = a[: len(a) - k], b[: len(b) - k]
    if not a:
        return len(b) <= most
    m, n, width = len(a), len(b), 2 * most + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    # while column j is worked out, bit i of the band stands for row j + 1 - most + i; rows past the last match nothing
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << (i + most + 1)
    plus, minus, score = full ^ ((1 << most) - 1), 0, most  # score: of the band's lowest row
    for j in range(n):
        match = (where.get(b[j], 0) >> (j + 1)) & full
        diagonal = (((((match & plus) + plus) ^ plus) | match | minus)) & full
        right_plus = minus | (full & ~(diagonal | plus))
        right_minus = diagonal & plus
        score += not diagonal & top
        shifted = diagonal >> 1
        plus = right_minus | (full & ~(shifted | right_plus))
        minus = shifted & right_plus
    # from the lowest row of the band up to row m; the differences already stand for the next column's rows
    bit = top >> 1
    for _ in range(n + most - m):
        score += bool(minus & bit) - bool(plus & bit)
        bit >>= 1
    return score <= most


def split_lines(text: str | None) -> list[str]:
    return [x.strip(SPACE) for x in text.split("\n")] if isinstance(text, str) else []


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """sid and content of the wanted lines (column sid), each once."""
    lines = docs.select(F.explode(lines_of(F.col("text"))).alias("content")).select(F.xxhash64("content").alias("sid"), "content")
    return join_small(lines, wanted.withColumn("__wanted", F.lit(True)), ["sid"], "inner").drop("__wanted").dropDuplicates(["sid"])


def confirmed(pairs: DataFrame, edits: Edits) -> DataFrame:
    """Those rows a, b, x, y (lines and their contents) that are within their edits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.loc[[within_edits(x, y, edits.of(min(len(x), len(y)))) for x, y in zip(batch["x"], batch["y"])], ["a", "b"]]

    return pairs.select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def parities(lines: list[str]) -> np.ndarray:
    """For each line 256 parities of its characters' pairs. An edit changes four pairs at the most, and so flips four bits."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    inside = np.flatnonzero(owner[1:] == owner[:-1])
    with np.errstate(over="ignore"):
        bit = ((codes[inside] * np.uint64(0x9E3779B97F4A7C15) ^ codes[inside + 1] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(56)).astype(np.int64)
    odd = np.bincount(owner[inside] * 256 + bit, minlength=len(lines) * 256).reshape(len(lines), 256) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.uint64)


def block_links(p: list[dict], q: list[dict], edits: Edits) -> list[tuple[int, int]]:
    """Links between lines of different classes of two blocks; pairs that differ in too many parities are left out at once."""
    ones = np.bitwise_count(parities([x["content"] for x in p])[:, None, :] ^ parities([y["content"] for y in q])[None, :, :]).sum(2)
    size = [np.array([len(x["content"]) for x in side]) for side in (p, q)]
    near = (ones <= 4 * edits.most) & (np.abs(size[0][:, None] - size[1][None, :]) <= edits.most)
    links = []
    for i, j in zip(*np.nonzero(near)):
        x, y = p[i], q[j]
        if x["sid"] != y["sid"] and x["c"] != y["c"] and within_edits(x["content"], y["content"], edits.of(int(min(size[0][i], size[1][j])))):
            links.append((x["sid"], y["sid"]))
    return links


def across_blocks(members: DataFrame, edits: Edits) -> DataFrame:
    """Links a, b between lines of different classes of a large key: key, sid, content, c (class)."""
    n_blocks = F.ceil(F.count("*").over(Window.partitionBy("key")) / F.lit(BLOCK))
    dealt = members.withColumn("n", n_blocks).withColumn("block", F.pmod(F.xxhash64("sid"), F.col("n")))
    held = cut(dealt.groupBy("key", "n", "block").agg(F.collect_list(F.struct("sid", "content", "c")).alias("rows")))
    one = held.select("key", "block", F.col("rows").alias("p"))
    two = held.select("key", F.col("block").alias("other"), F.col("rows").alias("q"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([x for p, q in zip(batch["p"], batch["q"]) for x in block_links(p, q, edits)], columns=["a", "b"])

    # blocks cost far more than their bytes tell
    n_held, n_pairs = held.agg(F.count("*"), F.sum(F.col("n") + 1) / 2).first()
    n_tasks = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_held // 8)
    dealt = one.join(two, "key").where("block <= other").repartition(n_tasks, "key", "block", "other")
    return cut(in_tasks(dealt.select("p", "q"), int(n_pairs or 0), PAIRS).mapInPandas(run, "a long, b long"))


def in_tasks(rows: DataFrame, n: int, worth: int = ROWS) -> DataFrame:
    """The same rows, of which there are about n, in no more partitions than are worth a task: a task without work costs as much as thousands of rows."""
    return rows.coalesce(1 + n // worth)


def link_lines(docs: DataFrame, edits: Edits) -> DataFrame | None:
    """node and component of every line of docs (text) linked with another one, or None without links."""
    members = cut(shared_keys(key_lines(docs, edits)))
    n_rows = members.count()
    if not n_rows:
        return None
    popular = cut(in_tasks(members.groupBy("sid").agg(F.sum("size").alias("shared")), n_rows))
    n_lines = popular.count()
    texts = cut(in_tasks(texts_of(docs, popular.select("sid")), n_lines, TEXTS))
    chars = (texts.agg(F.sum(F.length("content"))).first()[0] or 0) / n_lines
    members = cut(in_tasks(members.join(popular, "sid"), n_rows))
    found = None

    def add(pairs: DataFrame, n_pairs: int) -> None:
        """Compares at most n_pairs pairs a, b."""
        add_sure(confirmed(in_tasks(with_texts(pairs), int(n_pairs * chars), CHARS), edits))

    def add_sure(sure: DataFrame) -> None:
        nonlocal found
        sure = cut(sure)
        if sure.limit(1).count():
            found = components(sure if found is None else sure.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        release(sure)

    def with_texts(pairs: DataFrame) -> DataFrame:
        told = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        for side, name in (("a", "x"), ("b", "y")):
            told = told.join(texts.select(F.col("sid").alias(side), F.col("content").alias(name)), side)
        return told

    for turn in range(2):
        rows = with_component(members, found)
        rank = F.struct("own", "shared", "sid") if turn == 0 else F.struct(F.col("own"), F.xxhash64("sid", F.lit(turn)), F.col("sid"))
        mixed = rows if turn == 0 else rows.join(mixed_keys(rows), "key", "left_semi")
        leaders = mixed.groupBy("key").agg(F.max_by("sid", rank).alias("leader"), F.max_by("c", rank).alias("leader_c"))
        add(mixed.join(leaders, "key").where("c <> leader_c").select(F.col("sid").alias("a"), F.col("leader").alias("b")), n_rows)

    def compare(members: DataFrame, n: int) -> tuple[DataFrame, int]:
        """Compares lines of different classes that share a small key; returns the rows of large ones and their number. n: about the rows of members."""
        rows = with_component(members, found)
        mixed = cut(in_tasks(rows.join(mixed_keys(rows), "key", "left_semi"), n))
        is_small = F.col("size") <= SMALL
        n_large, twice = mixed.agg(F.count_if(~is_small), F.coalesce(F.sum(F.when(is_small, F.col("size") - 1)), F.lit(0))).first()
        small = mixed.where(is_small)
        other = small.select("key", F.col("sid").alias("b"), F.col("c").alias("c_b"), F.col("own").alias("own_b"))
        if twice:
            add(small.join(other, "key").where("c <> c_b and sid < b and (own or own_b)").select(F.col("sid").alias("a"), "b"), twice // 2)
        return mixed.where(~is_small), n_large

    large, n_large = compare(members, n_rows)
    if n_large:
        finer = shared_keys(finer_keys(in_tasks(large.join(texts, "sid"), n_large, TEXTS), edits))
        large, n_large = compare(cut(in_tasks(finer, 4 * n_large)), 4 * n_large)
        if n_large:
            add_sure(across_blocks(in_tasks(large.select("key", "sid", "c").distinct().join(texts, "sid"), n_large, TEXTS), edits))
    return found


def classify_lines(docs: DataFrame, edits: Edits = Edits()) -> DataFrame:  # noqa: B008
    """doc_id, number (of the line), class_id and kept of each line that isn't blank; row tells rows of docs apart.

    Needs doc_id and text; other columns are left out. Lines end at line feeds and are compared
    without white space at their ends. Blank lines have no class and are kept. Equal lines are of
    one class, and so are lines within the edits that their length allows. Of a class the line with
    the least doc_id, then number, is kept, a null doc_id coming last. A document without such
    lines, its text being null or not, has one row without number and class. Of repeated rows all
    keep the same lines.
    """
    with scratch() as keep:
        texts = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
        ids = F.transform(lines_of(F.col("text")), lambda x: F.when(x != "", F.xxhash64(x)))
        filed = cut(texts.select("row", "doc_id", ids.alias("lines")))
        each = filed.select("row", "doc_id", F.posexplode("lines").alias("number", "sid")).where(F.col("sid").isNotNull())
        place = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("doc"), F.col("number").alias("number"))
        by_line = each.groupBy("sid").agg(F.min(place).alias("first"), F.count("*").alias("n"))
        n = filed.agg(F.sum(F.size("lines"))).first()[0] or 0
        found = link_lines(docs, edits)
        placed = with_component(by_line, found)
        classes = placed.groupBy("c").agg(F.min("first").alias("kept_at"), F.sum("n").alias("size")).where("size > 1")
        moved = cut(in_tasks(placed.join(classes, "c").select("sid", "c", "kept_at"), n))
        keep += [filed, moved]
    told = join_small(each, moved, ["sid"])
    blank = filed.where(~F.exists("lines", lambda x: x.isNotNull()))
    kept = F.col("kept_at").isNull() | (F.col("kept_at.doc").eqNullSafe(F.col("doc_id")) & (F.col("kept_at.number") == F.col("number")))
    lines = told.select("row", "doc_id", "number", F.coalesce("c", "sid").alias("class_id"), kept.alias("kept"))
    return lines.unionByName(blank.select("row", "doc_id", F.lit(None).cast("int").alias("number"), F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept")))


def dedup_report(docs: DataFrame, edits: Edits = Edits()) -> DataFrame:  # noqa: B008
    """doc_id, n_lines (not blank), n_dropped and dropped (numbers of the dropped lines, from 0) of each document."""
    told = classify_lines(docs, edits)
    numbers = F.array_sort(F.collect_list(F.when(~F.col("kept"), F.col("number"))))
    return told.groupBy("row", "doc_id").agg(
        F.count("number").alias("n_lines"), F.count_if(~F.col("kept")).alias("n_dropped"),
        F.array_join(F.transform(numbers, lambda x: x.cast("string")), ",").alias("dropped"),
    ).drop("row")
