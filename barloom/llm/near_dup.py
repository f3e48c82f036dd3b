"""Near duplicates by MinHash, odd sketches and exact verification.

A text's set is that of its five-word shingles. Texts with the same set are one node. MinHash
samples are banded: nodes that agree in all samples of a band share a bucket. With BANDS bands of
ROWS samples a pair with similarity 0.75 shares a bucket with a probability of 1 - 1.3e-6.

For each node, one-permutation MinHash samples (the least hash in each of BINS ranges of the hash)
are folded into an odd sketch, a bitmap of parities. The ones in the exclusive or of two sketches
tell how many samples differ, with an error far below that of the banded samples, so that only
pairs that are nearly similar have their sets fetched. Those are confirmed on the full sets.

Buckets are never expanded into all pairs. Nodes of a bucket are first compared with one of them,
the one that shares buckets with most others, then with another one, and what turns out to be
linked becomes one component. After that only nodes of different components are compared: in
buckets of up to FEW nodes each with each, by their sketches. A larger bucket is cut into blocks, and
pairs of blocks whose sets' sizes allow a link are compared where they are read, by their sketches
and then by 32 bits of each shingle, each pair of nodes in the first band that both share. Only
pairs that pass are written, which are links but for collisions of those 32 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, cut, join_small, release, scratch
from .components import components
from .tokens import blocks, find_words, mix64, window_hashes

SHINGLE = 5
BANDS, ROWS = 50, 5
BINS = 1024
SKETCH_BITS = 2048
#: Least similarity, in hundredths.
SIMILAR = 75
#: Standard deviations below the samples expected in common at SIMILAR at which a pair is given up.
DEVIATIONS = 5.0
#: Nodes of a block, and the largest set that is compared within blocks; larger ones pass by their sketches.
BLOCK, SHORT_SET = 256, 4096
#: Nodes of a bucket up to which those of different components are compared each with each.
FEW = 8
#: Shingles by which a comparison of 32 bits may be off.
SLACK = 2

_RANDOM = np.random.default_rng(20240229)
_A = (_RANDOM.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted shingle hashes of each text; fewer words than SHINGLE are one shingle, no words none."""
    found = find_words(texts, lower=True)
    windows = window_hashes(found.hash, SHINGLE)
    out = []
    for a, b in zip(found.first[:-1], found.first[1:]):
        if b - a >= SHINGLE:
            out.append(np.unique(windows[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(window_hashes(found.hash[a:b], int(b - a)) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A number for each set that only its members decide."""
    out = np.zeros(len(sets), np.uint64)
    with np.errstate(over="ignore"):
        for i, s in enumerate(sets):
            out[i] = mix64(np.array([mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s)) * np.uint64(0xA24BAED4963EE407)], np.uint64))[0]
    return out.view(np.int64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples, a row for each set; sets must not be empty."""
    start = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    values = (np.concatenate(sets) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = np.empty((len(sets), BANDS * ROWS), np.uint32)
    with np.errstate(over="ignore"):
        for j in range(BANDS * ROWS):
            out[:, j] = np.minimum.reduceat(values * _A[j] + _B[j], start)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(len(samples), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for j in range(ROWS):
        out = mix64(out ^ (rows[:, :, j] + (np.uint64(j + 1) << np.uint64(32))))
    return out.view(np.int64)


def odd_sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps in which each sample flips the bit that it hashes to, and the number of samples.

    A set is sorted, so the first hash of each range of BINS is that range's least.
    """
    start = np.cumsum([0, *[len(x) for x in sets[:-1]]])
    members = np.concatenate(sets)
    place = members >> np.uint64(64 - (BINS.bit_length() - 1))
    first = np.concatenate([[True], place[1:] != place[:-1]])
    first[start] = True
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[first]
    bit = (mix64(members[first] ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = (np.bincount(owner * SKETCH_BITS + bit, minlength=len(sets) * SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(sets), SKETCH_BITS), axis=1), np.bincount(owner, minlength=len(sets))


def passes(ones: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, s_a: np.ndarray, s_b: np.ndarray) -> np.ndarray:
    """Whether pairs may be similar: ones in the exclusive or of their sketches, sizes of their sets, numbers of their samples."""
    j = SIMILAR / 100
    size = 100 * np.minimum(n_a, n_b) >= SIMILAR * np.maximum(n_a, n_b)
    load = ones / SKETCH_BITS
    differ = -SKETCH_BITS / 2 * np.log(np.maximum(1e-9, 1 - 2 * load))
    common = (s_a + s_b - differ) / 2
    # at similarity j: union, ranges of BINS that hold some of it, and how many of these hold more than one
    union = (n_a + n_b) / (1 + j)
    rate = union / BINS
    held = BINS * -np.expm1(-rate)
    shared = 1 - rate * np.exp(-rate) / -np.expm1(-rate)
    rho = np.maximum(0.0, (s_a + s_b) - 2 * j * held) / SKETCH_BITS
    p = -np.expm1(-2 * rho) / 2
    fading = np.exp(-4 * rho)
    noise = np.maximum(0.0, SKETCH_BITS * (p * (1 - p) - rho * fading)) / fading
    deviation = np.sqrt(held * j * (1 - j) * shared + noise / 4)
    return size & (common >= j * held - DEVIATIONS * deviation - 2)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), sid (null of an empty set), samples, bands (their keys) and odd (the sketch), null where no other set can be similar."""
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, part in blocks(batch["text"].tolist(), 1 << 20):
                sets = shingle_sets(part)
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                out = pd.DataFrame({"doc_id": batch["doc_id"].iloc[first : first + len(part)].to_numpy(), "n": n, "samples": 0})
                out["sid"] = pd.array(set_ids(sets), dtype="Int64")
                out.loc[n == 0, "sid"] = pd.NA
                bands: list = [None] * len(part)
                odds: list = [None] * len(part)
                # three of four shingles in common is the least that can be similar and not equal
                some = np.flatnonzero(n >= 3)
                if len(some):
                    own = [sets[i] for i in some]
                    keys = band_keys(signatures(own))
                    sketches, samples = odd_sketches(own)
                    for i, x, y in zip(some, keys, sketches):
                        bands[i], odds[i] = x, y.tobytes()
                    out.loc[some, "samples"] = samples
                out["bands"], out["odd"] = bands, odds
                yield out[["doc_id", "n", "sid", "samples", "bands", "odd"]]

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n long, sid long, samples long, bands array<long>, odd binary")


def unpack(column: pa.Array) -> np.ndarray:
    """Sketches as 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def full_sets(docs: DataFrame) -> DataFrame:
    """sid, its sorted shingle hashes as bytes, and the same cut to 32 bits (none of a large set)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in blocks(batch["text"].tolist(), 1 << 20):
                sets = shingle_sets(part)
                short = [np.unique((s & np.uint64(0xFFFFFFFF)).astype(np.uint32)).tobytes() if len(s) <= SHORT_SET else b"" for s in sets]
                yield pd.DataFrame({"sid": set_ids(sets), "members": [s.tobytes() for s in sets], "short": short})

    return docs.select("text").mapInPandas(run, "sid long, members binary, short binary")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs a, b whose full sets are similar."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"]):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= SIMILAR * (len(p) + len(q) - common))
            yield batch.loc[keep, ["a", "b"]]

    with_x = pairs.join(sets.select(F.col("sid").alias("a"), F.col("members").alias("x")), "a")
    with_y = with_x.join(sets.select(F.col("sid").alias("b"), F.col("members").alias("y")), "b")
    return with_y.select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs a, b once each, without those whose sizes or sketches rule them out."""
    told = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for side in "ab":
        told = told.join(nodes.select(F.col("sid").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "samples", "odd")]), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                col = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
                number = {k: col[k].to_numpy(zero_copy_only=False).astype(float) for k in ("n_a", "n_b", "samples_a", "samples_b")}
                ones = np.bitwise_count(unpack(col["odd_a"]) ^ unpack(col["odd_b"])).sum(1)
                keep = pa.array(passes(ones, number["n_a"], number["n_b"], number["samples_a"], number["samples_b"]))
                yield pa.RecordBatch.from_arrays([col["a"].filter(keep), col["b"].filter(keep)], schema=PAIR)

    return told.mapInArrow(run, "a long, b long")


def across(mixed: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs a, b of nodes of different components that share a key and may be similar.

    mixed: key, sid, c. A key's nodes are parted by the size of their sets, so that only nodes of the
    same part and of the next one can be similar, and dealt over blocks by a hash. Each pair of
    blocks is one row that some task compares on its own.
    """
    spark = mixed.sparkSession
    sized = mixed.join(nodes.select("sid", "n", "samples", "odd", "bands"), "sid").withColumn("part", F.floor(F.log(F.col("n").cast("double")) / np.log(100 / SIMILAR) + 1e-9))
    n_blocks = F.ceil(F.count("*").over(Window.partitionBy("key", "part")) / F.lit(BLOCK))
    dealt = sized.withColumn("m", n_blocks).withColumn("block", F.concat_ws("/", "part", F.pmod(F.xxhash64("sid"), F.col("m"))))
    whole = dealt.join(sets.select("sid", "short"), "sid")
    held = cut(whole.groupBy("key", "part", "block").agg(F.collect_list(F.struct("sid", "c", "n", "samples", "odd", "bands", "short")).alias("rows")))
    # which blocks meet is told by their names; then each content is sent to its pairs, the second one by the pairs' own partitioning
    ids = held.select("key", "part", "block")
    one = ids.select("key", "block", "part", F.explode(F.array("part", F.col("part") + 1)).alias("next"))
    two = ids.select(F.col("key").alias("key_q"), F.col("part").alias("part_q"), F.col("block").alias("other"))
    pairs = one.join(two, (F.col("key") == F.col("key_q")) & (F.col("next") == F.col("part_q"))).where((F.col("next") != F.col("part")) | (F.col("block") <= F.col("other"))).select("key", "block", "other")
    met = pairs.join(held.select("key", "block", F.col("rows").alias("p")), ["key", "block"]).join(held.select("key", F.col("block").alias("other"), F.col("rows").alias("q")), ["key", "other"])
    met = met.select("key", "block", "other", "p", "q")

    def similar(x: bytes, y: bytes, n: float) -> bool:
        if not x or not y:
            return True
        both = np.sort(np.concatenate([np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)]), kind="stable")
        common = int((both[1:] == both[:-1]).sum()) + SLACK
        return 100 * common >= SIMILAR * (n - common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            key = batch.column(names.index("key")).to_numpy()
            within = (batch.column(names.index("block")).to_numpy(zero_copy_only=False) == batch.column(names.index("other")).to_numpy(zero_copy_only=False))
            sides = []
            for side in "pq":
                lists = batch.column(names.index(side))
                flat = lists.flatten()
                at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                fields = [flat.field(k).to_numpy(zero_copy_only=False) for k in range(4)]
                short = np.empty(len(flat), object)
                short[:] = flat.field(6).to_pylist()
                bands = flat.field(5).flatten().to_numpy(zero_copy_only=False).reshape(len(flat), BANDS)
                sides.append((at, *fields, unpack(flat.field(4)), bands, short))
            a: list[int] = []
            b: list[int] = []
            for r in range(batch.num_rows):
                (sid_p, c_p, n_p, s_p, odd_p, bands_p, short_p), (sid_q, c_q, n_q, s_q, odd_q, bands_q, short_q) = ([x[at[r] : at[r + 1]] for x in rest] for at, *rest in sides)
                apart = c_p[:, None] != c_q[None, :]
                i, j = np.nonzero(apart & (sid_p[:, None] < sid_q[None, :]) if within[r] else apart)
                ones = np.bitwise_count(odd_p[i] ^ odd_q[j]).sum(1)
                ok = passes(ones, n_p[i].astype(float), n_q[j].astype(float), s_p[i].astype(float), s_q[j].astype(float))
                i, j = i[ok], j[ok]
                here = bands_p[i, (bands_p[i] == bands_q[j]).argmax(1)] == key[r]
                for x, y in zip(i[here], j[here]):
                    if similar(short_p[x], short_q[y], float(n_p[x] + n_q[y])):
                        a.append(int(sid_p[x]))
                        b.append(int(sid_q[y]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=PAIR)

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "4")  # a row here is two blocks
    try:
        return cut(met.mapInArrow(run, "a long, b long"))
    finally:
        spark.conf.set(key, before)
        release(held)


def with_component(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """rows with the component of sid; a node without links is its own."""
    if found is None:
        return rows.withColumn("c", F.col("sid"))
    return rows.join(found.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("c", F.coalesce("component", "sid")).drop("component")


def link_components(docs: DataFrame, sketched: DataFrame) -> DataFrame:
    """node and component of every node linked with another one."""
    nodes = cut(sketched.where(F.col("bands").isNotNull()).dropDuplicates(["sid"]).select("sid", "n", "samples", "odd", "bands"))
    keyed = nodes.select("sid", F.explode("bands").alias("key"))
    members = cut(keyed.withColumn("size", F.count("*").over(Window.partitionBy("key"))).where("size > 1"))
    popular = members.groupBy("sid").agg(F.sum("size").alias("shared"))
    members = cut(members.join(popular, "sid"))

    holders = sketched.where(F.col("bands").isNotNull()).select("doc_id", "sid")
    links, found, sets = None, None, None

    def fetch(need: DataFrame) -> None:
        """Looks up the texts of sets that haven't been fetched yet."""
        nonlocal sets
        if sets is not None:
            need = need.join(sets.select("sid"), "sid", "left_anti")
        who = cut(holders.join(need, "sid", "left_semi").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.count("doc_id").alias("k")))
        if who.limit(1).count():
            ids = who.where("k > 0").select("doc_id").distinct()
            texts = join_small(docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()), ids, ["doc_id"], "inner", salts=1).select("text")
            if who.where("k = 0").limit(1).count():  # sets that only documents without an id have
                texts = texts.unionByName(docs.where(F.col("doc_id").isNull()).select("text"))
            more = cut(full_sets(texts).join(who.select("sid"), "sid", "left_semi").dropDuplicates(["sid"]))
            sets = more if sets is None else sets.unionByName(more)

    def test(pairs: DataFrame) -> tuple[DataFrame, int]:
        wanted = cut(likely(pairs, nodes))
        fetch(wanted.select(F.explode(F.array("a", "b")).alias("sid")).distinct())
        if sets is None:
            return wanted, 0
        sure = cut(confirmed(wanted, sets))
        return sure, sure.limit(1).count()

    def add(pairs: DataFrame) -> None:
        nonlocal links, found
        sure, some = test(pairs)
        if some:
            stars = sure if found is None else sure.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
            found = components(stars)

    for turn in range(2):
        rows = with_component(members, found)
        rank = F.struct("shared", "sid") if turn == 0 else F.struct(F.xxhash64("sid", F.lit(turn)), F.col("sid"))
        mixed = rows if turn == 0 else rows.join(mixed_keys(rows), "key", "left_semi")
        leaders = mixed.groupBy("key").agg(F.max_by("sid", rank).alias("leader"), F.max_by("c", rank).alias("leader_c"))
        add(mixed.join(leaders, "key").where("c <> leader_c").select(F.col("sid").alias("a"), F.col("leader").alias("b")))
    rows = with_component(members, found)
    mixed = rows.join(mixed_keys(rows), "key", "left_semi").select("key", "sid", "c")
    mixed = cut(mixed.withColumn("size", F.count("*").over(Window.partitionBy("key"))))
    few, many = mixed.where(F.col("size") <= FEW), mixed.where(F.col("size") > FEW)
    other = few.select("key", F.col("sid").alias("b"), F.col("c").alias("c_b"))
    pairs = few.join(other, "key").where("c <> c_b and sid < b").select(F.col("sid").alias("a"), "b")
    fetch(many.select("sid").distinct())
    blocks_told = across(many, nodes, sets) if sets is not None else None
    add(pairs if blocks_told is None else pairs.unionByName(blocks_told))
    return found if found is not None else docs.sparkSession.createDataFrame([], "node long, component long")


def mixed_keys(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document.

    Needs doc_id and text; other columns are left out. component_id is the least doc_id that the
    document reaches over links. Null and blank texts have no set, are linked with nothing and are
    kept. A document without doc_id is kept only if all it is linked with have none. Repeated rows
    have the same set, so that all with the least doc_id are kept. An empty table gives no rows.
    """
    with scratch() as keep:
        sketched = cut(sketch(docs))
        moved = cut(moved_sets(docs, sketched))
        alone = cut(sketched.select("doc_id", "n", "sid"))
        keep += [moved, alone]
    joined = join_small(alone, moved, ["sid"])
    component = F.when(F.col("moved"), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def moved_sets(docs: DataFrame, sketched: DataFrame) -> DataFrame:
    """sid, component_id and moved (true) of the sets that several documents have or that are linked with another one."""
    found = link_components(docs, sketched)
    by_set = sketched.where(F.col("sid").isNotNull()).groupBy("sid").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    placed = with_component(by_set, found)
    of_component = placed.groupBy("c").agg(F.min("least").alias("component_id"), F.sum("copies").alias("size")).where("size > 1")
    return placed.join(of_component, "c").select("sid", "component_id", F.lit(True).alias("moved"))
