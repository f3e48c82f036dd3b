"""Prefix tries of conversations, built as succinct level-order (LOUDS) tries by prefix shard.

Every conversation is first rebuilt (`rebuilt`): some turns that its family shares, then its own. A
node is one sequence of first turns; it is known by 128 bits, the exclusive or of a hash of each
turn and its place, so that a running window gives the node of every step of a conversation.

Nodes on the path of more than HEAVY conversations form the heavy upper levels. They are merged by
partial aggregates. Below them, and again every LEVELS levels, a prefix shard begins: at most HEAVY
conversations by LEVELS steps. Shards are dealt over tasks by their root; each task builds one LOUDS
bitvector with its label arrays in numpy and rolls up from the last level to the first with add.at.

What lies below a shard or a heavy node is added once, by ownership: each heavy node, and each
shard as a whole, belongs to the smallest conversation on its path. A node's total is its shard's
own plus what the conversations through it own further down, a running sum along each
conversation. So a conversation of any length needs no walk from shard to shard.

Turns are ordered by turn (null first), then role, then text; a null role or text is empty. Rows
that repeat are turns of their own. Remainders of negative ids are negative, as in SQL. Rows without a conv_id belong to no conversation. An empty table
gives no node, not even a root.

The ids that end at one node are hashed in order, so one task streams them, in chunks that were
sorted and joined elsewhere; it holds one chunk at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, join_small, release, scratch

#: Conversations through a node above which it belongs to the upper levels, and levels of a shard.
HEAVY, LEVELS = 1000, 64
#: Steps of a task, about.
TASK_STEPS = 50_000
#: Conversations of a family, turns that it may share, and ids of a chunk that is hashed at once.
FAMILY, SHARED = 5, 9
CHUNK = 10_000
#: The hash of no ids.
NO_ENDS = hashlib.sha256(b"").hexdigest()

KEY = ["depth", "k1", "k2"]


def shared_turns(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % SHARED


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), role, text of each turn of the rebuilt conversations, and n_turns; one without turns has a row of depth null."""
    own = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    turns = own.withColumn("place", F.row_number().over(order)).drop("turn")
    lengths = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", shared_turns(F.col("conv_id")))
    first = lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("in_base"))
    plan = lengths.join(first, "base", "left").withColumn("head", F.least("h", F.coalesce("in_base", F.lit(0))))
    plan = plan.withColumn("n_turns", F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).select("conv_id", "base", "h", "head", "n_turns")
    tail = turns.join(plan, "conv_id").where(F.col("place") > F.col("h")).select("conv_id", "n_turns", (F.col("place") - F.col("h") + F.col("head")).alias("depth"), "role", "text")
    heads = turns.where(F.col("place") < SHARED).withColumnRenamed("conv_id", "base")
    head = heads.join(plan, "base").where(F.col("place") <= F.col("head")).select("conv_id", "n_turns", F.col("place").alias("depth"), "role", "text")
    silent = plan.where("n_turns = 0").select("conv_id", "n_turns", F.lit(None).cast("int").alias("depth"), F.lit("").alias("role"), F.lit("").alias("text"))
    return tail.unionByName(head).unionByName(silent)


def steps_of(turns: DataFrame) -> DataFrame:
    """A row for each step of each conversation, from the root at depth 0: conv_id, n_turns, its node (depth, k1, k2), the node above (p1, p2) and bytes of its text."""
    part = lambda seed: F.xxhash64(F.lit(seed), "depth", "role", "text")
    labels = turns.where(F.col("depth").isNotNull()).select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.col("depth").cast("long").alias("depth"), part(1).alias("h1"), part(2).alias("h2"), F.octet_length("text").cast("long").alias("bytes"))
    run = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    keyed = labels.withColumn("k1", F.bit_xor("h1").over(run)).withColumn("k2", F.bit_xor("h2").over(run))
    below = keyed.select("conv_id", "n_turns", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("h2")).alias("p2"), "bytes")
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    root = turns.where(F.col("depth").isNull() | (F.col("depth") == 1)).select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("bytes"))
    return below.unionByName(root)


class Louds:
    """An ordinal tree in level order: a one for each child of a node, then a zero, packed to bits.

    Node 0 is the root; the i-th one (from 0) is node i + 1. Ranks are kept for each 64 bits.
    """

    def __init__(self, parents: np.ndarray) -> None:
        """parents of nodes 1, 2, ...; they must not decrease, as level order has it."""
        self.nodes = len(parents) + 1
        degree = np.bincount(parents, minlength=self.nodes) if len(parents) else np.zeros(self.nodes, np.int64)
        bits = np.ones(2 * self.nodes - 1, np.uint8)
        bits[np.cumsum(degree + 1) - 1] = 0
        self.length = len(bits)
        self.packed = np.packbits(np.concatenate([bits, np.zeros(-len(bits) % 64, np.uint8)]))
        ones = np.unpackbits(self.packed).reshape(-1, 64).sum(1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.packed)[: self.length]

    def rank1(self, place: int) -> int:
        """Ones before place."""
        block, rest = divmod(place, 64)
        return int(self.before[block] + (np.unpackbits(self.packed[block * 8 : block * 8 + 8])[:rest].sum() if rest else 0))

    def _select(self, k: int, bit: int) -> int:
        """Where the k-th such bit (from 0) is."""
        counts = self.before if bit else np.arange(len(self.before)) * 64 - self.before
        block = int(np.searchsorted(counts, k, side="right")) - 1
        own = np.unpackbits(self.packed[block * 8 : block * 8 + 8])
        return block * 64 + int(np.flatnonzero(own == bit)[k - counts[block]])

    def parent(self, node: int) -> int:
        """The number of zeros before the node's one."""
        place = self._select(node - 1, 1)
        return place - self.rank1(place)

    def children(self, node: int) -> range:
        """Consecutive in level order."""
        start = self._select(node - 1, 0) + 1 if node else 0
        end = self._select(node, 0)
        first = self.rank1(start) + 1
        return range(first, first + end - start)

    def parents(self) -> np.ndarray:
        """Of all nodes from 1 on."""
        ones = np.flatnonzero(self.bits())
        return ones - np.arange(len(ones))

    def degrees(self) -> np.ndarray:
        zeros = np.flatnonzero(self.bits() == 0)
        return np.diff(zeros, prepend=-1) - 1


@dataclass
class Forest:
    """The shards of a task below one made-up root: the tree, and for each node from 1 on a row that stands for it, and for each row its node."""

    tree: Louds
    example: np.ndarray
    node: np.ndarray
    level_start: list[int]


def plant(level: np.ndarray, above: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> Forest:
    """Nodes in level order. above: the row of the same conversation one level up, for level 0 anything."""
    node = np.zeros(len(level), np.int64)
    parents, example, starts, made = [], [], [1], 1
    for at in range(int(level.max(initial=-1)) + 1):
        rows = np.flatnonzero(level == at)
        parent = node[above[rows]] if at else np.zeros(len(rows), np.int64)
        order = np.lexsort((k2[rows], k1[rows], parent))
        rows, parent = rows[order], parent[order]
        new = np.ones(len(rows), bool)
        new[1:] = (np.diff(parent) != 0) | (np.diff(k1[rows]) != 0) | (np.diff(k2[rows]) != 0)
        node[rows] = made - 1 + np.cumsum(new)
        parents.append(parent[new])
        example.append(rows[new])
        made += int(new.sum())
        starts.append(made)
    return Forest(Louds(np.concatenate(parents) if parents else np.zeros(0, np.int64)), np.concatenate(example) if example else np.zeros(0, np.int64), node, starts)


def roll_up(forest: Forest, *values: np.ndarray) -> None:
    """Adds to each node what is below it, level by level from the last one; values are by node."""
    parents = np.concatenate([[0], forest.tree.parents()])
    for a, b in zip(forest.level_start[-2::-1], forest.level_start[:0:-1]):
        for v in values:
            np.add.at(v, parents[a:b], v[a:b])


SHARD_OUT = "conv_id long, depth long, k1 long, k2 long, p1 long, p2 long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, stub boolean, unit_root boolean"


def shard_nodes(rows: pa.Table) -> pa.Table:
    """The nodes of all prefix shards of a task. Stubs stand for roots of deeper shards: they count as children and hold nothing."""
    get = lambda c: rows.column(c).combine_chunks().to_numpy(zero_copy_only=False)
    conv, depth, start, stub = get("conv_id"), get("depth"), get("start"), get("stub").astype(bool)
    u1, u2, k1, k2 = get("u1"), get("u2"), get("k1"), get("k2")
    order = np.lexsort((depth, conv, start, u2, u1))
    conv, depth, start, stub, k1, k2 = (x[order] for x in (conv, depth, start, stub, k1, k2))
    forest = plant(depth - start, np.arange(len(conv)) - 1, k1, k2)
    tree, node, n = forest.tree, forest.node, forest.tree.nodes
    example = np.concatenate([[0], forest.example])
    is_stub = stub[example]
    n_convs, least = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    np.add.at(n_convs, node, 1)
    np.minimum.at(least, node, conv)
    degrees = tree.degrees()
    saved = np.where(is_stub, 0, (n_convs - 1) * get("bytes")[order][example])
    leaves = ((degrees == 0) & ~is_stub).astype(np.int64)
    saved[0] = leaves[0] = 0
    roll_up(forest, saved, leaves)
    ends = np.full(n, NO_ENDS, object)
    last = np.flatnonzero((get("n_turns")[order] == depth) & ~stub)
    last = last[np.lexsort((conv[last], node[last]))]
    for group in np.split(last, np.flatnonzero(np.diff(node[last])) + 1) if len(last) else []:
        ends[node[group[0]]] = hashlib.sha256(",".join(map(str, conv[group].tolist())).encode()).hexdigest()
    parents = np.concatenate([[0], tree.parents()])
    root = parents == 0
    up, has_up = least[parents], ~root
    own = slice(1, None)
    pick = lambda c: pa.array(rows.column(c).combine_chunks().take(pa.array(order[example[own]])))
    carried = pick("up")
    parent_conv = pa.array(np.where(has_up[own], up[own], 0), mask=~has_up[own])
    return pa.table({
        "conv_id": least[own], "depth": depth[example[own]], "k1": k1[example[own]], "k2": k2[example[own]], "p1": pick("p1"), "p2": pick("p2"),
        "parent_conv_id": pc.coalesce(parent_conv, carried), "n_convs": n_convs[own], "n_children": degrees[own], "n_leaves": leaves[own], "saved_tokens": saved[own],
        "ends_sha256": pa.array(ends[own], pa.string()), "stub": is_stub[own], "unit_root": root[own],
    })


def joined_ids(ends: DataFrame) -> DataFrame:
    """depth, k1, k2 and the hash of the conv_ids that end there, in order and comma-joined."""
    plan = ends.sparkSession

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, k1, k2, conv = (b.column(c).to_numpy(zero_copy_only=False) for c in (*KEY, "conv_id"))
            edges = np.flatnonzero((np.diff(d) != 0) | (np.diff(k1) != 0) | (np.diff(k2) != 0)) + 1
            cuts = sorted({0, len(conv), *edges.tolist(), *range(0, len(conv), CHUNK)})
            at = np.array(cuts[:-1], np.int64)
            if len(conv):
                yield pa.RecordBatch.from_pydict({"depth": d[at], "k1": k1[at], "k2": k2[at], "first": conv[at], "ids": pa.array([",".join(map(str, conv[x:y].tolist())) for x, y in zip(cuts, cuts[1:])], pa.string())})

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, running = None, None
        for b in batches:
            done = []
            for key, ids in zip(zip(*(b.column(c).to_pylist() for c in KEY)), b.column("ids").to_pylist()):
                if key != held:
                    done += [(*held, running.hexdigest())] if held else []
                    held, running = key, hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip((*KEY, "ends_sha256"), x)) for x in done])
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip((*KEY, "ends_sha256"), (*held, running.hexdigest())))])

    pieces = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(chunks, "depth long, k1 long, k2 long, first long, ids string")
    spread = max(1, int(plan.conf.get("spark.sql.shuffle.partitions")))
    return pieces.repartition(spread, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digests, "depth long, k1 long, k2 long, ends_sha256 string")


def placed(steps: DataFrame, heavy: DataFrame, levels: int) -> DataFrame:
    """steps with what the heavy levels know of their node (n_heavy, owner), up (the owner of the node above), the depth where the shard starts, its root (u1, u2), and those of the shard above (b1, b2)."""
    step = Window.partitionBy("conv_id").orderBy("depth")
    so_far = step.rowsBetween(Window.unboundedPreceding, 0)
    told = join_small(steps, heavy.select(*KEY, "n_heavy", "owner"), KEY)
    above = F.sum(F.when(F.col("n_heavy").isNotNull(), 1).otherwise(0)).over(so_far)  # heavy nodes are a path from the root
    told = told.withColumn("above", above).withColumn("up", F.lag("owner").over(step))
    told = told.withColumn("start", F.when(F.col("n_heavy").isNull(), F.col("above") + levels * F.floor((F.col("depth") - F.col("above")) / levels)))
    held = lambda c: F.last(F.when(F.col("depth") == F.col("start"), F.col(c)), ignorenulls=True).over(so_far)
    told = told.withColumn("u1", held("k1")).withColumn("u2", held("k2"))
    return told.withColumn("b1", F.lag("u1").over(step)).withColumn("b2", F.lag("u2").over(step))


def prefix_trie(conversations: DataFrame, heavy_at: int = HEAVY, levels: int = LEVELS, rebuild: bool = True) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Without rebuild, conversations hold conv_id, n_turns, depth, role and text as `rebuilt` gives them.
    """
    with scratch() as keep:
        steps = cut(steps_of(rebuilt(conversations) if rebuild else conversations))
        counts = steps.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_heavy"), F.min("conv_id").alias("owner"), F.max("bytes").alias("bytes"), F.first("p1").alias("p1"), F.first("p2").alias("p2"))
        heavy = cut(counts.where((F.col("n_heavy") > heavy_at) | (F.col("depth") == 0)))
        told = cut(placed(steps, heavy, levels))
        release(steps)

        light = told.where(F.col("n_heavy").isNull())
        shared = ["conv_id", "n_turns", *KEY, "p1", "p2", "bytes"]
        real = light.select(*shared, "start", "u1", "u2", F.when(F.col("depth") == F.col("above"), F.col("up")).alias("up"), F.lit(False).alias("stub"))
        deeper = light.where((F.col("depth") == F.col("start")) & (F.col("start") > F.col("above")))
        stubs = deeper.select(*shared, (F.col("start") - levels).alias("start"), F.col("b1").alias("u1"), F.col("b2").alias("u2"), F.lit(None).cast("long").alias("up"), F.lit(True).alias("stub"))
        rows = real.unionByName(stubs)
        tasks = 1 + light.count() // TASK_STEPS
        dealt = rows.withColumn("task", F.pmod(F.xxhash64("u1", "u2", "start"), F.lit(tasks)))
        shards = cut(dealt.groupBy("task").applyInArrow(shard_nodes, SHARD_OUT))

        kept = shards.where(~F.col("stub"))
        roots = kept.where("unit_root")
        first = roots.where(F.col("parent_conv_id").isNotNull())
        children = first.select("depth", "p1", "p2").unionByName(heavy.where("depth > 0").select("depth", "p1", "p2"))
        children = children.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
        ends = joined_ids(told.where(F.col("n_heavy").isNotNull() & (F.col("depth") == F.col("n_turns"))).select(*KEY, "conv_id"))
        above = heavy.select(*KEY, F.col("owner").alias("parent_conv_id")).withColumn("depth", F.col("depth") + 1).withColumnsRenamed({"k1": "p1", "k2": "p2"})
        upper = heavy.join(children, KEY, "left").join(ends, KEY, "left").join(above, ["depth", "p1", "p2"], "left")
        upper = cut(upper.select(
            F.col("owner").alias("conv_id"), *KEY, "parent_conv_id", F.col("n_heavy").alias("n_convs"), F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
            F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("own_leaves"), ((F.col("n_heavy") - 1) * F.col("bytes")).alias("own_saved"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
        ))
        release(heavy)

        # what a conversation owns: heavy nodes, and shards as a whole
        owned = roots.select("conv_id", F.col("depth").alias("at"), F.col("n_leaves").alias("l"), F.col("saved_tokens").alias("s")).unionByName(upper.select("conv_id", F.col("depth").alias("at"), F.col("own_leaves").alias("l"), F.col("own_saved").alias("s")))
        reach = F.when(F.col("n_heavy").isNotNull(), F.col("depth")).otherwise(F.col("start") + levels)
        asking = told.where(F.col("n_heavy").isNotNull() | (F.col("n_turns") >= F.col("start") + levels)).select("conv_id", reach.alias("at"), F.lit(0).cast("long").alias("l"), F.lit(0).cast("long").alias("s"), *KEY)
        both = owned.select("*", *[F.lit(None).cast("long").alias(k) for k in KEY]).unionByName(asking)
        beyond = Window.partitionBy("conv_id").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, 0)
        sums = both.withColumn("l", F.sum("l").over(beyond)).withColumn("s", F.sum("s").over(beyond)).where(F.col("depth").isNotNull())
        more = cut(sums.groupBy(*KEY).agg(F.sum("l").alias("more_leaves"), F.sum("s").alias("more_saved")))

        through = shards.where("stub").select(*KEY, F.col("parent_conv_id").alias("over"))
        lower = kept.join(through, KEY, "left").select("conv_id", *KEY, F.coalesce("parent_conv_id", "over").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
        nothing = F.lit(0).cast("long")
        top = upper.select("conv_id", *KEY, "parent_conv_id", "n_convs", "n_children", nothing.alias("n_leaves"), nothing.alias("saved_tokens"), "ends_sha256")
        nodes = lower.unionByName(top).join(more, KEY, "left")
        out = cut(nodes.select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.coalesce("more_leaves", nothing)).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("more_saved", nothing)).alias("saved_tokens"), "ends_sha256",
        ))
        keep.append(out)
    return out
