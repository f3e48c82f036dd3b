"""Prefix tries against plain Python, at thresholds that bring heavy levels and deep shards into play."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.llm import tries as T

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(int(c / 5) * 5, [])[:h] + turns[h:]  # % as SQL has it
    return out


def plain_nodes(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)

    def below(k):
        stack, leaves, saved = [k], 0, 0
        while stack:
            x = stack.pop()
            leaves += x not in kids
            saved += (len(nodes[x]) - 1) * len(x[-1][1].encode()) if x else 0
            stack += kids.get(x, [])
        return leaves, saved

    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids.get(k, [])), *below(k), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes_of(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def made_up(seed):
    rng = random.Random(seed)
    openings = [[("user", f"hello {i}"), ("assistant", "yes?")] for i in range(3)]
    rows = []
    for c in range(60):
        turns = list(rng.choice(openings)) + [(rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ccc", "d\nd", "é"])) for _ in range(rng.randrange(0, 9))]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    rows += [(100 + c, i, "user", "same") for c in range(20) for i in range(4)]  # one conversation that repeats
    rows += [(205, i, "user", f"long {i}") for i in range(40)] + [(206, i, "user", f"long {i}") for i in range(35)]
    rows += [(None, 0, "user", "nobody"), (301, None, None, None), (301, None, "user", "x"), (301, 3, "user", "x"), (301, 3, "user", "x"), (302, 1, "", ""), (-7, 0, "user", "below zero"), (-5, 0, "user", "base"), (303, 0, "user", "z" * 5000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("heavy,levels", [(1000, 64), (4, 3), (1, 2)])
def test_against_plain_tries(spark, heavy, levels):
    rows = made_up(heavy)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("depth", "k1", "start", "place", "n_turns", "stub", "task", "up", "owner")})
    assert nodes_of(T.prefix_trie(df.repartition(3), heavy, levels)) == plain_nodes(plain_rebuilt(rows))


def test_turnless_and_empty(spark):
    lone = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(lone, 0, "user", "its only turn is within its first h, and its base is absent")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert nodes_of(T.prefix_trie(df)) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    assert T.prefix_trie(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 10**6), max_size=60))
def test_louds_navigates_as_the_tree_it_was_built_from(draws):
    parents = np.array(sorted(x % (i + 1) for i, x in enumerate(draws)), np.int64)
    parents = np.minimum(parents, np.arange(len(parents)))
    tree = T.Louds(parents)
    assert tree.parents().tolist() == parents.tolist()
    for node in range(1, tree.nodes):
        assert tree.parent(node) == parents[node - 1]
    for node in range(tree.nodes):
        kids = [i + 1 for i, p in enumerate(parents) if p == node]
        assert list(tree.children(node)) == kids and tree.degrees()[node] == len(kids)
