"""Removal of repeated passages, and the index below it, against plain Python."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.llm import fm_index, substrings as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, least):
    starts = {}
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    rank = lambda d: float("inf") if d is None else d
    for d, w in split:
        for i in range(len(w) - least + 1):
            key = tuple(w[i : i + least])
            starts[key] = min(starts.get(key, rank(d)), rank(d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - least + 1):
            if starts[tuple(w[i : i + least])] < rank(d):
                gone |= set(range(i, i + least))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone).encode()))
    return sorted(out, key=str)


def result(df, least, **options):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in S.drop_repeats(df, least, **options).collect()), key=str)


def made_up(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "bb", "ccc", "dd", "é"]) + str(rng.randrange(40))
    passage = [[word() for _ in range(n)] for n in (9, 14, 30, 60)]
    rows = []
    for d in range(90):
        text = []
        for _ in range(rng.randrange(0, 4)):
            text += [word() for _ in range(rng.randrange(0, 12))] + (rng.choice(passage) if rng.random() < 0.7 else [])
        rows.append((d * 3 % 97, rng.choice([" ", "\n", "\t ", "  "]).join(text)))
    hot = passage[2]
    rows += [(200 + i, " ".join([word(), word(), *hot, word()])) for i in range(60)]  # one passage in many contexts
    rows += [(300 + i, " ".join(passage[3])) for i in range(40)]  # copies
    rows += [(None, " ".join(passage[3])), (None, None), (301, " ".join(passage[3])), (7, None), (8, ""), (9, " \n "), (400, "same " * 50), (401, "same " * 30), (402, "x " * 3), (403, " ".join(word() for _ in range(3000)) + " " + " ".join(hot))]
    return rows


@pytest.mark.parametrize("options", [{}, {"most": 2, "shard_words": 200}, {"most": 0}, {"gram": 2, "shard_words": 50}])
def test_against_plain_python(spark, options):
    rows = made_up(len(options))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("h", "th", "order", "parts", "n", "at", "ch", "owner", "kept", "hot")})
    assert result(df.repartition(3), 8, **options) == plain(rows, 8)


def test_fifty_words_and_no_rows(spark):
    rng = random.Random(3)
    passage = [f"w{rng.randrange(1000)}" for _ in range(50)]
    rows = [(1, "start " + " ".join(passage) + " end"), (2, " ".join(passage)), (3, " ".join(passage[:49]) + " other"), (4, "x " + "\n".join(passage) + " y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, 50) == plain(rows, 50)
    assert [r[2] for r in result(df, 50)] == [0, 50, 0, 50]
    assert S.drop_repeats(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 12))
def test_leftmost_least(values, width):
    v = np.array(values)
    want = [i + int(np.argmin(v[i : i + width])) for i in range(len(v) - width + 1)]
    if want:
        assert S.leftmost_least(v, width).tolist() == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=200))
def test_ranks_of_the_wavelet_tree(values):
    v = np.array(values, np.int64)
    tree = fm_index.WaveletTree(v, 10)
    symbol, place = np.meshgrid(np.arange(10), np.arange(len(v) + 1))
    want = [[int((v[:p] == c).sum()) for c in range(10)] for p in range(len(v) + 1)]
    assert tree.rank(symbol.ravel(), place.ravel()).reshape(-1, 10).tolist() == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 3), max_size=14), st.integers(0, 5)), min_size=1, max_size=9), st.integers(1, 5))
def test_repeats_are_those_of_all_windows(sequences, least):
    lengths, owner = np.array([len(s) for s, _ in sequences]), np.array([o for _, o in sequences])
    flat = np.array([x for s, _ in sequences for x in s], np.int64)
    found = fm_index.FMIndex(flat, lengths, owner).repeats(flat, lengths, owner, least)
    got = {(int(q), i) for q, a, e in zip(found.query, found.start, found.end) for i in range(a, e - least + 1)}
    windows = {}
    for s, o in sequences:
        for i in range(len(s) - least + 1):
            windows.setdefault(tuple(s[i : i + least]), set()).add(o)
    assert got == {(q, i) for q, (s, o) in enumerate(sequences) for i in range(len(s) - least + 1) if min(windows[tuple(s[i : i + least])]) < o}
