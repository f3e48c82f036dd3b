"""Nearest peers and leads and lags by blocks against plain joins of days."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators import peers as P
from barloom.operators import stats as S


@pytest.fixture
def series(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(30, 20))
    m[7] = m[3]  # equal series tie
    m[9] = 1.0  # no variance
    rows = [(f"S{i:02d}", d, float(m[i, d])) for i in range(30) for d in range(20) if (i + d) % 7 or i == 9]
    return spark.createDataFrame(rows, "symbol string, t int, e double")


@pytest.mark.parametrize("block", [4, 64])
def test_nearest_by_blocks_are_those_of_all_pairs(series, monkeypatch, block):
    monkeypatch.setattr(P, "STRIP", 3)
    pairs = P.pair_correlations(series, least=14)
    both = pairs.select(F.col("a").alias("symbol"), F.col("b").alias("peer"), "corr").unionByName(pairs.select(F.col("b").alias("symbol"), F.col("a").alias("peer"), "corr"))
    both = both.withColumn("corr", F.round("corr", 9))
    want = both.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("corr"), "peer"))).where("rank <= 4")
    met = P.nearest(series, 4, least=14, block=block)
    told = sorted((r.symbol, r["rank"], r.peer, None if r.corr is None else round(r.corr, 9)) for r in met.collect())
    assert told == sorted((r.symbol, r["rank"], r.peer, r.corr) for r in want.collect())
    assert len(told) == 120


def plain_lead_lag(m, groups, q=0.05):
    """By numpy, a pair at a time: m[name] is {t: e}."""
    out = {}
    for a in m:
        ts = sorted(m[a])
        before = {t: m[a][s] for s, t in zip(ts, ts[1:])}
        for b in m:
            both = sorted(set(before) & set(m[b]))
            if a == b or groups[a] != groups[b] or not both:
                continue
            x, y = np.array([before[t] for t in both]), np.array([m[b][t] for t in both])
            u, v = x - x.mean(), y - y.mean()
            if (u * u).sum() < 1e-12:
                out[a, b] = (len(both), None, None)
                continue
            slope = (u * v).sum() / (u * u).sum()
            error = np.sqrt((u**2 * (v - slope * u) ** 2).sum())
            out[a, b] = (len(both), slope, slope * (u * u).sum() / error if error > 0 else None)
    p = {k: 1.0 if t is None else float(P._p_value(np.array([t]))[0]) for k, (_, _, t) in out.items()}
    order = sorted(p.values())
    line = max([x for i, x in enumerate(order, 1) if x <= q * i / len(order)], default=-1)
    return {k: (*out[k], p[k] <= line) for k in out}


@pytest.mark.parametrize("block,q", [(4, 0.3), (64, 0.05)])
def test_leads_by_blocks_are_those_of_single_pairs(spark, series, monkeypatch, block, q):
    monkeypatch.setattr(P, "STRIP", 3)
    m, groups = {}, {f"S{i:02d}": str(i % 2) for i in range(30)}
    for r in series.collect():
        m.setdefault(r.symbol, {})[r.t] = r.e
    m["S04"] = {t + 1: 0.8 * x + 0.1 * m["S04"].get(t + 1, 0.0) for t, x in m["S02"].items()}  # S02 leads S04
    df = spark.createDataFrame([(s, t, float(x)) for s, d in m.items() for t, x in d.items()], "symbol string, t int, e double")
    met = P.lead_lag(df, spark.createDataFrame(list(groups.items()), "symbol string, grp string"), q, block)
    assert "CartesianProduct" not in met._jdf.queryExecution().toString() and "row_number" not in met._jdf.queryExecution().toString()
    told = {(r.leader, r.follower): (r.n, r.slope, r.t_stat, r.found) for r in met.collect()}
    want = plain_lead_lag(m, groups, q)
    assert told.keys() == want.keys() and told["S02", "S04"][3]
    for k, (n, slope, t, found) in want.items():
        assert told[k][0] == n and told[k][3] == found, k
        for x, y in ((told[k][1], slope), (told[k][2], t)):
            assert (x is None) == (y is None) and (y is None or abs(x - y) < 1e-6 * max(1, abs(y))), k


def test_the_threshold_is_that_of_ranks(spark):
    rng = np.random.default_rng(2)
    for ps in (list(rng.random(200) ** 3), [0.5, 0.9], [0.01, 0.01, 0.03, 0.9], [0.0, 0.9], []):
        tests = spark.createDataFrame([(float(x),) for x in ps], "p double")
        line = max([x for i, x in enumerate(sorted(ps), 1) if x <= 0.05 * i / len(ps)], default=-1)
        got = S.step_up(tests, "p", 0.05)
        assert [x <= got for x in ps] == [x <= line for x in ps]


@pytest.mark.parametrize("steps", [2, 7, 1024])
def test_the_threshold_is_found_in_a_few_counts(spark, steps):
    rng = np.random.default_rng(3)
    for ps in (rng.random(300) ** 6, rng.random(300), np.round(rng.random(300) ** 3, 2), np.zeros(0)):
        rounds = []

        def counts(lines):
            rounds.append(len(lines))
            batch = S.in_bins([ps[:100], ps[100:]], lines)
            return spark.createDataFrame(list(zip(*(c.to_pylist() for c in batch.columns))), S.BINS)

        line = max([x for i, x in enumerate(sorted(ps), 1) if x <= 0.3 * i / len(ps)], default=-1)
        got = S.line_by_counts(counts, len(ps) + 5, 0.3, steps)  # told a wrong number at first
        assert ((ps <= got) == (ps <= line)).all()
        assert steps < 1024 or len(rounds) <= 2


def test_leads_of_whole_series_are_rounded_in_tasks_and_need_a_group(spark):
    rng = np.random.default_rng(7)
    m = {f"S{i:02d}": dict(enumerate(rng.normal(size=15))) for i in range(24)}
    m["S05"] = {t: 1.0 for t in range(15)}  # no variance
    groups = {s: None if i % 4 == 3 else str(i % 2) for i, s in enumerate(m)}
    df = spark.createDataFrame([(s, t, float(x)) for s, d in m.items() for t, x in d.items()], "symbol string, t int, e double")
    met = P.lead_lag(df, spark.createDataFrame(list(groups.items()), "symbol string, grp string"), 0.3, 5, 5)
    told = {(r.leader, r.follower): (r.n, r.slope, r.t_stat, r.found) for r in met.collect()}
    m = {s: d for s, d in m.items() if groups[s] is not None}  # a null equals no null
    want = plain_lead_lag(m, groups, 0.3)
    assert told.keys() == want.keys() and len(want) == 12 * 11 + 6 * 5
    for k, (n, slope, t, found) in want.items():
        assert told[k][0] == n and told[k][3] == found, k
        for x, y in ((told[k][1], slope), (told[k][2], t)):
            assert (x is None) == (y is None) and (y is None or x == round(x, 5) and abs(x - y) < 6e-6), k


def test_a_series_is_sent_to_few_pairs_of_blocks():
    assert [P._few_blocks(n, 50_000) for n in (0, 900, 5000, 10_000, 600_000, 1_200_000)] == [1, 1, 5, 10, 12, 24]
    v = np.array([0.000005, -0.015625, 1e300, -0.0, np.nan, 123456.123455])
    assert str(P._round(v, 5).tolist()) == str([0.00001, -0.01563, 1e300, 0.0, np.nan, 123456.12346])


@pytest.mark.parametrize("whole", [True, False])
def test_nearest_of_many_equal_series_go_by_name(spark, monkeypatch, whole):
    monkeypatch.setattr(P, "STRIP", 3)
    monkeypatch.setattr(P, "TILE", 24)
    rng = np.random.default_rng(11)
    m = rng.normal(size=(40, 16))
    m[10:30] = m[10]
    m[35] = 0.1  # no variance
    m[36] = -m[10]
    rows = [(f"S{i:02d}", d, float(m[i, d])) for i in rng.permutation(40) for d in range(16) if whole or (i, d) != (2, 5)]
    met = P.nearest(spark.createDataFrame(rows, "symbol string, t int, e double"), 4, least=10, block=7)
    told = {(r.symbol, r["rank"]): (r.peer, r.corr) for r in met.collect()}
    assert len(told) == 160
    for i in range(40):
        want = []
        for j in range(40):
            if i != j:
                days = [d for d in range(16) if whole or d != 5 or 2 not in (i, j)]
                want.append((9.0 if 35 in (i, j) else -round(float(np.corrcoef(m[i, days], m[j, days])[0, 1]), 9), f"S{j:02d}"))
        for rank, (corr, peer) in enumerate(sorted(want)[:4], 1):
            name, got = told[f"S{i:02d}", rank]
            assert name == peer and (got is None if corr == 9.0 else abs(got + corr) < 1e-8), (i, rank)


def test_nearest_sends_a_series_to_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "WORTH", 2)
    df = spark.range(400).selectExpr("concat('S', id) AS symbol", "explode(array(1, 2, 3)) AS t", "sin(id * t) AS e")
    sent = []
    plain = P._block_pairs
    monkeypatch.setattr(P, "_block_pairs", lambda series, by, blocks: sent.append(blocks) or plain(series, by, blocks))
    assert P.nearest(df, 2, least=3).count() == 800 and sent == [P.SPREAD]
