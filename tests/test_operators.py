"""Operators on small frames with known results, and against plain Python."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.functions import text as X
from barloom.operators import events as E
from barloom.operators import indicators as I
from barloom.operators import ledger as L
from barloom.operators import paths as P
from barloom.operators import patterns as C
from barloom.operators import peers as G
from barloom.operators import portfolio as R
from barloom.operators import stats as S
from barloom.sources import bars as B
from barloom.sources import reports as Q

DAY = dt.date(2020, 1, 1)


def frame(spark, closes, symbol="A", opens=None, volume=None, gaps=()):
    rows, before = [], closes[0]
    for i, c in enumerate(closes):
        if i in gaps:
            continue
        o = before if opens is None else opens[i]
        rows.append((symbol, DAY + dt.timedelta(i), float(o), float(max(o, c) * 1.005), float(min(o, c) * 0.995), float(c), float(1e6 if volume is None else volume[i])))
        before = c
    return B.with_index(spark.createDataFrame(rows, B.BAR_SCHEMA))


def column(df, *names):
    return [tuple(r) for r in df.orderBy("bar_idx").select(*names).collect()]


def test_normalise_keeps_the_last_row_of_a_day(spark):
    raw = spark.createDataFrame([("a", "2020-01-02", 1, 2, 1, 2.0, 5, 1), ("a", "2020-01-02", 1, 3, 1, 3.0, 5, 2), ("a", "2020-01-01", 1, 2, 1, float("nan"), 5, 3), ("a", "2020-01-03", 1, 2, 1, 2.0, 5, 4)], "Symbol string, DATE string, Open int, HIGH int, low int, Close double, volume int, order int")
    rows = B.normalise(raw).orderBy("date").collect()
    assert [(str(r["date"]), r["close"], r["bar_idx"]) for r in rows] == [("2020-01-02", 3.0, 0), ("2020-01-03", 2.0, 1)]
    with pytest.raises(ValueError):
        B.normalise(raw.drop("Close"))


def test_csv_directory(spark, tmp_path):
    (tmp_path / "abc.csv").write_text("Date,Open,High,Low,Close,Volume\n2020-01-02,1,2,1,2,10\n2020-01-03,2,3,2,3,10\n")
    (tmp_path / "XY.csv").write_text("Date,Open,High,Low,Close,Volume\n2020-01-02,1,2,1,,10\n2020-01-03,2,3,2,3,10\n")
    rows = B.read_csv_directory(spark, str(tmp_path)).orderBy("symbol", "date").collect()
    assert [(r["symbol"], r["close"], r["bar_idx"]) for r in rows] == [("ABC", 2.0, 0), ("ABC", 3.0, 1), ("XY", 3.0, 0)]


def test_chart_json_is_adjusted(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"chart":{"result":[{"meta":{"symbol":"A"},"timestamp":[1577923200,1578009600],"indicators":{"quote":[{"open":[10,20],"high":[11,22],"low":[9,18],"close":[10,20],"volume":[1,2]}],"adjclose":[{"adjclose":[5,20]}]}}]}}')
    rows = B.read_chart_json(spark, str(tmp_path)).orderBy("date").collect()
    assert [(r["open"], r["close"], r["volume"]) for r in rows] == [(5.0, 5.0, 1.0), (20.0, 20.0, 2.0)]


def test_weekly_drops_short_and_unfinished_weeks(spark):
    rows = B.weekly(frame(spark, [float(i + 1) for i in range(14)])).orderBy("date").collect()  # starts on a Wednesday
    assert [(str(r["date"]), r["open"], r["close"]) for r in rows] == [("2020-01-03", 1.0, 3.0), ("2020-01-10", 3.0, 10.0)]


def test_densify_has_a_row_for_every_day(spark):
    both = frame(spark, [1.0, 2, 3, 4], "A", gaps=(1,)).unionByName(frame(spark, [5.0, 6, 7, 8], "B"))
    rows = B.densify(both, fill=True).where("symbol = 'A'").orderBy("t").select("t", "close").collect()
    assert [tuple(r) for r in rows] == [(0, 1.0), (1, 1.0), (2, 3.0), (3, 4.0)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(1, 100), min_size=5, max_size=60), st.integers(0, 10**6))
def test_indicators_match_pandas(spark, closes, seed):
    bars = frame(spark, closes)
    c = pd.Series(closes)
    got = column(I.with_rsi(I.with_sma(I.with_atr(bars), 5)), "sma5", "rsi")
    d = c.diff()
    up, down = (pd.Series(np.where(x > 0, x, 0.0)).ewm(alpha=1 / 14, adjust=False).mean() for x in (d, -d))
    for (sma, rsi), m, u, v in zip(got, c.rolling(5).mean(), up, down):
        assert (sma is None) == bool(np.isnan(m)) and (sma is None or sma == pytest.approx(m))
        assert rsi is None if v == 0 else rsi == pytest.approx(100 - 100 / (1 + u / v))


def test_run_below_and_crosses(spark):
    closes = [100.0] * 200 + [90.0] * 5 + [120.0, 80.0]
    bars = frame(spark, closes)
    runs = [r for (r,) in column(I.with_run_below(bars), "run_below")]
    assert runs[:199] == [0] * 199 and runs[199:206] == [1, 2, 3, 4, 5, 6, 0]
    assert column(I.ma200_crosses(bars, 5), "bar_idx", "bars_below") == [(205, 6)]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 80), max_size=30), st.integers(1, 12))
def test_cooldown_is_greedy(spark, hits, gap):
    rows = spark.createDataFrame([("A", h, i) for i, h in enumerate(hits)], "symbol string, bar_idx int, k int")
    kept, last = [], None
    for h in sorted(set(hits)):
        if last is None or h - last >= gap:
            kept.append(h)
            last = h
    got = E.cooldown(rows, ["symbol"], gap).collect()
    assert sorted(r["k"] for r in got) == [i for i, h in enumerate(hits) if h in kept]


def test_forward_returns_and_local_mean(spark):
    rng = np.random.default_rng(1)
    closes = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 300)))
    bars = frame(spark, list(closes))
    o = np.concatenate([closes[:1], closes[:-1]])
    h, w, n = 7, 126, len(closes)
    rows = {r["bar_idx"]: r for r in E.with_forward(E.align_benchmark(bars, B.benchmark(bars)), [h]).collect()}
    for t in (5, 130, 280, 291, 295):
        want = closes[t + h] / o[t + 1] - 1 if t + h < n else None
        assert rows[t]["ret_7"] == (None if want is None else pytest.approx(want))
        cand = [c for c in range(max(1, t - w), min(n - h - 3, t + w) + 1) if abs(c - t) > h]
        assert rows[t]["n_local_7"] == len(cand) and rows[t]["local_7"] == pytest.approx(np.mean([closes[c + h] / o[c + 1] - 1 for c in cand]))


def test_later_bars_change_no_past_event(spark):
    rng = np.random.default_rng(3)
    closes = list(100 * np.exp(np.cumsum(rng.normal(0, 0.03, 420))))
    volume = list(1e6 * (1 + rng.random(420) * 3))
    short = {(r["rule"], r["bar_idx"]) for r in E.rally_hits(frame(spark, closes[:380], volume=volume), E.RULES).collect()}
    long = {(r["rule"], r["bar_idx"]) for r in E.rally_hits(frame(spark, closes, volume=volume), E.RULES).collect()}
    assert short == {x for x in long if x[1] < 380}


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=12), st.lists(st.integers(0, 40), min_size=1, max_size=12), st.booleans(), st.booleans())
def test_as_of(spark, left, right, forward, strict):
    day = lambda k: DAY + dt.timedelta(k)
    a = spark.createDataFrame([("A", day(x), i) for i, x in enumerate(left)], "symbol string, event_date date, i int")
    b = spark.createDataFrame([("A", day(x)) for x in set(right)], "symbol string, date date")
    got = {r["i"]: r["date"] for r in E.as_of(a, b, forward, strict).collect()}
    for i, x in enumerate(left):
        fits = [y for y in right if (y > x or not strict and y == x)] if forward else [y for y in right if y <= x]
        assert got[i] == (day(min(fits) if forward else max(fits)) if fits else None)


def test_exit_rules_on_hand_made_paths(spark):
    path = [(1, 0.0, 0.01, -0.01, 0.005), (2, 0.0, 0.03, 0.0, 0.02), (3, 0.04, 0.06, 0.01, 0.03), (4, 0.0, 0.01, -0.05, -0.04)]
    rows = spark.createDataFrame([(path,)], "path array<struct<k:int,open:double,high:double,low:double,close:double>>")
    result = lambda rule: tuple(rows.select(rule.result(F.col("path")).alias("x")).first()["x"])
    assert result(P.ExitRule("", "time", 4)) == (pytest.approx(-0.04), 4, False)
    assert result(P.ExitRule("", "target", 4, 0.02)) == (pytest.approx(0.02), 2, True)
    assert result(P.ExitRule("", "target", 4, 0.035)) == (pytest.approx(0.04), 3, True)  # opens beyond the target
    assert result(P.ExitRule("", "rising", 4, 0.02, 0.01)) == (pytest.approx(0.03), 2, True)
    assert result(P.ExitRule("", "perday", 4, 0.01)) == (pytest.approx(0.02), 2, True)
    assert result(P.ExitRule("", "hybrid", 4, 0.02, 0.05)) == (pytest.approx(0.05), 3, True)
    assert result(P.ExitRule("", "trail", 4, 0.05)) == (pytest.approx(-0.04), 4, True)
    assert result(P.ExitRule("", "time", 9))[0] is None
    both = rows.select(P.target_stop(F.col("path"), 4, 0.06, 0.01).alias("x")).first()["x"]
    assert tuple(both) == (pytest.approx(-0.01), 1, True)
    assert len({r.name for r in P.default_rules()}) == 26


def test_quantile_groups_are_equal(spark):
    for n, groups in ((10, 4), (25, 5), (101, 10)):
        days = [DAY, DAY + dt.timedelta(1), DAY + dt.timedelta(31), DAY + dt.timedelta(32), DAY + dt.timedelta(62)]
        rows = [(f"S{i:03d}", t, d, 1.0, float(i), 1.0, 10.0 + i, 0.0) for i in range(n) for t, d in enumerate(days)]
        dense = spark.createDataFrame(rows, "symbol string, t int, date date, open double, high double, low double, close double, volume double")
        got = R.ranked_backtest(dense, F.col("high"), groups, least_names=2).where("grp > 0").orderBy("date", "grp").select("grp", "names").collect()
        want = pd.qcut(pd.Series(range(n)).rank(method="first"), groups, labels=False).value_counts().sort_index().tolist()
        assert [r["names"] for r in got[:groups]] == want


def test_performance(spark):
    r = [0.1, -0.05, 0.02, 0.03, -0.01]
    rows = spark.createDataFrame([("x", DAY + dt.timedelta(i), v) for i, v in enumerate(r)], "k string, date date, r double")
    got = S.performance(rows, ["k"], 252.0).first()
    eq = np.cumprod(1 + np.array(r))
    assert got["total_return"] == pytest.approx(eq[-1] - 1) and got["max_drawdown"] == pytest.approx((eq / np.maximum.accumulate(eq) - 1).min()) and got["sharpe"] == pytest.approx(np.mean(r) / np.std(r, ddof=1) * 252**0.5)


def test_benjamini_hochberg(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205]
    got = [r["found"] for r in S.benjamini_hochberg(spark.createDataFrame([(x,) for x in p], "p double"), "p", 0.05).orderBy("p").collect()]
    assert got == [True, True] + [False] * 6


def test_permutation_moments_and_bootstrap(spark):
    rng = random.Random(1)
    rows = [("g", i, 1.0, rng.gauss(0, 1)) for i in range(200) for _ in range(5)]
    z = S.permutation_moments(spark.createDataFrame(rows, "g string, event int, actual double, r double"), ["g"]).first()
    assert z["z"] > 5 and abs(z["null_mean"]) < 0.2
    x = spark.createDataFrame([("g", rng.gauss(3, 1)) for _ in range(300)], "g string, x double")
    ci = S.bootstrap_ci(x, "x", ["g"], 300).first()
    mean = x.agg(F.avg("x")).first()[0]
    assert ci["low"] < mean < ci["high"] and ci["high"] - ci["low"] == pytest.approx(2 * 1.96 / 300**0.5, rel=0.35)


def shape(path, seed=1, noise=0.003):
    rng, x = np.random.default_rng(seed), []
    for (a, p), (b, q) in zip(path[:-1], path[1:]):
        x += list(np.linspace(p, q, b - a, endpoint=False))
    c = np.array(x + [path[-1][1]])
    c = c * (1 + rng.normal(0, noise, len(c)))
    o = np.concatenate([c[:1], c[:-1]])
    return pd.DataFrame({"symbol": "X", "bar_idx": range(len(c)), "open": o, "high": np.maximum(o, c) * (1 + abs(rng.normal(0, noise, len(c)))), "low": np.minimum(o, c) * (1 - abs(rng.normal(0, noise, len(c)))), "close": c, "volume": 1e6 * (1 + rng.random(len(c)))})


SHAPES = {
    "Head and Shoulders": ("bearish", [(0, 70), (40, 100), (55, 90), (75, 112), (95, 91), (112, 101), (135, 80), (150, 76)]),
    "Inverse Head and Shoulders": ("bullish", [(0, 130), (40, 100), (55, 110), (75, 88), (95, 109), (112, 99), (135, 120), (150, 124)]),
    "Double Top": ("bearish", [(0, 70), (40, 100), (60, 88), (82, 100), (105, 80), (120, 75)]),
    "Double Bottom": ("bullish", [(0, 130), (40, 100), (60, 112), (82, 100), (105, 120), (120, 126)]),
    "Ascending Triangle": ("bullish", [(0, 70), (30, 100), (45, 85), (60, 100), (72, 91), (85, 100), (94, 95), (102, 100), (120, 115)]),
    "Falling Wedge": ("bullish", [(0, 130), (20, 120), (35, 96), (52, 110), (66, 90), (80, 101), (92, 87), (102, 94), (112, 86), (130, 110)]),
    "Bull Flag": ("bullish", [(0, 80), (40, 82), (52, 105), (66, 101), (80, 125)]),
    "Cup and Handle": ("bullish", [(0, 75), (40, 100)] + [(40 + i, 100 - 22 * (1 - ((i - 40) / 40) ** 2)) for i in range(5, 81, 5)] + [(128, 95), (134, 94), (150, 112)]),
}


@pytest.mark.parametrize("name", SHAPES)
def test_textbook_shapes_are_found(name):
    way, path = SHAPES[name]
    found = [m for m in C.detect(shape(path), list(C.SPECIFIC), C.Settings()) if m["pattern"] == name]
    assert found and found[0]["status"] == "confirmed" and found[0]["direction"] == way and found[0]["score"] >= 0.6
    assert (found[0]["target"] > found[0]["level"]) == (way == "bullish") or name == "Falling Wedge"


@pytest.mark.parametrize("seed", range(4))
def test_pivots_alternate_and_thin_out(seed):
    rng = np.random.default_rng(seed)
    rows = shape([(i * 4, 100 + rng.normal(0, 12)) for i in range(60)], seed)
    before = None
    for scale in (3, 5, 8, 13):
        p = C.pivots_of(C.Bars(rows, C.Settings()), scale)
        assert (np.diff(p[:, 2]) != 0).all() and (np.diff(p[:, 0]) >= 0).all()
        assert before is None or len(p) <= before
        before = len(p)


def test_scan_settings_and_names(spark):
    bars = spark.createDataFrame(shape(SHAPES["Double Top"][1])).withColumn("date", F.date_add(F.lit(DAY), F.col("bar_idx").cast("int"))).withColumn("bar_idx", F.col("bar_idx").cast("int"))
    assert [r["pattern"] for r in C.scan(bars, ["double-top"]).collect()] == ["Double Top"]
    assert C.scan(bars, ["double top"], cfg=C.Settings.from_json('{"level_tolerance": 0.0001}')).count() == 0
    assert C.scan(bars.limit(0)).count() == 0
    with pytest.raises(ValueError):
        C.resolve(["no such shape"])
    with pytest.raises(ValueError):
        C.Settings.from_json('{"nope": 1}')
    seen = C.walk_forward(bars, ["Double Top"], window=100, step=2).collect()
    assert seen and all(r["seen_at"] >= r["breakout_idx"] for r in seen)


def test_walk_forward_looks_at_every_bar(spark, monkeypatch, tmp_path):
    from barloom.plans import shapes

    bars = spark.createDataFrame(shape(SHAPES["Double Top"][1])).withColumn("date", F.date_add(F.lit(DAY), F.col("bar_idx").cast("int"))).withColumn("bar_idx", F.col("bar_idx").cast("int"))
    each = lambda **k: {(r["breakout_idx"], r["seen_at"]) for r in C.walk_forward(bars, ["Double Top"], window=93, **k).collect()}
    seen = each()
    assert seen and seen == each(step=1) == each(looks=1) and any(t % 5 for _, t in seen)
    lines = [(i, 1, 1, 1, 1000.0, 1.0, DAY + dt.timedelta(i), "N") for i in range(700)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_shipdate date, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    told = {}
    monkeypatch.setattr(shapes.P, "walk_forward", lambda rows, **k: told.update(k) or rows)
    assert shapes.walk_forward(spark, str(tmp_path)).count() == 700
    assert told == {"window": 400, "step": 1, "most_lag": 15}


def test_ward_finds_blocks():
    d = np.full((9, 9), 1.4)
    for block in ((0, 1, 2), (3, 4, 5, 6), (7, 8)):
        for i in block:
            for j in block:
                d[i, j] = 0.2
    labels = G.ward(d, 3)
    assert [len(set(labels[list(b)])) for b in ((0, 1, 2), (3, 4, 5, 6), (7, 8))] == [1, 1, 1] and len(set(labels)) == 3


def test_mark_to_market_by_hand(spark):
    bars = frame(spark, [10.0, 11, 12, 13, 14])
    journal = spark.createDataFrame([("r", "A", DAY, 2), ("r", "A", DAY + dt.timedelta(3), 9), ("r", "A", DAY + dt.timedelta(4), 1), ("r", "Z", DAY, 1)], L.SIGNALS)
    rows = {(r["symbol"], r["signal_date"].day): r for r in L.mark_to_market(journal, bars, B.benchmark(bars)).collect()}
    assert rows["A", 1]["ret"] == pytest.approx(12 / 10 - 1) and rows["A", 1]["done"] and rows["A", 1]["bars_elapsed"] == 2
    assert rows["A", 4]["ret"] == pytest.approx(14 / 13 - 1) and not rows["A", 4]["done"]
    assert rows["A", 5]["ret"] is None and rows["Z", 1]["ret"] is None


def test_insider_clusters_by_hand(spark):
    day = lambda k: DAY + dt.timedelta(k)
    rows = [("A", 1, day(0)), ("A", 1, day(5)), ("A", 2, day(20)), ("A", 3, day(25)), ("A", 4, day(60)), ("A", 5, day(70)), ("B", 1, day(0)), ("B", 2, day(31))]
    tx = spark.createDataFrame([(s, o, d, "P", 100.0, 10.0) for s, o, d in rows], "symbol string, owner int, filing_date date, code string, value double, shares double")
    got = sorted((r["symbol"], str(r["date"]), r["n_insiders"]) for r in L.insider_clusters(tx).collect())
    assert got == [("A", str(day(20)), 2), ("A", str(day(70)), 2)]


def test_percentile_rank_matches_pandas(spark):
    values = [3.0, 1.0, None, 3.0, 7.0, 1.0, 2.0]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    got = {r["i"]: r["p"] for r in rows.withColumn("p", L.percentile_rank(F.col("x"))).collect()}
    want = pd.Series(values, dtype=float).rank(pct=True)
    assert all((got[i] is None) if np.isnan(w) else got[i] == pytest.approx(w) for i, w in want.items())


def test_text_functions(spark):
    rows = spark.createDataFrame([("Shares surge on strong growth", "+3.2%"), ("Lawsuit and losses, growth slows", "$1,200"), (None, "n/a")], "t string, n string")
    got = rows.select(X.tone(F.col("t"), ["surge", "growth", "strong"], ["lawsuit", "losses"]).alias("tone"), X.number(F.col("n")).alias("n"), X.relevant(F.col("t"), ["shares"], ["zzz"]).alias("r")).collect()
    assert [(r["tone"], r["n"], r["r"]) for r in got] == [(1, 3.2, True), (-1, 1200.0, False), (None, None, None)]


def test_reports_become_rows(spark):
    text = "# Day\n## Wedges\n| Symbol | Score |\n|---|---|\n| A | 0.7 |\n| B | 0.6 |\ntext\n## News\n| Symbol | Gap |\n|---|---|\n| C | +4% |\n"
    rows = Q.markdown_tables(spark.createDataFrame([(1, text)], "id int, text string")).orderBy("line").collect()
    assert [(r["section"], r["row"]["Symbol"], r["row"].get("Score")) for r in rows] == [("Wedges", "A", "0.7"), ("Wedges", "B", "0.6"), ("News", "C", None)]
    feed = "<rss><item><title>Big news - The Paper</title><source url='x'>The Paper</source><pubDate>Tue, 03 Mar 2020 10:00:00 GMT</pubDate></item></rss>"
    r = Q.rss_items(spark.createDataFrame([(1, feed)], "id int, text string")).first()
    assert (r["title"], r["publisher"], str(r["date"])) == ("Big news", "The Paper", "2020-03-03")
    form = "<ownershipDocument><issuer><issuerTradingSymbol>A</issuerTradingSymbol></issuer><reportingOwner><reportingOwnerId><rptOwnerCik>7</rptOwnerCik></reportingOwnerId></reportingOwner><nonDerivativeTable><nonDerivativeTransaction><transactionDate><value>2020-03-02</value></transactionDate><transactionCoding><transactionCode>P</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>10</value></transactionShares><transactionPricePerShare><value>2.5</value></transactionPricePerShare></transactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"
    r = Q.form4_trades(spark.createDataFrame([(1, form)], "id int, text string")).first()
    assert (r["symbol"], r["owner"], r["code"], r["shares"], r["price"]) == ("A", "7", "P", 10.0, 2.5)


def test_missing_quarter(spark):
    facts = spark.createDataFrame([("A", 2020, q, v) for q, v in ((0, 100.0), (1, 20.0), (2, 25.0), (3, 22.0))] + [("B", 2020, 0, 5.0)], "symbol string, year int, quarter int, value double")
    assert {(r["symbol"], r["value"]) for r in L.missing_quarter(facts).where("quarter = 4").collect()} == {("A", 33.0)}
