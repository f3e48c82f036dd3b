"""Folds and made-up bars."""

import datetime
import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import extras as X
from barloom.operators import patterns as C
from barloom.sources import bars as B
from barloom.sources import synthetic as Y


@pytest.mark.parametrize("name", ["Double Top", "Head and Shoulders", "Bull Flag", "Falling Wedge"])
def test_made_up_shapes_are_found(spark, name):
    assert name in {r["pattern"] for r in C.scan(Y.shape(spark, name)).collect()}


def test_macd_crosses_and_touches_where_it_says(spark):
    bars = Y.random_walk(spark, 6, 260)
    seen = set()
    for r in X.macd_touch(bars).collect():
        c = bars.where(f"symbol = '{r['symbol']}'").orderBy("bar_idx").toPandas()["close"]

        def lines(x, c=c):
            c = pd.concat([c, pd.Series([x])], ignore_index=True)
            macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
            return macd.iloc[-1], macd.ewm(span=9, adjust=False).mean().iloc[-1]

        macd, signal = lines(r["cross_price"])
        assert macd == pytest.approx(signal, abs=1e-9)
        macd, signal = lines(r["touch_price"])
        assert signal - macd == pytest.approx(0.05 * abs(r["signal"]), abs=1e-9)
        seen.add(r["status"])
        assert (r["probability"] is not None) == (r["status"] == "apart") and (r["hist"] >= 0) == (r["status"] == "above_signal")
        if r["status"] == "apart":
            assert r["z"] == pytest.approx((r["touch_price"] / c.iloc[-1] - 1) / c.pct_change().iloc[-60:].std())
    assert "apart" in seen
    assert X.macd_touch(bars.where("bar_idx < 100")).first()["status"] == "insufficient_data"


def test_zigzag_legs_join_and_turn(spark):
    for _, legs in X.zigzag(Y.random_walk(spark, 2, 400), 0.05).toPandas().sort_values("leg").groupby("symbol"):
        assert legs["start_idx"].iloc[0] == 0 and legs["end_idx"].iloc[-1] == 399 and (legs["start_idx"].iloc[1:].to_numpy() == legs["end_idx"].iloc[:-1].to_numpy()).all()
        assert (np.diff(np.sign(legs["ret"].to_numpy())[:-1]) != 0).all()


def test_turns():
    assert X.turns(np.array([100.0, 95, 104, 111, 108, 99, 103, 120, 119]), 0.1) == [0, 3, 5, 7, 8]
    assert X.turns(np.array([100.0, 101, 102]), 0.1) == [0, 2] and X.turns(np.array([100.0, 101]), 0.1) == [0, 1]
    # the first move counts from the first close, not from the lowest one
    assert X.turns(np.array([100.0, 95, 104, 105]), 0.1) == [0, 3]


def test_late_entry_and_variants(spark):
    bars = Y.random_walk(spark, 1, 120)
    p = bars.orderBy("bar_idx").toPandas()
    ev = bars.where("bar_idx IN (20, 50)").selectExpr("symbol", "bar_idx", "close AS level")
    for r in X.late_entry(ev, bars, 10, (20,)).collect():
        t = r["bar_idx"]
        first = next(i for i in range(t + 1, t + 11) if p["close"][i] > p["high"][i - 1])
        assert r["late_idx"] == first and r["late_ret_20"] == pytest.approx(p["close"][first + 20] / p["open"][first + 1] - 1)
    rows = {(r["bar_idx"], r["entry"]): r["ret"] for r in X.entry_variants(ev, bars).collect()}
    assert rows[20, "close"] == pytest.approx(p["close"][40] / p["close"][20] - 1) and rows[20, "next_open"] == pytest.approx(p["close"][40] / p["open"][21] - 1)


def test_slots_are_never_overfilled(spark):
    rows = X.slot_portfolio(B.densify(Y.random_walk(spark, 8, 300)), 0.05, 0.05, slots=3, hold=20, start=50).collect()
    assert len(rows) == 249 and max(r["positions"] for r in rows) <= 3


def test_slots_see_every_bar(spark):
    """Against the walk in plain Python, with many more symbols than slots, days without a bar, and a condition on the day before."""
    dense = B.densify(Y.random_walk(spark, 15, 120).where("pmod(xxhash64(symbol, bar_idx), 6) > 0"))
    days: dict[int, dict[str, object]] = {}
    for r in dense.collect():
        days.setdefault(r["t"], {})[r["symbol"]] = r
    book, want = [None, None], []
    for t in sorted(days):
        if t <= 10:
            continue
        gains = [0.0, 0.0]
        owned = [x["s"] for x in book if x]
        may = [s for s in sorted(days[t], key=lambda s: hashlib.md5(f"0|{s}|{t}".encode()).hexdigest()) if days[t - 1][s]["close"] is not None and days[t - 1][s]["close"] > 90 and days[t][s]["open"] is not None and s not in owned]
        for k in range(2):
            if book[k] is None and may:
                s = may.pop(0)
                book[k] = {"s": s, "px": days[t][s]["open"], "last": days[t][s]["open"], "since": t}
                gains[k] -= 0.0005
        for k, x in enumerate(book):
            if x is None:
                continue
            r = days[t][x["s"]]
            if r["close"] is None:
                book[k] = None
                continue
            down, up, out = x["px"] * 0.96, x["px"] * 1.03, None
            if r["low"] <= down:
                out = min(r["open"], down) if t > x["since"] else down
            elif r["high"] >= up:
                out = max(r["open"], up) if t > x["since"] else up
            elif t - x["since"] + 1 >= 9:
                out = r["close"]
            gains[k] += (r["close"] if out is None else out) / x["last"] - 1
            x["last"] = r["close"]
            book[k] = x if out is None else None
        want.append((sum(gains) / 2, sum(x is not None for x in book)))
    got = X.slot_portfolio(dense, 0.03, 0.04, slots=2, hold=9, start=10, eligible=F.col("close") > 90).orderBy("date").collect()
    assert [r["positions"] for r in got] == [n for _, n in want] and [r["r"] for r in got] == pytest.approx([v for v, _ in want])


def test_slot_query_reads_its_tables(spark, tmp_path):
    from barloom.plans import more

    day = datetime.date(1995, 1, 2)
    lines = [(i, 1, i % 4, 1, 1000.0 + i % 7, 1.0, day + datetime.timedelta(i // 4), "N") for i in range(4 * 230)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_shipdate date, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"Brand#{k}") for k in range(4)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    rows = more.slot_portfolio(spark, str(tmp_path)).orderBy("date").collect()
    assert [r["date"] for r in rows] == [day + datetime.timedelta(d) for d in range(201, 230)] and max(r["positions"] for r in rows) == 4


def test_price_context(spark):
    bars = Y.random_walk(spark, 1, 300)
    p, r = bars.orderBy("bar_idx").toPandas(), X.price_context(bars).first()
    assert r["high_52w"] == pytest.approx(p["high"].iloc[-252:].max()) and r["ret_63"] == pytest.approx(p["close"].iloc[-1] / p["close"].iloc[-64] - 1)
    worst = p["close"].pct_change().iloc[-63:].nsmallest(5).index
    assert [str(d) for d in r["worst_days"]] == [str(p["date"][i]) for i in worst]
