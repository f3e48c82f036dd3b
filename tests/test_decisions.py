"""Decisions, small views and the universe scan, by hand and against plain Python."""

import datetime as dt

import numpy as np
import pytest

from barloom.operators import decisions as D
from barloom.operators import scan as N

DAY = "2024-06-03"


def test_answers_are_flattened_and_logged_once(spark):
    text = '{"action": {"choice": "%s", "confidence": 0.8, "probabilities": {"buy": %s, "skip": %s}}, "cause_type": {"choice": "earnings"}, "event_ahead": {"noul": true}, "severity": {"score": 1.5}}'
    rows = [("A", text % ("buy", 0.7, 0.1)), ("B", text % ("buy", 0.59, 0.1)), ("C", text % ("skip", 0.1, 0.5)), ("D", text % ("buy", 0.9, 0.0)), ("E", "not json"), ("F", text % ("buy", 0.9, 0.0)), ("G", text % ("buy", 0.9, 0.0))]
    flat = D.flatten(spark.createDataFrame(rows, "symbol string, json string"))
    told = {r["symbol"]: r for r in flat.collect()}
    assert (told["A"]["p_buy"], told["A"]["p_watch"], told["A"]["event_ahead"], told["A"]["severity"], told["E"]["action"]) == (0.7, None, True, 1.5, None)
    journal = spark.createDataFrame([("jev_pick", "D", "open", "2024-05-01"), ("jev_pick", "F", "closed", DAY), ("jev_pick", "A", "closed", "2024-05-01"), ("jev_skip", "A", "open", DAY)], "rule string, symbol string, status string, signal_date string")
    prices = spark.createDataFrame([(s, 10.0) for s in "ABCDEF"], "symbol string, close double")
    picks = D.log_decisions(flat, journal, prices, DAY).collect()
    assert [(r["symbol"], r["ref_price"], r["note"]) for r in picks] == [("A", "10.0000", "P(buy) 0.70, cause earnings, evidence None, severity 1.5")]
    skips = D.log_decisions(flat, journal, prices, DAY, "skip", "jev_skip", D.SKIP).collect()
    assert [(r["symbol"], r["rule"], r["hold_bars"]) for r in skips] == [("C", "jev_skip", "20")]


def test_small_views(spark):
    rows = D.positioning(spark.createDataFrame([("A", 120.0, 100.0, 1717372800), ("B", 1.0, 0.0, 0)], "symbol string, shares_short double, shares_short_before double, short_epoch long")).collect()
    assert rows[0]["short_change"] == pytest.approx(0.2) and rows[0]["short_date"] == dt.date(2024, 6, 3) and rows[1]["short_change"] is None and rows[1]["short_date"] is None
    bars = spark.createDataFrame([("A", i, dt.date(2024, 1, 1) + dt.timedelta(i)) for i in range(5)], "symbol string, bar_idx int, date date")
    at = D.attach_dates(spark.createDataFrame([("A", -3, 9, 2, None)], "symbol string, start_idx int, end_idx int, mid_idx int, breakout_idx int"), bars, ["start_idx", "end_idx", "mid_idx", "breakout_idx"]).first()
    assert (at["start_date"].day, at["end_date"].day, at["mid_date"].day, at["breakout_date"]) == (1, 5, 3, None)
    fit = D.r_squared(spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 2.0), ("b", 1.0, 9.0), ("b", 2.0, 9.0), ("c", 1.0, 0.0)], "k string, y double, f double"), "y", "f", ["k"])
    assert {r["k"]: r["r2"] for r in fit.collect()} == {"a": 1.0, "b": 0.0, "c": 0.0}
    text = D.match_text(spark.createDataFrame([("Double Top", "bearish", "confirmed", 0.71, 9.5, None, 11.0)], "pattern string, direction string, status string, score double, level double, target double, stop double")).first()["text"]
    assert text == "Double Top (bearish, confirmed), score 0.71, level 9.50, stop 11.00"


def test_shocks_reach_peers(spark):
    rng = np.random.default_rng(5)
    e = rng.normal(0, 0.01, (4, 120))
    e[0, 40], e[1, 40], e[2, 40] = 0.2, 0.03, 0.01
    e[1, 41], e[2, 41], e[1, 43] = 0.02, -0.01, 0.015
    rows = [(f"S{i}", t, float(e[i, t])) for i in range(4) for t in range(120) if not (i == 2 and t == 43)]
    groups = spark.createDataFrame([("S0", 1), ("S1", 1), ("S2", 1), ("S3", 2)], "symbol string, grp int")
    told = {r["span"]: r for r in N.shock_spillover(spark.createDataFrame(rows, "symbol string, t int, e double"), groups, 8.0).collect()}
    assert told["day"]["n"] == 1 and told["day"]["mean"] == pytest.approx(0.02) and told["next"]["mean"] == pytest.approx(0.005)
    assert told["later"]["mean"] == pytest.approx((e[1, 42:46].sum() + e[2, 42:46].sum() - e[2, 43]) / 2)


def test_profiles_of_groups(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=200)
    rows = [(f"S{i}", t, float(base[t] + rng.normal() * 0.1)) for i in range(4) for t in range(200)]
    values = spark.createDataFrame(rows, "symbol string, t int, e double")
    groups = spark.createDataFrame([(f"S{i}", 1) for i in range(3)] + [("S3", 2)], "symbol string, grp int")
    labels = spark.createDataFrame([("S0", "tech"), ("S1", "tech"), ("S3", None)], "symbol string, label string")
    told = {r["grp"]: r for r in N.group_profiles(values, groups, labels).collect()}
    assert (told[1]["n"], told[1]["label"], told[1]["labels"]) == (3, "tech", 2) and told[1]["label_share"] == pytest.approx(2 / 3) and told[1]["intra"] > 0.95
    assert told[2]["label"] == "Unclassified" and told[2]["intra"] is None
