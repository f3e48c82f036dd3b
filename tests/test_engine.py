"""The whole engine on made-up bars, outcomes, and profiles."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.engine import Engine
from barloom.operators import outcomes as O
from barloom.operators import portfolio as R
from barloom.sources import profiles as Q
from barloom.sources import synthetic as Y


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, Y.random_walk(spark, 12, 420, noise=0.03).cache())


def test_every_method_gives_rows(engine, spark, tmp_path):
    assert engine.indicators().count() == engine.bars.count() == 12 * 420
    assert engine.pivots().count() > 100 and engine.scan(mode="history").count() > 0
    for family, options in (("rally", {}), ("news", {"gap_min": 0.0, "times": 1.1}), ("reversal", {}), ("ma200", {"least_below": 5}), ("doji", {}), ("patterns", {})):
        ev = engine.events(family, **options)
        assert {"ret_5", "local_5", "bench_5"} <= set(ev.columns) and ev.count() >= 0
    rally = engine.events("rally")
    assert engine.study(rally, "rule", "2021-01-01").count() > 0
    assert engine.exits(rally).count() == 26
    assert engine.portfolio(R.momentum(60, 5), 3, least_names=6).where("grp = 3").count() > 3
    assert engine.peers(4).count() == 12
    assert engine.weekly().bars.count() < 12 * 70


def test_round_trip_through_csv(engine, spark, tmp_path):
    one = engine.bars.where("symbol = 'W1'").toPandas()
    one[["date", "open", "high", "low", "close", "volume"]].to_csv(tmp_path / "W1.csv", index=False)
    back = Engine(spark).read_csv(str(tmp_path)).bars.orderBy("bar_idx").toPandas()
    assert (back["symbol"] == "W1").all() and back["close"].to_numpy() == pytest.approx(one.sort_values("bar_idx")["close"].to_numpy())


def test_outcomes(engine, spark):
    p = engine.bars.where("symbol = 'W0'").orderBy("bar_idx").toPandas()
    m = spark.createDataFrame([("W0", 100, "bullish", float(p["close"][100] * 1.01), float(p["close"][100] * 0.5))], "symbol string, end_idx int, direction string, target double, stop double")
    r = O.forward_outcome(m, engine.bars).first()
    ahead = p.iloc[101:141]
    assert r["ret_10"] == pytest.approx(p["close"][110] / p["close"][100] - 1) and r["max_favorable"] == pytest.approx(ahead["high"].max() / p["close"][100] - 1)
    hit = ahead.index[ahead["high"] >= p["close"][100] * 1.01]
    assert r["target_hit"] == (len(hit) > 0) and (r["bars_to_target"] == (hit[0] - 100 if len(hit) else None)) and not r["stop_hit"]
    assert O.market_filter(m, engine.bars, ret_126=(-9.0, 9.0)).count() == 0 and O.market_filter(m, engine.bars, atr_pct=(0.0, 9.0)).count() == 1


def test_story_pieces(engine, spark):
    q = spark.createDataFrame([("A", dt.date(2020, 3, 31)), ("A", dt.date(2020, 6, 30))], "symbol string, end date")
    d = spark.createDataFrame([("A", dt.date(2020, 5, 1)), ("A", dt.date(2020, 12, 1)), ("A", dt.date(2020, 1, 1))], "symbol string, day date")
    assert [str(r["quarter_end"]) for r in O.quarter_before(d, q).orderBy("day").collect()] == ["None", "2020-03-31", "None"]
    f = spark.createDataFrame([("A", 2019, 1, 10.0), ("A", 2020, 1, 12.0)], "symbol string, year int, quarter int, value double")
    assert {r["year"]: r["growth"] for r in O.year_on_year(f).collect()} == {2019: None, 2020: pytest.approx(0.2)}
    day = engine.bars.where("symbol = 'W0' AND bar_idx = 50").first()["date"]
    r = O.reaction(spark.createDataFrame([("W0", day)], "symbol string, event_date date"), engine.bars).first()
    p = engine.bars.where("symbol = 'W0'").orderBy("bar_idx").toPandas()["close"].pct_change()
    assert r["move"] == pytest.approx(max(p[50], p[51], key=abs))
    groups = spark.createDataFrame([("A", 1), ("B", 1), ("C", 2)], "symbol string, grp int")
    ev = spark.createDataFrame([("A", dt.date(2020, 1, 1)), ("B", dt.date(2020, 1, 10)), ("C", dt.date(2020, 1, 2)), ("A", dt.date(2020, 3, 1))], "symbol string, date date")
    assert sorted((r["symbol"], str(r["date"]), r["co_signals"]) for r in O.co_signals(ev, groups).collect()) == [("A", "2020-01-01", 1), ("A", "2020-03-01", 0), ("B", "2020-01-10", 1), ("C", "2020-01-02", 0)]
    spans = spark.createDataFrame([("A", 0, 0, 10), ("A", 1, 10, 30)], "symbol string, leg int, start_idx int, end_idx int")
    at = spark.createDataFrame([("A", 5), ("A", 10), ("A", 29)], "symbol string, bar_idx int")
    assert [r["leg"] for r in O.interval_of(at, spans).orderBy("bar_idx").collect()] == [0, 1, 1]


def test_profiles(spark):
    text = '{"defaultKeyStatistics":{"sharesShort":{"raw":12,"fmt":"12"},"sharesShortPriorMonth":{"raw":10},"shortPercentOfFloat":{"raw":0.05}},"financialData":{"targetMeanPrice":{"raw":15},"currentPrice":{"raw":10},"numberOfAnalystOpinions":{"raw":7}}}'
    r = Q.quote_profile(spark.createDataFrame([("A", text)], "symbol string, text string")).first()
    assert (r["short_change"], r["upside"], r["analysts"]) == (pytest.approx(0.2), pytest.approx(0.5), 7)
    k = '{"filings":{"recent":{"form":["8-K","10-Q"],"filingDate":["2020-01-02","2020-01-03"],"items":["2.02,9.01",""]}}}'
    r = Q.filings_8k(spark.createDataFrame([("A", k)], "symbol string, text string")).collect()
    assert [(str(x["date"]), x["items"]) for x in r] == [("2020-01-02", ["2.02"])]
    m = '{"messages":[{"entities":{"sentiment":{"basic":"Bullish"}}},{"entities":{"sentiment":null}},{"entities":{"sentiment":{"basic":"Bearish"}}}]}'
    assert tuple(Q.crowd(spark.createDataFrame([("A", m)], "symbol string, text string")).first()) == ("A", 3, 1, 1)
    f = '{"timeseries":{"result":[{"meta":"{}","annualTotalRevenue":[{"asOfDate":"2020-12-31","reportedValue":{"raw":5}}]}]}}'
    assert [(r["type"], str(r["date"]), r["value"]) for r in Q.fundamentals_facts(spark.createDataFrame([("A", f)], "symbol string, text string")).collect()] == [("annualTotalRevenue", "2020-12-31", 5.0)]
    assert [r["tag"] for r in Q.quarters(spark, "2016-08-01", "2017-02-01").orderBy("day").collect()] == ["2016q3", "2016q4", "2017q1"]
    lists = spark.createDataFrame([("A", "Alpha Inc", "tech", "nasdaq100"), ("A", "Alpha", "tech", "sp500"), ("B", "Beta Corp", "util", "nasdaq100")], "symbol string, name string, sector string, list string")
    assert sorted((r["symbol"], r["name"]) for r in Q.universe(lists).collect()) == [("A", "Alpha"), ("B", "Beta Corp")]
    assert lists.select(Q.company_tokens(F.col("name")).alias("t")).orderBy("name").first()["t"] == ["alpha"]
