"""Briefs, reads and reports read back, by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import briefs as P
from barloom.operators import lookback as L

DAY = dt.date(2024, 6, 3)


def test_analysts(spark):
    profiles = spark.createDataFrame([("A", None, None, None, 100.0, 130.0), ("B", "none", 2.0, 5, 100.0, None), ("C", "hold", 1.0, 0, None, 90.0), ("D", None, None, None, None, None)], "symbol string, rating string, mean double, n int, price double, target double")
    ratings = spark.createDataFrame([("A", 0, 1, 1, 1, 1, 0), ("A", 3, 0, 1, 3, 0, None), ("C", 0, 0, 0, 0, 0, 0)], "symbol string, months_ago int, strong_buy int, buy int, hold int, sell int, strong_sell int")
    act = lambda s, k, a, t=None: (s, DAY - dt.timedelta(days=k), a, t)
    actions = spark.createDataFrame([act("A", 1, "up"), act("A", 90, "down", "Lowers"), act("A", 91, "up"), act("A", 5, "main", "Raises"), act("B", -1, "up")], "symbol string, date date, action string, target_action string")
    rows = {r["symbol"]: r for r in P.analyst_view(profiles, ratings, actions, str(DAY)).collect()}
    a = rows["A"]
    assert (a["rating"], a["mean"], a["n"], a["bullish_now"], a["bullish_3m"]) == ("hold", 2.5, 4, 0.5, 0.25) and a["upside"] == pytest.approx(0.3)
    assert (a["n_up"], a["n_down"], a["n_target_cuts"], a["n_target_raises"]) == (1, 1, 1, 1)
    assert (rows["B"]["rating"], rows["B"]["n"], rows["B"]["upside"], rows["B"]["n_up"]) == ("buy", 5, None, 0)
    assert rows["C"]["rating"] == "hold" and rows["D"]["rating"] is None and rows["D"]["mean"] is None


def test_earnings(spark):
    q = lambda s, k, e, x: (s, dt.date(2023, 1, 1) + dt.timedelta(days=91 * k), e, 1.0, x)
    history = spark.createDataFrame([q("A", k, 1.0, 0.1 if k % 2 else -0.1) for k in range(6)] + [q("A", 6, None, 0.5)], "symbol string, quarter date, eps double, estimate double, surprise double")
    estimates = spark.createDataFrame([("A", "0y", 1.1, 1.0, 0.0, 4, None), ("A", "0q", 2.0, None, 1.0, 0, 0), ("B", "0y", 1.0, 2.0, 2.0, 0, 9)], "symbol string, period string, current double, ago_30 double, ago_90 double, up_30 int, down_30 int")
    rows = {r["symbol"]: r for r in P.earnings_view(history, estimates).collect()}
    a = rows["A"]
    assert a["last_quarter"] == dt.date(2023, 1, 1) + dt.timedelta(days=455) and (a["beats_4q"], a["n_4q"], a["surprise"]) == (2, 4, 0.1)
    assert a["year_rev_30d"] == pytest.approx(0.1) and a["year_rev_90d"] is None and a["quarter_rev_30d"] is None and (a["up_30"], a["down_30"]) == (4, 0)
    assert rows["B"]["last_quarter"] is None and rows["B"]["down_30"] == 9


def test_the_read_adds_up(spark):
    rows = spark.createDataFrame([("A", 0.1, "buy", 0.3, 5, 1, 0.02, -0.1), ("B", -0.1, "sell", 0.01, 0, 2, None, None), ("C", None, None, None, 0, 0, None, None), ("D", 0.1, "buy", None, 0, 0, None, None)], "symbol string, dist_ma50 double, rating string, upside double, n_up int, n_down int, surprise double, revenue_growth double")
    told = {r["symbol"]: r for r in P.summary_order(P.read_lines(P.read(rows.withColumn("insider_buying", F.col("symbol") == "A")))).collect()}
    assert told["A"]["fired"] == ["above_ma50", "consensus_buy", "target_far", "more_upgrades", "beat", "revenue_down", "insiders"] and told["A"]["score"] == 5.0 and told["A"]["read"] == "up"
    assert told["B"]["fired"] == ["below_ma50", "consensus_sell", "target_near", "more_downgrades"] and told["B"]["read"] == "down" and told["B"]["lines"][0] == "-1 below_ma50"
    assert (told["C"]["fired"], told["C"]["score"], told["C"]["read"]) == ([], 0.0, "flat") and told["D"]["read"] == "flat"
    assert [s for s, _ in sorted(told.items(), key=lambda kv: kv[1]["place"])] == ["A", "D", "C", "B"]
    own = P.fundamentals_view(spark.createDataFrame([(10.0, 100.0, 250.0), (None, 0.0, None)], "free_cashflow double, market_cap double, debt_to_equity double")).collect()
    assert (own[0]["fcf_yield"], own[0]["debt_to_equity"]) == (0.1, 2.5) and own[1]["fcf_yield"] is None


REPORT = """# Daily
## 1. Signals
### News-day signals (3)
| symbol | gap | flags |
|:--|--:|--|
| [AAA](http://x) | +5.0% | **Z** S |
| plain | 1 | |
### Falling wedge, beaten-down
| symbol | status | vs peers 20d | from 52w high | target upside | sentiment |
|---|---|---|---|---|---|
| [BBB](u) | forming | -3.1% (z -1.2) | -45% | 55% | negative |
| [CCC](u) | confirmed | +3.1% (z +1.2) | -10% | 5% | positive |
### Something else
| symbol | x |
| [DDD](u) | 1 |
## 3. Stock briefs
| symbol | read |
|---|---|
| [EEE](u) | still falling | extra |
text
"""


def test_reports_are_read_back(spark):
    rows = L.report_rows(spark.createDataFrame([(DAY, REPORT)], "date date, text string"))
    got = {r["symbol"]: r for r in rows.withColumn("found", L.flags_from_cells(F.col("cells"))).collect()}
    assert {s: r["section"] for s, r in got.items()} == {"AAA": "newsday", "BBB": "wedge_watch", "CCC": "wedge", "EEE": "briefs"}
    assert got["AAA"]["found"] == ["Z", "S"] and got["BBB"]["found"] == ["Z", "D", "S", "T"] and got["CCC"]["found"] == []
    assert got["AAA"]["cells"]["gap"] == "+5.0%" and got["EEE"]["cells"] == {"symbol": "[EEE](u)", "read": "still falling"}


def test_new_signals_of_the_journal(spark):
    text = "## New signals today\n| rule | symbol | date | price | hold | note |\n|:--|--|--|--|--|--|\n| newsday | AAA | 2024-06-03 | 10.0 | 60 | gap |\n| short | x |\n## Open\n| newsday | BBB | 2024-06-03 | 1 | 60 | n |"
    rows = L.new_signals(spark.createDataFrame([(1, text), (2, "nothing")], "id int, text string")).collect()
    assert [(r["rule"], r["symbol"], r["price"], r["hold"]) for r in rows] == [("newsday", "AAA", "10.0", "60")]


def test_collecting_and_reading_the_journal(spark, tmp_path):
    news = spark.createDataFrame([("A", DAY, 12.5, 0.051, 3.2, -0.2, -0.1)], "symbol string, news_date date, news_close double, gap double, volume_ratio double, ret_6m double, dist_ma200 double")
    wedges = spark.createDataFrame([("B", DAY, DAY, "confirmed", 9.0, 0.7, 8.0, 9.5), ("C", DAY - dt.timedelta(1), DAY, "confirmed", 9.0, 0.7, 8.0, 9.5), ("D", None, DAY, "forming", 9.0, 0.7, 8.0, 9.5)], "symbol string, breakout_date date, last_date date, status string, price double, score double, stop double, level double")
    insiders = spark.createDataFrame([("E", DAY, 3.0, 2, 2_500_000.0, True), ("F", DAY, 3.0, 2, 2_500_000.0, False)], "symbol string, last_filing date, last_close double, n_buys int, total_value double, beaten boolean")
    rows = {r["symbol"]: r for r in L.collect_signals(str(DAY), news, wedges, None, insiders).collect()}
    assert sorted(rows) == ["A", "B", "E"] and rows["A"]["note"] == "gap +5.1%, vol 3.2x, 6m -20%, vs MA200 -10%" and rows["B"]["note"] == "score 0.70, stop 8.00, level 9.50"
    assert (rows["A"]["ref_price"], rows["A"]["hold_bars"], rows["E"]["hold_bars"], rows["E"]["note"]) == ("12.5000", "60", "120", "2 buy(s) $2.50M")
    (tmp_path / "j.csv").write_text("rule,symbol,old\nnewsday,A,1\n")
    got = L.read_journal(spark, str(tmp_path / "j.csv")).first().asDict()
    assert list(got) == L.JOURNAL and got["rule"] == "newsday" and got["note"] == ""
    with pytest.raises(ValueError):
        L.collect_signals(str(DAY))
