"""Queries on pattern events, live lists, verdicts and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import change, rolling, shift
from ..operators import events as E
from ..operators import ledger as L
from ..operators import portfolio as R
from ..operators import stats as S
from ..operators import verdicts as V
from ..sources import bars as B
from . import tables as T
from .desk import _MTM, _journal
from .happenings import _R, BASES, NEXT_OPEN, SQL_NARROW, SQL_RALLY, rally, rally_narrow, sql_bench, sql_forward
from .studies import _BY_PERIOD
from .tables import SPLIT, lag, roll, rounded, sql_bars

PH = [5, 20]


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    """Rally events as matches of every status, with shapes known a few bars before or after their breakout."""
    ev = rally(spark, sf)
    i = F.col("bar_idx")
    bull = F.col("rule") != "thrust"
    point = lambda x: F.struct(x.cast("int").alias("idx"), F.col("close").alias("price"), F.lit("p").alias("label"))
    return ev.select(
        "symbol", F.col("rule").alias("pattern"), F.when(bull, "bullish").otherwise("bearish").alias("direction"), F.when(i % 4 <= 1, "confirmed").when(i % 4 == 2, "failed").otherwise("expired").alias("status"),
        F.lit(3).alias("scale"), (i - 30).alias("start_idx"), i.alias("end_idx"), i.alias("breakout_idx"), (0.3 + (i % 5) / 10.0).alias("score"), (F.col("close") * 0.98).alias("level"),
        (F.col("close") * F.when(bull, 1.5).otherwise(0.6)).alias("target"), (F.col("close") * F.when(bull, 0.7).otherwise(1.4)).alias("stop"), F.array(point(i - 20), point(i - i % 6)).alias("key_points"),
    )


def _events(spark: SparkSession, sf: str) -> DataFrame:
    bars = T.bars_brand(spark, sf)
    return V.pattern_events(_matches(spark, sf), bars, B.benchmark(bars), PH)


def pattern_events(spark: SparkSession, sf: str) -> DataFrame:
    cols = [f"{c}_{h}" for h in PH for c in ("ret", "xbench", "xlocal")]
    return rounded(_events(spark, sf).select("symbol", "pattern", "dir", "signal_idx", "date", "entry", "delay", "gap_from_level", "breakout_volume", *cols), entry=9)


def pattern_trades(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.with_trades(_events(spark, sf), T.bars_brand(spark, sf), 20)
    return rounded(rows.select("symbol", "pattern", "signal_idx", "exit_reason", "bars_held", "trade_ret", "mfe", "mae", "r_multiple"))


def structure_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.structure_table(V.structures(_matches(spark, sf), T.bars_brand(spark, sf))))


def hindsight_match(spark: SparkSession, sf: str) -> DataFrame:
    """Events against the same ones seen up to eight bars later."""
    ev = _events(spark, sf)
    return rounded(V.hindsight_match(ev, ev.withColumn("signal_idx", F.col("signal_idx") + F.col("signal_idx") % 9)))


def pattern_conditions(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.conditional_table(_events(spark, sf), 20, 20, 20))


def volume_buckets(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).where("ret_20 IS NOT NULL")
    return rounded(rows.groupBy(V.volume_bucket(F.col("breakout_volume")).alias("bucket")).agg(F.count("*").alias("n"), F.avg("ret_20").alias("ret"), F.avg("xlocal_20").alias("xlocal")))


def research_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = rally_narrow(spark, sf).where("ret IS NOT NULL AND xlocal IS NOT NULL").groupBy("rule", "h").agg(
        F.count("*").alias("n"), F.avg("xlocal").alias("m"), (1.96 * F.stddev_samp("xlocal") / F.sqrt(F.count("*"))).alias("w"), F.try_divide(F.sum(F.when(F.col("ret") > 0, F.col("ret"))), -F.sum(F.when(F.col("ret") < 0, F.col("ret")))).alias("profit_factor"), F.avg("ret").alias("avg_r"),
    ).withColumns({"low": F.col("m") - F.col("w"), "high": F.col("m") + F.col("w"), "p": F.when(F.abs("m") > F.col("w"), 0.01).otherwise(0.5)})
    return rounded(rows.select("rule", "h", "n", "low", "high", V.research_verdict(100).alias("verdict")))


def period_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each rule's excess agrees in all, train and test, by horizon."""
    table = S.by_period(rally_narrow(spark, sf), ["rule"], SPLIT, least=10)
    return rounded(V.agreement(table, ["rule", "h"], ("all", "train", "test")))


def cost_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.cost_sensitivity(rally_narrow(spark, sf), [0.0, 0.0005, 0.001, 0.002], ["rule"]), 6)


def base_directions(spark: SparkSession, sf: str) -> DataFrame:
    """Bases of any width after a fall by volume bucket, at both horizons."""
    bars = T.bars_brand(spark, sf)
    wide = F.coalesce(F.col("beaten") & (F.col("base_range") <= 12.0), F.lit(False))
    return rounded(V.base_directions(E.bases(bars, B.benchmark(bars), state=wide), [0.8, 1.0, 1.3], SPLIT))


def newsday_live(spark: SparkSession, sf: str) -> DataFrame:
    """Over a year of bars and without the fall, as these tables have few such days."""
    rows = V.newsday_live(T.bars_brand(spark, sf), 0.04, 1.5, 250, None, 260)
    return rounded(rows, news_close=9, last_close=9)


def rally_live(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.rally_live(T.bars_brand(spark, sf), max_age=120), close=9, last=9)


def early_rally(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.early_rally(V.rally_live(T.bars_brand(spark, sf), max_age=250)).select("symbol", "rules", "n_rules", "signal_date", "bars_ago", "ret_10", "dist_ma200"))


def candle_control(spark: SparkSession, sf: str) -> DataFrame:
    """Dojis on the mean against all other bars after the same past."""
    bars = T.bars_flag(spark, sf)
    rows = E.every_bar(bars, B.benchmark(bars), [5]).withColumns({"above_ma50": F.col("close") > rolling("close", 50), "ma10_slope": F.try_divide(F.col("ma10"), shift("ma10", 5)) - 1})
    return rounded(V.candle_control(rows, V.downtrends(rows), 5))


def journal_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    bars = T.bars_nation(spark, sf).drop("sector")
    return rounded(V.journal_verdicts(L.mark_to_market(_journal(spark, sf), bars, B.benchmark(bars)).where("ret IS NOT NULL"), {"1-URGENT": 0.62, "2-HIGH": 0.9}))


def journal_stability(spark: SparkSession, sf: str) -> DataFrame:
    bars = T.bars_nation(spark, sf).drop("sector")
    marked = L.mark_to_market(_journal(spark, sf), bars, B.benchmark(bars)).withColumn("excess", F.col("ret") - F.col("bench_ret"))
    return rounded(V.half_stability(marked, ["rule", "symbol"]))


def days_listed(spark: SparkSession, sf: str) -> DataFrame:
    e = T.read(spark, sf, "events").select(F.to_date("ts").alias("date"), F.col("event_type").alias("section"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"))
    return V.days_listed(e, "2100-01-01", 30)


def checklist_top(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten orders by checks passed: the limit is the feature."""
    o = T.read(spark, sf, "orders")
    flags = F.filter(F.array(F.when(F.col("o_totalprice") > 300000, "Z"), F.when(F.col("o_orderstatus") == "P", "D"), F.when(F.col("o_orderpriority").like("1%"), "S")), lambda x: x.isNotNull())
    rows = o.select(F.col("o_orderkey").alias("symbol"), F.col("o_orderpriority").like("2%").alias("signal"), flags.alias("flags"), (F.col("o_orderkey") % 2 == 0).alias("read"), (F.col("o_custkey") % 2 == 0).alias("group"), F.col("o_totalprice").alias("score"))
    return rounded(V.checklist(rows, ["Z", "S"]), 2)


def group_first_order(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of each nation, those in debt first, each part by key."""
    s = T.read(spark, sf, "supplier")
    return V.first_by(s, F.col("s_acctbal") < 0, [F.col("s_suppkey")], ["s_nationkey"]).select("s_suppkey", "s_nationkey", "place")


def rolling_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """Each dense symbol's daily change against the benchmark's, over 60 bars."""
    bars = T.bars_flag(spark, sf)
    rows = E.align_benchmark(bars, B.benchmark(bars)).withColumns({"x": change("close", 1), "y": change("bench_close", 1)})
    return rounded(V.rolling_correlation(rows, "x", "y", 60).select("symbol", "bar_idx", "corr"), 5)


def forward_volume(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.forward_sum(T.bars_brand(spark, sf), "volume", 5).select("symbol", "bar_idx", "ahead"), 4)


def shared_months(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols and months in which both a thrust and a cross of the 50-bar mean fired."""
    hits = E.rally_hits(T.bars_brand(spark, sf)).select("rule", "symbol", F.trunc("date", "month").alias("month"))
    return hits.where("rule = 'thrust'").select("symbol", "month").intersect(hits.where("rule = 'ma50_cross'").select("symbol", "month"))


def growth_price_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.growth_price_features(T.bars_brand(spark, sf)), 5)


def breakout_context(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.breakout_context(T.bars_flag(spark, sf)).select("symbol", "bar_idx", "ret_126", "dist_ma200", "dist_ma50", "close_strength", "volume_ratio"))


def shifted_portfolio(spark: SparkSession, sf: str) -> DataFrame:
    """The curve of reversal entries moved by up to 126 days."""
    dense = B.densify(T.bars_flag(spark, sf))
    ev = dense.withColumn("m", change("close", 1, "t")).where(F.col("m") < -0.5).select("symbol", "t", F.lit(1).alias("direction"))
    return rounded(R.event_curve(V.shifted_events(ev, dense), dense, 20))


QUERIES = {f.__name__: f for f in (
    pattern_events, pattern_trades, structure_outcomes, hindsight_match, pattern_conditions, volume_buckets, research_verdicts, period_agreement, cost_sensitivity, base_directions, newsday_live, rally_live, early_rally,
    candle_control, journal_verdicts, journal_stability, days_listed, checklist_top, group_first_order, rolling_correlation, forward_volume, shared_months, growth_price_features, breakout_context, shifted_portfolio,
)}

_LAST = "max(bar_idx) OVER (PARTITION BY symbol)"
_MATCH = """, mt AS MATERIALIZED (SELECT symbol, rule AS pattern, CASE WHEN rule = 'thrust' THEN -1 ELSE 1 END AS dir, CASE WHEN bar_idx % 4 <= 1 THEN 'confirmed' WHEN bar_idx % 4 = 2 THEN 'failed' ELSE 'expired' END AS status, bar_idx AS breakout_idx, bar_idx - bar_idx % 6 + 3 AS complete,
(0.3 + (bar_idx % 5) / 10.0)::DOUBLE AS score, close * 0.98 AS level, close * CASE WHEN rule = 'thrust' THEN 0.6 ELSE 1.5 END AS target, close * CASE WHEN rule = 'thrust' THEN 1.4 ELSE 0.7 END AS stop, volume_ratio, last_at FROM ev)"""
_PE = SQL_RALLY + _MATCH + sql_forward("al", PH, "open", 1, 0, "open", 1, 126, 0, 1, name="fp") + """, pe AS MATERIALIZED (SELECT mt.symbol, mt.pattern, mt.dir, greatest(breakout_idx, complete) AS signal_idx, fp.date, fp.entry, greatest(breakout_idx, complete) - breakout_idx AS delay, (fp.entry / level - 1) * dir AS gap, volume_ratio AS bv, target, stop, year(fp.date) AS year,
dir * ret_5 AS r5, dir * ret_20 AS r20, dir * (ret_5 - bench_5) AS b5, dir * (ret_20 - bench_20) AS b20, dir * (ret_5 - local_5) AS l5, dir * (ret_20 - local_20) AS l20 FROM mt JOIN fp ON fp.symbol = mt.symbol AND fp.bar_idx = greatest(breakout_idx, complete) WHERE status = 'confirmed' AND fp.entry IS NOT NULL)"""
_WELCH = "CASE WHEN count(a) >= 3 AND count(b) >= 3 THEN (avg(a) - avg(b)) / nullif(sqrt(var_samp(a) / count(a) + var_samp(b) / count(b)), 0) END"
_LIVE = SQL_RALLY + f""", lc AS (SELECT h.*, last_at - bar_idx AS bars_ago FROM hits h), lw AS (SELECT symbol, bar_idx, close / ({lag('close', 10)}) - 1 AS ret_10, close / ({roll('avg', 'close', 50)}) - 1 AS d50, close / ({roll('avg', 'close', 200)}) - 1 AS d200, last_value(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lastc FROM bars)"""


def _live(age: int) -> str:
    return _LIVE + f""", lv AS MATERIALIZED (SELECT lc.symbol, rule, lc.close, lw.lastc, date AS signal_date, CAST(bars_ago AS INT) AS bars_ago, day_ret, lw.ret_10, ret_126 AS ret_6m, from_52w_high, d50, d200, volume_ratio, beaten FROM lc JOIN lw ON lw.symbol = lc.symbol AND lw.bar_idx = lc.bar_idx WHERE bars_ago < {age} AND last_at + 1 >= 300 QUALIFY row_number() OVER (PARTITION BY lc.symbol, rule ORDER BY bars_ago) = 1)"""


_COND = {"loud": "bv >= 1.5", "quiet": "NOT coalesce(bv >= 1.5, false)", "same_bar": "delay <= 0", "delayed": "delay > 0", "extended": "gap > 0.03", "near_level": "NOT coalesce(gap > 0.03, false)"}
_PAST = [
    ("all", "true"), ("quarter under -10%", "ret_q < -0.10"), ("quarter under -20%", "ret_q < -0.20"), ("half under -15%", "ret_h < -0.15"), ("20% below the high", "from_high <= -0.20"), ("mean falls 4+ bars", "ma_down >= 4"), ("3+ falling bars", "down_run >= 3"),
    ("falling and below", "close <= ma50 AND slope <= 0"), ("quarter under -10%, falling and below", "ret_q < -0.10 AND close <= ma50 AND slope <= 0"), ("uptrend", "ret_q > 0.10"), ("mean rises", "slope > 0"), ("mean falls", "slope <= 0"), ("above the 50-bar mean", "close > ma50"), ("below the 50-bar mean", "close <= ma50"),
]


def _run_sql(flag: str) -> str:
    """Rows in a row for which a flag of rr holds, up to each row; the first row never counts."""
    return f"CASE WHEN coalesce({flag}, false) AND rn > 1 THEN rn - coalesce(max(CASE WHEN NOT (coalesce({flag}, false) AND rn > 1) THEN rn END) OVER (PARTITION BY symbol ORDER BY date), 0) ELSE 0 END"


ORACLES = {
    "pattern_events": _PE + f" SELECT symbol, pattern, dir, CAST(signal_idx AS INT) AS signal_idx, date, {_R('entry', 9)} AS entry, CAST(delay AS INT) AS delay, {_R('gap')} AS gap_from_level, {_R('bv')} AS breakout_volume, {', '.join(f'{_R(f"{c}{h}")} AS {n}_{h}' for h in PH for c, n in (('r', 'ret'), ('b', 'xbench'), ('l', 'xlocal')))} FROM pe",
    "pattern_trades": _PE + """, tp AS (SELECT pe.*, b.bar_idx - pe.signal_idx AS k, CASE WHEN dir > 0 THEN b.high ELSE b.low END / entry AS best, CASE WHEN dir > 0 THEN b.low ELSE b.high END / entry AS worst, b.close / entry AS c FROM pe JOIN bars b ON b.symbol = pe.symbol AND b.bar_idx BETWEEN pe.signal_idx + 1 AND pe.signal_idx + 20),
tq AS (SELECT *, dir * (best - 1) AS fav, dir * (worst - 1) AS adv, dir * (c - 1) AS cl, dir * (target / entry - 1) AS tg, dir * (stop / entry - 1) AS sp FROM tp),
tk AS (SELECT symbol, pattern, signal_idx, entry, stop, tg, sp, count(*) AS n, coalesce(min(k) FILTER (adv <= sp), 1073741824) AS ks, coalesce(min(k) FILTER (fav >= tg), 1073741824) AS kt FROM tq GROUP BY ALL),
te AS (SELECT *, CASE WHEN ks <= kt AND ks <= n THEN 'stop' WHEN kt <= n THEN 'target' ELSE 'time' END AS exit_reason FROM tk), tb AS (SELECT *, CASE exit_reason WHEN 'stop' THEN ks WHEN 'target' THEN kt ELSE n END AS bars_held FROM te),
tf AS (SELECT b.symbol, b.pattern, b.signal_idx, b.entry, b.stop, exit_reason, bars_held, CASE exit_reason WHEN 'stop' THEN b.sp WHEN 'target' THEN b.tg ELSE max(q.cl) FILTER (q.k = b.n) END AS tr, greatest(0, max(q.fav) FILTER (q.k <= bars_held)) AS mfe, greatest(0, -min(q.adv) FILTER (q.k <= bars_held)) AS mae FROM tb b JOIN tq q ON q.symbol = b.symbol AND q.pattern = b.pattern AND q.signal_idx = b.signal_idx GROUP BY b.symbol, b.pattern, b.signal_idx, b.entry, b.stop, exit_reason, bars_held, b.sp, b.tg, b.n)
""" + f"SELECT symbol, pattern, CAST(signal_idx AS INT) AS signal_idx, exit_reason, CAST(bars_held AS INT) AS bars_held, {_R('tr')} AS trade_ret, {_R('mfe')} AS mfe, {_R('mae')} AS mae, {_R('CASE WHEN abs(entry - stop) > 0.003 * entry THEN tr * entry / abs(entry - stop) END')} AS r_multiple FROM tf",
    "structure_outcomes": SQL_RALLY + _MATCH + f""", sr AS (SELECT pattern, status FROM mt WHERE last_at - complete >= 60 AND score / CASE status WHEN 'failed' THEN 0.6 WHEN 'expired' THEN 0.7 ELSE 1 END >= 0.5),
sa AS (SELECT pattern, status FROM sr UNION ALL SELECT 'ALL', status FROM sr), sc AS (SELECT pattern, count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'expired') AS expired, count(*) AS n FROM sa GROUP BY pattern)
SELECT pattern, confirmed, failed, expired, n, {_R('confirmed / n')} AS confirm_rate, {_R('failed / n')} AS fail_rate, {_R('expired / n')} AS expire_rate FROM sc""",
    "hindsight_match": _PE + f""", ha AS (SELECT DISTINCT symbol, pattern, signal_idx FROM pe), hb AS (SELECT DISTINCT symbol, pattern, signal_idx + signal_idx % 9 AS signal_idx FROM pe),
hm AS (SELECT (SELECT count(*) FROM ha) AS hindsight_events, (SELECT count(*) FROM ha WHERE EXISTS (SELECT 1 FROM hb WHERE hb.symbol = ha.symbol AND hb.pattern = ha.pattern AND abs(hb.signal_idx - ha.signal_idx) <= 3)) AS matched, (SELECT count(*) FROM hb) AS seen_events)
SELECT hindsight_events, matched, seen_events, {_R('matched / hindsight_events')} AS match_rate FROM hm""",
    "pattern_conditions": _PE + ", pk AS (SELECT * FROM pe WHERE r20 IS NOT NULL), py AS (SELECT pattern, count(*) AS years, count(*) FILTER (m > 0) AS years_positive FROM (SELECT pattern, year, avg(l20) AS m FROM pk GROUP BY ALL HAVING count(*) >= 20) GROUP BY pattern), pc AS (SELECT pattern, count(*) AS n, avg(l20) AS x_all, " + ", ".join(f"count(*) FILTER ({c}) AS n_{k}, CASE WHEN count(*) FILTER ({c}) >= 20 THEN avg(l20) FILTER ({c}) END AS x_{k}" for k, c in _COND.items()) + f" FROM pk GROUP BY pattern) SELECT pc.pattern, n, {_R('x_all')} AS x_all, " + ", ".join(f"n_{k}, {_R(f'x_{k}')} AS x_{k}" for k in _COND) + ", coalesce(years, 0) AS years, coalesce(years_positive, 0) AS years_positive FROM pc LEFT JOIN py ON py.pattern = pc.pattern",
    "volume_buckets": _PE + f" SELECT CASE WHEN bv IS NULL OR bv <= 0 THEN NULL WHEN bv <= 0.8 THEN '<0.8x' WHEN bv <= 1.1 THEN '0.8-1.1x' WHEN bv <= 1.5 THEN '1.1-1.5x' WHEN bv <= 2.5 THEN '1.5-2.5x' ELSE '>2.5x' END AS bucket, count(*) AS n, {_R('avg(r20)')} AS ret, {_R('avg(l20)')} AS xlocal FROM pe WHERE r20 IS NOT NULL GROUP BY 1",
    "research_verdicts": SQL_NARROW + f""", rv AS (SELECT rule, h, count(*) AS n, avg(xlocal) AS m, 1.96 * stddev_samp(xlocal) / sqrt(count(*)) AS w, sum(ret) FILTER (ret > 0) / nullif(-sum(ret) FILTER (ret < 0), 0) AS pf, avg(ret) AS r FROM nv WHERE ret IS NOT NULL AND xlocal IS NOT NULL GROUP BY rule, h)
SELECT rule, h, n, {_R('m - w')} AS low, {_R('m + w')} AS high, CASE WHEN n < 100 THEN 'insufficient data' WHEN m - w > 0 AND abs(m) > w THEN 'edge' WHEN m + w < 0 THEN 'worse than random' WHEN pf > 1.1 AND r > 0.05 THEN 'unproven' ELSE 'no edge' END AS verdict FROM rv""",
    "period_agreement": SQL_NARROW + _BY_PERIOD + ", pw AS (SELECT rule, h, " + ", ".join(f"max({c}) FILTER (period = '{p}') AS {p}_{c}" for p in ("all", "train", "test") for c in ("n", "xlocal")) + " FROM bt GROUP BY rule, h), pv AS (SELECT *, CASE WHEN " + " AND ".join(f"{p}_n >= 30 AND {p}_xlocal >= 0.005" for p in ("all", "train", "test")) + " THEN 'up' WHEN " + " AND ".join(f"{p}_n >= 30 AND {p}_xlocal <= -0.005" for p in ("all", "train", "test")) + " THEN 'down' ELSE 'none' END AS direction FROM pw) SELECT rule, h, " + ", ".join(f"CAST({p}_n AS BIGINT) AS {p}_n, {_R(f'{p}_xlocal')} AS {p}_xlocal" for p in ("all", "train", "test")) + ", direction, direction <> 'none' AS passed FROM pv",
    "cost_sensitivity": SQL_NARROW + f", cc AS (SELECT rule, cost, ret - cost AS net, xlocal - cost AS x FROM nv, (VALUES (0.0::DOUBLE), (0.0005), (0.001), (0.002)) c(cost) WHERE h = 20 AND ret IS NOT NULL) SELECT cost, rule, count(*) AS n, {_R('avg(net)')} AS net_ret, {_R('avg((net > 0)::INT)')} AS hit, {_R('avg(x)')} AS excess, {_R('sum(net) FILTER (net > 0) / nullif(-sum(net) FILTER (net < 0), 0)')} AS profit_factor FROM cc GROUP BY ALL",
    "base_directions": sql_bars("brand", bench=True) + sql_bench("bars") + sql_forward("al", [20, 60], *NEXT_OPEN) + BASES + f""", bd AS (SELECT CAST((bv > 0.8)::INT + (bv > 1.0)::INT + (bv > 1.3)::INT AS INT) AS bucket, CASE WHEN date < DATE '{SPLIT}' THEN 'train' ELSE 'test' END AS period, ret_20, ret_60, c20 > h15 AS u20, c20 < l15 AS d20, c60 > h15 AS u60, c60 < l15 AS d60 FROM kept WHERE entry > 0)
SELECT bucket, period, count(*) AS n, {', '.join(f"{_R(f'avg(u{h}::INT)')} AS up_{h}, {_R(f'avg(d{h}::INT)')} AS down_{h}, {_R(f'avg(ret_{h}) - 0.001')} AS net_{h}" for h in (20, 60))} FROM bd GROUP BY ALL""",
    "newsday_live": sql_bars("brand") + f""", nl AS (SELECT *, open / ({lag('close')}) - 1 AS gap, volume / ({roll('avg', 'volume', 20, None, 1)}) AS vr, close / ({lag('close')}) - 1 AS day_return, close / ({lag('close', 126)}) - 1 AS ret_6m, close / ({roll('avg', 'close', 200)}) - 1 AS dist, count(*) OVER (PARTITION BY symbol) AS n, last_value(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS last_close FROM bars),
nh AS (SELECT * FROM nl WHERE abs(gap) >= 0.04 AND vr >= 1.5 AND dist < 0 AND n - 1 - bar_idx < 250 AND n >= 260 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_idx) = 1)
SELECT symbol, date AS news_date, CAST(n - 1 - bar_idx AS INT) AS bars_ago, {_R('gap')} AS gap, {_R('day_return')} AS day_return, {_R('vr')} AS volume_ratio, {_R('ret_6m')} AS ret_6m, {_R('dist')} AS dist_ma200, {_R('close', 9)} AS news_close, {_R('last_close', 9)} AS last_close, {_R('last_close / close - 1')} AS since_news, CAST(260 - (n - 1 - bar_idx) AS INT) AS bars_left FROM nh""",
    "rally_live": _live(120) + f" SELECT symbol, rule, {_R('close', 9)} AS close, {_R('lastc', 9)} AS last, signal_date, bars_ago, {_R('day_ret')} AS day_ret, {_R('ret_10')} AS ret_10, {_R('ret_6m')} AS ret_6m, {_R('from_52w_high')} AS from_52w_high, {_R('d50')} AS dist_ma50, {_R('d200')} AS dist_ma200, {_R('volume_ratio')} AS volume_ratio, d200 < 0 AS below_ma200, beaten FROM lv",
    "early_rally": _live(250) + f""", eb AS (SELECT * FROM lv WHERE beaten), ea AS (SELECT symbol, string_agg(rule, ', ' ORDER BY bars_ago, rule) AS rules, CAST(count(*) AS INT) AS n_rules FROM eb GROUP BY symbol), en AS (SELECT * FROM eb QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bars_ago, rule) = 1)
SELECT ea.symbol, rules, n_rules, signal_date, bars_ago, {_R('ret_10')} AS ret_10, {_R('d200')} AS dist_ma200 FROM ea JOIN en ON en.symbol = ea.symbol""",
    "candle_control": sql_bars("flag") + f""", r0 AS (SELECT *, {roll('avg', 'close', 10)} AS ma10, {roll('avg', 'close', 50)} AS ma50, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn, close < ({lag('close')}) AS dn, close / ({lag('close', 63)}) - 1 AS ret_q, close / ({lag('close', 126)}) - 1 AS ret_h, close / ({roll('max', 'close', 252, 20)}) - 1 AS from_high, ({lag('close', -5)}) / close - 1 AS r FROM bars),
rr AS (SELECT *, ma10 < ({lag('ma10')}) AS md, ma10 / ({lag('ma10', 5)}) - 1 AS slope FROM r0), r2 AS (SELECT *, {_run_sql('dn')} AS run0, {_run_sql('md')} AS ma_down FROM rr), r3 AS (SELECT *, coalesce({lag('run0')}, 0) AS down_run, (high - low > 0 AND high - low >= 0.01 * close AND abs(close - open) <= 0.1 * (high - low)) AND coalesce(ma10 BETWEEN low AND high, false) AS dj FROM r2),
r4 AS (SELECT label, CASE WHEN dj THEN r END AS a, CASE WHEN NOT dj THEN r END AS b FROM r3, LATERAL (VALUES {', '.join(f"('{n}', {c})" for n, c in _PAST)}) l(label, v) WHERE r IS NOT NULL AND v)
SELECT label, count(a) AS n_doji, count(b) AS n_rest, {_R('avg(a)')} AS doji, {_R('avg(b)')} AS rest, {_R('avg((a > 0)::INT)')} AS hit_doji, {_R('avg((b > 0)::INT)')} AS hit_rest, {_R(_WELCH)} AS t FROM r4 GROUP BY label HAVING count(a) >= 5""",
    "journal_verdicts": _MTM + f""", jv AS (SELECT rule, count(*) AS logged, count(*) FILTER (done) AS closed, count(*) FILTER (NOT done) AS open, avg(ret) FILTER (done) AS mc, avg((ret > 0)::INT) FILTER (done) AS hc, avg(ret - bench_ret) FILTER (done) AS xc, avg(ret) FILTER (NOT done) AS mo, avg((ret > 0)::INT) FILTER (NOT done) AS ho, avg(ret) AS ma, avg((ret > 0)::INT) AS ha, CASE rule WHEN '1-URGENT' THEN 0.62::DOUBLE WHEN '2-HIGH' THEN 0.9 END AS expected_hit FROM mt WHERE ret IS NOT NULL GROUP BY rule)
SELECT rule, logged, closed, open, {_R('mc')} AS mean_closed, {_R('hc')} AS hit_closed, {_R('xc')} AS xbench_closed, {_R('mo')} AS mean_open, {_R('ho')} AS hit_open, {_R('ma')} AS mean_all, {_R('ha')} AS hit_all, expected_hit, CASE WHEN closed < 10 THEN 'early' WHEN mc > 0 AND hc >= coalesce(expected_hit - 0.1, 0.5) THEN 'on_track' ELSE 'below' END AS verdict FROM jv""",
    "journal_stability": _MTM + f""", js AS (SELECT rule, symbol, ret - bench_ret AS x, (signal_date - DATE '1970-01-01') AS d, min(signal_date - DATE '1970-01-01') OVER g AS lo, max(signal_date - DATE '1970-01-01') OVER g AS hi FROM mt WINDOW g AS (PARTITION BY rule, symbol)),
jh AS (SELECT rule, symbol, count(x) FILTER (d <= lo + (hi - lo) / 2) AS n1, avg(x) FILTER (d <= lo + (hi - lo) / 2) AS half1, count(x) FILTER (d > lo + (hi - lo) / 2) AS n2, avg(x) FILTER (d > lo + (hi - lo) / 2) AS half2 FROM js WHERE x IS NOT NULL GROUP BY ALL)
SELECT rule, symbol, n1, {_R('half1')} AS half1, n2, {_R('half2')} AS half2, coalesce(n1 >= 8 AND n2 >= 8 AND sign(half1) = sign(half2), false) AS stable FROM jh""",
    "days_listed": "WITH rp AS (SELECT DISTINCT CAST(ts AS DATE) AS date, event_type AS section, 'U' || user_id AS symbol FROM events), dd AS (SELECT DISTINCT date FROM rp ORDER BY date DESC LIMIT 30) SELECT section, symbol, count(*) AS days FROM rp JOIN dd USING (date) GROUP BY ALL",
    "checklist_top": f"SELECT o_orderkey AS symbol, CAST(2 + (o_orderstatus = 'P')::INT + (o_custkey % 2 = 0)::INT + (o_orderkey % 2 = 0)::INT AS INT) AS passes, {_R('o_totalprice', 2)} AS score FROM orders WHERE o_orderpriority LIKE '2%' AND NOT o_totalprice > 300000 ORDER BY passes DESC, o_totalprice DESC, symbol LIMIT 10",
    "group_first_order": "SELECT s_suppkey, s_nationkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY (s_acctbal < 0) DESC, s_suppkey) AS INT) AS place FROM supplier",
    "rolling_correlation": sql_bars("flag", bench=True) + sql_bench("bars") + f", rc AS (SELECT *, close / ({lag('close')}) - 1 AS x, bench_close / ({lag('bench_close')}) - 1 AS y FROM al) SELECT symbol, CAST(bar_idx AS INT) AS bar_idx, {_R('CASE WHEN count(x) OVER w >= 60 THEN corr(x, y) OVER w END', 5)} AS corr FROM rc WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)",
    "forward_volume": sql_bars("brand") + f" SELECT symbol, CAST(bar_idx AS INT) AS bar_idx, {_R('CASE WHEN count(volume) OVER w >= 5 THEN sum(volume) OVER w END', 4)} AS ahead FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)",
    "shared_months": SQL_RALLY + " SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS month FROM hits WHERE rule = 'thrust' INTERSECT SELECT symbol, CAST(date_trunc('month', date) AS DATE) FROM hits WHERE rule = 'ma50_cross'",
    "growth_price_features": sql_bars("brand") + f""", g0 AS (SELECT *, close / ({lag('close')}) - 1 AS r, greatest(high - low, coalesce(abs(high - ({lag('close')})), 0), coalesce(abs(low - ({lag('close')})), 0)) AS tr, max(bar_idx) OVER (PARTITION BY symbol) AS last_at FROM bars),
g1 AS (SELECT symbol, date, bar_idx, last_at, ({lag('close', 21)}) / ({lag('close', 252)}) - 1 AS a, ({lag('close', 21)}) / ({lag('close', 126)}) - 1 AS b, close / ({lag('close', 21)}) - 1 AS c, close / ({roll('avg', 'close', 200)}) - 1 AS d, avg(tr) OVER (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING) / close AS e, ({roll('stddev_samp', 'r', 252)}) * sqrt(252) AS f FROM g0)
SELECT symbol, date, {_R('a', 5)} AS mom_12_1, {_R('b', 5)} AS mom_6_1, {_R('c', 5)} AS ret_21, {_R('d', 5)} AS dist_ma200, {_R('e', 5)} AS atr_pct, {_R('f', 5)} AS vol_1y FROM g1 WHERE bar_idx = last_at""",
    "breakout_context": sql_bars("flag") + f""", bx AS (SELECT symbol, bar_idx, close / ({lag('close', 126)}) - 1 AS a, close / ({roll('avg', 'close', 200)}) - 1 AS b, close / ({roll('avg', 'close', 50)}) - 1 AS c, (close - low) / nullif(high - low, 0) AS d, CASE WHEN volume > 0 THEN volume / (avg(CASE WHEN volume > 0 THEN volume END) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) END AS e FROM bars)
SELECT symbol, CAST(bar_idx AS INT) AS bar_idx, {_R('a')} AS ret_126, {_R('b')} AS dist_ma200, {_R('c')} AS dist_ma50, {_R('d')} AS close_strength, {_R('e')} AS volume_ratio FROM bx""",
}
