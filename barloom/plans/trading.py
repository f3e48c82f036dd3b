"""Queries on portfolios and exits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import change
from ..operators import paths as P
from ..operators import portfolio as R
from ..operators import stats as S
from ..sources import bars as B
from . import tables as T
from .happenings import _R, SQL_RALLY, rally
from .tables import lag, roll, rounded, sql_bars


def _nation(spark: SparkSession, sf: str) -> DataFrame:
    bars = T.bars_nation(spark, sf)
    sector = bars.select("symbol", "sector").distinct()
    return B.densify(bars.drop("sector"), fill=True).join(sector, "symbol")


def xs_momentum_groups(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.ranked_backtest(_nation(spark, sf), R.momentum(126, 21), 5, least_names=10))


def xs_momentum_summary(spark: SparkSession, sf: str) -> DataFrame:
    bt = R.ranked_backtest(_nation(spark, sf), R.momentum(126, 21), 5, least_names=10)
    return rounded(R.summarise_groups(bt, 12.0, T.SPLIT, 5).drop("ann_return", "total_return", "max_drawdown"), 4)


def xs_lowvol(spark: SparkSession, sf: str) -> DataFrame:
    dense = _nation(spark, sf).withColumn("r1", change("close", 1, "t"))
    return rounded(R.ranked_backtest(dense, R.low_volatility(), 5, least_names=10))


def xs_sector_residual(spark: SparkSession, sf: str) -> DataFrame:
    dense = _nation(spark, sf).withColumn("rk", change("close", 20, "t"))
    return rounded(R.ranked_backtest(dense, R.sector_residual(20), 5, "week", least_names=10))


def ts_momentum(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.index_strategies(B.benchmark(T.bars_brand(spark, sf)))
    return rounded(S.performance(rows, ["strategy"], 252.0), 4)


def vol_managed(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.volatility_managed(B.benchmark(T.bars_brand(spark, sf))).drop("symbol"))


def turn_of_month(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.turn_of_month(B.benchmark(T.bars_brand(spark, sf)), T.SPLIT))


def overnight_intraday(spark: SparkSession, sf: str) -> DataFrame:
    bars = T.bars_flag(spark, sf)
    return rounded(R.overnight_intraday(B.densify(bars), B.benchmark(bars), T.SPLIT).select("series", "leg", "period", "n", "mean_period", "t_stat", "hit"))


def event_portfolio_curve(spark: SparkSession, sf: str) -> DataFrame:
    dense = B.densify(T.bars_flag(spark, sf))
    ev = dense.withColumn("m", change("close", 1, "t")).where(F.col("m") < -0.5).select("symbol", "t", F.lit(1).alias("direction"))
    return rounded(R.event_curve(ev, dense))


def _trades(spark: SparkSession, sf: str, length: int) -> DataFrame:
    return P.paths_of(rally(spark, sf).select("symbol", "bar_idx").distinct(), T.bars_brand(spark, sf), length)


def exit_rules_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.exit_grid(_trades(spark, sf, 60), P.default_rules()), 5)


def shortterm_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.strategy_grid(_trades(spark, sf, 10), [1, 2, 5, 10], [None, 0.02, 0.05], [None, 0.03]), 5)


def tpsl_trades(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.take_profit_rule(T.bars_flag(spark, sf), 0.8, 0.6, 20, 5)
    return rounded(rows.select("symbol", "date", "days", "reason", "ret", "hold_ret"))


def tpsl_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.trade_stats(P.take_profit_rule(T.bars_flag(spark, sf), 0.8, 0.6, 20, 5), ["symbol"]), 5)


def trade_sim_target_stop(spark: SparkSession, sf: str) -> DataFrame:
    rows = _trades(spark, sf, 20).withColumns({"direction": F.lit(1), "target": F.col("entry") * 1.75, "stop": F.col("entry") * 0.6})
    return rounded(P.simulate_trade(rows, 20).select("symbol", "bar_idx", "exit_reason", "bars_held", "trade_ret", "mfe", "mae", "r_multiple"))


QUERIES = {f.__name__: f for f in (
    xs_momentum_groups, xs_momentum_summary, xs_lowvol, xs_sector_residual, ts_momentum, vol_managed, turn_of_month, overnight_intraday, event_portfolio_curve,
    exit_rules_grid, shortterm_grid, tpsl_trades, tpsl_grid, trade_sim_target_stop,
)}

_FILL = sql_bars("nation", dense=True) + ", fl AS MATERIALIZED (SELECT symbol, sector, t, date, last_value(open IGNORE NULLS) OVER w AS open, last_value(close IGNORE NULLS) OVER w AS close FROM dense WINDOW w AS (PARTITION BY symbol ORDER BY t))"


def _sql_ranked(signal: str, unit: str, groups: int = 5, least: int = 10) -> str:
    return f""", sg AS MATERIALIZED (SELECT symbol, t, date, {signal} AS signal, {lag('open', -1, 't')} AS nopen, CAST(date_trunc('{unit}', date) AS DATE) AS period FROM sgin),
rb AS (SELECT *, lead(t) OVER (ORDER BY t) AS until, row_number() OVER (ORDER BY t) AS k FROM (SELECT period, max(t) AS t FROM sg GROUP BY period)),
hd AS (SELECT a.symbol, a.date, rb.k, a.signal, a.nopen AS bought, b.nopen AS sold FROM sg a JOIN rb ON rb.t = a.t JOIN sg b ON b.symbol = a.symbol AND b.t = rb.until WHERE a.signal IS NOT NULL AND a.nopen IS NOT NULL AND b.nopen IS NOT NULL),
rk AS (SELECT *, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY signal, symbol) AS r FROM hd),
gr AS MATERIALIZED (SELECT *, CASE WHEN n > 1 THEN greatest(1, ((r - 1) * {groups} + n - 2) // (n - 1)) ELSE 1 END AS grp, sold / bought - 1 AS ret FROM rk WHERE n >= {least}),
fm AS (SELECT k, lag(k) OVER (ORDER BY k) AS before FROM (SELECT DISTINCT k FROM gr)),
bt AS MATERIALIZED (SELECT date, CAST(grp AS INT) AS grp, gross, turnover, names, gross - 2 * turnover * 10 / 1e4 AS net FROM (SELECT g.k, g.date, g.grp, avg(g.ret) AS gross, 1 - count(w.symbol) / count(*) AS turnover, count(*) AS names FROM gr g JOIN fm ON fm.k = g.k LEFT JOIN gr w ON w.k = fm.before AND w.symbol = g.symbol AND w.grp = g.grp GROUP BY ALL)
UNION ALL SELECT date, 0, avg(ret), 0.0, count(*), avg(ret) FROM gr GROUP BY date)"""


_BT = f" SELECT date, grp, {_R('gross')} AS gross, {_R('turnover')} AS turnover, names, {_R('net')} AS net FROM bt"


def _sql_perf(source: str, by: str, per_year: float, r: str = "r") -> str:
    w = f"(PARTITION BY {by} ORDER BY date)"
    return f""", pf0 AS (SELECT *, exp(sum(ln(1 + {r})) OVER {w}) AS eq FROM {source} WHERE {r} IS NOT NULL), pf1 AS (SELECT *, eq / max(eq) OVER {w} - 1 AS fall FROM pf0),
pf2 AS (SELECT {by}, count(*) AS n, avg({r}) AS mean, stddev_samp({r}) AS sd, avg(({r} > 0)::INT) AS hit, min(fall) AS dd, exp(sum(ln(1 + {r}))) AS growth FROM pf1 GROUP BY {by} HAVING count(*) >= 2),
perf AS (SELECT {by}, n, pow(growth, {per_year} / n) - 1 AS ann_return, sd * sqrt({per_year}) AS ann_vol, mean / nullif(sd, 0) * sqrt({per_year}) AS sharpe, mean / nullif(sd, 0) * sqrt(n) AS t_stat, hit, dd AS max_drawdown, mean AS mean_period, growth - 1 AS total_return FROM pf2)"""


_PERF = lambda n, short=False: ", ".join(f"{_R(c, n)} AS {c}" for c in ("ann_return", "ann_vol", "sharpe", "t_stat", "hit", "max_drawdown", "mean_period", "total_return") if not (short and c in ("ann_return", "total_return", "max_drawdown")))
_SPLIT2 = f"unnest(['all', CASE WHEN date < DATE '{T.SPLIT}' THEN 'train' ELSE 'test' END]) AS period"
_BR = sql_bars("brand", bench=True)
_BD = f", bd AS (SELECT *, close / lag(close) OVER (ORDER BY date) - 1 AS daily FROM bench)"
_NEXT = "fb AS MATERIALIZED (SELECT symbol, bar_idx, date, open, high, low, close, lead(open) OVER (PARTITION BY symbol ORDER BY bar_idx) AS entry, max(bar_idx) OVER (PARTITION BY symbol) AS last_at FROM bars)"


def _sql_path(trades: str, length: int) -> str:
    """A CTE `pa`: each bar of each trade's path, k from 1."""
    return f""", pa AS MATERIALIZED (SELECT t.symbol, t.bar_idx, t.entry, b.bar_idx - t.bar_idx AS k, b.open / t.entry - 1 AS o, b.high / t.entry - 1 AS h, b.low / t.entry - 1 AS l, b.close / t.entry - 1 AS c FROM {trades} t JOIN bars b ON b.symbol = t.symbol AND b.bar_idx BETWEEN t.bar_idx + 1 AND t.bar_idx + {length})"""


def _rule_sql(r: P.ExitRule) -> str:
    lvl = {"target": f"{r.a}", "rising": f"{r.a} + {r.b} * (k - 1)", "hybrid": f"CASE WHEN k = 1 THEN {r.a} ELSE {r.b} END"}.get(r.kind)
    if lvl:
        hit, out = f"h >= ({lvl})", f"greatest(o, ({lvl}))"
    elif r.kind == "perday":
        hit, out = f"c >= {r.a} * k", "c"
    elif r.kind == "trail":
        hit, out = f"k > 1 AND (1 + c) / (1 + peak) - 1 <= -{r.a}", "c"
    else:
        hit, out = "false", "c"
    return f"""SELECT '{r.name}' AS rule, symbol, bar_idx, coalesce(arg_min({out}, k) FILTER ({hit}), max(c) FILTER (k = {r.hold})) AS ret, coalesce(min(k) FILTER ({hit}), {r.hold}) AS bars, count(*) FILTER ({hit}) > 0 AS early FROM pp WHERE k <= {r.hold} GROUP BY symbol, bar_idx"""


#: Each bar at which some rule fires, once.
_ANY = SQL_RALLY + ", ed AS MATERIALIZED (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY symbol, bar_idx ORDER BY rule) = 1)"
_CELLS = [(h, t, s) for h in (1, 2, 5, 10) for t in (0.0, 0.02, 0.05) for s in (0.0, 0.03)]


def _cell_sql(h: int, t: float, s: float) -> str:
    st, tg = (f"l <= -{s}" if s else "false"), (f"h >= {t}" if t else "false")
    return f"""SELECT {h} AS hold, {t}::DOUBLE AS target, {s}::DOUBLE AS stop, symbol, bar_idx, coalesce(arg_min(CASE WHEN {st} THEN least(o, -{s}::DOUBLE) ELSE greatest(o, {t}::DOUBLE) END, k) FILTER ({st} OR {tg}), max(c) FILTER (k = {h})) AS ret, coalesce(min(k) FILTER ({st} OR {tg}), {h}) AS bars FROM pa WHERE k <= {h} GROUP BY symbol, bar_idx"""


_TPSL = sql_bars("flag") + ", " + _NEXT + ", tr AS (SELECT * FROM fb WHERE entry > 0 AND bar_idx >= 200 AND (bar_idx - 200) % 5 = 0 AND bar_idx < last_at - 1)" + _sql_path("tr", 20) + """,
ag AS (SELECT symbol, bar_idx, count(*) AS n, coalesce(min(k) FILTER (h >= 0.8), 1073741824) AS kt, coalesce(min(k) FILTER (l <= -0.6), 1073741824) AS ks FROM pa GROUP BY ALL),
rz AS (SELECT *, CASE WHEN ks <= kt AND ks <= n THEN 'stop' WHEN kt <= n THEN 'target' WHEN n = 20 THEN 'time' ELSE 'end' END AS reason FROM ag),
dz AS (SELECT *, CASE reason WHEN 'stop' THEN ks WHEN 'target' THEN kt ELSE n END AS days FROM rz),
tz AS MATERIALIZED (SELECT dz.symbol, tr.date, dz.days, reason, CASE reason WHEN 'stop' THEN CASE WHEN dz.days > 1 THEN least(pa.o, -0.6) ELSE -0.6 END WHEN 'target' THEN CASE WHEN dz.days > 1 THEN greatest(pa.o, 0.8) ELSE 0.8 END ELSE pa.c END - 0.0005 AS ret, pa.c AS hold_ret FROM dz JOIN pa ON pa.symbol = dz.symbol AND pa.bar_idx = dz.bar_idx AND pa.k = dz.days JOIN tr ON tr.symbol = dz.symbol AND tr.bar_idx = dz.bar_idx)"""

ORACLES = {
    "xs_momentum_groups": _FILL + ", sgin AS (SELECT * FROM fl)" + _sql_ranked(f"({lag('close', 21, 't')}) / ({lag('close', 126, 't')}) - 1", "month") + _BT,
    "xs_momentum_summary": _FILL + ", sgin AS (SELECT * FROM fl)" + _sql_ranked(f"({lag('close', 21, 't')}) / ({lag('close', 126, 't')}) - 1", "month") + f""", sl AS (SELECT date, 'G' || grp AS portfolio, net AS r FROM bt UNION ALL SELECT date, 'spread', max(gross) FILTER (grp = 5) - max(gross) FILTER (grp = 1) - (max(gross) FILTER (grp = 5) - max(net) FILTER (grp = 5)) - (max(gross) FILTER (grp = 1) - max(net) FILTER (grp = 1)) FROM bt GROUP BY date),
sp AS (SELECT *, {_SPLIT2} FROM sl)""" + _sql_perf("sp", "period, portfolio", 12.0) + f" SELECT period, portfolio, n, {_PERF(4, True)} FROM perf",
    "xs_lowvol": _FILL + f", sgin AS (SELECT *, close / ({lag('close', 1, 't')}) - 1 AS r1 FROM fl)" + _sql_ranked(f"-({roll('stddev_samp', 'r1', 60, 2, 0, 't')})", "month") + _BT,
    "xs_sector_residual": _FILL + f", sg0 AS (SELECT *, close / ({lag('close', 20, 't')}) - 1 AS rk FROM fl), sgin AS (SELECT * FROM sg0)" + _sql_ranked("rk - avg(rk) OVER (PARTITION BY t, sector)", "week") + _BT,
    "ts_momentum": _BR + _BD + f""", ix AS (SELECT date, daily, coalesce((close / lag(close, 252) OVER (ORDER BY date) - 1 > 0)::INT::DOUBLE, 0) AS a, coalesce((close > CASE WHEN count(*) OVER (ORDER BY date ROWS 199 PRECEDING) >= 200 THEN avg(close) OVER (ORDER BY date ROWS 199 PRECEDING) END)::INT::DOUBLE, 0) AS b FROM bd),
iy AS (SELECT *, lag(a) OVER (ORDER BY date) AS pa, lag(b) OVER (ORDER BY date) AS pb FROM ix), iz AS (SELECT *, coalesce(abs(pa - lag(pa) OVER (ORDER BY date)), 0) * 5 / 1e4 AS ca, coalesce(abs(pb - lag(pb) OVER (ORDER BY date)), 0) * 5 / 1e4 AS cb FROM iy),
st AS (SELECT date, 'hold' AS strategy, daily AS r FROM iz UNION ALL SELECT date, 'trend', pa * daily - ca FROM iz UNION ALL SELECT date, 'mean', pb * daily - cb FROM iz)""" + _sql_perf("st", "strategy", 252.0) + f" SELECT strategy, n, {_PERF(4)} FROM perf",
    "vol_managed": _BR + _BD + f""", vw AS (SELECT date, daily, least(1.5, 0.15 / (CASE WHEN count(daily) OVER w >= 21 THEN stddev_samp(daily) OVER w END * sqrt(252))) AS w0 FROM bd WHERE daily IS NOT NULL WINDOW w AS (ORDER BY date ROWS 20 PRECEDING)),
vx AS (SELECT date, daily, coalesce(lag(w0) OVER (ORDER BY date), 0) AS exposure FROM vw)
SELECT date, {_R('daily')} AS daily, {_R('exposure')} AS exposure, {_R('exposure * daily - coalesce(abs(exposure - lag(exposure) OVER (ORDER BY date)), 0) * 0.0005')} AS managed FROM vx""",
    "turn_of_month": _BR + _BD + f""", tm AS (SELECT date, daily AS r, row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY date) AS pos, count(*) OVER (PARTITION BY date_trunc('month', date)) AS size FROM bd WHERE daily IS NOT NULL),
tn AS (SELECT *, pos <= 3 OR pos > size - 4 AS ins, {_SPLIT2} FROM tm), tp AS (SELECT *, CASE WHEN ins THEN r END AS a, CASE WHEN NOT ins THEN r END AS b FROM tn)
SELECT period, count(a) AS days_in, count(b) AS days_out, {_R('avg(a)')} AS mean_in, {_R('avg(b)')} AS mean_out, {_R('(avg(a) - avg(b)) / nullif(sqrt(var_samp(a) / count(a) + var_samp(b) / count(b)), 0)')} AS t_diff, {_R('avg(ins::INT)')} AS share_invested FROM tp GROUP BY period""",
    "overnight_intraday": sql_bars("flag", bench=True, dense=True) + f""", ol AS (SELECT date, open / ({lag('close', 1, 't')}) - 1 AS ov, close / open - 1 AS it FROM dense), oa AS (SELECT date, avg(ov) AS ov, avg(it) AS it, 'universe' AS series FROM ol GROUP BY date UNION ALL SELECT date, open / lag(close) OVER (ORDER BY date) - 1, close / open - 1, 'bench' FROM bench),
ob AS (SELECT series, date, 'overnight' AS leg, ov AS r FROM oa UNION ALL SELECT series, date, 'intraday', it FROM oa), oc AS (SELECT *, {_SPLIT2} FROM ob)""" + _sql_perf("oc", "series, leg, period", 252.0) + f" SELECT series, leg, period, n, {_R('mean_period')} AS mean_period, {_R('t_stat')} AS t_stat, {_R('hit')} AS hit FROM perf",
    "event_portfolio_curve": sql_bars("flag", dense=True) + f""", em AS MATERIALIZED (SELECT *, close / ({lag('close', 1, 't')}) - 1 AS m, max(t) OVER (PARTITION BY symbol) AS last_at, {', '.join(f"{lag('date', -k, 't')} AS d{k}, {lag('close', -k, 't')} AS c{k}" for k in (1, 2, 3))}, {lag('open', -1, 't')} AS o1 FROM dense),
ed AS (SELECT d1 AS date, c1 / o1 - 1 - 0.0005 AS r FROM em WHERE m < -0.5 AND t + 4 < last_at + 1 UNION ALL SELECT d2, c2 / c1 - 1 FROM em WHERE m < -0.5 AND t + 4 < last_at + 1 UNION ALL SELECT d3, c3 / c2 - 1 FROM em WHERE m < -0.5 AND t + 4 < last_at + 1)
SELECT date, {_R('avg(r)')} AS r, count(*) AS positions FROM ed GROUP BY date HAVING avg(r) IS NOT NULL""",
    "exit_rules_grid": _ANY + _sql_path("ed", 60) + ", pp AS MATERIALIZED (SELECT *, max(c) OVER (PARTITION BY symbol, bar_idx ORDER BY k) AS peak FROM pa), ru AS (" + " UNION ALL ".join(_rule_sql(r) for r in P.default_rules()) + f"), rn AS (SELECT *, ret - 0.001 AS net FROM ru WHERE ret IS NOT NULL) SELECT rule, count(*) AS n, {_R('avg(net)', 5)} AS net, {_R('avg((net > 0)::INT)', 5)} AS hit, {_R('avg(bars)', 5)} AS avg_bars, {_R('avg(early::INT)', 5)} AS early_exit, {_R('sum(net) / sum(bars) * 1e4', 5)} AS per_bar_bp, {_R('sum(net) FILTER (net > 0) / nullif(-sum(net) FILTER (net < 0), 0)', 5)} AS profit_factor FROM rn GROUP BY rule",
    "shortterm_grid": _ANY + _sql_path("ed", 10) + ", ce AS (" + " UNION ALL ".join(_cell_sql(*c) for c in _CELLS) + f"), cn AS (SELECT *, ret - 0.0005 AS net FROM ce WHERE ret IS NOT NULL) SELECT hold, target, stop, count(*) AS n, {_R('avg(net)', 5)} AS net, {_R('avg((net > 0)::INT)', 5)} AS hit, {_R('avg(bars)', 5)} AS avg_bars FROM cn GROUP BY ALL",
    "tpsl_trades": _TPSL + f" SELECT symbol, date, CAST(days AS INT) AS days, reason, {_R('ret')} AS ret, {_R('hold_ret')} AS hold_ret FROM tz",
    "tpsl_grid": _TPSL + f" SELECT symbol, count(*) AS n, {_R('avg((ret > 0)::INT)', 5)} AS hit, {_R(chr(97) + 'vg((reason = ' + chr(39) + 'target' + chr(39) + ')::INT)', 5)} AS target_rate, {_R('avg((reason = ' + chr(39) + 'stop' + chr(39) + ')::INT)', 5)} AS stop_rate, {_R('avg(ret)', 5)} AS mean_ret, {_R('quantile_cont(ret, 0.5)', 5)} AS median_ret, {_R('avg(days)', 5)} AS mean_days, {_R('quantile_cont(days, 0.9)', 5)} AS p90_days, {_R('sum(ret) / sum(days) * 1e4', 5)} AS per_day_bp, {_R('sum(hold_ret) / sum(days) * 1e4', 5)} AS hold_per_day_bp, {_R('sum(ret) FILTER (ret > 0) / nullif(-sum(ret) FILTER (ret < 0), 0)', 5)} AS profit_factor FROM tz GROUP BY symbol",
    "trade_sim_target_stop": _ANY + _sql_path("ed", 20) + f""", ts AS (SELECT *, entry * 1.75 / entry - 1 AS tg, entry * 0.6 / entry - 1 AS sp FROM pa), tk AS (SELECT symbol, bar_idx, entry, tg, sp, count(*) AS n, coalesce(min(k) FILTER (l <= sp), 1073741824) AS ks, coalesce(min(k) FILTER (h >= tg), 1073741824) AS kt FROM ts GROUP BY ALL),
te AS (SELECT *, CASE WHEN ks <= kt AND ks <= n THEN 'stop' WHEN kt <= n THEN 'target' ELSE 'time' END AS exit_reason FROM tk), tb AS (SELECT *, CASE exit_reason WHEN 'stop' THEN ks WHEN 'target' THEN kt ELSE n END AS bars_held FROM te),
tf AS (SELECT b.symbol, b.bar_idx, b.entry, exit_reason, bars_held, CASE exit_reason WHEN 'stop' THEN b.sp WHEN 'target' THEN b.tg ELSE max(p.c) FILTER (p.k = b.n) END AS tr, greatest(0, max(p.h) FILTER (p.k <= bars_held)) AS mfe, greatest(0, -min(p.l) FILTER (p.k <= bars_held)) AS mae FROM tb b JOIN ts p ON p.symbol = b.symbol AND p.bar_idx = b.bar_idx GROUP BY b.symbol, b.bar_idx, b.entry, exit_reason, bars_held, b.sp, b.tg, b.n)
SELECT symbol, CAST(bar_idx AS INT) AS bar_idx, exit_reason, CAST(bars_held AS INT) AS bars_held, {_R('tr')} AS trade_ret, {_R('mfe')} AS mfe, {_R('mae')} AS mae, {_R('CASE WHEN abs(entry - entry * 0.6) > 0.003 * entry THEN tr * entry / abs(entry - entry * 0.6) END')} AS r_multiple FROM tf""",
}
