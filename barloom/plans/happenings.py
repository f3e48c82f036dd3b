"""Queries on events and what followed them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as E
from ..sources import bars as B
from . import tables as T
from .tables import lag, roll, rounded, sql_bars

HS = [5, 10, 20]


def rally(spark: SparkSession, sf: str, rules: tuple[str, ...] = E.WINDOW_RULES) -> DataFrame:
    bars = T.bars_brand(spark, sf)
    return E.rally_events(bars, B.benchmark(bars), rules, HS)


def rally_narrow(spark: SparkSession, sf: str) -> DataFrame:
    """The event table that the studies use: a row for each event and horizon."""
    return E.narrow(rally(spark, sf), HS, ["rule", "symbol", "date", "bar_idx", "beaten", "ret_126", "volume_ratio", "day_ret", "year"])


def rally_rule_hits(spark: SparkSession, sf: str) -> DataFrame:
    return E.rally_hits(T.bars_brand(spark, sf)).select("symbol", "date", "rule")


def rally_events(spark: SparkSession, sf: str) -> DataFrame:
    cols = [f"{c}_{h}" for h in HS for c in ("ret", "bench", "local")]
    return rounded(rally(spark, sf).select("rule", "symbol", "date", "entry", "ret_126", "day_ret", "from_52w_high", "beaten", *cols), entry=9)


def rally_turn_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The two rules that need folds: the RSI's turn and the higher high."""
    return rounded(rally(spark, sf, ("rsi_turn", "higher_high")).select("rule", "symbol", "date", "ret_5", "ret_20"))


def rally_combined(spark: SparkSession, sf: str) -> DataFrame:
    return E.combined(rally(spark, sf)).select("symbol", "date", "rule", "confluence")


def forward_returns(spark: SparkSession, sf: str) -> DataFrame:
    """Forward, benchmark and random-entry returns of every bar as a pattern event would have them."""
    bars = T.bars_flag(spark, sf)
    rows = E.with_forward(E.align_benchmark(bars, B.benchmark(bars)), [5, 20], E.PATTERN)
    return rounded(rows.select("symbol", "bar_idx", *[f"{c}_{h}" for h in (5, 20) for c in ("ret", "bench", "local", "n_local")]))


def local_baseline_md5(spark: SparkSession, sf: str) -> DataFrame:
    bars = T.bars_brand(spark, sf)
    return rounded(E.hashed_baseline(rally(spark, sf).select("symbol", "bar_idx").distinct(), bars, 20))


def news_gap_events(spark: SparkSession, sf: str) -> DataFrame:
    bars = T.bars_flag(spark, sf)
    ev = E.news_gaps(B.densify(bars), B.benchmark(bars), [1, 5, 10, 20], times=1.8)
    return rounded(ev.select("symbol", "date", "direction", "gap", "volume_times", "ret_5", "bench_5", "local_5", "ret_20"))


def reversal_events(spark: SparkSession, sf: str) -> DataFrame:
    bars = T.bars_flag(spark, sf)
    ev = E.reversals(B.densify(bars), B.benchmark(bars))
    return rounded(ev.select("symbol", "date", "threshold", "direction", "z", "move", "ret_1", "ret_10", "bench_10", "local_10"))


def ma200_cross_events(spark: SparkSession, sf: str) -> DataFrame:
    bars = T.bars_brand(spark, sf)
    ev = E.ma200_cross_events(bars, B.benchmark(bars), 5)
    return rounded(ev.select("symbol", "date", F.col("bars_below").cast("int"), "entry", "day_ret", "ret_20", "ret_60", "local_60"), entry=9)


def doji_on_ma10(spark: SparkSession, sf: str) -> DataFrame:
    bars = T.bars_flag(spark, sf)
    ev = E.doji_events(bars, B.benchmark(bars))
    return rounded(ev.select("symbol", "date", "ret_1", "bench_1", "ret_5", "ret_21", "local_21"))


def base_events(spark: SparkSession, sf: str) -> DataFrame:
    """Bases of any width after a fall, for these bars swing too far for tight ones."""
    bars = T.bars_brand(spark, sf)
    wide = F.coalesce(F.col("beaten") & (F.col("base_range") <= 12.0), F.lit(False))
    ev = E.bases(bars, B.benchmark(bars), state=wide)
    return rounded(ev.select("symbol", "date", "base_volume", "ret_20", "ret_60", "up_20", "down_60"))


def dated_event_returns(spark: SparkSession, sf: str) -> DataFrame:
    """Order days of each nation's customers as events on the nation's bars."""
    bars = T.bars_nation(spark, sf).drop("sector")
    orders = T.read(spark, sf, "orders").join(T.read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(T.read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    ev = orders.select(F.col("n_name").alias("symbol"), F.to_date("o_orderdate").alias("event_date"))
    found = E.dated(ev, bars, B.benchmark(bars))
    return rounded(found.select("symbol", "event_date", "date", "ret_5", "bench_5", "local_5", "ret_60"))


QUERIES = {f.__name__: f for f in (
    rally_rule_hits, rally_events, rally_turn_rules, rally_combined, forward_returns, local_baseline_md5, news_gap_events, reversal_events,
    ma200_cross_events, doji_on_ma10, base_events, dated_event_returns,
)}

_R = lambda x, n=6: f"round({x}, {n}) + 0.0"


def sql_forward(table: str, hs: list[int], entry: str, entry_shift: int, exit_shift: int, bench: str, bench_shift: int, window: int, margin: int, anchor: int = 0, order: str = "bar_idx", name: str = "fw") -> str:
    """A CTE with what operators.events.with_forward adds; table must have bench_open and bench_close."""
    cols = []
    look = lambda x, k: lag(x, -k, order) if k else x
    for h in hs:
        cols.append(f"({look('close', h + exit_shift)}) / ({look(entry, entry_shift)}) - 1 AS ret_{h}")
        cols.append(f"({look('bench_close', h + exit_shift)}) / ({look(f'bench_{bench}', bench_shift)}) - 1 AS bench_{h}")
    cand = [f"CASE WHEN {order} + {anchor} >= 1 AND {order} + {anchor} <= last_at + 1 - {h} - {margin} THEN ret_{h} END AS cand_{h}" for h in hs]
    means = []
    for h in hs:
        a = f"OVER (PARTITION BY symbol ORDER BY {order} ROWS BETWEEN {window} PRECEDING AND {h + 1} PRECEDING)"
        b = f"OVER (PARTITION BY symbol ORDER BY {order} ROWS BETWEEN {h + 1} FOLLOWING AND {window} FOLLOWING)"
        n, s = f"(count(cand_{h}) {a} + count(cand_{h}) {b})", f"(coalesce(sum(cand_{h}) {a}, 0) + coalesce(sum(cand_{h}) {b}, 0))"
        means.append(f"CAST({n} AS INT) AS n_local_{h}, CASE WHEN {n} >= 5 THEN {s} / {n} END AS local_{h}")
    return f""", {name}0 AS (SELECT *, {look(entry, entry_shift)} AS entry, max({order}) OVER (PARTITION BY symbol) AS last_at, {', '.join(cols)} FROM {table}),
{name}1 AS (SELECT *, {', '.join(cand)} FROM {name}0), {name} AS MATERIALIZED (SELECT *, {', '.join(means)} FROM {name}1)"""


def sql_bench(table: str, name: str = "al") -> str:
    return f", {name} AS MATERIALIZED (SELECT x.*, bn.open AS bench_open, bn.close AS bench_close FROM {table} x LEFT JOIN bench bn ON bn.date = x.date)"


def sql_cooldown(table: str, keys: str, gap: int, at: str = "bar_idx", name: str = "kept") -> str:
    """A CTE of the rows of table that a cooldown keeps: each hit points to the next that may follow it."""
    on = " AND ".join(f"k.{c.strip()} = n.{c.strip()}" for c in keys.split(","))
    back = " AND ".join(f"k.{c.strip()} = x.{c.strip()}" for c in keys.split(","))
    return f""", {name}_d AS MATERIALIZED (SELECT DISTINCT {keys}, {at} FROM {table}), {name}_n AS MATERIALIZED (SELECT *, min({at}) OVER (PARTITION BY {keys} ORDER BY {at} RANGE BETWEEN {gap} FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt, min({at}) OVER (PARTITION BY {keys}) AS head FROM {name}_d),
{name}_k AS (SELECT {keys}, {at}, nxt FROM {name}_n WHERE {at} = head UNION ALL SELECT n.{keys.replace(',', ', n.')}, n.{at}, n.nxt FROM {name}_k k JOIN {name}_n n ON {on} AND n.{at} = k.nxt),
{name} AS MATERIALIZED (SELECT x.* FROM {table} x JOIN {name}_k k ON {back} AND x.{at} = k.{at})"""


_AV20 = roll("avg", "volume", 20, None, 1)
_HITS = f""", s0 AS (SELECT *, {roll('avg', 'close', 20)} AS ma20, {roll('avg', 'close', 50)} AS ma50, {lag('close')} AS c1, {lag('close', 10)} AS c10, {lag('close', 136)} AS c136, {roll('max', 'high', 60, None, 1)} AS hi60, {roll('max', 'close', 252, None, 1)} AS hi252,
{_AV20} AS av20, {roll('min', 'low', 60, None, 10)} AS lo60 FROM {{table}}),
s1 AS (SELECT *, coalesce(close < ma50, false)::INT AS below, coalesce(ma20 < ma50, false)::INT AS under FROM s0),
s2 AS (SELECT *, {roll('sum', 'below', 20, None, 1)} AS below20, {roll('sum', 'under', 20, None, 1)} AS under20, {lag('ma50')} AS ma50_1, {lag('ma20')} AS ma20_1, {lag('hi60')} AS hi60_1 FROM s1),
hits AS MATERIALIZED (SELECT *, 'ma50_cross' AS rule FROM s2 WHERE bar_idx >= 260 AND close > ma50 AND c1 <= ma50_1 AND below20 >= 15 AND close > c1
UNION ALL SELECT *, 'golden_20_50' FROM s2 WHERE bar_idx >= 260 AND ma20 > ma50 AND ma20_1 <= ma50_1 AND under20 >= 20
UNION ALL SELECT *, 'base_breakout' FROM s2 WHERE bar_idx >= 260 AND close > hi60 AND NOT coalesce(c1 > hi60_1, false) AND c1 <= 0.90 * hi252 AND volume >= 1.5 * av20
UNION ALL SELECT *, 'thrust' FROM s2 WHERE bar_idx >= 260 AND close / c10 - 1 >= 0.08 AND close > c1 AND c10 / c136 - 1 <= 0 AND c10 <= 1.05 * lo60)"""
_MA200, _R126 = roll("avg", "close", 200), f"close / ({lag('close', 126)}) - 1"
_RICH = f""", rich AS MATERIALIZED (SELECT *, coalesce(close < ({_MA200}) AND {_R126} < -0.08, false) AS beaten, {_R126} AS ret_126, close / ({lag('close')}) - 1 AS day_ret, close / ({roll('max', 'close', 252)}) - 1 AS from_52w_high,
CASE WHEN volume > 0 THEN volume / (avg(CASE WHEN volume > 0 THEN volume END) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) END AS volume_ratio FROM fw)"""
NEXT_OPEN = ("open", 1, 0, "close", 1, 126, 3)
#: Everything up to `ev`, the rally events, as rally() gives them.
SQL_RALLY = sql_bars("brand", bench=True) + sql_bench("bars") + sql_forward("al", HS, *NEXT_OPEN) + _RICH + _HITS.replace("{table}", "rich") + ", room AS MATERIALIZED (SELECT * FROM hits WHERE bar_idx + 21 < last_at + 1)" + sql_cooldown("room", "symbol, rule", 20) + ", ev AS MATERIALIZED (SELECT *, year(date) AS year FROM kept WHERE entry > 0)"
#: And its narrow form, `nv`.
SQL_NARROW = SQL_RALLY + ", nv AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT rule, symbol, date, bar_idx, beaten, ret_126, volume_ratio, day_ret, year, {h} AS h, ret_{h} AS ret, ret_{h} - bench_{h} AS xbench, ret_{h} - local_{h} AS xlocal FROM ev" for h in HS) + ")"

#: The bases of base_events, `kept`.
BASES = f""", bb AS (SELECT *, coalesce(close < ({_MA200}) AND {_R126} < -0.08, false) AS beaten, {roll('max', 'close', 15)} AS h15, {roll('min', 'close', 15)} AS l15, {roll('avg', 'close', 15)} AS m15, ({roll('avg', 'volume', 15)}) / ({roll('avg', 'volume', 45, 30, 15)}) AS bv, {lag('close', -20)} AS c20, {lag('close', -60)} AS c60 FROM fw),
hit AS MATERIALIZED (SELECT * FROM bb WHERE beaten AND (h15 - l15) / m15 <= 12.0 AND bar_idx + 61 < last_at + 1 AND bar_idx >= 260 AND bv IS NOT NULL)""" + sql_cooldown("hit", "symbol", 30)
_DOJI = f""", m0 AS (SELECT *, {roll('avg', 'close', 10)} AS ma10 FROM fw), dj AS MATERIALIZED (SELECT * FROM m0 WHERE high - low > 0 AND high - low >= 0.01 * close AND abs(close - open) <= 0.1 * (high - low) AND ma10 BETWEEN low AND high AND bar_idx + 21 < last_at + 1 AND bar_idx >= 55)"""
_RUNS = """, mk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn, close <= ma AS f FROM mm),
rs AS (SELECT *, CASE WHEN f THEN rn - coalesce(max(CASE WHEN NOT coalesce(f, false) THEN rn END) OVER (PARTITION BY symbol ORDER BY date), 0) ELSE 0 END AS run FROM mk)"""

_TURNS = f""", dx AS (SELECT symbol, bar_idx, close - ({lag('close')}) AS step FROM bars), wk AS (SELECT symbol, bar_idx, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down FROM dx WHERE bar_idx = 0
UNION ALL SELECT d.symbol, d.bar_idx, wk.up * (1 - 1.0::DOUBLE / 14) + greatest(step, 0) / 14, wk.down * (1 - 1.0::DOUBLE / 14) + greatest(-step, 0) / 14 FROM wk JOIN dx d ON d.symbol = wk.symbol AND d.bar_idx = wk.bar_idx + 1),
ri AS (SELECT symbol, bar_idx, CASE WHEN down <> 0 THEN 100 - 100 / (1 + up / down) END AS rsi FROM wk), rj AS (SELECT *, {lag('rsi', 1, 'bar_idx')} AS rsi_1, {roll('min', 'rsi', 20, None, 1, 'bar_idx')} AS rsi20 FROM ri),
hb AS (SELECT symbol, bar_idx AS t, close, arg_min(bar_idx, (low, bar_idx)) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 120 PRECEDING AND 11 PRECEDING) AS base FROM bars), tp AS (SELECT symbol, bar_idx, low, {roll('max', 'close', 252, None, 0, 'bar_idx')} AS top FROM bars),
hc AS (SELECT hb.*, tp.low AS bl FROM hb JOIN tp ON tp.symbol = hb.symbol AND tp.bar_idx = hb.base WHERE t >= 260 AND tp.low <= 0.85 * tp.top AND t - 3 > base + 5), hp AS (SELECT hc.symbol, t, hc.close AS c, bl, arg_min(b.bar_idx, (-b.high, b.bar_idx)) AS peak, max(b.high) AS level FROM hc JOIN bars b ON b.symbol = hc.symbol AND b.bar_idx BETWEEN base + 5 AND t - 4 GROUP BY hc.symbol, t, hc.close, bl),
hh AS (SELECT hp.symbol, t FROM hp JOIN bars b ON b.symbol = hp.symbol AND b.bar_idx BETWEEN peak + 1 AND t - 1 GROUP BY hp.symbol, t, c, bl, level HAVING min(b.low) > 1.02 * bl AND max(b.close) <= level AND c > level),
hits AS MATERIALIZED (SELECT rich.*, 'rsi_turn' AS rule FROM rich JOIN rj ON rj.symbol = rich.symbol AND rj.bar_idx = rich.bar_idx WHERE rich.bar_idx >= 260 AND rsi > 50 AND rsi_1 <= 50 AND rsi20 < 35 UNION ALL SELECT rich.*, 'higher_high' FROM rich JOIN hh ON hh.symbol = rich.symbol AND hh.t = rich.bar_idx)"""

ORACLES = {
    "rally_turn_rules": sql_bars("brand", bench=True) + sql_bench("bars") + sql_forward("al", HS, *NEXT_OPEN) + _RICH + _TURNS + ", room AS MATERIALIZED (SELECT * FROM hits WHERE bar_idx + 21 < last_at + 1)" + sql_cooldown("room", "symbol, rule", 20) + f" SELECT rule, symbol, date, {_R('ret_5')} AS ret_5, {_R('ret_20')} AS ret_20 FROM kept WHERE entry > 0",
    "rally_rule_hits": sql_bars("brand") + _HITS.replace("{table}", "bars") + " SELECT symbol, date, rule FROM hits",
    "rally_events": SQL_RALLY + " SELECT rule, symbol, date, " + f"{_R("entry", 9)} AS entry, {_R('ret_126')} AS ret_126, {_R('day_ret')} AS day_ret, {_R('from_52w_high')} AS from_52w_high, beaten, " + ", ".join(f"{_R(f'{c}_{h}')} AS {c}_{h}" for h in HS for c in ("ret", "bench", "local")) + " FROM ev",
    "rally_combined": SQL_RALLY + """, cb AS (SELECT *, date - DATE '1970-01-01' AS day FROM ev WHERE beaten), cf AS (SELECT a.symbol, a.date, a.day, count(DISTINCT b.rule) AS confluence, min(a.rule) AS rule FROM cb a JOIN cb b ON b.symbol = a.symbol AND b.day BETWEEN a.day - 8 AND a.day GROUP BY ALL)""" + sql_cooldown("cf", "symbol", 30, "day", "cbk") + " SELECT symbol, date, rule, CAST(confluence AS INT) AS confluence FROM cbk",
    "forward_returns": sql_bars("flag", bench=True) + sql_bench("bars") + sql_forward("al", [5, 20], "open", 1, 0, "open", 1, 126, 0, 1) + " SELECT symbol, CAST(bar_idx AS INT) AS bar_idx, " + ", ".join(f"{_R(f'{c}_{h}')} AS {c}_{h}" for h in (5, 20) for c in ("ret", "bench", "local")) + ", n_local_5, n_local_20 FROM fw",
    "local_baseline_md5": SQL_RALLY + """, cd AS (SELECT symbol, bar_idx, unnest(range(greatest(1, bar_idx - 126), least(last_at + 1 - 20 - 3, bar_idx + 126) + 1)) AS c FROM (SELECT DISTINCT symbol, bar_idx, last_at FROM ev)),
cr AS (SELECT *, count(*) OVER (PARTITION BY symbol, bar_idx) AS n, row_number() OVER (PARTITION BY symbol, bar_idx ORDER BY md5(concat_ws('|', '1', symbol, CAST(bar_idx AS VARCHAR), '20', CAST(c AS VARCHAR)))) AS rk FROM cd WHERE abs(c - bar_idx) > 20)
""" + f"SELECT cr.symbol, CAST(cr.bar_idx AS INT) AS bar_idx, {_R('avg(fw.ret_20)')} AS local, count(*) AS draws FROM cr JOIN fw ON fw.symbol = cr.symbol AND fw.bar_idx = cr.c WHERE n >= 5 AND rk <= 10 GROUP BY cr.symbol, cr.bar_idx",
    "news_gap_events": sql_bars("flag", bench=True, dense=True) + sql_bench("dense") + sql_forward("al", [1, 5, 10, 20], "close", 0, 0, "close", 0, 126, 2, 0, "t") + f""", g AS (SELECT *, open / ({lag('close', 1, 't')}) - 1 AS gap, {roll('avg', 'volume', 20, None, 1, 't')} AS av FROM fw), hit AS MATERIALIZED (SELECT * FROM g WHERE abs(gap) >= 0.04 AND volume >= 1.8 * av AND t + 20 < last_at + 1 AND t >= 260)""" + sql_cooldown("hit", "symbol", 5, "t") + f" SELECT symbol, date, CASE WHEN gap > 0 THEN 1 ELSE -1 END AS direction, {_R('gap')} AS gap, {_R('volume / av')} AS volume_times, {_R('ret_5')} AS ret_5, {_R('bench_5')} AS bench_5, {_R('local_5')} AS local_5, {_R('ret_20')} AS ret_20 FROM kept",
    "reversal_events": sql_bars("flag", bench=True, dense=True) + sql_bench("dense") + sql_forward("al", [1, 2, 3, 5, 10], "open", 1, 0, "close", 1, 126, 1, 1, "t") + f""", g0 AS (SELECT *, close / ({lag('close', 1, 't')}) - 1 AS move, {lag('open', -1, 't')} AS nopen FROM fw), g AS (SELECT *, move / nullif({roll('stddev_samp', 'move', 60, 40, 1, 't')}, 0) AS z FROM g0),
hit AS MATERIALIZED (SELECT g.*, threshold, direction FROM g, (VALUES (2.0::DOUBLE), (2.5), (3.0)) th(threshold), (VALUES (1), (-1)) dr(direction) WHERE z * -direction >= threshold AND open IS NOT NULL AND nopen IS NOT NULL AND t + 11 < last_at + 1)""" + sql_cooldown("hit", "symbol, threshold, direction", 3, "t").replace("JOIN kept_k k ON k.symbol = x.symbol AND k.threshold", "JOIN kept_k k ON k.symbol = x.symbol AND k.threshold") + f" SELECT symbol, date, CAST(threshold AS DOUBLE) AS threshold, direction, {_R('z')} AS z, {_R('move')} AS move, {_R('ret_1')} AS ret_1, {_R('ret_10')} AS ret_10, {_R('bench_10')} AS bench_10, {_R('local_10')} AS local_10 FROM kept",
    "ma200_cross_events": sql_bars("brand", bench=True) + sql_bench("bars") + sql_forward("al", [20, 60], *NEXT_OPEN) + f", mm AS (SELECT *, {_MA200} AS ma, close / ({lag('close')}) - 1 AS day_ret FROM fw)" + _RUNS + f", cc AS (SELECT *, {lag('run')} AS before FROM rs), hit AS MATERIALIZED (SELECT * FROM cc WHERE close > ma AND before >= 5 AND bar_idx + 61 < last_at + 1)" + sql_cooldown("hit", "symbol", 20) + f" SELECT symbol, date, CAST(before AS INT) AS bars_below, {_R("entry", 9)} AS entry, {_R('day_ret')} AS day_ret, {_R('ret_20')} AS ret_20, {_R('ret_60')} AS ret_60, {_R('local_60')} AS local_60 FROM kept WHERE entry > 0",
    "doji_on_ma10": sql_bars("flag", bench=True) + sql_bench("bars") + sql_forward("al", [1, 5, 21], "close", 0, 0, "close", 0, 63, 1) + _DOJI + sql_cooldown("dj", "symbol", 5) + f" SELECT symbol, date, {_R('ret_1')} AS ret_1, {_R('bench_1')} AS bench_1, {_R('ret_5')} AS ret_5, {_R('ret_21')} AS ret_21, {_R('local_21')} AS local_21 FROM kept",
    "base_events": sql_bars("brand", bench=True) + sql_bench("bars") + sql_forward("al", [20, 60], *NEXT_OPEN) + BASES + f" SELECT symbol, date, {_R('bv')} AS base_volume, {_R('ret_20')} AS ret_20, {_R('ret_60')} AS ret_60, c20 > h15 AS up_20, c60 < l15 AS down_60 FROM kept WHERE entry > 0",
    "dated_event_returns": sql_bars("nation", bench=True) + sql_bench("bars") + sql_forward("al", [5, 20, 60], "open", 0, -1, "close", 0, 126, 1) + f""", oe AS (SELECT DISTINCT n_name AS symbol, CAST(o_orderdate AS DATE) AS event_date FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
ja AS (SELECT oe.symbol, oe.event_date, fw.* EXCLUDE (symbol) FROM oe ASOF JOIN fw ON oe.symbol = fw.symbol AND oe.event_date < fw.date)
SELECT symbol, event_date, date, {_R('ret_5')} AS ret_5, {_R('bench_5')} AS bench_5, {_R('local_5')} AS local_5, {_R('ret_60')} AS ret_60 FROM ja WHERE bar_idx >= 210 AND bar_idx + 60 < last_at + 1""",
}
