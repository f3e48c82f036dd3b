"""Queries on bars and indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import indicators as I
from ..sources import bars as B
from . import tables as T
from .tables import lag, roll, rounded, sql_bars


def bars_daily(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.bars_brand(spark, sf), 9)


def bars_weekly(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.weekly(T.bars_flag(spark, sf)), 9)


def benchmark_bars(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.benchmark(T.bars_brand(spark, sf)).drop("symbol"), 4)


def panel_dense(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.densify(T.bars_nation(spark, sf).drop("sector")).select("symbol", "t", "date", "close"), 9)


def panel_ffill(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.densify(T.bars_nation(spark, sf).drop("sector"), fill=True).select("symbol", "t", "open", "close"), 9)


def sma_strict(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(I.with_sma(T.bars_brand(spark, sf), 20, 50, 200).select("symbol", "date", "sma20", "sma50", "sma200"), 4)


def rolling_extremes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(I.with_extremes(T.bars_brand(spark, sf), 60).select("symbol", "date", "high60", "low60"), 9)


def atr14(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(I.with_atr(T.bars_brand(spark, sf)).select("symbol", "date", "atr"), 4)


def volume_ratio20(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(I.with_volume_ratio(T.bars_brand(spark, sf)).select("symbol", "date", "volume_ratio"))


def context_126_200(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(I.with_context(T.bars_brand(spark, sf)).select("symbol", "date", "ret_126", "ma200_distance", "atr_pct", "ma200_bars"))


def beaten_mask(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(I.with_beaten(T.bars_brand(spark, sf)).where("beaten").select("symbol", "date", "ret_126"))


def rsi_wilder(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(I.with_rsi(T.bars_flag(spark, sf)).select("symbol", "bar_idx", "rsi"), 4)


def run_below_ma200(spark: SparkSession, sf: str) -> DataFrame:
    return I.with_run_below(T.bars_brand(spark, sf)).select("symbol", "date", F.col("run_below").cast("int"))


def ma200_crosses(spark: SparkSession, sf: str) -> DataFrame:
    return I.ma200_crosses(T.bars_brand(spark, sf), 5).select("symbol", "date", F.col("bars_below").cast("int"))


def lowday_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(I.with_low_day_ratio(T.bars_brand(spark, sf)).select("symbol", "date", "low_day_ratio"))


def volume_context(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["five_ratio", "climax10", "up_share", "base_range", "base_volume"]
    return rounded(I.with_volume_context(T.bars_brand(spark, sf)).select("symbol", "date", *cols, "base"))


def regime_stats(spark: SparkSession, sf: str) -> DataFrame:
    bars = T.bars_nation(spark, sf).drop("sector")
    return rounded(I.regime(B.densify(bars, fill=True), B.benchmark(bars)))


def panel_context_sector(spark: SparkSession, sf: str) -> DataFrame:
    bars = T.bars_nation(spark, sf)
    sector = bars.select("symbol", "sector").distinct()
    dense = B.densify(bars.drop("sector")).join(sector, "symbol")
    return rounded(I.panel_context(dense).select("symbol", "t", "basket20", "breadth50", "sector_r20", "sector_r60"))


def doji_days(spark: SparkSession, sf: str) -> DataFrame:
    """Every candle's doji and mean-line state with what came before it."""
    rows = I.with_trend_before(T.bars_flag(spark, sf), 13, 26, 52).withColumn("doji", F.coalesce(I.doji(), F.lit(False)))
    return rounded(rows.select("symbol", "date", "doji", "on_ma10", "ret_q", "ret_h", "from_high", F.col("down_run").cast("int"), F.col("ma_down_run").cast("int")))


QUERIES = {f.__name__: f for f in (
    bars_daily, bars_weekly, benchmark_bars, panel_dense, panel_ffill, sma_strict, rolling_extremes, atr14, volume_ratio20, context_126_200, beaten_mask,
    rsi_wilder, run_below_ma200, ma200_crosses, lowday_ratio, volume_context, regime_stats, panel_context_sector, doji_days,
)}

_R = lambda x, n=6: f"round({x}, {n}) + 0.0"
_MA200, _R126 = roll("avg", "close", 200), f"close / ({lag('close', 126)}) - 1"
_BEATEN = f"coalesce(close < ({_MA200}) AND {_R126} < -0.08, false)"
_RUN = """, marked AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn, {flag} AS f FROM {table}),
runs AS (SELECT *, CASE WHEN f THEN rn - coalesce(max(CASE WHEN NOT coalesce(f, false) THEN rn END) OVER (PARTITION BY symbol ORDER BY date), 0) ELSE 0 END AS run FROM marked)"""

ORACLES = {
    "bars_daily": sql_bars("brand") + f" SELECT symbol, date, CAST(bar_idx AS INT) AS bar_idx, {_R('open', 9)} AS open, {_R('high', 9)} AS high, {_R('low', 9)} AS low, {_R('close', 9)} AS close, {_R('volume', 9)} AS volume FROM bars",
    "bars_weekly": sql_bars("flag") + f""", w AS (SELECT *, date + CAST((12 - CAST(isodow(date) AS INT)) % 7 AS INT) AS week, max(date) OVER (PARTITION BY symbol) AS final FROM bars),
g AS (SELECT symbol, week, final, first(open ORDER BY date) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY date) AS close, sum(volume) AS volume, count(*) AS n FROM w GROUP BY ALL)
SELECT symbol, CAST(week AS DATE) AS date, {_R('open', 9)} AS open, {_R('high', 9)} AS high, {_R('low', 9)} AS low, {_R('close', 9)} AS close, {_R('volume', 9)} AS volume, CAST(row_number() OVER (PARTITION BY symbol ORDER BY week) - 1 AS INT) AS bar_idx
FROM g WHERE n >= 3 AND NOT (week >= final AND isodow(final) < 5)""",
    "benchmark_bars": sql_bars("brand", bench=True) + f" SELECT date, {_R('open', 4)} AS open, {_R('high', 4)} AS high, {_R('low', 4)} AS low, {_R('close', 4)} AS close, {_R('volume', 4)} AS volume, CAST(row_number() OVER (ORDER BY date) - 1 AS INT) AS bar_idx FROM bench",
    "panel_dense": sql_bars("nation", dense=True) + f" SELECT symbol, CAST(t AS INT) AS t, date, {_R('close', 9)} AS close FROM dense",
    "panel_ffill": sql_bars("nation", dense=True) + f" SELECT symbol, CAST(t AS INT) AS t, {_R('last_value(open IGNORE NULLS) OVER w', 9)} AS open, {_R('last_value(close IGNORE NULLS) OVER w', 9)} AS close FROM dense WINDOW w AS (PARTITION BY symbol ORDER BY t)",
    "rolling_extremes": sql_bars("brand") + f" SELECT symbol, date, {_R(roll('max', 'high', 60), 9)} AS high60, {_R(roll('min', 'low', 60), 9)} AS low60 FROM bars",
    "atr14": sql_bars("brand") + f""", r AS (SELECT symbol, date, greatest(high - low, abs(high - coalesce({lag('close')}, close)), abs(low - coalesce({lag('close')}, close))) AS tr FROM bars)
SELECT symbol, date, {_R('avg(tr) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)', 4)} AS atr FROM r""",
    "volume_ratio20": sql_bars("brand") + f" SELECT symbol, date, {_R('CASE WHEN volume > 0 THEN volume / (avg(CASE WHEN volume > 0 THEN volume END) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) END')} AS volume_ratio FROM bars",
    "context_126_200": sql_bars("brand") + f""", r AS (SELECT *, greatest(high - low, abs(high - coalesce({lag('close')}, close)), abs(low - coalesce({lag('close')}, close))) AS tr FROM bars)
SELECT symbol, date, {_R(f"close / coalesce({lag('close', 126)}, first(close) OVER (PARTITION BY symbol ORDER BY date)) - 1")} AS ret_126,
{_R('close / (avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)) - 1')} AS ma200_distance,
{_R('(avg(tr) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)) / close')} AS atr_pct, least(count(*) OVER (PARTITION BY symbol ORDER BY date), 200) AS ma200_bars FROM r""",
    "beaten_mask": sql_bars("brand") + f", s AS (SELECT symbol, date, {_R126} AS ret_126, {_BEATEN} AS beaten FROM bars) SELECT symbol, date, {_R('ret_126')} AS ret_126 FROM s WHERE beaten",
    "rsi_wilder": sql_bars("flag") + f""", d AS (SELECT symbol, bar_idx, close - ({lag('close')}) AS step FROM bars),
walk AS (SELECT symbol, bar_idx, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down FROM d WHERE bar_idx = 0
UNION ALL SELECT d.symbol, d.bar_idx, walk.up * (1 - 1.0::DOUBLE / 14) + greatest(step, 0) / 14, walk.down * (1 - 1.0::DOUBLE / 14) + greatest(-step, 0) / 14 FROM walk JOIN d ON d.symbol = walk.symbol AND d.bar_idx = walk.bar_idx + 1)
SELECT symbol, CAST(bar_idx AS INT) AS bar_idx, {_R('CASE WHEN down <> 0 THEN 100 - 100 / (1 + up / down) END', 4)} AS rsi FROM walk""",
    "run_below_ma200": sql_bars("brand") + f", m AS (SELECT *, {_MA200} AS ma FROM bars)" + _RUN.format(flag="close <= ma", table="m") + " SELECT symbol, date, CAST(run AS INT) AS run_below FROM runs",
    "ma200_crosses": sql_bars("brand") + f", m AS (SELECT *, {_MA200} AS ma FROM bars)" + _RUN.format(flag="close <= ma", table="m") + f", c AS (SELECT *, {lag('run')} AS before FROM runs) SELECT symbol, date, CAST(before AS INT) AS bars_below FROM c WHERE close > ma AND before >= 5",
    "lowday_ratio": sql_bars("brand") + f""", r AS (SELECT *, volume / ({roll('avg', 'volume', 20, 15, 1)}) AS ratio FROM bars),
l AS (SELECT r.symbol, r.date, r.bar_idx, (SELECT x.ratio FROM r x WHERE x.symbol = r.symbol AND x.bar_idx BETWEEN r.bar_idx - 19 AND r.bar_idx ORDER BY x.close, x.bar_idx LIMIT 1) AS low_ratio FROM r)
SELECT symbol, date, {_R('CASE WHEN bar_idx >= 19 THEN low_ratio END')} AS low_day_ratio FROM l""",
    "volume_context": sql_bars("brand") + f""", a AS (SELECT *, {roll('avg', 'volume', 20, 15, 1)} AS a20, {roll('avg', 'volume', 60, 40, 1)} AS a60, {roll('avg', 'volume', 5)} AS v5, CASE WHEN close > ({lag('close')}) THEN volume ELSE 0.0 END AS upv,
{roll('max', 'close', 15)} AS h15, {roll('min', 'close', 15)} AS l15, {roll('avg', 'close', 15)} AS m15, {_BEATEN} AS beaten, {roll('avg', 'volume', 15)} AS v15, {roll('avg', 'volume', 45, 30, 15)} AS v45, ({roll('min', 'close', 10)}) > ({roll('min', 'close', 30, None, 10)}) AS lb FROM bars),
b AS (SELECT *, volume / a60 AS to60 FROM a)
SELECT symbol, date, {_R('v5 / a20')} AS five_ratio, {_R(roll('max', 'to60', 10, 5))} AS climax10, {_R(f"({roll('sum', 'upv', 10, 8)}) / ({roll('sum', 'volume', 10, 8)})")} AS up_share, {_R('(h15 - l15) / m15')} AS base_range, {_R('v15 / v45')} AS base_volume,
coalesce(beaten AND (h15 - l15) / m15 <= 0.10 AND lb, false) AS base FROM b""",
    "regime_stats": sql_bars("nation", bench=True, dense=True) + f""", f AS (SELECT symbol, t, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t) AS close FROM dense),
s AS (SELECT *, {roll('avg', 'close', 50, order='t')} AS ma50, coalesce(close < ({roll('avg', 'close', 200, order='t')}) AND close / ({lag('close', 126, 't')}) - 1 < -0.08, false) AS beaten FROM f),
u AS (SELECT *, close > ma50 AS over50, {lag('beaten', 10, 't')} AS b10, {lag('beaten', 20, 't')} AS b20, close / ({lag('close', 10, 't')}) - 1 AS r10, close / ({lag('close', 20, 't')}) - 1 AS r20 FROM s),
v AS (SELECT *, {lag('over50', 20, 't')} AS over50_20 FROM u),
e AS (SELECT avg(CASE WHEN b10 THEN r10 END) AS k10, avg(CASE WHEN b20 THEN r20 END) AS k20, avg(over50::INT) AS br, avg(over50_20::INT) AS brb, avg(beaten::INT) AS bs FROM v WHERE t = (SELECT max(t) FROM v)),
bm AS (SELECT date, close, CASE WHEN count(*) OVER (ORDER BY date ROWS 49 PRECEDING) >= 50 THEN avg(close) OVER (ORDER BY date ROWS 49 PRECEDING) END AS m50, CASE WHEN count(*) OVER (ORDER BY date ROWS 199 PRECEDING) >= 200 THEN avg(close) OVER (ORDER BY date ROWS 199 PRECEDING) END AS m200 FROM bench)
SELECT {_R('k10')} AS basket_10, {_R('k20')} AS basket_20, {_R('br')} AS breadth50, {_R('brb')} AS breadth50_before, {_R('bs')} AS beaten_share, close > m50 AS bench_over_ma50, close > m200 AS bench_over_ma200, coalesce(k20 < -0.03, false) AS warning
FROM e, bm WHERE bm.date = (SELECT max(date) FROM bench)""",
    "panel_context_sector": sql_bars("nation", dense=True) + f""", s AS (SELECT *, {roll('avg', 'close', 50, order='t')} AS ma50, close / ({lag('close', 20, 't')}) - 1 AS r20, close / ({lag('close', 60, 't')}) - 1 AS r60,
coalesce(close < ({roll('avg', 'close', 200, order='t')}) AND close / ({lag('close', 126, 't')}) - 1 < -0.08, false) AS beaten FROM dense), u AS (SELECT *, {lag('beaten', 20, 't')} AS b20 FROM s)
SELECT symbol, CAST(t AS INT) AS t, {_R('avg(CASE WHEN b20 THEN r20 END) OVER (PARTITION BY t)')} AS basket20, {_R('avg(CASE WHEN close IS NOT NULL AND ma50 IS NOT NULL THEN (close > ma50)::INT END) OVER (PARTITION BY t)')} AS breadth50,
{_R('avg(r20) OVER (PARTITION BY t, sector)')} AS sector_r20, {_R('avg(r60) OVER (PARTITION BY t, sector)')} AS sector_r60 FROM u""",
    "doji_days": sql_bars("flag") + f""", m AS (SELECT *, {roll('avg', 'close', 10)} AS ma10 FROM bars), n AS (SELECT *, close < ({lag('close')}) AS down, ma10 < ({lag('ma10')}) AS mdown, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM m),
r AS (SELECT *, CASE WHEN down AND rn > 1 THEN rn - coalesce(max(CASE WHEN NOT (coalesce(down, false) AND rn > 1) THEN rn END) OVER w, 0) ELSE 0 END AS dr, CASE WHEN mdown AND rn > 1 THEN rn - coalesce(max(CASE WHEN NOT (coalesce(mdown, false) AND rn > 1) THEN rn END) OVER w, 0) ELSE 0 END AS mr FROM n WINDOW w AS (PARTITION BY symbol ORDER BY date))
SELECT symbol, date, (high - low > 0 AND high - low >= 0.01 * close AND abs(close - open) <= 0.1 * (high - low)) AS doji, coalesce(ma10 BETWEEN low AND high, false) AS on_ma10, {_R(f"close / ({lag('close', 13)}) - 1")} AS ret_q, {_R(f"close / ({lag('close', 26)}) - 1")} AS ret_h,
{_R(f"close / ({roll('max', 'close', 52, 20)}) - 1")} AS from_high, CAST(coalesce({lag('dr')}, 0) AS INT) AS down_run, CAST(mr AS INT) AS ma_down_run FROM r""",
}
ORACLES["sma_strict"] = sql_bars("brand") + " SELECT symbol, date, " + ", ".join(f"{_R(roll('avg', 'close', n), 4)} AS sma{n}" for n in (20, 50, 200)) + " FROM bars"
