"""Indicators: every function takes bars and returns them with more columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frames import change, own, rolling, run_length, shift


def true_range() -> Column:
    before = F.coalesce(shift("close"), F.col("close"))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def with_atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """Mean true range of up to n bars; the first bars have shorter means."""
    return bars.withColumn("tr", true_range()).withColumn("atr", F.avg("tr").over(own().rowsBetween(-(n - 1), 0))).drop("tr")


def with_sma(bars: DataFrame, *lengths: int) -> DataFrame:
    return bars.withColumns({f"sma{n}": rolling("close", n) for n in lengths})


def with_extremes(bars: DataFrame, n: int) -> DataFrame:
    return bars.withColumns({f"high{n}": rolling("high", n, F.max), f"low{n}": rolling("low", n, F.min)})


def with_volume_ratio(bars: DataFrame, n: int = 20) -> DataFrame:
    """Volume over the mean of the positive ones among the n bars before."""
    base = F.avg(F.when(F.col("volume") > 0, F.col("volume"))).over(own().rowsBetween(-n, -1))
    return bars.withColumn("volume_ratio", F.when(F.col("volume") > 0, F.try_divide(F.col("volume"), base)))


def with_context(bars: DataFrame) -> DataFrame:
    """126-bar return and distance from the 200-bar mean, both over shorter spans where there is less, and how many bars there are."""
    so_far = own().rowsBetween(Window.unboundedPreceding, 0)
    start = F.coalesce(shift("close", 126), F.first("close").over(so_far))
    mean = F.avg("close").over(own().rowsBetween(-199, 0))
    return with_atr(bars).withColumns({
        "ret_126": F.try_divide(F.col("close"), start) - 1, "ma200_distance": F.try_divide(F.col("close"), mean) - 1,
        "atr_pct": F.try_divide(F.col("atr"), F.col("close")), "ma200_bars": F.least(F.count("*").over(so_far), F.lit(200)),
    })


def with_beaten(bars: DataFrame) -> DataFrame:
    """Below the 200-bar mean and down more than 8 % in 126 bars."""
    state = bars.withColumns({"ma200": rolling("close", 200), "ret_126": change("close", 126)})
    return state.withColumn("beaten", F.coalesce((F.col("close") < F.col("ma200")) & (F.col("ret_126") < -0.08), F.lit(False)))


def with_run_below(bars: DataFrame) -> DataFrame:
    """Bars in a row at or below the 200-bar mean."""
    return bars.withColumn("ma200", rolling("close", 200)).withColumn("run_below", run_length(F.col("close") <= F.col("ma200")))


def ma200_crosses(bars: DataFrame, least_below: int = 60) -> DataFrame:
    """Bars that close above the mean after least_below or more bars at or below it."""
    state = with_run_below(bars).withColumn("bars_below", shift("run_below"))
    return state.where((F.col("close") > F.col("ma200")) & (F.col("bars_below") >= least_below)).drop("run_below")


def with_low_day_ratio(bars: DataFrame, n: int = 20) -> DataFrame:
    """Volume ratio on the day of the lowest close of the last n bars, the earliest of equals."""
    day = F.try_divide(F.col("volume"), rolling("volume", 20, least=15, lag=1))
    frame = own().rowsBetween(-(n - 1), 0)
    lowest = F.min_by(F.struct(F.col("day_ratio").alias("r")), F.struct("close", "bar_idx")).over(frame)["r"]
    return bars.withColumn("day_ratio", day).withColumn("low_day_ratio", F.when(F.count("close").over(frame) == n, lowest))


def with_volume_context(bars: DataFrame) -> DataFrame:
    """Volume of the day, of five days, its climax in ten, its share on up days, and tight ranges after a fall."""
    average = {"avg20": rolling("volume", 20, least=15, lag=1), "avg60": rolling("volume", 60, least=40, lag=1)}
    step = with_beaten(with_low_day_ratio(bars)).withColumns(average).withColumns({
        "five_ratio": F.try_divide(rolling("volume", 5), F.col("avg20")), "to60": F.try_divide(F.col("volume"), F.col("avg60")),
        "up_volume": F.when(F.col("close") > shift("close"), F.col("volume")).otherwise(0.0),
        "high15": rolling("close", 15, F.max), "low15": rolling("close", 15, F.min), "mean15": rolling("close", 15),
    })
    step = step.withColumns({
        "climax10": rolling("to60", 10, F.max, least=5), "up_share": F.try_divide(rolling("up_volume", 10, F.sum, least=8), rolling("volume", 10, F.sum, least=8)),
        "base_range": F.try_divide(F.col("high15") - F.col("low15"), F.col("mean15")),
        "base_volume": F.try_divide(rolling("volume", 15), rolling("volume", 45, least=30, lag=15)),
        "low_before": rolling("close", 10, F.min) > rolling("close", 30, F.min, lag=10),
    })
    base = F.col("beaten") & (F.col("base_range") <= 0.10) & F.col("low_before")
    return step.withColumn("base", F.coalesce(base, F.lit(False))).drop("avg20", "avg60", "to60", "up_volume", "mean15", "low_before")


def doji(body: float = 0.1, least_range: float = 0.01) -> Column:
    """A small body in a range worth looking at."""
    span = F.col("high") - F.col("low")
    return (span > 0) & (span >= least_range * F.col("close")) & (F.abs(F.col("close") - F.col("open")) <= body * span)


def with_ma10(bars: DataFrame, strict: float | None = None) -> DataFrame:
    """The 10-bar mean, and whether it lies inside the candle (and near its middle, with strict)."""
    state = bars.withColumn("ma10", rolling("close", 10))
    inside = (F.col("ma10") >= F.col("low")) & (F.col("ma10") <= F.col("high"))
    if strict is not None:
        inside = inside & (F.abs(F.col("ma10") - (F.col("open") + F.col("close")) / 2) <= strict * F.col("close"))
    return state.withColumn("on_ma10", F.coalesce(inside, F.lit(False)))


def with_trend_before(bars: DataFrame, quarter: int = 63, half: int = 126, year: int = 252) -> DataFrame:
    """Where a candle comes from: returns, distance from the high, falling bars in a row."""
    state = with_ma10(bars).withColumns({"__down": F.col("close") < shift("close"), "__ma_down": F.col("ma10") < shift("ma10")})
    return state.withColumns({
        "ret_q": change("close", quarter), "ret_h": change("close", half),
        "from_high": F.try_divide(F.col("close"), rolling("close", year, F.max, least=20)) - 1,
        "down_run": run_length(F.col("__down"), first=False), "ma_down_run": run_length(F.col("__ma_down"), first=False),
    }).withColumn("down_run", F.coalesce(shift("down_run"), F.lit(0))).drop("__down", "__ma_down")


def with_rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's RSI. Each value needs the one before, so each symbol's closes are folded in order."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bar_idx")
        step = np.diff(rows["close"].to_numpy(float), prepend=np.nan)
        mean = lambda x: pd.Series(x).ewm(alpha=1 / n, adjust=False).mean()
        up, down = mean(np.where(step > 0, step, 0.0)), mean(np.where(step < 0, -step, 0.0))
        out = rows[["symbol", "bar_idx"]].copy()
        out["rsi"] = [None if d == 0 else 100 - 100 / (1 + u / d) for u, d in zip(up, down)]
        return out

    values = bars.select("symbol", "bar_idx", "close").groupBy("symbol").applyInPandas(fold, "symbol string, bar_idx int, rsi double")
    return bars.join(values, ["symbol", "bar_idx"])


def regime(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """One row of market state: the beaten-down stocks' basket, breadth, and the benchmark against its means.

    bars must be dense (with t) and filled. The basket's return over n days is that of the stocks that
    were beaten down n days ago.
    """
    by_t = lambda x, n, fn=F.avg, **k: rolling(x, n, fn, order="t", **k)
    state = bars.withColumns({"ma200": by_t("close", 200), "ma50": by_t("close", 50), "r126": change("close", 126, "t")})
    state = state.withColumn("beaten", F.coalesce((F.col("close") < F.col("ma200")) & (F.col("r126") < -0.08), F.lit(False)))
    ages = {f"b{n}": shift("beaten", n, "t") for n in (10, 20)}
    state = state.withColumns({**ages, "r10": change("close", 10, "t"), "r20": change("close", 20, "t"), "over50": F.col("close") > F.col("ma50"), "over50_20": shift(F.col("close") > F.col("ma50"), 20, "t")})
    last = state.where(F.col("t") == F.lit(bars.agg(F.max("t")).first()[0]))
    share = lambda flag: F.try_divide(F.count_if(flag).cast("double"), F.count(flag))
    stocks = last.agg(
        F.avg(F.when(F.col("b10"), F.col("r10"))).alias("basket_10"), F.avg(F.when(F.col("b20"), F.col("r20"))).alias("basket_20"),
        share(F.col("over50")).alias("breadth50"), share(F.col("over50_20")).alias("breadth50_before"), share(F.col("beaten")).alias("beaten_share"),
    )
    b = bench.withColumns({"m50": rolling("close", 50), "m200": rolling("close", 200)})
    end = b.agg(F.max_by(F.struct("close", "m50", "m200"), "date").alias("b")).select((F.col("b.close") > F.col("b.m50")).alias("bench_over_ma50"), (F.col("b.close") > F.col("b.m200")).alias("bench_over_ma200"))
    return stocks.join(F.broadcast(end)).withColumn("warning", F.coalesce(F.col("basket_20") < -0.03, F.lit(False)))


def panel_context(dense: DataFrame, sector: str = "sector") -> DataFrame:
    """Market and sector context of each day, over the panel's clock."""
    by_t = lambda x, n, fn=F.avg, **k: rolling(x, n, fn, order="t", **k)
    state = dense.withColumns({"ma200": by_t("close", 200), "ma50": by_t("close", 50), "r126": change("close", 126, "t"), "r20": change("close", 20, "t"), "r60": change("close", 60, "t")})
    state = state.withColumn("beaten", F.coalesce((F.col("close") < F.col("ma200")) & (F.col("r126") < -0.08), F.lit(False))).withColumn("beaten_20", shift("beaten", 20, "t"))
    day, own_sector = Window.partitionBy("t"), Window.partitionBy("t", sector)
    over = F.when(F.col("close").isNotNull() & F.col("ma50").isNotNull(), (F.col("close") > F.col("ma50")).cast("double"))
    return state.withColumns({
        "basket20": F.avg(F.when(F.col("beaten_20"), F.col("r20"))).over(day), "breadth50": F.avg(over).over(day),
        "sector_r20": F.avg("r20").over(own_sector), "sector_r60": F.avg("r60").over(own_sector),
    })
