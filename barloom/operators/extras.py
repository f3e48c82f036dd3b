"""Operators that fold a series in order, and studies built on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frames import change, rolling

#: Required move, in daily deviations, and the probability that the next close reaches it. Fixed values.
REACH = [
    (-3.0, 0.944), (-2.5, 0.944), (-2.0, 0.944), (-1.5, 0.915), (-1.4, 0.906), (-1.3, 0.897), (-1.2, 0.887), (-1.1, 0.874), (-1.0, 0.856), (-0.9, 0.839), (-0.8, 0.814), (-0.7, 0.788), (-0.6, 0.755),
    (-0.5, 0.726), (-0.4, 0.693), (-0.3, 0.649), (-0.2, 0.599), (-0.1, 0.562), (0.0, 0.505), (0.1, 0.431), (0.2, 0.392), (0.3, 0.339), (0.4, 0.297), (0.5, 0.260), (0.6, 0.224), (0.7, 0.194),
    (0.8, 0.165), (0.9, 0.140), (1.0, 0.121), (1.1, 0.106), (1.2, 0.087), (1.3, 0.080), (1.4, 0.067), (1.5, 0.055), (2.0, 0.025), (2.5, 0.012), (3.0, 0.006),
]


def interpolate(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise-linear, flat outside the knots."""
    out = F.when(x <= knots[0][0], F.lit(knots[0][1]))
    for (a, p), (b, q) in zip(knots, knots[1:]):
        out = out.when(x <= b, p + (x - a) * ((q - p) / (b - a)))
    return F.when(x.isNotNull(), out.otherwise(F.lit(knots[-1][1])))


def macd_touch(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, closeness: float = 0.05, span: int = 60, least: int = 200, alert: float = 0.7, knots: list[tuple[float, float]] = REACH) -> DataFrame:  # noqa: B006
    """Per symbol at its last bar: MACD, its signal, the next closes at which they touch and cross, and how likely a touch is.

    With the next close x, MACD is a line in x and so is its signal; they meet at the cross price. A
    touch is a MACD within `closeness` of the signal's size below it. status is insufficient_data (fewer
    than `least` bars; all else null), above_signal, touching or apart; only apart has a required
    move, z and probability, and alert tells whether that is high.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        c = rows.sort_values("bar_idx")["close"]
        f, s = (c.ewm(span=n, adjust=False).mean() for n in (fast, slow))
        sig = (f - s).ewm(span=signal, adjust=False).mean()
        vol = c.pct_change().iloc[-span:].std() if len(c) > span else np.nan
        return pd.DataFrame([(rows["symbol"].iloc[0], len(c), float(c.iloc[-1]), float(f.iloc[-1]), float(s.iloc[-1]), float(sig.iloc[-1]), None if np.isnan(vol) else float(vol))], columns=["symbol", "n", "close", "fast", "slow", "signal", "vol"])

    out = bars.where(F.col("close").isNotNull()).select("symbol", "bar_idx", "close").groupBy("symbol").applyInPandas(fold, "symbol string, n int, close double, fast double, slow double, signal double, vol double")
    a, b, g = 2 / (fast + 1), 2 / (slow + 1), 2 / (signal + 1)
    enough = F.col("n") >= least
    near = F.lit(closeness) * F.abs("signal")
    out = out.withColumns({"macd": F.col("fast") - F.col("slow")}).withColumns({"hist": F.col("macd") - F.col("signal"), "cross_price": (F.col("signal") - (1 - a) * F.col("fast") + (1 - b) * F.col("slow")) / (a - b)})
    out = out.withColumn("touch_price", F.col("cross_price") - near / ((1 - g) * (a - b)))
    out = out.withColumn("status", F.when(~enough, "insufficient_data").when(F.col("hist") >= 0, "above_signal").when(F.col("hist") >= -near, "touching").otherwise("apart"))
    out = out.withColumn("required", F.when(F.col("status") == "apart", F.col("touch_price") / F.col("close") - 1))
    out = out.withColumn("z", F.try_divide("required", "vol")).withColumn("probability", interpolate(F.col("z"), knots))
    told = lambda c: F.when(enough, F.col(c)).alias(c)
    return out.select("symbol", "n", "status", *map(told, ("close", "macd", "signal", "hist", "touch_price", "cross_price")), "required", "z", "probability", (F.col("probability") >= alert).alias("alert"))


def turns(c: np.ndarray, limit: float) -> list[int]:
    """First and last bar, and the extremes between moves of at least `limit`. The first move is measured from the first close.

    From each confirmed move the next extreme is looked up at once: the running extreme of what is
    left tells where a counter-move first reaches the limit, and the last bar at that extreme turns.
    """
    last = len(c) - 1
    if last < 2:
        return list(range(len(c)))
    found, begun = [0], np.flatnonzero(np.abs(c / c[0] - 1) >= limit)
    if len(begun):
        at, side = int(begun[0]), np.sign(c[begun[0]] - c[0])
        while True:
            left = c[at:]
            edge = np.maximum.accumulate(left) if side > 0 else np.minimum.accumulate(left)
            back = np.flatnonzero(side * (1 - left / edge) >= limit)
            until = int(back[0]) if len(back) else len(left) - 1
            turn = at + int(np.flatnonzero(left[: until + 1] == edge[until])[-1])
            if not len(back):
                return [*found, last] if turn in (found[-1], last) else [*found, turn, last]
            found.append(turn)
            at, side = at + until, -side
    return [*found, last]


def legs(series: DataFrame, by: list[str], threshold: float | str = 0.1, most_legs: int = 12, tries: int = 5) -> DataFrame:
    """by, leg, start_idx, end_idx, ret and threshold: legs of the closes of each `by` between turns of at least threshold, a number or a column.

    Of thresholds that rise by two fifths the first one counts that gives no more than most_legs, or
    the last. A last leg of less than half of it belongs to the one before.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in series.schema.fields if f.name in by)
    rows = series.select(*by, "bar_idx", "close", (F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))).alias("__limit"))

    def find(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("bar_idx")
        c, place = part["close"].to_numpy(float), part["bar_idx"].to_numpy()
        told = [(t, turns(c, t)) for t in part["__limit"].iloc[0] * 1.4 ** np.arange(tries)]
        limit, at = next((x for x in told if len(x[1]) <= most_legs + 1), told[-1])
        stub = len(at) > 2 and abs(c[at[-1]] / c[at[-2]] - 1) < limit / 2
        ends = np.array(at[:-2] + at[-1:] if stub else at)
        a, b = ends[:-1], ends[1:]
        own = {k: part[k].iloc[0] for k in by}
        return pd.DataFrame({**own, "leg": np.arange(len(a)), "start_idx": place[a], "end_idx": place[b], "ret": c[b] / c[a] - 1, "threshold": limit}, index=range(len(a)))

    return rows.groupBy(*by).applyInPandas(find, f"{kinds}, leg int, start_idx int, end_idx int, ret double, threshold double")


def zigzag(bars: DataFrame, threshold: float = 0.1, most_legs: int = 12) -> DataFrame:
    """Legs of each symbol's closes; see `legs`."""
    return legs(bars, ["symbol"], threshold, most_legs)


def late_entry(events: DataFrame, bars: DataFrame, within: int = 10, horizons: tuple[int, ...] = (20, 60)) -> DataFrame:
    """events (symbol, bar_idx) entered at the first close above the high before it, within so many bars; those without one are left out."""
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    state = bars.withColumn("__up", F.when(F.col("close") > F.lag("high").over(w), F.col("bar_idx")))
    ahead = F.min("__up").over(w.rowsBetween(1, within))
    entry = bars.select("symbol", F.col("bar_idx").alias("late_idx"), F.lead("open").over(w).alias("late_entry"), *[(F.try_divide(F.lead("close", h).over(w), F.lead("open").over(w)) - 1).alias(f"late_ret_{h}") for h in horizons])
    return events.join(state.select("symbol", "bar_idx", ahead.alias("late_idx")), ["symbol", "bar_idx"]).join(entry, ["symbol", "late_idx"])


def entry_variants(events: DataFrame, bars: DataFrame, level: str = "level", hold: int = 20, retest_bars: int = 5, tolerance: float = 0.01) -> DataFrame:
    """For each event (symbol, bar_idx, level): returns to the same exit from its close, the next open, and a limit order near the level."""
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    ahead = F.collect_list(F.struct("bar_idx", "low")).over(w.rowsBetween(1, retest_bars))
    rows = bars.select("symbol", "bar_idx", "close", F.lead("open").over(w).alias("next_open"), F.lead("close", hold).over(w).alias("exit"), ahead.alias("ahead"))
    j = events.join(rows, ["symbol", "bar_idx"])
    limit = F.col(level) * (1 + tolerance)
    filled = F.exists("ahead", lambda b: b["low"] <= limit)
    each = F.array(*[F.struct(F.lit(k).alias("entry"), p.alias("price")) for k, p in (("close", F.col("close")), ("next_open", F.col("next_open")), ("retest", F.when(filled, F.least(limit, F.col("next_open")))))])
    return j.select("symbol", "bar_idx", "exit", F.explode(each).alias("x")).select("symbol", "bar_idx", "x.entry", "x.price", (F.try_divide(F.col("exit"), F.col("x.price")) - 1).alias("ret"))


def slot_trades(dense: DataFrame, target: float, stop: float | None, hold: int, start: int, may: Column) -> DataFrame:
    """symbol, t, exit_t, entry, exit: the trade that begins at the open of every day after start on which `may` holds, by the rule record's order: stop, target, time.

    All days of a symbol are walked at once, one bar of their trades after the other. A trade that the
    series ends first has no exit and an exit_t beyond it.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t", ignore_index=True)
        o, h, low, c = (rows[k].to_numpy(float) for k in ("open", "high", "low", "close"))
        first = np.flatnonzero(rows["__may"].to_numpy(bool) & (rows["t"].to_numpy() > start))
        price, n = o[first], len(o)
        up, down = price * (1 + target), np.full(len(first), -np.inf) if stop is None else price * (1 - stop)
        ends, out, held, live = np.full(len(first), -1), np.full(len(first), np.nan), price.copy(), np.arange(len(first))
        for k in range(hold):
            live = live[first[live] + k < n]
            if not len(live):
                break
            at = first[live] + k
            missing = np.isnan(c[at])  # leaves at the price before
            hit_stop, hit_target, timed = low[at] <= down[live], h[at] >= up[live], np.full(len(live), k == hold - 1)
            worse, better = (np.minimum(o[at], down[live]), np.maximum(o[at], up[live])) if k else (down[live], up[live])
            leave = np.select([missing, hit_stop, hit_target, timed], [held[live], worse, better, c[at]], np.nan)
            gone = ~np.isnan(leave)
            ends[live[gone]], out[live[gone]] = at[gone], leave[gone]
            held[live] = np.where(missing, held[live], c[at])
            live = live[~gone]
        t = rows["t"].to_numpy()
        return pd.DataFrame({"symbol": rows["symbol"].iloc[0], "t": t[first], "exit_t": np.where(ends >= 0, t[ends], np.iinfo(np.int32).max).astype(np.int64), "entry": price, "exit": out}, index=range(len(first)))

    rows = dense.select("symbol", "t", "open", "high", "low", "close", may.alias("__may"))
    return rows.groupBy("symbol").applyInPandas(run, "symbol string, t long, exit_t long, entry double, exit double")


def slot_portfolio(dense: DataFrame, target: float, stop: float | None, slots: int = 20, hold: int = 250, cost: float = 0.0005, seed: int = 0, start: int = 200, eligible: Column | None = None) -> DataFrame:
    """date, r and positions of a portfolio with so many equal slots: r is the mean of the slots' returns of the day.

    On each day after `start` every free slot buys, at the open and for `cost`, the next stock in the
    day's order by a hash among those that closed the day before, were `eligible` then (a condition on
    the day before's row), open today and are not held. A held stock is marked to market at the
    close. It leaves at the stop, which comes first, at the target, or at the close of its hold-th
    day; where the open is beyond stop or target on a later day than the first, it leaves at the open.
    A held stock without a close leaves at no gain.

    What a trade earns depends on its first day alone, so all trades that might be are worked out by
    symbol. Which are made depends on the slots that are free: one ordered walk over the days, that
    reads for each the first 2 * slots in its order, as no more than slots of them can be held. The
    trades made are then marked to market by day in parallel.
    """
    w = Window.partitionBy("symbol").orderBy("t")
    fit = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    rows = dense.withColumn("__may", F.coalesce(F.lag(F.col("close").isNotNull() & fit).over(w) & F.col("open").isNotNull(), F.lit(False)))
    trades = slot_trades(rows, target, stop, hold, start, F.col("__may"))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), "symbol", F.col("t").cast("string")))
    line = Window.partitionBy("t").orderBy("pick")
    offered = trades.withColumn("pick", order).withColumn("__r", F.row_number().over(line)).where(F.col("__r") <= 2 * slots)

    def walk(offers: pd.DataFrame) -> pd.DataFrame:
        free_at: dict[str, int] = {}  # of what is held: the day it leaves
        made = []
        for t, today in offers.sort_values(["t", "pick"]).groupby("t", sort=True):
            free_at = {s: e for s, e in free_at.items() if e >= t}
            wanted = today[~today["symbol"].isin(free_at)].head(slots - len(free_at))
            free_at.update(zip(wanted["symbol"], wanted["exit_t"]))
            made.append(wanted[["symbol", "t", "exit_t", "entry", "exit"]])
        return pd.concat(made) if made else offers[["symbol", "t", "exit_t", "entry", "exit"]]

    made = offered.select("symbol", "t", "exit_t", "entry", "exit", "pick").groupBy(F.lit("all")).applyInPandas(walk, "symbol string, t long, exit_t long, entry double, exit double")
    calendar = dense.select(F.col("t").cast("long").alias("t"), "date").distinct().where(F.col("t") > start)
    last = F.least(F.col("exit_t"), F.col("t") + hold - 1)
    days = made.select("symbol", "entry", "exit", "exit_t", F.col("t").alias("since"), F.explode(F.sequence(F.col("t"), last)).alias("t"))
    priced = days.join(dense.select("symbol", F.col("t").cast("long").alias("t"), "close", F.lag("close").over(w).alias("before")), ["symbol", "t"])
    base = F.when(F.col("t") == F.col("since"), F.col("entry")).otherwise(F.col("before"))
    worth = F.when(F.col("t") == F.col("exit_t"), F.col("exit")).otherwise(F.col("close"))
    gain = worth / base - 1 - F.when(F.col("t") == F.col("since"), cost).otherwise(0.0)
    daily = priced.groupBy("t").agg(F.sum(gain).alias("gain"), F.count_if(F.col("t") < F.col("exit_t")).alias("positions"))
    return calendar.join(daily, "t", "left").select("date", (F.coalesce("gain", F.lit(0.0)) / slots).alias("r"), F.coalesce("positions", F.lit(0)).cast("int").alias("positions"))


def wedge_geometry(matches: DataFrame) -> DataFrame:
    """matches of two-line patterns with their height, its share of the price, and the bars to the apex."""
    return matches.where(F.col("pattern").rlike("Wedge|Triangle")).select(
        "symbol", "pattern", "status", "start_idx", "end_idx", F.col("metrics")["height_pct"].alias("height_pct"), F.col("metrics")["convergence"].alias("convergence"),
        (F.col("metrics")["apex"] - F.col("end_idx")).alias("bars_to_apex"), F.col("metrics")["touches"].alias("touches"),
    )


def price_context(bars: DataFrame) -> DataFrame:
    """Per symbol at its last bar: means, returns over months, the year's high and low with their days, and the five worst days of the last 63."""
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    s = bars.withColumns({**{f"ma{n}": rolling("close", n) for n in (20, 50, 200)}, **{f"ret_{n}": change("close", n) for n in (21, 63, 126, 252)}, "day_ret": change("close", 1)})
    year = w.rowsBetween(-251, 0)
    s = s.withColumns({"high_52w": F.max("high").over(year), "high_day": F.max_by("date", "high").over(year), "low_52w": F.min("low").over(year), "low_day": F.min_by("date", "low").over(year), "__recent": F.collect_list(F.struct("day_ret", "date")).over(w.rowsBetween(-62, 0))})
    last = s.withColumn("__r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("bar_idx")))).where("__r = 1")
    worst = F.slice(F.array_sort(F.filter("__recent", lambda x: x["day_ret"].isNotNull())), 1, 5)
    return last.select("symbol", "date", "close", "ma20", "ma50", "ma200", "ret_21", "ret_63", "ret_126", "ret_252", "high_52w", "high_day", "low_52w", "low_day", F.transform(worst, lambda x: x["date"]).alias("worst_days"))
