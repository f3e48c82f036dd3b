"""Dated events from bars, and what followed them.

An event is a symbol and the bar at whose close it is known. A convention says what is measured
from there. All of a bar's forward returns are window expressions, and the mean return of entries
near it is a pair of window sums, so no event is ever joined with its candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frames import change, rolling, shift
from ..functions.scores import t_stat
from . import indicators as I


@dataclass(frozen=True)
class Convention:
    """How an event at bar t is entered and left. Shifts count bars from t.

    entry is bought at entry_shift, and left at the close of h + exit_shift. The benchmark runs from
    bench_field at bench_shift to the same close. Random entries lie within `window` bars, at least
    one after the first bar and with `margin` bars less than h to spare, more than h bars away.
    """

    entry: str = "open"
    entry_shift: int = 1
    exit_shift: int = 0
    bench_field: str = "close"
    bench_shift: int = 1
    window: int = 126
    margin: int = 3
    anchor_shift: int = 0  #: the bar that random entries are placed around


NEXT_OPEN = Convention()
AT_CLOSE = Convention(entry="close", entry_shift=0, bench_shift=0, margin=2)
REVERSAL = Convention(bench_shift=1, margin=1, anchor_shift=1)
PATTERN = Convention(bench_field="open", bench_shift=1, margin=0, anchor_shift=1)
CANDLE = Convention(entry="close", entry_shift=0, bench_shift=0, window=63, margin=1)


def align_benchmark(bars: DataFrame, bench: DataFrame, order: str = "date") -> DataFrame:
    """bars with bench_open and bench_close of their day, or of the last day before, or of the first after."""
    joined = bars.join(bench.select("date", F.col("open").alias("bench_open"), F.col("close").alias("bench_close")), "date", "left")
    back = Window.partitionBy("symbol").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("symbol").orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    fill = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(ahead))
    return joined.withColumns({c: fill(c) for c in ("bench_open", "bench_close")})


def with_forward(bars: DataFrame, horizons: list[int], how: Convention = NEXT_OPEN, order: str = "bar_idx") -> DataFrame:
    """bars with ret_h, bench_h, local_h and n_local_h for each horizon, as an event at the bar would have them.

    local_h is the mean over all random entries, the limit of many draws. Needs bench_open and bench_close.
    """
    w = Window.partitionBy("symbol").orderBy("date" if order == "bar_idx" and "date" in bars.columns else order)  # one order, one sort
    last = F.max(order).over(Window.partitionBy("symbol"))
    entry = F.lead(how.entry, how.entry_shift).over(w) if how.entry_shift else F.col(how.entry)
    start = F.lead(f"bench_{how.bench_field}", how.bench_shift).over(w) if how.bench_shift else F.col(f"bench_{how.bench_field}")
    out = bars.withColumns({"entry": entry, "__bench": start, "__last": last})
    returns = {}
    for h in horizons:
        returns[f"ret_{h}"] = F.try_divide(F.lead("close", h + how.exit_shift).over(w), F.col("entry")) - 1
        returns[f"bench_{h}"] = F.try_divide(F.lead("bench_close", h + how.exit_shift).over(w), F.col("__bench")) - 1
    out = out.withColumns(returns)
    a = how.anchor_shift
    near = {}
    for h in horizons:
        # a candidate c is a bar counted from the anchor; as an event it would stand at c - anchor_shift
        place = F.col(order) + a
        sound = F.when((place >= 1) & (place <= F.col("__last") + 1 - h - how.margin), F.col(f"ret_{h}"))
        near[f"__c_{h}"] = sound
    out = out.withColumns(near)
    # sums over the bars near each bar are differences of running sums, so a bar costs the same whatever the window
    running, means = {}, {}
    everything = Window.partitionBy("symbol")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    for h in horizons:
        c = F.col(f"__c_{h}")
        running |= {f"__s_{h}": F.sum(F.coalesce(c, F.lit(0.0))).over(so_far), f"__n_{h}": F.count(c).over(so_far), f"__st_{h}": F.sum(F.coalesce(c, F.lit(0.0))).over(everything), f"__nt_{h}": F.count(c).over(everything)}
    out = out.withColumns(running)
    for h in horizons:

        def near_sum(x: str) -> Column:
            before = F.coalesce(F.lag(f"__{x}_{h}", h + 1).over(w), F.lit(0)) - F.coalesce(F.lag(f"__{x}_{h}", how.window + 1).over(w), F.lit(0))
            after = F.coalesce(F.lead(f"__{x}_{h}", how.window).over(w), F.col(f"__{x}t_{h}")) - F.coalesce(F.lead(f"__{x}_{h}", h).over(w), F.col(f"__{x}t_{h}"))
            return before + after if h < how.window else F.lit(0)

        n = near_sum("n")
        means[f"n_local_{h}"] = n.cast("int")
        means[f"local_{h}"] = F.when(n >= 5, F.try_divide(near_sum("s"), n))
    return out.withColumns(means).drop("__bench", "__last", *near, *running)


def narrow(events: DataFrame, horizons: list[int], keep: list[str]) -> DataFrame:
    """A row for each event and horizon: ret, xbench and xlocal, signed by direction if there is one."""
    sign = F.col("direction") if "direction" in events.columns else F.lit(1)
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"ret_{h}").alias("r"), F.col(f"bench_{h}").alias("b"), F.col(f"local_{h}").alias("l")) for h in horizons]))
    rows = events.select(*keep, sign.alias("__sign"), each.alias("x"))
    return rows.select(*keep, F.col("x.h").alias("h"), (F.col("__sign") * F.col("x.r")).alias("ret"), (F.col("__sign") * (F.col("x.r") - F.col("x.b"))).alias("xbench"), (F.col("__sign") * (F.col("x.r") - F.col("x.l"))).alias("xlocal"))


def cooldown(hits: DataFrame, keys: list[str], gap: int, at: str = "bar_idx") -> DataFrame:
    """hits that are at least gap after the last one kept of their key: a hit that is dropped drops no others.

    The hits of a key are gathered once and folded in order; a key has no more than its symbol has
    bars. Hits at the same position stay or go together.
    """
    others = [c for c in hits.columns if c not in keys and c != at]
    own = F.array_sort(F.collect_list(F.struct(at, *others)))
    gathered = hits.groupBy(*keys).agg(own.alias("__all"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["last"].isNull() | (x[at] - acc["last"] >= gap) | (x[at] == acc["last"])
        return F.when(fits, F.struct(x[at].cast("long").alias("last"), F.array_append(acc["out"], x).alias("out"))).otherwise(acc)

    start = F.struct(F.lit(None).cast("long").alias("last"), F.filter("__all", lambda x: F.lit(False)).alias("out"))
    kept = F.aggregate("__all", start, step, lambda acc: acc["out"])
    return gathered.select(*keys, F.explode(kept).alias("__x")).select(*keys, "__x.*").select(*hits.columns)


def room(horizons: list[int], extra: int = 1, order: str = "bar_idx") -> Column:
    """Whether the longest horizon still has its bars."""
    return F.col(order) + max(horizons) + extra < F.max(order).over(Window.partitionBy("symbol")) + 1


# --- early rallies ---------------------------------------------------------

WINDOW_RULES = ("ma50_cross", "golden_20_50", "base_breakout", "thrust")
RULES = (*WINDOW_RULES, "rsi_turn", "higher_high")


def rally_hits(bars: DataFrame, rules: tuple[str, ...] = WINDOW_RULES) -> DataFrame:
    """bars' rows at which a rule fires, with `rule`; the first 260 bars fire none."""
    known = bars
    if "rsi_turn" in rules:
        known = I.with_rsi(known)
    if "higher_high" in rules:
        known = known.join(higher_highs(bars).withColumn("__hh", F.lit(True)), ["symbol", "bar_idx"], "left")
    by = {
        "ma20": rolling("close", 20), "ma50": rolling("close", 50), "c1": shift("close"), "c10": shift("close", 10), "c136": shift("close", 136),
        "hi60": rolling("high", 60, F.max, lag=1), "hi252": rolling("close", 252, F.max, lag=1), "av20": rolling("volume", 20, lag=1), "lo60": rolling("low", 60, F.min, lag=10),
    }
    s = known.withColumns(by)
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    s = s.withColumns({"__below": flag(F.col("close") < F.col("ma50")), "__under": flag(F.col("ma20") < F.col("ma50"))})
    s = s.withColumns({"below20": rolling("__below", 20, F.sum, lag=1), "under20": rolling("__under", 20, F.sum, lag=1), "ma50_1": shift("ma50"), "ma20_1": shift("ma20"), "hi60_1": shift("hi60")})
    c = F.col
    fires = {
        "ma50_cross": (c("close") > c("ma50")) & (c("c1") <= c("ma50_1")) & (c("below20") >= 15) & (c("close") > c("c1")),
        "golden_20_50": (c("ma20") > c("ma50")) & (c("ma20_1") <= c("ma50_1")) & (c("under20") >= 20),
        "base_breakout": (c("close") > c("hi60")) & ~F.coalesce(c("c1") > c("hi60_1"), F.lit(False)) & (c("c1") <= 0.90 * c("hi252")) & (c("volume") >= 1.5 * c("av20")),
        "thrust": (c("close") / c("c10") - 1 >= 0.08) & (c("close") > c("c1")) & (c("c10") / c("c136") - 1 <= 0) & (c("c10") <= 1.05 * c("lo60")),
    }
    if "rsi_turn" in rules:
        s = s.withColumns({"rsi_1": shift("rsi"), "rsi20": rolling("rsi", 20, F.min, lag=1)})
        fires["rsi_turn"] = (c("rsi") > 50) & (c("rsi_1") <= 50) & (c("rsi20") < 35)
    if "higher_high" in rules:
        fires["higher_high"] = F.coalesce(c("__hh"), F.lit(False))
    labels = F.filter(F.array(*[F.when(F.coalesce(fires[r], F.lit(False)), F.lit(r)) for r in rules]), lambda x: x.isNotNull())
    return s.where(c("bar_idx") >= 260).select(*bars.columns, F.explode(labels).alias("rule"))


def higher_highs(bars: DataFrame, look: int = 120) -> DataFrame:
    """symbol and bar_idx of the first close above the swing high between a deep low and a higher one.

    Where the swing lies depends on the low found before it, so each symbol's bars are searched in order.
    """

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bar_idx")
        high, low, close = (rows[k].to_numpy(float) for k in ("high", "low", "close"))
        top = rows["close"].rolling(252).max().to_numpy()
        out = []
        for t in range(260, len(rows)):
            base = t - look + int(low[t - look : t - 10].argmin())
            if not low[base] <= 0.85 * top[base] or t - 3 <= base + 5:
                continue
            peak = base + 5 + int(high[base + 5 : t - 3].argmax())
            level = high[peak]
            if t - peak >= 3 and low[peak + 1 : t].min() > 1.02 * low[base] and close[t] > level and (close[peak + 1 : t] <= level).all():
                out.append(t)
        return pd.DataFrame({"symbol": rows["symbol"].iloc[0], "bar_idx": np.array(out, np.int32)})

    return bars.select("symbol", "bar_idx", "high", "low", "close").groupBy("symbol").applyInPandas(find, "symbol string, bar_idx int")


def rally_events(bars: DataFrame, bench: DataFrame, rules: tuple[str, ...] = WINDOW_RULES, horizons: list[int] = [5, 10, 20], gap: int = 20) -> DataFrame:  # noqa: B006
    """One row for each rule and bar, gap bars apart, with context and forward returns."""
    rich = with_forward(align_benchmark(I.with_beaten(I.with_volume_ratio(bars)), bench), horizons).withColumns({
        "ret_20_before": change("close", 20), "day_ret": change("close", 1), "from_52w_high": F.try_divide(F.col("close"), rolling("close", 252, F.max)) - 1, "__room": room(horizons),
    })
    hits = cooldown(rally_hits(rich, rules).where("__room").drop("__room"), ["symbol", "rule"], gap)
    return hits.where(F.col("entry") > 0).withColumn("year", F.year("date"))


def combined(events: DataFrame, beaten_only: bool = True, gap_days: int = 30, confluence_days: int = 8) -> DataFrame:
    """One event per symbol in gap_days calendar days, with how many rules fired in the days before."""
    rows = events.where("beaten") if beaten_only else events
    rows = rows.withColumn("day", F.unix_date("date"))
    recent = Window.partitionBy("symbol").orderBy("day").rangeBetween(-confluence_days, 0)
    rows = rows.withColumn("confluence", F.size(F.collect_set("rule").over(recent)))
    first = rows.groupBy("symbol", "date", "day").agg(F.max("confluence").alias("confluence"), F.min("rule").alias("rule"))
    return cooldown(first, ["symbol"], gap_days, "day").drop("day")


# --- other families --------------------------------------------------------


def news_gaps(dense: DataFrame, bench: DataFrame, horizons: list[int] = [1, 5, 10, 20], gap_min: float = 0.04, times: float = 3.0, gap: int = 5) -> DataFrame:  # noqa: B006
    """Days that open far from the close before, on much more volume, on the panel's clock; direction is the gap's."""
    rich = with_forward(align_benchmark(dense, bench, "t"), horizons, AT_CLOSE, "t")
    s = rich.withColumns({"gap": F.try_divide(F.col("open"), shift("close", 1, "t")) - 1, "av20": rolling("volume", 20, lag=1, order="t"), "day_ret": change("close", 1, "t"), "__room": room(horizons, 0, "t")})
    hits = s.where((F.abs("gap") >= gap_min) & (F.col("volume") >= times * F.col("av20")) & F.col("__room") & (F.col("t") >= 260))
    return cooldown(hits, ["symbol"], gap, "t").withColumns({"direction": F.when(F.col("gap") > 0, 1).otherwise(-1), "volume_times": F.col("volume") / F.col("av20")}).drop("__room", "av20")


def reversals(dense: DataFrame, bench: DataFrame, thresholds: list[float] = [2.0, 2.5, 3.0], horizons: list[int] = [1, 2, 3, 5, 10], gap: int = 3) -> DataFrame:  # noqa: B006
    """Days whose return is beyond a number of standard deviations of the 60 before; bought after falls, sold after rises."""
    rich = with_forward(align_benchmark(dense, bench, "t"), horizons, REVERSAL, "t")
    s = rich.withColumns({"move": change("close", 1, "t"), "next_open": shift("open", -1, "t"), "__room": room(horizons, 1, "t")})
    s = s.withColumn("z", F.try_divide(F.col("move"), rolling("move", 60, F.stddev_samp, least=40, lag=1, order="t")))
    sides = F.filter(
        F.array(*[F.when(F.coalesce(F.col("z") * -d >= thr, F.lit(False)), F.struct(F.lit(thr).alias("threshold"), F.lit(d).alias("direction"))) for thr in thresholds for d in (1, -1)]), lambda x: x.isNotNull()
    )
    hits = s.where(F.col("open").isNotNull() & F.col("next_open").isNotNull() & F.col("__room")).select("*", F.explode(sides).alias("side")).select("*", "side.threshold", "side.direction")
    return cooldown(hits, ["symbol", "threshold", "direction"], gap, "t").drop("side", "__room", "next_open")


def bases(bars: DataFrame, bench: DataFrame, horizons: list[int] = [20, 60], gap: int = 30, state: Column | None = None) -> DataFrame:  # noqa: B006
    """Tight ranges after a fall, gap bars apart, and whether the price later left them upward or downward."""
    rich = with_forward(align_benchmark(I.with_volume_context(bars), bench), horizons).withColumn("__room", room(horizons))
    later = {f"up_{h}": F.lead("close", h).over(Window.partitionBy("symbol").orderBy("date")) > F.col("high15") for h in horizons}
    later |= {f"down_{h}": F.lead("close", h).over(Window.partitionBy("symbol").orderBy("date")) < F.col("low15") for h in horizons}
    held = F.col("base") if state is None else state
    hits = rich.withColumns(later).where(held & F.col("__room") & (F.col("bar_idx") >= 260) & F.col("base_volume").isNotNull())
    return cooldown(hits, ["symbol"], gap).where(F.col("entry") > 0).drop("__room")


def ma200_cross_events(bars: DataFrame, bench: DataFrame, least_below: int = 60, horizons: list[int] = [20, 60], gap: int = 20) -> DataFrame:  # noqa: B006
    rich = with_forward(align_benchmark(bars, bench), horizons).withColumns({"day_ret": change("close", 1), "__room": room(horizons)})
    crosses = I.ma200_crosses(rich, least_below).where("__room")
    return cooldown(crosses, ["symbol"], gap).where(F.col("entry") > 0).drop("__room")


def doji_events(bars: DataFrame, bench: DataFrame, horizons: list[int] = [1, 5, 21], gap: int = 5, body: float = 0.1) -> DataFrame:  # noqa: B006
    """Dojis on the 10-bar mean, from the 56th bar on, gap bars apart, with close-to-close returns."""
    rich = with_forward(align_benchmark(I.with_trend_before(bars), bench), horizons, CANDLE).withColumn("__room", room(horizons, 0))
    hits = rich.where(F.coalesce(I.doji(body), F.lit(False)) & F.col("on_ma10") & F.col("__room") & (F.col("bar_idx") >= 55))
    return cooldown(hits, ["symbol"], gap).drop("__room")


def doji_sensitivity(bars: DataFrame, bench: DataFrame, bodies: list[float] = [0.05, 0.10, 0.20], tolerance: float = 0.0025, horizons: list[int] = [1, 5, 21], least: int = 5) -> DataFrame:  # noqa: B006
    """body, position (inside the range, or on the line as well): results of dojis at the last horizon and after a bar, for each size of body."""
    h = max(horizons)
    parts = None
    for body in bodies:
        ev = doji_events(bars, bench, horizons, body=body)
        on_line = F.abs(F.col("ma10") - (F.col("open") + F.col("close")) / 2) <= tolerance * F.col("close")
        where = F.explode(F.filter(F.array(F.lit("inside"), F.when(on_line, "line")), lambda x: x.isNotNull()))
        rows = ev.select(F.lit(body).alias("body"), where.alias("position"), "ret_1", F.col(f"ret_{h}").alias("ret"), (F.col(f"ret_{h}") - F.col(f"local_{h}")).alias("xlocal"))
        parts = rows if parts is None else parts.unionByName(rows)
    hit = lambda c: F.avg((F.col(c) > 0).cast("int"))
    return parts.groupBy("body", "position").agg(F.count("*").alias("n"), F.avg("ret").alias("ret"), hit("ret").alias("hit"), F.avg("xlocal").alias("xlocal"), t_stat(F.col("xlocal")).alias("t"), F.avg("ret_1").alias("ret_1"), hit("ret_1").alias("hit_1")).where(F.col("n") >= least)


def every_bar(bars: DataFrame, bench: DataFrame, horizons: list[int] = [1, 5, 21]) -> DataFrame:  # noqa: B006
    """The control population: each bar with its context, its returns and whether it is a doji on the mean."""
    rich = with_forward(align_benchmark(I.with_trend_before(bars), bench), horizons, CANDLE)
    return rich.withColumn("is_doji", F.coalesce(I.doji(), F.lit(False)) & F.col("on_ma10"))


def dated(events: DataFrame, bars: DataFrame, bench: DataFrame, horizons: list[int] = [5, 20, 60], least_bars: int = 210) -> DataFrame:  # noqa: B006
    """Events of any origin (symbol, event_date) entered at the open of the first bar after their date."""
    how = Convention(entry_shift=0, exit_shift=-1, bench_shift=0, margin=1)
    rich = with_forward(align_benchmark(bars, bench), horizons, how).withColumn("__room", room(horizons, 0))
    at = as_of(events.select("symbol", "event_date").distinct(), rich.select("symbol", "date"), forward=True)
    joined = at.join(rich.drop("event_date"), ["symbol", "date"])
    return joined.where((F.col("bar_idx") >= least_bars) & F.col("__room")).drop("__room")


def as_of(left: DataFrame, right: DataFrame, forward: bool = False, strict: bool = True) -> DataFrame:
    """left (symbol, event_date, ...) with the date of right (symbol, date) next to event_date, or the last one up to it.

    Both are laid on one line per symbol and the nearest row of the other kind is carried along, so
    a symbol costs a sort of its rows and no pair is ever made. Without a match date is null.
    """
    rank = (0 if strict else 1) if forward else 1
    asked = left.select("symbol", "event_date").distinct()
    line = asked.select("symbol", F.col("event_date").alias("day"), F.lit(1 - rank if forward else 1).alias("kind"), F.lit(True).alias("asked"), F.lit(None).cast("date").alias("date"))
    bars = right.select("symbol", F.col("date").alias("day"), F.lit(rank if forward else 0).alias("kind"), F.lit(False).alias("asked"), "date")
    w = Window.partitionBy("symbol").orderBy("day", "kind")
    if forward:
        found = F.first("date", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    else:
        found = F.last("date", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    told = line.unionByName(bars).withColumn("date", found).where("asked").select("symbol", F.col("day").alias("event_date"), "date")
    return left.join(told, ["symbol", "event_date"], "left")


def hashed_baseline(events: DataFrame, bars: DataFrame, h: int, draws: int = 10, seed: int = 1, how: Convention = NEXT_OPEN) -> DataFrame:
    """symbol, bar_idx and the mean return of `draws` random entries: the first by the MD5 of seed, symbol, bar, horizon and candidate."""
    last = bars.groupBy("symbol").agg(F.max("bar_idx").alias("__last"))
    low = F.greatest(F.lit(1), F.col("bar_idx") - how.window)
    high = F.least(F.col("__last") + 1 - h - how.margin, F.col("bar_idx") + how.window)
    cand = events.select("symbol", "bar_idx").join(last, "symbol").where(low <= high).select("symbol", "bar_idx", F.explode(F.sequence(low, high)).alias("c")).where(F.abs(F.col("c") - F.col("bar_idx")) > h)
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), "symbol", F.col("bar_idx").cast("string"), F.lit(str(h)), F.col("c").cast("string")))
    own = Window.partitionBy("symbol", "bar_idx")
    drawn = cand.withColumns({"n": F.count("*").over(own), "rank": F.row_number().over(own.orderBy(order))}).where((F.col("n") >= 5) & (F.col("rank") <= draws))
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    paid = bars.select("symbol", F.col("bar_idx").alias("c"), (F.try_divide(F.lead("close", h).over(w), F.lead(how.entry, how.entry_shift).over(w)) - 1).alias("r"))
    return drawn.join(paid, ["symbol", "c"]).groupBy("symbol", "bar_idx").agg(F.avg("r").alias("local"), F.count("*").alias("draws"))
