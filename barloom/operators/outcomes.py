"""What followed a match, market filters, and the pieces of a stock's story."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frames import shift
from . import indicators as I


def forward_outcome(matches: DataFrame, bars: DataFrame, horizons: tuple[int, ...] = (5, 10, 20, 40)) -> DataFrame:
    """matches (symbol, end_idx, direction, target, stop) with closes later, best and worst excursion, and whether and when target and stop were met.

    Returns are plain ones from the close of end_idx; excursions follow the direction.
    """
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    ahead = F.collect_list(F.struct("bar_idx", "high", "low")).over(w.rowsBetween(1, max(horizons)))
    later = bars.select("symbol", F.col("bar_idx").alias("end_idx"), F.col("close").alias("__close"), ahead.alias("__ahead"), *[(F.try_divide(F.lead("close", h).over(w), F.col("close")) - 1).alias(f"ret_{h}") for h in horizons])
    rows = matches.join(later, ["symbol", "end_idx"], "left")
    up = F.col("direction") == "bullish"
    high, low = F.array_max(F.transform("__ahead", lambda b: b["high"])), F.array_min(F.transform("__ahead", lambda b: b["low"]))
    meets = lambda side: F.filter("__ahead", side)
    target = F.when(up, meets(lambda b: b["high"] >= F.col("target"))).otherwise(meets(lambda b: b["low"] <= F.col("target")))
    stop = F.when(up, meets(lambda b: b["low"] <= F.col("stop"))).otherwise(meets(lambda b: b["high"] >= F.col("stop")))
    c = F.col("__close")
    return rows.withColumns({
        "max_favorable": F.when(up, high / c - 1).otherwise(c / low - 1), "max_adverse": F.when(up, low / c - 1).otherwise(c / high - 1), "target_hit": F.size(target) > 0,
        "bars_to_target": F.try_element_at(target, F.lit(1))["bar_idx"] - F.col("end_idx"), "stop_hit": F.size(stop) > 0, "bars_available": F.size("__ahead"),
    }).drop("__close", "__ahead")


def market_filter(matches: DataFrame, bars: DataFrame, ret_126: tuple[float | None, float | None] = (None, None), ma200: tuple[float | None, float | None] = (None, None), atr_pct: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """Matches whose context at their last bar lies within bounds; bounds on return or mean need 200 bars."""
    context = I.with_context(bars).select("symbol", F.col("bar_idx").alias("end_idx"), "ret_126", "ma200_distance", "atr_pct", "ma200_bars")
    within = lambda c, b: (F.lit(True) if b[0] is None else F.col(c) >= b[0]) & (F.lit(True) if b[1] is None else F.col(c) <= b[1])
    needs = any(x is not None for x in (*ret_126, *ma200))
    ok = within("ret_126", ret_126) & within("ma200_distance", ma200) & within("atr_pct", atr_pct) & (F.col("ma200_bars") >= 200 if needs else F.lit(True))
    return matches.join(context, ["symbol", "end_idx"]).where(ok)


def year_on_year(facts: DataFrame, keys: list[str] = ["symbol", "quarter"]) -> DataFrame:  # noqa: B006
    """facts (symbol, year, quarter, value) with growth over the same quarter of the year before."""
    before = facts.select(*keys, (F.col("year") + 1).alias("year"), F.col("value").alias("before"))
    return facts.join(before, [*keys, "year"], "left").withColumn("growth", F.when(F.col("before") > 0, F.col("value") / F.col("before") - 1)).drop("before")


def quarter_before(days: DataFrame, quarters: DataFrame, most_days: int = 100) -> DataFrame:
    """days (symbol, day) with the last quarter that ended up to most_days before (quarters: symbol, end)."""
    line = days.select("symbol", "day", F.lit(1).alias("kind"), F.lit(None).cast("date").alias("end")).distinct().unionByName(quarters.select("symbol", F.col("end").alias("day"), F.lit(0).alias("kind"), "end"))
    last = F.last("end", ignorenulls=True).over(Window.partitionBy("symbol").orderBy("day", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return line.withColumn("end", last).where("kind = 1").select("symbol", "day", F.when(F.datediff("day", "end") <= most_days, F.col("end")).alias("quarter_end"))


def reaction(days: DataFrame, bars: DataFrame) -> DataFrame:
    """days (symbol, event_date) with the session that reacted: of the first one on or after the day and the next, the one with the larger move."""
    from .events import as_of

    w = Window.partitionBy("symbol").orderBy("bar_idx")
    moves = bars.withColumn("move", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1).withColumns({"next_move": F.lead("move").over(w), "next_date": F.lead("date").over(w)})
    found = as_of(days, bars.select("symbol", "date"), forward=True, strict=False).where(F.datediff("date", "event_date") <= 4)
    j = found.join(moves.select("symbol", "date", "move", "next_move", "next_date"), ["symbol", "date"])
    later = F.abs("next_move") > F.abs("move")
    return j.select("symbol", "event_date", F.when(later, F.col("next_date")).otherwise(F.col("date")).alias("session"), F.when(later, F.col("next_move")).otherwise(F.col("move")).alias("move"))


def concerns(headlines: DataFrame, patterns: dict[str, str], tone: Column, top: int = 4) -> DataFrame:
    """headlines (symbol, title, weight): themes of the negative ones and, at half weight, the neutral ones; the heaviest per symbol."""
    from ..functions.text import themes

    once = headlines.groupBy("symbol", F.lower(F.trim("title")).alias("title")).agg(F.max("weight").alias("weight")).where("title <> ''").withColumn("tone", tone).where("tone <= 0")
    rows = once.select("symbol", F.explode(themes(F.col("title"), patterns)).alias("theme"), F.when(F.col("tone") < 0, F.col("weight")).otherwise(F.col("weight") * 0.5).alias("w"))
    sums = rows.groupBy("symbol", "theme").agg(F.sum("w").alias("weight")).where("weight >= 1")
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("weight"), "theme"))).where(F.col("rank") <= top)


def group_state(bars: DataFrame, groups: DataFrame) -> DataFrame:
    """Per symbol at its last bar: whether it is beaten down, and the share of the other members of its group that are."""
    last = I.with_beaten(bars).withColumn("__r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("bar_idx")))).where("__r = 1").select("symbol", "beaten")
    g = Window.partitionBy("grp")
    rows = last.join(groups.select("symbol", "grp"), "symbol").withColumns({"n": F.count("*").over(g), "all": F.sum(F.col("beaten").cast("int")).over(g)})
    return rows.select("symbol", "grp", "beaten", F.try_divide((F.col("all") - F.col("beaten").cast("int")).cast("double"), F.col("n") - 1).alias("others_beaten"))


def co_signals(events: DataFrame, groups: DataFrame, days: int = 15) -> DataFrame:
    """events (symbol, date) with how many other members of the group had one within so many days."""
    e = events.join(groups.select("symbol", "grp"), "symbol").withColumn("d", F.unix_date("date"))
    near = Window.partitionBy("grp").orderBy("d").rangeBetween(-days, days)
    return e.withColumn("co_signals", F.size(F.array_remove(F.collect_set("symbol").over(near), F.col("symbol")))).drop("d")


def interval_of(events: DataFrame, spans: DataFrame) -> DataFrame:
    """events (symbol, bar_idx) with the span (symbol, leg, start_idx, end_idx) that they fall into."""
    line = events.select("symbol", F.col("bar_idx").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("leg")).unionByName(spans.select("symbol", F.col("start_idx").alias("at"), F.lit(0).alias("kind"), "leg"))
    last = F.last("leg", ignorenulls=True).over(Window.partitionBy("symbol").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return line.withColumn("leg", last).where("kind = 1").select("symbol", F.col("at").alias("bar_idx"), "leg")


def gap_days(bars: DataFrame, least: float = 0.04) -> DataFrame:
    return bars.withColumn("gap", F.try_divide(F.col("open"), shift("close")) - 1).where(F.abs("gap") >= least)
