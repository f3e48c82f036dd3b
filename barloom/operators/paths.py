"""Exits: what a trade earns along its path under stops, targets and rules.

A trade's path is an array of bars from its entry on, each relative to the entry price; rules are
folds over that array, so that any number of rules reads each path once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_path(bars: DataFrame, length: int, order: str = "bar_idx") -> DataFrame:
    """bars with the path of a trade entered at the next open: k, and open, high, low and close over the entry price less 1."""
    order = "date" if order == "bar_idx" and "date" in bars.columns else order
    ahead = Window.partitionBy("symbol").orderBy(order).rowsBetween(1, length)
    ahead_bars = F.collect_list(F.struct("open", "high", "low", "close")).over(ahead)
    entry = F.lead("open").over(Window.partitionBy("symbol").orderBy(order))
    rel = lambda b, i: F.struct((i + 1).alias("k"), *[(b[f] / F.col("entry") - 1).alias(f) for f in ("open", "high", "low", "close")])
    out = bars.withColumns({"__ahead": ahead_bars, "entry": entry})
    return out.where(F.col("entry") > 0).withColumn("path", F.transform("__ahead", rel)).drop("__ahead")


def paths_of(events: DataFrame, bars: DataFrame, length: int) -> DataFrame:
    """symbol, bar_idx, entry and path, as with_path makes them, of the bars in events alone: each is joined with the bars of its path."""
    fields = ("open", "high", "low", "close")
    steps = events.select("symbol", "bar_idx", F.explode(F.sequence(F.lit(1), F.lit(length))).alias("k")).withColumn("__at", F.col("bar_idx") + F.col("k"))
    ahead = steps.join(bars.select("symbol", F.col("bar_idx").alias("__at"), *fields), ["symbol", "__at"]).groupBy("symbol", "bar_idx").agg(F.array_sort(F.collect_list(F.struct("k", *fields))).alias("__ahead"))
    told = ahead.withColumn("entry", F.when(F.col("__ahead")[0]["k"] == 1, F.col("__ahead")[0]["open"])).where(F.col("entry") > 0)
    return told.select("symbol", "bar_idx", "entry", F.transform("__ahead", lambda b: F.struct(b["k"].alias("k"), *[(b[f] / F.col("entry") - 1).alias(f) for f in fields])).alias("path"))


def signed(path: Column, direction: Column) -> Column:
    """The path as a short position sees it where direction is negative."""
    flip = lambda b: F.struct(b["k"].alias("k"), (-b["open"]).alias("open"), (-b["low"]).alias("high"), (-b["high"]).alias("low"), (-b["close"]).alias("close"))
    return F.when(direction > 0, path).otherwise(F.transform(path, flip))


def _fold(path: Column, hold: int | Column, step, first: dict[str, Column] | None = None) -> Column:  # noqa: ANN001
    """Walks up to hold bars; step(state, bar) gives the return at which a trade ends there, or null, and the state's next extras."""
    first = first or {}
    start = F.struct(F.lit(None).cast("double").alias("ret"), F.lit(None).cast("int").alias("bars"), F.lit(None).cast("double").alias("last"), F.lit(0).alias("seen"), *[v.alias(k) for k, v in first.items()])

    def walk(s: Column, b: Column) -> Column:
        out, extra = step(s, b)
        ends = s["ret"].isNull() & out.isNotNull()
        return F.struct(
            F.coalesce(s["ret"], out).alias("ret"), F.when(ends, b["k"]).otherwise(s["bars"]).alias("bars"), b["close"].alias("last"), b["k"].alias("seen"), *[v.alias(k) for k, v in extra.items()]
        )

    return F.aggregate(F.slice(path, 1, hold), start, walk, lambda s: F.struct(
        F.coalesce(s["ret"], F.when(s["seen"] == hold, s["last"])).alias("ret"), F.coalesce(s["bars"], F.lit(hold).cast("int")).alias("bars"), s["ret"].isNotNull().alias("early")
    ))


def target_stop(path: Column, hold: int, target: float | None, stop: float | None) -> Column:
    """ret, bars and early: a stop comes before a target on the same bar, and gaps fill at the open."""

    def step(s: Column, b: Column) -> tuple[Column, dict]:
        out = F.lit(None).cast("double")
        if target is not None:
            out = F.when(b["high"] >= target, F.greatest(b["open"], F.lit(target)))
        if stop is not None:
            out = F.when(b["low"] <= -stop, F.least(b["open"], F.lit(-stop))).otherwise(out)
        return out, {}

    return _fold(path, hold, step)


@dataclass(frozen=True)
class ExitRule:
    """time: at the last close. target: at a. rising: at a + b a bar. perday: at a close of a a bar. hybrid: at a on the first bar, then b. trail: at a close a below the best close."""

    name: str
    kind: str
    hold: int
    a: float = 0.0
    b: float = 0.0

    def result(self, path: Column) -> Column:
        bar = lambda s, b: b["k"] - 1
        level = {
            "target": lambda s, b: F.lit(self.a), "rising": lambda s, b: self.a + self.b * bar(s, b), "hybrid": lambda s, b: F.when(bar(s, b) == 0, self.a).otherwise(self.b),
        }.get(self.kind)
        if level is not None:
            return _fold(path, self.hold, lambda s, b: (F.when(b["high"] >= level(s, b), F.greatest(b["open"], level(s, b))), {}))
        if self.kind == "perday":
            return _fold(path, self.hold, lambda s, b: (F.when(b["close"] >= self.a * b["k"], b["close"]), {}))
        if self.kind == "trail":
            def trail(s: Column, b: Column) -> tuple[Column, dict]:
                peak = F.greatest(s["peak"], b["close"])
                return F.when((b["k"] > 1) & ((1 + b["close"]) / (1 + peak) - 1 <= -self.a), b["close"]), {"peak": peak}
            return _fold(path, self.hold, trail, {"peak": F.lit(-1.0)})
        return _fold(path, self.hold, lambda s, b: (F.lit(None).cast("double"), {}))


def default_rules() -> list[ExitRule]:
    """Fixed holding times, targets, rising and per-day targets, a hybrid and trailing stops; 26 rules."""
    take = [ExitRule(f"take {int(x * 100)}% / time {h}", "target", h, x) for h, xs in ((20, (0.02, 0.03, 0.05, 0.08)), (60, (0.05, 0.08))) for x in xs]
    rising = [ExitRule(f"rising {int(a * 100)}% +{b * 100:g}%/bar / time {h}", "rising", h, a, b) for a, b, h in ((0.02, 0.0025, 20), (0.02, 0.005, 20), (0.03, 0.005, 20), (0.02, 0.005, 60))]
    perday = [ExitRule(f"per-day {x * 100:g}% / time {h}", "perday", h, x) for x, h in ((0.005, 20), (0.01, 20), (0.02, 20), (0.005, 60))]
    hybrid = [ExitRule(f"hybrid 2% day 1 then 6% / time {h}", "hybrid", h, 0.02, 0.06) for h in (7, 10, 20)]
    trail = [ExitRule(f"trail {int(x * 100)}% / time {h}", "trail", h, x) for x, h in ((0.03, 60), (0.05, 60), (0.08, 60), (0.05, 20))]
    return [*[ExitRule(f"time {h}", "time", h) for h in (5, 10, 20, 40, 60)], *take, *rising, *perday, *hybrid, *trail]


def exit_grid(trades: DataFrame, rules: list[ExitRule], cost: float = 0.001, by: list[str] | None = None) -> DataFrame:
    """A row for each rule (and group): trades, net return, hit rate, bars held, share ended early, net basis points a bar, profit factor."""
    by = by or []
    results = F.array(*[F.struct(F.lit(r.name).alias("rule"), r.result(F.col("path")).alias("x")) for r in rules])
    rows = trades.select(*by, F.explode(results).alias("g")).select(*by, F.col("g.rule").alias("rule"), (F.col("g.x.ret") - cost).alias("net"), F.col("g.x.bars").alias("bars"), F.col("g.x.early").alias("early")).where(F.col("net").isNotNull())
    return rows.groupBy(*by, "rule").agg(
        F.count("*").alias("n"), F.avg("net").alias("net"), F.avg((F.col("net") > 0).cast("double")).alias("hit"), F.avg("bars").alias("avg_bars"), F.avg(F.col("early").cast("double")).alias("early_exit"),
        (F.sum("net") / F.sum("bars") * 1e4).alias("per_bar_bp"), F.try_divide(F.sum(F.when(F.col("net") > 0, F.col("net"))), -F.sum(F.when(F.col("net") < 0, F.col("net")))).alias("profit_factor"),
    )


def strategy_grid(trades: DataFrame, holds: list[int], targets: list[float | None], stops: list[float | None], cost: float = 0.0005) -> DataFrame:
    """Net results of every combination of holding time, target and stop (0 for none)."""
    cells = [F.struct(F.lit(h).alias("hold"), F.lit(t or 0.0).alias("target"), F.lit(s or 0.0).alias("stop"), target_stop(F.col("path"), h, t, s).alias("x")) for h in holds for t in targets for s in stops]
    rows = trades.select(F.explode(F.array(*cells)).alias("g")).select("g.hold", "g.target", "g.stop", (F.col("g.x.ret") - cost).alias("net"), F.col("g.x.bars").alias("bars")).where(F.col("net").isNotNull())
    return rows.groupBy("hold", "target", "stop").agg(F.count("*").alias("n"), F.avg("net").alias("net"), F.avg((F.col("net") > 0).cast("double")).alias("hit"), F.avg("bars").alias("avg_bars"))


def take_profit_rule(bars: DataFrame, target: float, stop: float | None, hold: int = 250, stride: int = 1, start: int = 200, cost: float = 0.0005, eligible: Column | None = None) -> DataFrame:
    """A row for each trade of every stride-th bar: ret, days and reason.

    Stops win ties, gaps fill at the open except on the entry bar, and what neither hits leaves at the
    last close, by time or because the bars end.
    """
    last = F.max("bar_idx").over(Window.partitionBy("symbol"))
    rows = with_path(bars.withColumn("__last", last), hold).where((F.col("bar_idx") >= start) & ((F.col("bar_idx") - start) % stride == 0) & (F.col("bar_idx") < F.col("__last") - 1))
    if eligible is not None:
        rows = rows.where(eligible)
    first = lambda x: F.coalesce(F.try_element_at(F.filter("path", x), F.lit(1))["k"], F.lit(1 << 30))
    rows = rows.withColumns({"kt": first(lambda b: b["high"] >= target), "ks": first(lambda b: b["low"] <= -stop) if stop is not None else F.lit(1 << 30)})
    at = lambda k: F.element_at("path", k)
    n = F.size("path")
    out = rows.withColumn("reason", F.when((F.col("ks") <= F.col("kt")) & (F.col("ks") <= n), "stop").when(F.col("kt") <= n, "target").when(n == hold, "time").otherwise("end"))
    k = F.when(F.col("reason") == "stop", F.col("ks")).when(F.col("reason") == "target", F.col("kt")).otherwise(n)
    out = out.withColumn("days", k.cast("int"))
    gross = F.when(F.col("reason") == "stop", F.when(F.col("days") > 1, F.least(at(F.col("days"))["open"], F.lit(-(stop or 0.0)))).otherwise(-(stop or 0.0)))
    gross = gross.when(F.col("reason") == "target", F.when(F.col("days") > 1, F.greatest(at(F.col("days"))["open"], F.lit(target))).otherwise(target)).otherwise(at(n)["close"])
    return out.withColumn("ret", gross - cost).withColumn("hold_ret", at(F.col("days"))["close"]).drop("path", "kt", "ks", "__last")


def trade_stats(trades: DataFrame, by: list[str]) -> DataFrame:
    r, d = F.col("ret"), F.col("days")
    share = lambda w: F.avg(w.cast("double"))
    return trades.groupBy(*by).agg(
        F.count("*").alias("n"), share(r > 0).alias("hit"), share(F.col("reason") == "target").alias("target_rate"), share(F.col("reason") == "stop").alias("stop_rate"),
        F.avg(r).alias("mean_ret"), F.expr("percentile(ret, 0.5)").alias("median_ret"), F.avg(d).alias("mean_days"), F.expr("percentile(days, 0.9)").alias("p90_days"),
        (F.sum(r) / F.sum(d) * 1e4).alias("per_day_bp"), (F.sum("hold_ret") / F.sum(d) * 1e4).alias("hold_per_day_bp"), F.try_divide(F.sum(F.when(r > 0, r)), -F.sum(F.when(r < 0, r))).alias("profit_factor"),
    )


def simulate_trade(trades: DataFrame, length: int = 60) -> DataFrame:
    """trades (with path, target and stop as prices, direction) with exit_reason, bars_held, trade_ret, mfe, mae and r_multiple.

    Exits fill at the stop or target itself; excursions count up to the bar of the exit; R needs a risk above 0.3 % of the entry.
    """
    d = F.col("direction")
    rel = lambda p: d * (F.col(p) / F.col("entry") - 1)
    t = trades.withColumns({"__path": signed(F.slice("path", 1, length), d), "__t": rel("target"), "__s": rel("stop")})
    first = lambda x: F.coalesce(F.try_element_at(F.filter("__path", x), F.lit(1))["k"], F.lit(1 << 30))
    t = t.withColumns({"__ks": first(lambda b: b["low"] <= F.col("__s")), "__kt": first(lambda b: b["high"] >= F.col("__t"))})
    n = F.size("__path")
    t = t.withColumn("exit_reason", F.when((F.col("__ks") <= F.col("__kt")) & (F.col("__ks") <= n), "stop").when(F.col("__kt") <= n, "target").otherwise("time"))
    t = t.withColumn("bars_held", F.when(F.col("exit_reason") == "stop", F.col("__ks")).when(F.col("exit_reason") == "target", F.col("__kt")).otherwise(n).cast("int"))
    seen = F.slice("__path", F.lit(1), F.col("bars_held"))
    risk = F.abs(F.col("entry") - F.col("stop"))
    t = t.withColumns({
        "trade_ret": F.when(F.col("exit_reason") == "stop", F.col("__s")).when(F.col("exit_reason") == "target", F.col("__t")).otherwise(F.element_at("__path", n)["close"]),
        "mfe": F.greatest(F.lit(0.0), F.array_max(F.transform(seen, lambda b: b["high"]))), "mae": F.greatest(F.lit(0.0), -F.array_min(F.transform(seen, lambda b: b["low"]))),
    })
    return t.withColumn("r_multiple", F.when(risk > 0.003 * F.col("entry"), F.col("trade_ret") * F.col("entry") / risk)).drop("__path", "__t", "__s", "__ks", "__kt")
