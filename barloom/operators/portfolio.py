"""Ranked portfolios, index strategies and event portfolios, over dense panels (symbol, t, date, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frames import change, rolling, shift
from ..functions.scores import periods
from .stats import performance


def momentum(lookback: int, skip: int) -> Column:
    """Return from lookback to skip days ago."""
    late = shift("close", skip, "t") if skip else F.col("close")
    return F.try_divide(late, shift("close", lookback, "t")) - 1


def low_volatility(window: int = 60) -> Column:
    """Minus the deviation of daily returns, so that quiet stocks rank high; needs a column r1 of daily returns."""
    return -rolling("r1", window, F.stddev_samp, least=2, order="t")


def sector_residual(lookback: int, sector: str = "sector") -> Column:
    """Return less the sector's mean return of the day; needs a column rk of returns over lookback."""
    return F.col("rk") - F.avg("rk").over(Window.partitionBy("t", sector))


def ranked_backtest(dense: DataFrame, signal: Column, groups: int = 10, rebalance: str = "month", cost_bps: float = 10.0, least_names: int = 100) -> DataFrame:
    """A row for each rebalance date and group: gross, turnover and net return from the next open to the one after the next rebalance.

    Signals are ranked by value, then by symbol; group g of n holds the ranks of the g-th n-th, as
    equal-frequency cuts of the ranks make them. Group 0 is all ranked names, without costs.
    """
    when = F.trunc("date", "month") if rebalance == "month" else F.date_trunc("week", "date").cast("date")
    rows = dense.withColumns({"signal": signal, "next_open": shift("open", -1, "t"), "period": when})
    days = rows.select("t", "date", "period").distinct().groupBy("period").agg(F.max("t").alias("t"), F.max("date").alias("date"))
    order = Window.orderBy("t")  # rebalance dates are few
    days = days.withColumns({"until": F.lead("t").over(order), "k": F.row_number().over(order)}).where(F.col("until").isNotNull())
    starts = rows.join(F.broadcast(days.select("t", "until", "k")), "t").select("symbol", "date", "k", "until", "signal", F.col("next_open").alias("bought"))
    ends = rows.select("symbol", F.col("t").alias("until"), F.col("next_open").alias("sold"))
    held = starts.join(ends, ["symbol", "until"]).where(F.col("signal").isNotNull() & F.col("bought").isNotNull() & F.col("sold").isNotNull())
    day = Window.partitionBy("k")
    held = held.withColumns({"n": F.count("*").over(day), "r": F.row_number().over(day.orderBy("signal", "symbol"))}).where(F.col("n") >= least_names)
    group = F.greatest(F.lit(1), F.expr(f"CAST((( r - 1) * {groups} + n - 2) DIV (n - 1) AS INT)"))
    held = held.withColumns({"grp": F.when(F.col("n") > 1, group).otherwise(1), "ret": F.col("sold") / F.col("bought") - 1})
    # turnover: names that the same group didn't hold when it last was formed
    formed = held.select("k").distinct().withColumn("before", F.lag("k").over(Window.orderBy("k")))
    held = held.join(F.broadcast(formed), "k")
    was = held.select(F.col("k").alias("before"), "symbol", "grp", F.lit(1).alias("stayed"))
    held = held.join(was, ["before", "symbol", "grp"], "left")
    per = held.groupBy("k", "date", "grp").agg(F.avg("ret").alias("gross"), (1 - F.count("stayed") / F.count("*")).alias("turnover"), F.count("*").alias("names"))
    per = per.withColumn("net", F.col("gross") - 2 * F.col("turnover") * cost_bps / 1e4)
    everyone = held.groupBy("k", "date").agg(F.avg("ret").alias("gross"), F.count("*").alias("names")).select("k", "date", F.lit(0).alias("grp"), "gross", F.lit(0.0).alias("turnover"), "names", F.col("gross").alias("net"))
    return per.unionByName(everyone).drop("k")


def summarise_groups(backtest: DataFrame, per_year: float, split: str, groups: int) -> DataFrame:
    """Performance of each group and of the spread between the top and the bottom one, in all, train and test."""
    long = backtest.select("date", F.concat(F.lit("G"), "grp").alias("portfolio"), F.col("net").alias("r"))
    at = lambda g, c: F.max(F.when(F.col("grp") == g, F.col(c)))
    cost = lambda g: at(g, "gross") - at(g, "net")
    spread = backtest.groupBy("date").agg((at(groups, "gross") - at(1, "gross") - cost(groups) - cost(1)).alias("r")).select("date", F.lit("spread").alias("portfolio"), "r")
    rows = long.unionByName(spread).select("*", F.explode(periods(F.col("date"), split)).alias("period"))
    return performance(rows, ["period", "portfolio"], per_year)


def index_strategies(bench: DataFrame, lookback: int = 252, cost_bps: float = 5.0, mean: int = 200) -> DataFrame:
    """Daily returns of holding, of holding while the trailing return is positive, and above the mean; positions lag a day."""
    s = bench.withColumns({"daily": change("close", 1), "__trend": F.coalesce((change("close", lookback) > 0).cast("double"), F.lit(0.0)), "__above": F.coalesce((F.col("close") > rolling("close", mean)).cast("double"), F.lit(0.0))})
    s = s.withColumns({"p_trend": shift("__trend"), "p_mean": shift("__above")})
    s = s.withColumns({f"c_{k}": F.coalesce(F.abs(F.col(f"p_{k}") - shift(f"p_{k}")), F.lit(0.0)) * cost_bps / 1e4 for k in ("trend", "mean")})
    each = [("hold", F.col("daily")), *[(k, F.col(f"p_{k}") * F.col("daily") - F.col(f"c_{k}")) for k in ("trend", "mean")]]
    return s.select("date", F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), x.alias("r")) for n, x in each])).alias("x")).select("date", "x.*").where(F.col("r").isNotNull())


def volatility_managed(bench: DataFrame, target: float = 0.15, window: int = 21, most: float = 1.5, cost: float = 0.0005) -> DataFrame:
    """date, daily, exposure and managed return: exposure is target over yesterday's volatility, up to most."""
    s = bench.withColumn("daily", change("close", 1)).where(F.col("daily").isNotNull())
    s = s.withColumn("__w", F.least(F.lit(most), F.try_divide(F.lit(target), rolling("daily", window, F.stddev_samp) * 252**0.5)))
    s = s.withColumn("exposure", F.coalesce(shift("__w"), F.lit(0.0)))
    return s.select("symbol", "date", "daily", "exposure", (F.col("exposure") * F.col("daily") - F.coalesce(F.abs(F.col("exposure") - shift("exposure")), F.lit(0.0)) * cost).alias("managed"))


def turn_of_month(bench: DataFrame, split: str, last_n: int = 4, first_n: int = 3) -> DataFrame:
    """Daily returns inside and outside the days around the turn of the month, by period, with Welch's t."""
    month = Window.partitionBy(F.trunc("date", "month"))
    s = bench.withColumn("r", change("close", 1)).where(F.col("r").isNotNull()).withColumns({"pos": F.row_number().over(month.orderBy("date")), "size": F.count("*").over(month)})
    s = s.withColumn("inside", (F.col("pos") <= first_n) | (F.col("pos") > F.col("size") - last_n)).select("*", F.explode(periods(F.col("date"), split)).alias("period"))
    a, b = F.when(F.col("inside"), F.col("r")), F.when(~F.col("inside"), F.col("r"))
    error = F.sqrt(F.var_samp(a) / F.count(a) + F.var_samp(b) / F.count(b))
    return s.groupBy("period").agg(
        F.count(a).alias("days_in"), F.count(b).alias("days_out"), F.avg(a).alias("mean_in"), F.avg(b).alias("mean_out"),
        F.try_divide(F.avg(a) - F.avg(b), error).alias("t_diff"), F.avg(F.col("inside").cast("double")).alias("share_invested"),
    )


def overnight_intraday(dense: DataFrame, bench: DataFrame, split: str) -> DataFrame:
    """Performance of the two legs of a day, for the equal-weight universe and the benchmark."""
    legs = lambda o: {"overnight": F.try_divide(F.col("open"), shift("close", 1, o)) - 1, "intraday": F.try_divide(F.col("close"), F.col("open")) - 1}
    stocks = dense.withColumns(legs("t")).groupBy("date").agg(F.avg("overnight").alias("overnight"), F.avg("intraday").alias("intraday")).withColumn("series", F.lit("universe"))
    index = bench.withColumns(legs("date")).select("date", "overnight", "intraday", F.lit("bench").alias("series"))
    both = stocks.unionByName(index).select("series", "date", F.explode(F.array(*[F.struct(F.lit(k).alias("leg"), F.col(k).alias("r")) for k in ("overnight", "intraday")])).alias("x")).select("series", "date", "x.*")
    return performance(both.select("*", F.explode(periods(F.col("date"), split)).alias("period")), ["series", "leg", "period"], 252.0)


def event_curve(events: DataFrame, dense: DataFrame, hold: int = 3, cost: float = 0.0005) -> DataFrame:
    """Daily equal-weight returns of all events held hold days from the next open (events: symbol, t, direction)."""
    w = Window.partitionBy("symbol").orderBy("t")
    days = []
    for k in range(hold):
        start = F.lead("open", 1).over(w) if k == 0 else F.lead("close", k).over(w)
        days.append(F.struct(F.lead("date", k + 1).over(w).alias("date"), (F.try_divide(F.lead("close", k + 1).over(w), start) - 1).alias("r"), F.lit(cost if k == 0 else 0.0).alias("c")))
    last = F.max("t").over(Window.partitionBy("symbol"))
    path = dense.select("symbol", "t", F.array(*days).alias("path"), (F.col("t") + 1 + hold < last + 1).alias("whole"))
    each = events.join(path, ["symbol", "t"]).where("whole").select("direction", F.explode("path").alias("d"))
    return each.groupBy(F.col("d.date").alias("date")).agg(F.avg(F.col("direction") * F.col("d.r") - F.col("d.c")).alias("r"), F.count("*").alias("positions")).where(F.col("r").isNotNull())
