"""What is said of a stock beside its price: analysts, earnings, fundamentals, and the read that adds up the signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frames import change, own, rolling, shift

#: Ratings from best to worst, upper edges of the mean rating for each name, and days of actions. Fixed values.
RATINGS = ["strong_buy", "buy", "hold", "sell", "strong_sell"]
EDGES = [1.5, 2.5, 3.5, 4.5]
RECENT_DAYS, YEAR_DAYS = 90, 365


def rating_of(mean: Column) -> Column:
    out = F.lit(RATINGS[-1])
    for edge, name in reversed(list(zip(EDGES, RATINGS))):
        out = F.when(mean < edge, name).otherwise(out)
    return F.when(mean.isNotNull(), out)


def analyst_view(profiles: DataFrame, ratings: DataFrame, actions: DataFrame, today: str) -> DataFrame:
    """Per symbol of profiles (rating, mean, n, price, target): rating, mean, n, upside, the share of buys now and three months ago, and counts of upgrades, downgrades, target cuts and raises in 90 days.

    ratings: symbol, months_ago (0 or 3), and a count for each of RATINGS. actions: symbol, date, action,
    target_action. A missing rating follows from the mean, a missing mean from the counts.
    """
    total = sum((F.coalesce(F.col(r), F.lit(0)) for r in RATINGS), F.lit(0))
    weighed = sum((k * F.coalesce(F.col(r), F.lit(0)) for k, r in enumerate(RATINGS, 1)), F.lit(0))
    each = ratings.select("symbol", "months_ago", total.alias("total"), F.try_divide(F.coalesce("strong_buy", F.lit(0)) + F.coalesce("buy", F.lit(0)), total).alias("bulls"), F.try_divide(weighed.cast("double"), total).alias("counted"))
    at = lambda m, c: F.max(F.when(F.col("months_ago") == m, F.col(c)))
    shares = each.groupBy("symbol").agg(at(0, "bulls").alias("bullish_now"), at(3, "bulls").alias("bullish_3m"), at(0, "counted").alias("__counted"), at(0, "total").alias("__total"))
    now = F.lit(today).cast("date")
    recent = actions.where(F.col("date").between(F.date_sub(now, RECENT_DAYS), now))
    count = recent.groupBy("symbol").agg(F.count_if(F.col("action") == "up").alias("n_up"), F.count_if(F.col("action") == "down").alias("n_down"), F.count_if(F.col("target_action") == "Lowers").alias("n_target_cuts"), F.count_if(F.col("target_action") == "Raises").alias("n_target_raises"))
    rows = profiles.join(shares, "symbol", "left").join(count, "symbol", "left").fillna(0, ["n_up", "n_down", "n_target_cuts", "n_target_raises"])
    told = F.nullif(F.col("rating"), F.lit("none"))
    mean = F.coalesce("mean", "__counted")
    return rows.select(
        "symbol", F.coalesce(told, rating_of(mean)).alias("rating"), mean.alias("mean"), F.coalesce(F.nullif("n", F.lit(0)), F.nullif("__total", F.lit(0))).alias("n"), (F.try_divide(F.nullif("target", F.lit(0.0)), F.col("price")) - 1).alias("upside"),
        "bullish_now", "bullish_3m", "n_up", "n_down", "n_target_cuts", "n_target_raises",
    )


def earnings_view(history: DataFrame, estimates: DataFrame) -> DataFrame:
    """Per symbol: the last quarter reported with its surprise, beats among the last four, and how the year's estimate was revised.

    history: symbol, quarter, eps, estimate, surprise. estimates: symbol, period (0q, 0y), current, ago_30, ago_90, up_30, down_30.
    """
    told = history.where(F.col("eps").isNotNull()).withColumn("__r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc_nulls_last("quarter"))))
    last = told.where("__r = 1").select("symbol", F.col("quarter").alias("last_quarter"), "eps", "estimate", "surprise")
    four = told.where("__r <= 4").groupBy("symbol").agg(F.count_if(F.col("surprise") > 0).alias("beats_4q"), F.count("*").alias("n_4q"))
    of = lambda p, c: F.max(F.when(F.col("period") == p, c))
    moved = lambda ago: F.when(F.col(ago) != 0, F.col("current") / F.col(ago) - 1)
    trend = estimates.groupBy("symbol").agg(
        of("0y", moved("ago_30")).alias("year_rev_30d"), of("0y", moved("ago_90")).alias("year_rev_90d"), of("0q", moved("ago_30")).alias("quarter_rev_30d"),
        of("0y", F.coalesce("up_30", F.lit(0))).alias("up_30"), of("0y", F.coalesce("down_30", F.lit(0))).alias("down_30"),
    )
    return last.join(four, "symbol").join(trend, "symbol", "full_outer")


def fundamentals_view(profiles: DataFrame) -> DataFrame:
    """profiles (free_cashflow, market_cap, debt_to_equity in percent, ...) with fcf_yield and debt to equity as a ratio."""
    return profiles.withColumns({"fcf_yield": F.try_divide("free_cashflow", F.nullif("market_cap", F.lit(0.0))), "debt_to_equity": F.col("debt_to_equity") / 100})


def trend_context(bars: DataFrame) -> DataFrame:
    """Per symbol at its last bar: distance from the 50-bar mean and whether that rises, a higher low, and a new low of the year within five bars."""
    w = own("bar_idx")
    low = F.min("close").over(w.rowsBetween(-251, 0))
    s = bars.withColumn("ma50", rolling("close", 50, order="bar_idx"))
    s = s.withColumns({
        "dist_ma50": F.try_divide(F.col("close"), F.col("ma50")) - 1, "ma50_rising": F.col("ma50") > shift("ma50", 20, "bar_idx"), "ret_6m": change("close", 126, "bar_idx"),
        "higher_low": F.min("close").over(w.rowsBetween(-19, 0)) > F.when(F.row_number().over(w) >= 40, F.min("close").over(w.rowsBetween(-39, -20))),
        "new_low": F.min("close").over(w.rowsBetween(-4, 0)) <= low, "__last": F.max("bar_idx").over(Window.partitionBy("symbol")),
    })
    return s.where("bar_idx = __last").select("symbol", "dist_ma50", "ma50_rising", "higher_low", "new_low", "ret_6m")


def signals() -> list[tuple[str, float, Column]]:
    """Code, points and condition of each signal of the read. Fixed values."""
    c = F.col
    return [
        ("above_ma50", 1.0, c("dist_ma50") > 0), ("below_ma50", -1.0, c("dist_ma50") <= 0), ("ma50_up", 1.0, c("ma50_rising")), ("higher_low", 1.0, c("higher_low")), ("new_low", -1.0, c("new_low")),
        ("consensus_buy", 1.0, c("rating").isin("strong_buy", "buy")), ("consensus_sell", -1.0, c("rating").isin("sell", "underperform", "strong_sell")), ("target_far", 1.0, c("upside") > 0.20), ("target_near", -1.0, c("upside") < 0.05),
        ("more_upgrades", 1.0, c("n_up") > c("n_down")), ("more_downgrades", -1.0, c("n_down") > c("n_up")), ("target_cuts", -1.0, c("n_target_cuts") >= c("n_target_raises") + 3), ("target_raises", 1.0, c("n_target_raises") >= c("n_target_cuts") + 3),
        ("revisions_down", -0.5, c("down_30") >= c("up_30") + 3), ("revisions_up", 0.5, c("up_30") >= c("down_30") + 3), ("eps_raised", 1.0, c("year_rev_30d") > 0.01), ("eps_cut", -1.0, c("year_rev_30d") < -0.01),
        ("beat", 0.5, c("surprise") > 0), ("miss", -1.0, c("surprise") < 0), ("revenue_up", 0.5, c("revenue_growth") > 0), ("revenue_down", -0.5, c("revenue_growth") < 0), ("fcf_positive", 0.5, c("free_cashflow") > 0), ("fcf_negative", -0.5, c("free_cashflow") < 0),
        ("leverage", -0.5, c("debt_to_equity") > 2), ("forward_pe_lower", 0.5, (c("pe") != 0) & (c("forward_pe") != 0) & (c("forward_pe") < c("pe"))), ("insiders", 1.0, c("insider_buying")), ("peer_oversold", 0.5, c("z") <= -2),
    ]


def read(stocks: DataFrame, rules: list[tuple[str, float, Column]] | None = None) -> DataFrame:
    """stocks with fired (codes in order), score and read: up from 3 points on, down to -2, else flat. Columns that are not there count as unknown."""
    wanted = ["dist_ma50", "rating", "upside", "n_up", "n_down", "n_target_cuts", "n_target_raises", "up_30", "down_30", "year_rev_30d", "surprise", "revenue_growth", "free_cashflow", "debt_to_equity", "pe", "forward_pe", "z"]
    full = stocks.withColumns({c: F.lit(None).cast("string" if c == "rating" else "double") for c in wanted if c not in stocks.columns} | {c: F.lit(False) for c in ("ma50_rising", "higher_low", "new_low", "insider_buying") if c not in stocks.columns})
    met = F.filter(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(points).alias("points"))) for code, points, when in (signals() if rules is None else rules)]), lambda x: x.isNotNull())
    out = full.withColumn("__met", met).withColumns({"fired": F.transform("__met", lambda m: m["code"]), "score": F.aggregate("__met", F.lit(0.0), lambda a, m: a + m["points"])})
    return out.withColumn("read", F.when(F.col("score") >= 3, "up").when(F.col("score") <= -2, "down").otherwise("flat")).drop("__met")


def read_lines(rows: DataFrame) -> DataFrame:
    """rows with `lines`: the points and code of each signal that fired."""
    points = F.create_map(*[F.lit(x) for code, p, _ in signals() for x in (code, f"{p:+g}")])
    return rows.withColumn("lines", F.transform("fired", lambda code: F.concat_ws(" ", F.element_at(points, code), code)))


def summary_order(rows: DataFrame) -> DataFrame:
    """rows with place: up before flat before down, each by falling score, then symbol."""
    rank = F.when(F.col("read") == "up", 0).when(F.col("read") == "flat", 1).otherwise(2)
    by_read = Window.partitionBy("read").orderBy(F.desc("score"), "symbol")
    counts = rows.groupBy("read").count().withColumn("__rank", rank).withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # three rows
    return rows.withColumn("__own", F.row_number().over(by_read)).join(F.broadcast(counts.select("read", "__before")), "read").withColumn("place", (F.col("__before") + F.col("__own")).cast("int")).drop("__own", "__before")
