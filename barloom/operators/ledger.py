"""Journal, mark-to-market, first appearances, scorecards; insider trades; growth scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .events import as_of, cooldown
from .stats import labelled

SIGNALS = "rule string, symbol string, signal_date date, hold_bars int"


def mark_to_market(journal: DataFrame, bars: DataFrame, bench: DataFrame) -> DataFrame:
    """journal (rule, symbol, signal_date, hold_bars) with entry, last price, return, benchmark and whether it is done.

    Entry is the open of the bar after the first one on or after the signal's day; the exit is the
    close hold bars on, or the last one.
    """
    rich = bars.join(bench.select("date", F.col("open").alias("b_open"), F.col("close").alias("b_close")), "date", "left")
    place = as_of(journal.withColumn("event_date", F.col("signal_date")), rich.select("symbol", "date"), forward=True, strict=False).withColumnRenamed("date", "seen")
    at = place.join(rich.select("symbol", F.col("date").alias("seen"), F.col("bar_idx").alias("pos")), ["symbol", "seen"], "left")
    last = bars.groupBy("symbol").agg(F.max("bar_idx").alias("last"))
    at = at.join(last, "symbol", "left").withColumns({"e": F.col("pos") + 1, "x": F.least(F.col("last"), F.col("pos") + F.col("hold_bars"))})
    side = lambda p, k: rich.select("symbol", F.col("bar_idx").alias(k), F.col("date").alias(f"{p}_date"), F.col("open").alias(f"{p}_open"), F.col("close").alias(f"{p}_close"), F.col("b_open").alias(f"{p}_b_open"), F.col("b_close").alias(f"{p}_b_close"))
    out = at.join(side("e", "e"), ["symbol", "e"], "left").join(side("x", "x"), ["symbol", "x"], "left")
    entered = F.col("e") <= F.col("last")
    return out.select(
        "rule", "symbol", "signal_date", "hold_bars", F.when(entered, F.col("e_date")).alias("entry_date"), F.when(entered, F.col("e_open")).alias("entry_price"),
        F.when(entered, F.col("x") - F.col("e") + 1).alias("bars_elapsed"), F.when(entered, F.try_divide(F.col("x_close"), F.col("e_open")) - 1).alias("ret"),
        F.when(entered, F.try_divide(F.col("x_b_close"), F.col("e_b_open")) - 1).alias("bench_ret"), F.coalesce(entered & (F.col("e") + F.col("hold_bars") - 1 <= F.col("last")), F.lit(False)).alias("done"),
    )


def new_signals(collected: DataFrame, journal: DataFrame) -> DataFrame:
    """Signals that aren't logged yet and whose symbol has no open position under the rule (journal: rule, symbol, signal_date, done)."""
    logged = journal.select("rule", "symbol", "signal_date")
    open_now = journal.where(~F.col("done")).select("rule", "symbol").distinct()
    return collected.dropDuplicates(["rule", "symbol", "signal_date"]).join(logged, ["rule", "symbol", "signal_date"], "left_anti").join(open_now, ["rule", "symbol"], "left_anti")


def rule_summary(marked: DataFrame) -> DataFrame:
    held = marked.where(F.col("ret").isNotNull())
    return held.groupBy("rule").agg(
        F.count("*").alias("n"), F.count_if("done").alias("closed"), F.avg("ret").alias("mean"), F.expr("percentile(ret, 0.5)").alias("median"), F.avg((F.col("ret") > 0).cast("double")).alias("hit"),
        F.max("ret").alias("best"), F.min("ret").alias("worst"), F.avg(F.col("ret") - F.col("bench_ret")).alias("excess"),
    )


def first_seen(reports: DataFrame) -> DataFrame:
    """reports (date, section, symbol, ...): the first appearance of each section and symbol, and on how many days it was listed."""
    rest = [c for c in reports.columns if c not in ("section", "symbol")]
    return reports.groupBy("section", "symbol").agg(F.min_by(F.struct(*rest), F.struct(*rest)).alias("first"), F.countDistinct("date").alias("n_days")).select("section", "symbol", "n_days", "first.*")


def scorecard(events: DataFrame, labels: list[tuple[str, Column]], h: int, least: int = 4) -> DataFrame:
    return labelled(events, labels, h, least)


def changes(now: DataFrame, before: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows whose value changed, appeared or went."""
    old = before.select(*keys, F.col(value).alias("before"))
    joined = now.select(*keys, F.col(value).alias("now")).join(old, keys, "full_outer")
    return joined.where(~F.col("now").eqNullSafe(F.col("before")))


def replace_day(log: DataFrame, rows: DataFrame, day: str = "date") -> DataFrame:
    """The log with the days of rows replaced by rows."""
    return log.join(rows.select(day).distinct(), day, "left_anti").unionByName(rows)


# --- insiders ----------------------------------------------------------------


def join_filings(submissions: DataFrame, owners: DataFrame, trades: DataFrame) -> DataFrame:
    """Open-market trades of officers and directors from the three tables of a filing set, one row for each trade."""
    t = trades.where(F.col("TRANS_CODE").isin("P", "S"))
    joined = t.join(submissions, "ACCESSION_NUMBER").join(owners, "ACCESSION_NUMBER")
    role = F.lower(F.coalesce("RPTOWNER_RELATIONSHIP", F.lit("")))
    number = lambda c: F.expr(f"try_cast({c} AS double)")
    day = lambda c: F.try_to_date(F.col(c), F.lit("dd-MMM-yyyy"))
    out = joined.select(
        F.col("ACCESSION_NUMBER").alias("accession"), F.upper("ISSUERTRADINGSYMBOL").alias("symbol"), F.col("RPTOWNERCIK").alias("owner"), F.col("TRANS_CODE").alias("code"),
        day("FILING_DATE").alias("filing_date"), day("TRANS_DATE").alias("trans_date"), number("TRANS_SHARES").alias("shares"), number("TRANS_PRICEPERSHARE").alias("price"),
        F.lower(F.coalesce("RPTOWNER_TITLE", F.lit(""))).rlike("chief executive|chief financial|\\bceo\\b|\\bcfo\\b").alias("ceo_cfo"), role.rlike("officer|director").alias("inside"),
    ).withColumn("value", F.col("shares") * F.col("price"))
    return out.where(F.col("inside") & F.col("filing_date").isNotNull() & F.col("trans_date").isNotNull() & (F.col("value") > 0)).drop("inside").dropDuplicates(["accession", "owner", "trans_date", "code", "shares", "price"])


def insider_clusters(trades: DataFrame, window_days: int = 30, least_insiders: int = 2, least_value: float = 0.0, code: str = "P") -> DataFrame:
    """Days on which enough different insiders traded within the window, window days apart per symbol."""
    t = trades.where((F.col("code") == code) & (F.col("value") >= least_value)).withColumn("day", F.unix_date("filing_date"))
    w = Window.partitionBy("symbol").orderBy("day").rangeBetween(-(window_days - 1), 0)
    hits = t.withColumns({"n_insiders": F.size(F.collect_set("owner").over(w)), "n_trades": F.count("*").over(w), "total_value": F.sum("value").over(w)}).where(F.col("n_insiders") >= least_insiders)
    hits = hits.select("symbol", F.col("filing_date").alias("date"), "day", "n_insiders", "n_trades", "total_value").distinct()
    return cooldown(hits, ["symbol"], window_days, "day").drop("day")


def insider_singles(trades: DataFrame, least_value: float = 100_000.0, code: str = "P", gap_days: int = 30) -> DataFrame:
    """Days with a large trade, gap days apart per symbol, with the day's largest value."""
    t = trades.where((F.col("code") == code) & (F.col("value") >= least_value)).withColumn("day", F.unix_date("filing_date"))
    return cooldown(t.groupBy("symbol", F.col("filing_date").alias("date"), "day").agg(F.max("value").alias("total_value")), ["symbol"], gap_days, "day").drop("day")


def insider_signals(trades: DataFrame, least_value: float = 100_000.0, days: int = 30) -> DataFrame:
    """Per symbol: last filing, insiders of the days before it, purchases, value, mean price paid, cluster."""
    buys = trades.where((F.col("code") == "P") & (F.col("value") >= least_value))
    latest = F.max("filing_date").over(Window.partitionBy("symbol"))
    rows = buys.withColumn("last_filing", latest).withColumn("__recent", F.when(F.col("filing_date") > F.date_sub("last_filing", days), F.col("owner")))
    out = rows.groupBy("symbol", "last_filing").agg(F.countDistinct("__recent").alias("n_insiders_30d"), F.count("*").alias("n_buys"), F.sum("value").alias("total_value"), (F.sum("value") / F.sum("shares")).alias("avg_price"))
    return out.withColumn("cluster", F.col("n_insiders_30d") >= 2)


# --- growth ------------------------------------------------------------------


def percentile_rank(x: Column, by: list[str] | None = None, higher: bool = True) -> Column:
    """Average rank among non-null values over their count; ties share their mean rank."""
    sign = x if higher else -x
    own = Window.partitionBy(*(by or []))
    rank = F.rank().over(own.orderBy(sign.asc_nulls_last())) + (F.count(x).over(Window.partitionBy(*(by or []), x)) - 1) / 2
    return F.when(x.isNotNull(), rank / F.count(x).over(own))


def block_score(rows: DataFrame, blocks: dict[str, list[tuple[str, bool]]], weights: dict[str, float]) -> DataFrame:
    """rows with a score for each block, the mean of its known percentile ranks, and their weighted sum."""
    ranked = rows.withColumns({f"__{b}_{c}": percentile_rank(F.col(c), higher=up) for b, cols in blocks.items() for c, up in cols})
    mean = {}
    for b, cols in blocks.items():
        parts = F.filter(F.array(*[F.col(f"__{b}_{c}") for c, _ in cols]), lambda v: v.isNotNull())
        mean[f"{b}_score"] = F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, v: a + v) / F.size(parts))
    scored = ranked.withColumns(mean).drop(*[f"__{b}_{c}" for b, cols in blocks.items() for c, _ in cols])
    return scored.withColumn("score", sum((F.coalesce(F.col(f"{b}_score"), F.lit(0.0)) * w for b, w in weights.items()), F.lit(0.0)))


def capped_top(scored: DataFrame, n: int = 10, most: int = 3, sector: str = "sector", key: str = "symbol") -> DataFrame:
    """The n best with at most `most` of a sector."""
    own = Window.partitionBy(sector).orderBy(F.desc("score"), key)
    return scored.withColumn("__r", F.row_number().over(own)).where(F.col("__r") <= most).drop("__r").orderBy(F.desc("score"), key).limit(n)


def fundamentals(facts: DataFrame) -> DataFrame:
    """Features per symbol from facts (symbol, type, date, value): growth over a year and three years, twelve-month sums, margins."""
    own = Window.partitionBy("symbol", "type").orderBy(F.desc("date"))
    f = facts.where(F.col("value").isNotNull()).withColumn("k", F.row_number().over(own))
    at = lambda t, k: F.max(F.when((F.col("type") == t) & (F.col("k") == k), F.col("value")))
    ttm = lambda t: F.when(F.count_if((F.col("type") == t) & (F.col("k") <= 4)) == 4, F.sum(F.when((F.col("type") == t) & (F.col("k") <= 4), F.col("value"))))
    g = f.groupBy("symbol").agg(
        (F.try_divide(at("quarterlyTotalRevenue", 1), at("quarterlyTotalRevenue", 5)) - 1).alias("rev_yoy_q"), ttm("quarterlyTotalRevenue").alias("rev_ttm"), ttm("quarterlyOperatingIncome").alias("op_ttm"), ttm("quarterlyFreeCashFlow").alias("fcf_ttm"),
        (F.pow(F.try_divide(at("annualTotalRevenue", 1), at("annualTotalRevenue", 4)), 1 / 3) - 1).alias("rev_cagr_3y"), at("quarterlyStockholdersEquity", 1).alias("equity"), ttm("quarterlyNetIncome").alias("net_ttm"),
    )
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return g.withColumns({"op_margin": ratio("op_ttm", "rev_ttm"), "fcf_margin": ratio("fcf_ttm", "rev_ttm"), "roe": ratio("net_ttm", "equity"), "rule_of_40": F.col("rev_yoy_q") + ratio("fcf_ttm", "rev_ttm")})


def missing_quarter(facts: DataFrame) -> DataFrame:
    """facts (symbol, year, quarter 0 for the whole year, value) with the fourth quarter as the year less the other three."""
    q = facts.where("quarter BETWEEN 1 AND 3").groupBy("symbol", "year").agg(F.sum("value").alias("three"), F.count("*").alias("n")).where("n = 3")
    have = facts.where("quarter = 4").select("symbol", "year")
    made = facts.where("quarter = 0").join(q, ["symbol", "year"]).join(have, ["symbol", "year"], "left_anti").select("symbol", "year", F.lit(4).alias("quarter"), (F.col("value") - F.col("three")).alias("value"))
    return facts.unionByName(made)
