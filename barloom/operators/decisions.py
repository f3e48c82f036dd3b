"""Typed decisions of a model, what of them is logged, and small views that reports need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frames import change, own, rolling
from .lookback import JOURNAL

#: Probability from which a pick or a skip is logged, and for how many bars it is held. Fixed values.
PICK, SKIP, HOLD = 0.6, 0.5, 20
ANSWERS = "action struct<choice:string,confidence:double,probabilities:map<string,double>>, cause_type struct<choice:string,confidence:double>, corporate_action struct<noul:boolean>, event_ahead struct<noul:boolean>, evidence_vs_setup struct<choice:string,confidence:double>, severity struct<score:double,confidence:double>"
#: Upper edges and labels of a day's volume, of a news day's, and of the largest of ten days. Fixed values.
DAY_BINS = [(0.8, "< 0.8x"), (1.2, "0.8-1.2x"), (2.0, "1.2-2x"), (3.0, "2-3x"), (None, "> 3x")]
NEWS_BINS = [(5.0, "3-5x"), (8.0, "5-8x"), (None, "> 8x")]
CLIMAX_BINS = [(1.5, "< 1.5x"), (3.0, "1.5-3x"), (5.0, "3-5x"), (None, "> 5x")]


def flatten(answers: DataFrame) -> DataFrame:
    """answers (symbol, json) as one flat row each; what is missing or malformed is null."""
    a = F.from_json("json", ANSWERS)
    rows = answers.select("symbol", a.alias("a"))
    p = lambda k: F.col("a.action.probabilities")[k].alias(f"p_{k}")
    return rows.select(
        "symbol", F.col("a.action.choice").alias("action"), p("buy"), p("watch"), p("skip"), F.col("a.action.confidence").alias("action_confidence"), F.col("a.cause_type.choice").alias("cause_type"), F.col("a.cause_type.confidence").alias("cause_confidence"),
        F.col("a.corporate_action.noul").alias("corporate_action"), F.col("a.event_ahead.noul").alias("event_ahead"), F.col("a.evidence_vs_setup.choice").alias("evidence"), F.col("a.evidence_vs_setup.confidence").alias("evidence_confidence"),
        F.col("a.severity.score").alias("severity"), F.col("a.severity.confidence").alias("severity_confidence"),
    )


def log_decisions(decisions: DataFrame, journal: DataFrame, prices: DataFrame, today: str, choice: str = "buy", rule: str = "jev_pick", least: float = PICK) -> DataFrame:
    """The journal's new rows: stocks of that choice with its probability at least `least`, a price (symbol, close), no open position of the rule, and no row of today."""
    p = F.col(f"p_{choice}")
    own_rows = journal.where(F.col("rule") == rule)
    taken = own_rows.where((F.col("status") != "closed") | (F.col("signal_date") == today)).select("symbol").distinct()
    rows = decisions.where((F.col("action") == choice) & (p >= least)).join(taken, "symbol", "left_anti").join(prices.where(F.col("close").isNotNull()), "symbol")
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    note = F.concat(F.lit(f"P({choice}) "), F.format_string("%.2f", p), F.lit(", cause "), show("cause_type"), F.lit(", evidence "), show("evidence"), F.lit(", severity "), show("severity"))
    own_cols = {"logged": F.lit(today), "rule": F.lit(rule), "symbol": F.col("symbol"), "signal_date": F.lit(today), "status": F.lit("open"), "ref_price": F.format_string("%.4f", "close"), "entry_date": F.lit(""), "entry_price": F.lit(""), "hold_bars": F.lit(str(HOLD)), "note": note}
    return rows.select(*[own_cols[c].alias(c) for c in JOURNAL])


def stock_state(bars: DataFrame) -> DataFrame:
    """Per symbol at its last bar: last_close, ret_6m, dist_ma200 (over fewer bars where there are fewer) and beaten_down."""
    w = own("bar_idx")
    s = bars.withColumns({"ret_6m": change("close", 126, "bar_idx"), "__mean": F.avg("close").over(w.rowsBetween(-199, 0)), "__next": F.lead("bar_idx").over(w)}).where("__next IS NULL")
    return s.select("symbol", F.col("close").alias("last_close"), "ret_6m", (F.try_divide(F.col("close"), F.col("__mean")) - 1).alias("dist_ma200"), F.coalesce((F.col("close") < F.col("__mean")) & (F.col("ret_6m") < -0.08), F.lit(False)).alias("beaten_down"))


def positioning(profiles: DataFrame) -> DataFrame:
    """profiles (symbol, shares_short, shares_short_before, short_epoch, ...) with short_change and short_date."""
    change_ = F.when((F.col("shares_short") != 0) & (F.col("shares_short_before") != 0), F.col("shares_short") / F.col("shares_short_before") - 1)
    return profiles.withColumns({"short_change": change_, "short_date": F.to_date(F.timestamp_seconds(F.nullif("short_epoch", F.lit(0))))}).drop("shares_short", "shares_short_before", "short_epoch")


def bucket(x: Column, bins: list[tuple[float | None, str]]) -> Column:
    """The label of the bin, closed on its upper edge, that a positive value falls into."""
    out = F.when(x.isNull() | (x <= 0), F.lit(None).cast("string"))
    for edge, label in bins:
        out = out.otherwise(label) if edge is None else out.when(x <= edge, label)
    return out


def volume_at(bars: DataFrame) -> DataFrame:
    """bars with vol_day, the volume over the 20-bar mean before (15 bars at least), and vol_climax, the most of the last ten bars over their 60-bar means before (40 at least), and their buckets."""
    v = F.coalesce(F.col("volume"), F.lit(0.0))
    s = bars.withColumn("__v", v)
    ratio = lambda n, least: F.try_divide(F.col("__v"), F.nullif(rolling("__v", n, least=least, lag=1, order="bar_idx"), F.lit(0.0)))
    s = s.withColumns({"vol_day": ratio(20, 15), "__r60": ratio(60, 40)}).withColumn("vol_climax", F.max("__r60").over(own("bar_idx").rowsBetween(-9, 0)))
    return s.withColumns({"day_bucket": bucket(F.col("vol_day"), DAY_BINS), "climax_bucket": bucket(F.col("vol_climax"), CLIMAX_BINS)}).drop("__v", "__r60")


def attach_dates(rows: DataFrame, bars: DataFrame, columns: list[str]) -> DataFrame:
    """rows with a day for each column of bar numbers (start_idx gives start_date); numbers beyond a series take its first or last day."""
    span = bars.groupBy("symbol").agg(F.min("bar_idx").alias("__a"), F.max("bar_idx").alias("__b"))
    out = rows.join(span, "symbol", "left")
    for c in columns:
        name = c.removesuffix("_idx") + "_date"
        out = out.withColumn("__at", F.greatest(F.least(F.col(c), F.col("__b")), F.col("__a"))).join(bars.select("symbol", F.col("bar_idx").alias("__at"), F.col("date").alias(name)), ["symbol", "__at"], "left").withColumn(name, F.when(F.col(c).isNotNull(), F.col(name))).drop("__at")
    return out.drop("__a", "__b")


def r_squared(rows: DataFrame, y: str, fitted: str, by: list[str]) -> DataFrame:
    """by, r2: the share of y's spread that fitted explains, no less than 0; 0 without spread."""
    told = rows.withColumn("__m", F.avg(y).over(Window.partitionBy(*by))).groupBy(*by).agg(F.sum((F.col(y) - F.col(fitted)) ** 2).alias("rest"), F.sum((F.col(y) - F.col("__m")) ** 2).alias("whole"))
    return told.select(*by, F.when(F.col("whole") > 0, F.greatest(F.lit(0.0), 1 - F.col("rest") / F.col("whole"))).otherwise(0.0).alias("r2"))


def match_text(matches: DataFrame) -> DataFrame:
    """matches with `text`: what a report says of each."""
    extra = lambda c, label: F.when(F.col(c).isNotNull(), F.concat(F.lit(f", {label} "), F.format_string("%.2f", c))).otherwise("")
    return matches.withColumn("text", F.concat("pattern", F.lit(" ("), "direction", F.lit(", "), "status", F.lit("), score "), F.format_string("%.2f", "score"), extra("level", "level"), extra("target", "target"), extra("stop", "stop")))
