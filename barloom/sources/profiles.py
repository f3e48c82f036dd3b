"""Symbols and what is known about them, from files that were fetched elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def quarters(spark: SparkSession, start: str = "2016-01-01", end: str | None = None) -> DataFrame:
    """Quarter tags like 2016q1, from start's quarter to end's (today's)."""
    last = F.lit(end).cast("date") if end else F.current_date()
    days = spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "quarter"), last, F.expr("INTERVAL 3 MONTHS"))).alias("day"))
    return days.select(F.concat(F.year("day").cast("string"), F.lit("q"), F.quarter("day").cast("string")).alias("tag"), "day")


def universe(lists: DataFrame, name: str = "all") -> DataFrame:
    """lists (symbol, name, sector, list): one row a symbol, of one list or of all; sp500 names come before others."""
    rows = lists if name == "all" else lists.where(F.col("list") == name)
    first = Window.partitionBy("symbol").orderBy(F.when(F.col("list") == "sp500", 0).otherwise(1), "list")
    return rows.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r", "list")


def liquid(bars: DataFrame, least_dollars: float, least_bars: int = 260, days: int = 60) -> DataFrame:
    """Symbols with enough bars whose median daily turnover of the last days is high enough."""
    back = Window.partitionBy("symbol").orderBy(F.desc("date"))
    recent = bars.withColumns({"__r": F.row_number().over(back), "__n": F.count("*").over(Window.partitionBy("symbol"))})
    out = recent.where(F.col("__r") <= days).groupBy("symbol").agg(F.first("__n").alias("bars"), F.expr("percentile(close * volume, 0.5)").alias("dollars"))
    return out.where((F.col("bars") >= least_bars) & (F.col("dollars") >= least_dollars))


def filings_8k(texts: DataFrame) -> DataFrame:
    """texts (symbol, text: the recent filings as parallel arrays): day and item codes of each 8-K, exhibits left out."""
    f = F.from_json("text", "filings struct<recent:struct<form:array<string>,filingDate:array<string>,items:array<string>>>")["filings"]["recent"]
    rows = texts.select("symbol", F.explode(F.arrays_zip(f["form"].alias("form"), f["filingDate"].alias("day"), f["items"].alias("items"))).alias("x"))
    return rows.where(F.col("x.form") == "8-K").select("symbol", F.expr("try_cast(x.day AS date)").alias("date"), F.array_except(F.split("x.items", ","), F.array(F.lit("9.01"))).alias("items"))


def quote_profile(texts: DataFrame) -> DataFrame:
    """texts (symbol, text: a quote summary): short interest, holders and targets; numbers stand in {raw, fmt}."""
    raw = "struct<raw:double>"
    schema = f"defaultKeyStatistics struct<sharesShort:{raw},sharesShortPriorMonth:{raw},shortPercentOfFloat:{raw},heldPercentInsiders:{raw},heldPercentInstitutions:{raw}>, financialData struct<targetMeanPrice:{raw},currentPrice:{raw},numberOfAnalystOpinions:{raw}>"
    j = texts.select("symbol", F.from_json("text", schema).alias("j"))
    k, f = "j.defaultKeyStatistics", "j.financialData"
    return j.select(
        "symbol", F.col(f"{k}.shortPercentOfFloat.raw").alias("short_pct"), (F.try_divide(F.col(f"{k}.sharesShort.raw"), F.col(f"{k}.sharesShortPriorMonth.raw")) - 1).alias("short_change"),
        F.col(f"{k}.heldPercentInsiders.raw").alias("insiders"), F.col(f"{k}.heldPercentInstitutions.raw").alias("institutions"),
        (F.try_divide(F.col(f"{f}.targetMeanPrice.raw"), F.col(f"{f}.currentPrice.raw")) - 1).alias("upside"), F.col(f"{f}.numberOfAnalystOpinions.raw").cast("int").alias("analysts"),
    )


def crowd(texts: DataFrame) -> DataFrame:
    """texts (symbol, text: a message stream): messages, and how many are bullish or bearish."""
    m = F.from_json("text", "messages array<struct<entities:struct<sentiment:struct<basic:string>>>>")["messages"]
    rows = texts.select("symbol", F.explode_outer(m).alias("m"))
    said = F.col("m.entities.sentiment.basic")
    return rows.groupBy("symbol").agg(F.count("m").alias("n"), F.count_if(said == "Bullish").alias("bullish"), F.count_if(said == "Bearish").alias("bearish"))


def fundamentals_facts(texts: DataFrame) -> DataFrame:
    """texts (symbol, text: a fundamentals time series): type, date and value of each reported number."""
    entry = F.from_json("text", "timeseries struct<result:array<map<string,string>>>")["timeseries"]["result"]
    rows = texts.select("symbol", F.explode(entry).alias("m")).select("symbol", F.explode("m").alias("type", "body")).where(~F.col("type").isin("meta", "timestamp"))
    value = F.explode(F.from_json("body", "array<struct<asOfDate:string,reportedValue:struct<raw:double>>>"))
    return rows.select("symbol", "type", value.alias("v")).select("symbol", "type", F.expr("try_cast(v.asOfDate AS date)").alias("date"), F.col("v.reportedValue.raw").alias("value")).where("value IS NOT NULL")


def company_tokens(name: F.Column) -> F.Column:
    """Words that tell a company's name apart."""
    common = ["inc", "corp", "corporation", "company", "co", "the", "group", "holdings", "plc", "ltd", "class", "a", "b", "common", "stock", "and"]
    return F.filter(F.split(F.lower(F.regexp_replace(name, r"[^A-Za-z0-9 ]", " ")), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(common))
