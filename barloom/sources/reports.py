"""Dated reports, feeds and pages as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def markdown_tables(texts: DataFrame) -> DataFrame:
    """texts (id, text): a row for each table row, with its section (the last ## heading), and cells by column name."""
    lines = texts.select("id", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    w = Window.partitionBy("id").orderBy("line")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    s = lines.withColumns({"section": F.last(F.when(F.col("value").rlike(r"^##+ "), F.regexp_replace("value", r"^#+\s+", "")), ignorenulls=True).over(so_far), "is_row": F.col("value").rlike(r"^\s*\|"), "rule": F.col("value").rlike(r"^\s*\|[\s:|-]+$")})
    s = s.withColumns({"head": F.when(F.lead("rule").over(w) & F.col("is_row"), cells), "cells": F.when(F.col("is_row"), cells)})
    s = s.withColumn("names", F.last("head", ignorenulls=True).over(so_far)).where(F.col("is_row") & ~F.col("rule") & F.col("head").isNull())
    same = F.size("names") == F.size("cells")
    return s.where(same).select("id", "section", "line", F.map_from_arrays("names", "cells").alias("row"))


def rss_items(texts: DataFrame) -> DataFrame:
    """texts (id, text): title without its publisher suffix, publisher and day of each item of a feed."""
    item = F.explode(F.regexp_extract_all("text", F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1)))
    rows = texts.select("id", item.alias("item"))
    get = lambda tag: F.regexp_extract("item", rf"(?s)<{tag}[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{tag}>", 1)
    out = rows.select("id", get("title").alias("full"), get("source").alias("publisher"), F.to_date(F.try_to_timestamp(F.substring(get("pubDate"), 6, 20), F.lit("dd MMM yyyy HH:mm:ss"))).alias("date"))
    return out.select("id", F.when(F.col("publisher") != "", F.regexp_replace("full", F.concat(F.lit(r"\s+-\s+\Q"), "publisher", F.lit(r"\E$")), "")).otherwise(F.col("full")).alias("title"), "publisher", "date")


def daily_index(spark: SparkSession, path: str, ciks: DataFrame) -> DataFrame:
    """Form 4 lines of daily filing indexes for the wanted companies (cik)."""
    parts = F.split("value", r"\s{2,}")
    rows = spark.read.text(path).where(F.col("value").rlike(r"^4\s")).select(F.get(parts, F.lit(1)).alias("company"), F.get(parts, F.lit(2)).cast("long").alias("cik"), F.get(parts, F.lit(3)).alias("day"), F.get(parts, F.lit(4)).alias("file"))
    return rows.join(ciks, "cik", "left_semi")


def form4_trades(texts: DataFrame) -> DataFrame:
    """texts (id, text): symbol, owner, code, day, shares and price of each trade of an ownership document."""
    path = lambda p: F.xpath_string("text", F.lit(p))
    one = "/ownershipDocument/nonDerivativeTable/nonDerivativeTransaction"
    many = lambda p: F.xpath("text", F.lit(f"{one}/{p}/text()"))
    cols = {"code": "transactionCoding/transactionCode", "day": "transactionDate/value", "shares": "transactionAmounts/transactionShares/value", "price": "transactionAmounts/transactionPricePerShare/value"}
    rows = texts.select("id", path("/ownershipDocument/issuer/issuerTradingSymbol").alias("symbol"), path("/ownershipDocument/reportingOwner/reportingOwnerId/rptOwnerCik").alias("owner"), F.explode(F.arrays_zip(*[many(p).alias(k) for k, p in cols.items()])).alias("t"))
    return rows.select("id", "symbol", "owner", "t.code", F.expr("try_cast(t.day AS date)").alias("trans_date"), F.expr("try_cast(t.shares AS double)").alias("shares"), F.expr("try_cast(t.price AS double)").alias("price"))


def link_targets(pages: DataFrame) -> DataFrame:
    """pages (page_id, html): how many links each page has and to how many different targets."""
    links = F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.size(links).alias("n_links"), F.size(F.array_distinct(links)).alias("n_targets"))
