"""Dated reports read back: sections by heading, flags from cells, the journal's file, and signals collected from the live lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import number

#: How a heading of the third or second level begins, and the section that it opens; the first that fits counts. Fixed values.
THIRD = [
    ("beaten-down stocks", "insider_beaten"), ("other stocks with insider", "insider_other"), ("news-day", "newsday"), ("watch list", "wedge_watch"), ("falling wedge", "wedge"), ("early rally", "early_rally"),
    ("crossed above the 200-day", "ma200_cross"), ("ai decisions", "jev"), ("model decisions", "jev"), ("checklist", "checklist"),
]
SECOND = [("3. growth screen", "growth"), ("3. stock briefs", "briefs")]
#: Columns of the journal's file, and for how many bars each rule holds. Fixed values.
JOURNAL = ["logged", "rule", "symbol", "signal_date", "status", "ref_price", "entry_date", "entry_price", "hold_bars", "note"]
HOLD = {"newsday": 60, "falling_wedge_beaten_down": 20, "insider_buy_beaten_down": 120, "jev_pick": 20, "jev_skip": 20, "early_rally_beaten_down": 20}


def section_of(second: Column, third: Column) -> Column:
    """The section that headings open; null for any other."""
    cases = [(F.lower(F.coalesce(third, F.lit(""))), THIRD), (F.lower(F.coalesce(second, F.lit(""))), SECOND)]
    return F.coalesce(*[F.when(F.startswith(text, F.lit(start)), F.lit(name)) for text, table in cases for start, name in table])


def report_rows(texts: DataFrame) -> DataFrame:
    """texts (date, text): date, section, line, symbol and cells (by header) of each table row below a known heading.

    A table begins with a header whose first cell is symbol and ends at the next heading. The symbol is
    the text of the first cell's link. Forming wedges of old reports belong to the watch list.
    """
    lines = texts.select("date", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    w = Window.partitionBy("date").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    second, third = F.col("value").rlike("^## "), F.col("value").rlike("^### ")
    title = F.trim(F.regexp_replace("value", "^#+ ", ""))
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x))
    is_row = F.col("value").rlike(r"^\|")
    s = lines.withColumns({"__two": F.last(F.when(second, title), ignorenulls=True).over(w), "__cut": F.sum((second | third).cast("int")).over(w), "__cut2": F.sum(second.cast("int")).over(w), "cells": F.when(is_row, cells)})
    within2, within = (Window.partitionBy("date", k).orderBy("line").rowsBetween(Window.unboundedPreceding, 0) for k in ("__cut2", "__cut"))
    head = F.col("cells")[0] == "symbol"
    s = s.withColumns({"__three": F.last(F.when(third, title), ignorenulls=True).over(within2), "__head": F.last(F.when(head, F.col("cells")), ignorenulls=True).over(within)})
    s = s.where(is_row & ~F.coalesce(head, F.lit(False)) & F.col("__head").isNotNull() & ~F.col("value").rlike(r"^[|:\- ]+$")).withColumn("section", section_of(F.col("__two"), F.col("__three")))
    names = F.slice("__head", 1, F.least(F.size("__head"), F.size("cells")))
    s = s.withColumns({"symbol": F.regexp_extract(F.col("cells")[0], r"\[([^\]]+)\]", 1), "row": F.map_from_arrays(names, F.slice("cells", 1, F.size(names)))}).where(F.col("section").isNotNull() & (F.col("symbol") != ""))
    watch = (F.col("section") == "wedge") & F.startswith(F.coalesce(F.col("row")["status"], F.lit("")), F.lit("forming"))
    return s.select("date", F.when(watch, "wedge_watch").otherwise(F.col("section")).alias("section"), "line", "symbol", F.col("row").alias("cells"))


def flags_from_cells(cells: Column) -> Column:
    """The flags that a row shows, or those that its numbers give: z of -1 or less, 40 % below the high, negative sentiment, a target 50 % above. Fixed values."""
    shown = F.trim(F.coalesce(cells["flags"], F.lit("")))
    told = F.filter(F.split(F.regexp_replace(shown, r"\*", ""), r"\s+"), lambda f: f.isin("Z", "D", "S", "T"))
    z = F.regexp_extract(F.coalesce(cells["vs peers 20d"], F.lit("")), r"z ([+-]?\d+\.\d+)", 1).try_cast("double")
    rules = [("Z", z <= -1), ("D", number(cells["from 52w high"]) <= -40), ("S", F.trim(cells["sentiment"]) == "negative"), ("T", number(cells["target upside"]) >= 50)]
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules]), lambda x: x.isNotNull())
    return F.when(shown != "", told).otherwise(found)


def new_signals(texts: DataFrame) -> DataFrame:
    """texts (id, text): the rows of the journal's table of new signals: rule, symbol, signal_date, price, hold, note."""
    lines = texts.select("id", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    w = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    s = lines.withColumn("__under", F.last(F.when(F.col("value").rlike("^## "), F.col("value")), ignorenulls=True).over(w))
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x))
    rows = s.where(F.startswith("__under", F.lit("## New signals today")) & F.col("value").rlike(r"^\|") & ~F.col("value").rlike(r"^\|:")).withColumn("c", cells)
    rows = rows.where((F.size("c") >= 6) & ~F.contains(F.col("c")[0], F.lit("rule")))
    return rows.select("id", "line", *[F.col("c")[k].alias(n) for k, n in enumerate(("rule", "symbol", "signal_date", "price", "hold", "note"))])


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """The journal's file, all columns as text; those that older files lack are empty, others are left out."""
    rows = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return rows.select(*[(F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")).alias(c) for c in JOURNAL])


def _signal(rows: DataFrame, rule: str, today: str, date: Column, price: Column, note: Column) -> DataFrame:
    own = {"logged": F.lit(today), "rule": F.lit(rule), "symbol": F.col("symbol"), "signal_date": date.cast("string"), "status": F.lit("open"), "ref_price": F.format_string("%.4f", price.cast("double")), "entry_date": F.lit(""), "entry_price": F.lit(""), "hold_bars": F.lit(str(HOLD[rule])), "note": note}
    return rows.select(*[own[c].alias(c) for c in JOURNAL])


def _pct(x: str, digits: int = 0) -> Column:
    return F.format_string(f"%+.{digits}f%%", F.col(x) * 100)


def collect_signals(today: str, newsdays: DataFrame | None = None, wedges: DataFrame | None = None, rallies: DataFrame | None = None, insiders: DataFrame | None = None) -> DataFrame:
    """The journal's rows of today's lists: news days, beaten-down wedges that broke out on the last bar, early rallies and insiders' purchases.

    newsdays and rallies are of `verdicts.newsday_live` and `early_rally`; wedges: symbol, breakout_date,
    last_date, status, price, score, stop, level; insiders: symbol, last_filing, last_close, n_buys,
    total_value, beaten. What a list is without counts as empty.
    """
    parts = []
    if newsdays is not None:
        note = F.concat(F.lit("gap "), _pct("gap", 1), F.lit(", vol "), F.format_string("%.1fx", "volume_ratio"), F.lit(", 6m "), _pct("ret_6m"), F.lit(", vs MA200 "), _pct("dist_ma200"))
        parts.append(_signal(newsdays, "newsday", today, F.col("news_date"), F.col("news_close"), note))
    if wedges is not None:
        fresh = wedges.where((F.col("status") == "confirmed") & (F.col("breakout_date") == F.col("last_date")))
        note = F.format_string("score %.2f, stop %.2f, level %.2f", "score", "stop", "level")
        parts.append(_signal(fresh, "falling_wedge_beaten_down", today, F.col("breakout_date"), F.col("price"), note))
    if rallies is not None:
        note = F.concat(F.col("rules"), F.lit("; day "), _pct("day_ret", 1), F.lit(", 10d "), _pct("ret_10", 1), F.lit(", 6m "), _pct("ret_6m"), F.lit(", vs MA200 "), _pct("dist_ma200"))
        parts.append(_signal(rallies, "early_rally_beaten_down", today, F.col("signal_date"), F.col("close"), note))
    if insiders is not None:
        note = F.concat(F.col("n_buys").cast("string"), F.lit(" buy(s) $"), F.format_string("%.2fM", F.col("total_value") / 1e6))
        parts.append(_signal(insiders.where("beaten"), "insider_buy_beaten_down", today, F.col("last_filing"), F.col("last_close"), note))
    if not parts:
        raise ValueError("no list was given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
