"""The review of dated reports: what each table earned, and which conditions told good names from bad ones.

rows are first appearances with what followed: section, symbol, date, flags (array of codes), n_flags,
n_days, market_wide, cells (map of a report's column to its formatted cell), and ret_h, xbasket_h for
each horizon h, of which "latest" is the last close. All conditions are evaluated in one pass: a row is
written out once for each condition whose population it is in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import t_stat, welch
from ..functions.text import number

#: Names a table and a side need for a verdict, and the t that counts. Fixed values.
LEAST, LEAST_SIDE, STRONG = 20, 12, 2.0
#: Sections that list signals. Fixed values.
SIGNALS = ["newsday", "wedge", "wedge_watch", "insider_beaten", "early_rally", "ma200_cross"]
#: Sections of the review's tables. Fixed values.
TABLES = ["newsday", "wedge", "insider_beaten", "early_rally", "ma200_cross", "wedge_watch", "insider_other", "jev", "growth"]


@dataclass(frozen=True)
class Condition:
    """population and met are predicates of a row; a population of under `least` names has no line."""

    key: str
    population: Column
    met: Column
    least: int = 1


def cell(name: str) -> Column:
    return F.coalesce(F.col("cells")[name], F.lit(""))


def cell_number(name: str, pattern: str | None = None) -> Column:
    return number(F.when(F.col("cells")[name].isNotNull(), F.regexp_extract(cell(name), pattern, 1) if pattern else cell(name)))


def catalogue() -> list[Condition]:
    """The conditions on report cells; thresholds are fixed values."""
    at = lambda *s: F.col("section").isin(*s)
    brief, listed = at("briefs"), at(*SIGNALS)
    buy, touch, rules, checks = cell_number("P(buy)"), cell_number("MACD pre-touch", r"(\d+)%"), cell_number("rules fired"), cell_number("checks passed", r"(\d+)/")
    above, six, loud, climax = cell_number("vs peers 20d", r"^([+-]?\d+\.\d+)%"), cell_number("6m"), cell_number("volume"), cell_number("max vol 10d")
    flag = lambda code: F.coalesce(F.array_contains("flags", code), F.lit(False))
    return [
        *[Condition(f"flag_{c}", brief, flag(c)) for c in "ZSTD"],
        Condition("no_warning", brief, F.col("n_flags") == 0), Condition("read_bottom", brief, cell("read") == "signs of a bottom"), Condition("read_falling", brief, cell("read") == "still falling"),
        Condition("market_wide", brief, F.col("market_wide")), Condition("sent_pos", brief, cell("sentiment") == "positive"), Condition("consensus_buy", brief, F.contains(cell("consensus"), F.lit("buy"))),
        Condition("deep_dd", brief, cell_number("from 52w high") <= -30), Condition("peers_up", brief, above > 0),
        Condition("jev_buy_brief", brief & buy.isNotNull(), buy >= 0.6, LEAST_SIDE), Condition("macd70_brief", brief & touch.isNotNull(), touch >= 70, LEAST_SIDE),
        Condition("checklist4", at("checklist") & checks.isNotNull(), checks >= 4, 2 * LEAST_SIDE), Condition("fresh", listed, F.col("n_days") <= 3),
        Condition("group_beaten", listed & (cell("group") != ""), F.startswith(cell("group"), F.lit("beaten")), 2 * LEAST_SIDE), Condition("depth30", listed & six.isNotNull(), six <= -30),
        Condition("vol15", listed & loud.isNotNull(), loud > 1.5, 2 * LEAST_SIDE), Condition("climax3", listed & climax.isNotNull(), climax >= 3, 2 * LEAST_SIDE),
        Condition("macd70", listed & touch.isNotNull(), touch >= 70, 2 * LEAST_SIDE), Condition("rules2", at("early_rally") & rules.isNotNull(), rules >= 2, 2 * LEAST_SIDE),
        Condition("jev_pick", at("jev") & buy.isNotNull(), buy >= 0.6), Condition("jev_low", at("jev") & buy.isNotNull(), buy < 0.2),
    ]


def split_verdict(n_yes: Column, n_no: Column, t: Column) -> Column:
    return F.when((n_yes < LEAST_SIDE) | (n_no < LEAST_SIDE) | t.isNull(), "early").when(t >= STRONG, "better_yes").when(t <= -STRONG, "better_no").otherwise("noise")


def table_verdict(n: Column, excess: Column, t: Column) -> Column:
    return F.when((n < LEAST) | t.isNull(), "early").when((excess > 0) & (t >= STRONG), "works").when((excess < 0) & (t <= -STRONG), "fails").otherwise("noise")


def condition_lines(rows: DataFrame, conditions: list[Condition], horizons: tuple[str, ...] = ("20", "latest")) -> DataFrame:
    """key, h, n_yes, n_no, excess and return and hit rate of either side, diff, t and verdict of each condition."""
    met = F.array(*[F.when(F.coalesce(c.population, F.lit(False)), F.struct(F.lit(c.key).alias("key"), F.coalesce(c.met, F.lit(False)).alias("yes"), F.lit(c.least).alias("least"))) for c in conditions])
    each = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"ret_{h}").alias("ret"), F.col(f"xbasket_{h}").alias("x")) for h in horizons])
    long = rows.select(F.explode(F.filter(met, lambda m: m.isNotNull())).alias("c"), each.alias("e")).select("c.*", F.explode("e").alias("e")).select("key", "yes", "least", "e.*")
    a, b = (F.when(F.col("yes") == s, F.col("x")) for s in (True, False))
    ra, rb = (F.when(F.col("yes") == s, F.col("ret")) for s in (True, False))
    hit = lambda r: F.avg((r > 0).cast("int"))
    out = long.groupBy("key", "h").agg(
        F.count("*").alias("population"), F.max("least").alias("least"), F.count(a).alias("n_yes"), F.count(b).alias("n_no"), F.avg(a).alias("excess_yes"), F.avg(b).alias("excess_no"),
        F.avg(ra).alias("ret_yes"), F.avg(rb).alias("ret_no"), hit(ra).alias("hit_yes"), hit(rb).alias("hit_no"), welch(a, b).alias("t"),
    ).where(F.col("population") >= F.col("least"))
    return out.drop("population", "least").withColumns({"diff": F.col("excess_yes") - F.col("excess_no"), "verdict": split_verdict(F.col("n_yes"), F.col("n_no"), F.col("t"))})


def table_lines(rows: DataFrame, sections: list[str] = TABLES, horizons: tuple[str, ...] = ("20", "latest")) -> DataFrame:
    """section, h, n, ret, hit, excess, t, verdict, and the excess of the first and second half of the section's span of days, which are stable if both have eight names and the same sign."""
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"ret_{h}").alias("ret"), F.col(f"xbasket_{h}").alias("x")) for h in horizons]))
    own = rows.where(F.col("section").isin(*sections))
    span = own.groupBy("section").agg(F.unix_date(F.min("date")).alias("__a"), F.unix_date(F.max("date")).alias("__b"))
    long = own.select("section", "date", each.alias("e")).select("section", "date", "e.*").join(F.broadcast(span), "section")  # a row a section
    early = F.unix_date("date") <= F.col("__a") + (F.col("__b") - F.col("__a")) / 2
    half = lambda when, c: F.when(when, F.col(c))
    out = long.groupBy("section", "h").agg(
        F.count("ret").alias("n"), F.avg("ret").alias("ret"), F.avg((F.col("ret") > 0).cast("int")).alias("hit"), F.avg("x").alias("excess"), t_stat(F.col("x")).alias("t"),
        F.count(half(early, "ret")).alias("n_first"), F.avg(half(early, "x")).alias("excess_first"), F.count(half(~early, "ret")).alias("n_second"), F.avg(half(~early, "x")).alias("excess_second"),
    )
    stable = (F.col("n_first") >= 8) & (F.col("n_second") >= 8) & (F.signum("excess_first") == F.signum("excess_second"))
    return out.withColumns({"stable": F.coalesce(stable, F.lit(False)), "verdict": table_verdict(F.col("n"), F.col("excess"), F.col("t"))})


def full_review(rows: DataFrame, conditions: list[Condition] | None = None, sections: list[str] = TABLES) -> DataFrame:
    """kind (table or condition), key, h, n, excess, t and verdict of everything that is reviewed; for conditions n is of the smaller side and excess the difference."""
    tables = table_lines(rows, sections).select(F.lit("table").alias("kind"), F.col("section").alias("key"), "h", "n", "excess", "t", "verdict")
    told = condition_lines(rows, catalogue() if conditions is None else conditions).select(F.lit("condition").alias("kind"), "key", "h", F.least("n_yes", "n_no").alias("n"), F.col("diff").alias("excess"), "t", "verdict")
    return tables.unionByName(told)


def verdict_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """kind, key, h, before, now: verdicts that both reviews have and that differ."""
    old = before.select("kind", "key", "h", F.col("verdict").alias("before"))
    return now.select("kind", "key", "h", F.col("verdict").alias("now")).join(old, ["kind", "key", "h"]).where(F.col("now") != F.col("before"))
