"""Study statistics over narrow event tables: rule, symbol, date, h, ret, xbench, xlocal and context.

Overlapping groups (all, train and test; families of labels) are exploded, so that one pass over
the events fills all of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scores import conditional, periods, profit_factor, t_stat, wilson

COST = 0.001


def summary(events: DataFrame, by: str = "rule") -> DataFrame:
    """Per group and horizon, and over all groups: counts, means, hit rate with its Wilson interval, excesses, t, profit factor."""
    out = events.where(F.col("ret").isNotNull()).cube(by, "h").agg(
        F.grouping(by).alias("__g"), F.grouping("h").alias("__h"), F.count("*").alias("n"), F.countDistinct("symbol").alias("symbols"),
        F.avg("ret").alias("mean"), F.expr("percentile(ret, 0.5)").alias("median"), F.count_if(F.col("ret") > 0).alias("hits"),
        F.avg("xbench").alias("xbench"), F.avg("xlocal").alias("xlocal"), t_stat(F.col("xlocal")).alias("t"), profit_factor(F.col("ret")).alias("profit_factor"),
    ).where("__h = 0")
    low, high = wilson(F.col("hits"), F.col("n"))
    named = F.when(F.col("__g") == 1, "ALL").otherwise(F.col(by))
    return out.select(named.alias(by), "h", "n", "symbols", "mean", "median", (F.col("hits") / F.col("n")).alias("hit"), low.alias("hit_low"), high.alias("hit_high"), "xbench", "xlocal", "t", "profit_factor")


def by_period(events: DataFrame, by: list[str], split: str, cost: float = COST, least: int = 1) -> DataFrame:
    """Net result, hit rate, excess and t of each group in all, train and test, and the share of years with a positive excess."""
    keys = ["period", *by, "h"]
    rows = events.select("*", F.explode(periods(F.col("date"), split)).alias("period"))
    yearly = rows.groupBy(*keys, "year").agg(
        F.count("ret").alias("n"), F.sum("ret").alias("s"), F.count_if(F.col("ret") > cost).alias("hits"), F.count("xlocal").alias("nx"), F.sum("xlocal").alias("sx"),
        F.sum(F.col("xlocal") * F.col("xlocal")).alias("sxx"), F.avg("xbench").alias("b"), F.sum("xbench").alias("sb"), F.count("xbench").alias("nb"), F.avg("xlocal").alias("year_excess"),
    )
    out = yearly.groupBy(*keys).agg(
        F.sum("n").alias("n"), (F.try_divide(F.sum("s"), F.sum("n")) - cost).alias("net"), F.try_divide(F.sum("hits").cast("double"), F.sum("n")).alias("hit"),
        F.try_divide(F.sum("sb"), F.sum("nb")).alias("xbench"), F.try_divide(F.sum("sx"), F.sum("nx")).alias("xlocal"),
        F.sum("nx").alias("nx"), F.sum("sx").alias("sx"), F.sum("sxx").alias("sxx"),
        F.count_if((F.col("n") >= 30) & (F.col("year_excess") > 0)).alias("years_positive"), F.count_if(F.col("n") >= 30).alias("years"),
    )
    variance = F.try_divide(F.col("sxx") - F.col("sx") * F.col("sx") / F.col("nx"), F.col("nx") - 1)
    t = F.when((F.col("nx") > 2) & (variance > 0), F.col("sx") / F.col("nx") / F.sqrt(variance / F.col("nx")))
    return out.where(F.col("n") >= least).withColumn("t", t).drop("nx", "sx", "sxx")


def event_table(events: DataFrame, by: list[str], split: str, cost: float = COST, means: list[str] = [], least: int = 1) -> DataFrame:  # noqa: B006
    """period, by and h: events, symbols, means of columns of the event, net result, hit rate, excesses and t, of narrow events in all, train and test."""
    rows = events.select("*", F.explode(periods(F.col("date"), split)).alias("period")).where(F.col("ret").isNotNull())
    out = rows.groupBy("period", *by, "h").agg(
        F.count("*").alias("n"), F.countDistinct("symbol").alias("n_symbols"), *[F.avg(m).alias(f"avg_{m}") for m in means], (F.avg("ret") - cost).alias("net"), F.avg((F.col("ret") > cost).cast("int")).alias("hit"),
        F.avg("xbench").alias("xbench"), F.avg("xlocal").alias("xlocal"), t_stat(F.col("xlocal")).alias("t"),
    )
    return out.where(F.col("n") >= least)


def verdicts(table: DataFrame, by: str = "rule", h: int = 20, t_min: float = 2.0, excess: float = 0.01) -> DataFrame:
    """Whether a group's excess holds in train and in test."""
    at = lambda p, c: F.max(F.when(F.col("period") == p, F.col(c)))
    wide = table.where(F.col("h") == h).groupBy(by).agg(*[at(p, c).alias(f"{p}_{c}") for p in ("train", "test") for c in ("n", "xlocal", "t")])
    good = [(F.col(f"{p}_xlocal") > excess) & (F.col(f"{p}_t") > t_min) for p in ("train", "test")]
    bad = [(F.col(f"{p}_xlocal") < -excess) & (F.col(f"{p}_t") < -t_min) for p in ("train", "test")]
    return wide.withColumn("verdict", F.when(good[0] & good[1], "holds").when(bad[0] & bad[1], "negative").when(good[0] | good[1], "one period only").otherwise("none"))


def quantile_bins(rows: DataFrame, score: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """rows with bin, 1 to bins, cut at exact quantiles with linear interpolation, bins closed on the right; equal edges make one bin."""
    by = by or []
    at = "array(" + ", ".join(str(i / bins) for i in range(bins + 1)) + ")"
    edges = rows.groupBy(*by).agg(F.array_distinct(F.expr(f"percentile({score}, {at})")).alias("__edges"))
    joined = rows.join(edges, by) if by else rows.join(F.broadcast(edges))
    below = F.size(F.filter("__edges", lambda e: e < F.col(score)))
    return joined.withColumn("bin", F.when(F.col(score).isNotNull(), F.greatest(F.lit(1), below))).drop("__edges")


def calibration(events: DataFrame, score: str, h: int = 20, bins: int = 5) -> DataFrame:
    """Results by quantile of a score."""
    rows = quantile_bins(events.where((F.col("h") == h) & F.col("ret").isNotNull() & F.col(score).isNotNull()), score, bins)
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.min(score).alias("score_min"), F.max(score).alias("score_max"), F.avg("ret").alias("ret"), F.avg("xlocal").alias("xlocal"), F.avg((F.col("ret") > 0).cast("double")).alias("hit"))


def spearman(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Rank correlation, ties at their average rank."""
    held = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rank = lambda c: F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2
    return held.withColumns({"__x": rank(x), "__y": rank(y)}).groupBy(*by).agg(F.corr("__x", "__y").alias("rho"), F.count("*").alias("n"))


def thresholds(events: DataFrame, score: str, cuts: list[float], h: int = 20) -> DataFrame:
    """Results of all events at or above each cut."""
    passed = F.filter(F.array(*[F.when(F.col(score) >= c, F.lit(c)) for c in cuts]), lambda x: x.isNotNull())
    rows = events.where((F.col("h") == h) & F.col("ret").isNotNull()).select("*", F.explode(passed).alias("cut"))
    return rows.groupBy("cut").agg(F.count("*").alias("n"), F.avg("ret").alias("ret"), F.avg("xlocal").alias("xlocal"), F.avg((F.col("ret") > 0).cast("double")).alias("hit"), profit_factor(F.col("ret")).alias("profit_factor"))


def breakdown(events: DataFrame, col: str, h: int = 20) -> DataFrame:
    return events.where((F.col("h") == h) & F.col("ret").isNotNull()).groupBy(col).agg(F.count("*").alias("n"), F.avg("ret").alias("ret"), F.avg("xbench").alias("xbench"), F.avg("xlocal").alias("xlocal"), F.avg((F.col("ret") > 0).cast("double")).alias("hit"))


def permutation_moments(draws: DataFrame, by: list[str]) -> DataFrame:
    """z of the mean return against means of one random draw per event.

    draws: keys, event, actual and r, a row for each draw. Mean and variance of the replicates are
    known without making them: the mean of the events' means, and their variances' sum over n squared.
    """
    each = draws.groupBy(*by, "event").agg(F.first("actual").alias("actual"), F.avg("r").alias("m"), F.var_pop("r").alias("v"))
    out = each.groupBy(*by).agg(F.count("*").alias("n"), F.avg("actual").alias("actual"), F.avg("m").alias("null_mean"), (F.sqrt(F.sum("v")) / F.count("*")).alias("null_sd"))
    return out.where("n >= 5").withColumn("z", F.try_divide(F.col("actual") - F.col("null_mean"), F.col("null_sd")))


def bootstrap_ci(rows: DataFrame, x: str, by: list[str], reps: int = 500, seed: int = 0) -> DataFrame:
    """Percentile interval of the mean by Poisson weights: a row counts a number of times in each replicate that a hash gives.

    The hash is of the row's columns and its number among equal rows, so that reruns agree and equal
    rows have weights of their own. Each batch adds its rows up to `reps` sums a group where it is.
    """
    law = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(19)])  # of the Poisson law with mean 1; what is beyond is less than a double tells
    equal = Window.partitionBy(*rows.columns).orderBy(F.lit(0))
    held = rows.where(F.col(x).isNotNull()).withColumn("__row", F.xxhash64(F.lit(seed), F.row_number().over(equal), *rows.columns)).select(*by, F.col(x).cast("double").alias("__x"), "__row")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields if f.name in by)
    turns = np.random.default_rng(seed).integers(0, 1 << 63, reps, dtype=np.uint64) << np.uint64(1) | np.uint64(1)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(by, dropna=False, sort=False):
                total, weight = np.zeros(reps), np.zeros(reps)
                for at in range(0, len(part), 1024):
                    row = part["__row"].to_numpy()[at : at + 1024].astype(np.int64).view(np.uint64)
                    with np.errstate(over="ignore"):
                        mixed = row[:, None] * turns[None, :]
                        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
                    w = np.searchsorted(law, (mixed >> np.uint64(11)).astype(float) / float(1 << 53), side="right")
                    total += part["__x"].to_numpy()[at : at + 1024] @ w
                    weight += w.sum(0)
                out = part[by].iloc[:1].copy()
                out["total"], out["weight"] = [total], [weight]
                yield out

    sums = held.mapInPandas(add, f"{kinds}, total array<double>, weight array<double>").select(*by, F.posexplode(F.arrays_zip("total", "weight")).alias("rep", "s"))
    means = sums.groupBy(*by, "rep").agg(F.try_divide(F.sum("s.total"), F.sum("s.weight")).alias("m"))
    return means.groupBy(*by).agg(F.expr("percentile(m, 0.025)").alias("low"), F.expr("percentile(m, 0.975)").alias("high"))


def condition_study(events: DataFrame, conditions: dict[str, Column], split: str, cost: float = COST) -> DataFrame:
    """Results with and without each condition, in train and test."""
    state = F.explode(F.array(*[F.struct(F.lit(k).alias("condition"), F.when(F.coalesce(c, F.lit(False)), "yes").otherwise("no").alias("state")) for k, c in conditions.items()]))
    rows = events.select("*", state.alias("s"), F.when(F.col("date") < F.lit(split).cast("date"), "train").otherwise("test").alias("period"))
    return rows.where(F.col("ret").isNotNull()).groupBy(F.col("s.condition").alias("condition"), "period", F.col("s.state").alias("state"), "h").agg(
        F.count("*").alias("n"), (F.avg("ret") - cost).alias("net"), F.avg((F.col("ret") > cost).cast("double")).alias("hit"), F.avg("xlocal").alias("excess")
    )


def condition_verdicts(study: DataFrame, h: int = 20, least: int = 30, gap: float = 0.005) -> DataFrame:
    """Whether a condition's gain is there in both periods with enough events on each side."""
    at = lambda p, s, c: F.max(F.when((F.col("period") == p) & (F.col("state") == s), F.col(c)))
    wide = study.where(F.col("h") == h).groupBy("condition").agg(
        *[(at(p, "yes", "excess") - at(p, "no", "excess")).alias(f"{p}_diff") for p in ("train", "test")],
        F.min("n").alias("least_n"), F.count("*").alias("cells"),
    )
    usable = (F.col("least_n") >= least) & (F.col("cells") == 4)
    return wide.select(
        "condition", "train_diff", "test_diff",
        F.coalesce(usable & (F.col("train_diff") >= gap) & (F.col("test_diff") >= gap), F.lit(False)).alias("consistent"),
        F.coalesce(usable & (F.col("train_diff") <= -gap) & (F.col("test_diff") <= -gap), F.lit(False)).alias("consistent_negative"),
    )


def labelled(events: DataFrame, labels: list[tuple[str, Column]], h: int, least: int = 1) -> DataFrame:
    """Results by label; an event counts under all labels that fit."""
    rows = events.where((F.col("h") == h) & F.col("ret").isNotNull()).select("*", F.explode(conditional(labels)).alias("label"))
    out = rows.groupBy("label").agg(F.count("*").alias("n"), F.avg("ret").alias("ret"), F.avg("xbench").alias("xbench"), F.avg("xlocal").alias("xlocal"), F.avg((F.col("ret") > 0).cast("double")).alias("hit"), t_stat(F.col("xlocal")).alias("t"))
    return out.where(F.col("n") >= least)


def feature_terciles(events: DataFrame, features: list[str], split: str, h: int = 20, bins: int = 3) -> DataFrame:
    """Results by bin of each feature; edges are fitted on train and used in both periods, and outer bins are open."""
    rows = events.where((F.col("h") == h) & F.col("xlocal").isNotNull())
    long = rows.select("date", "xlocal", "ret", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("x")).select("date", "xlocal", "ret", "x.*").where(F.col("value").isNotNull())
    long = long.withColumn("period", F.when(F.col("date") < F.lit(split).cast("date"), "train").otherwise("test"))
    at = "array(" + ", ".join(str(i / bins) for i in range(1, bins)) + ")"
    edges = long.where("period = 'train'").groupBy("feature").agg(F.expr(f"percentile(value, {at})").alias("edges"))
    placed = long.join(F.broadcast(edges), "feature").withColumn("bin", 1 + F.size(F.filter("edges", lambda e: e < F.col("value"))))
    return placed.groupBy("feature", "period", "bin").agg(F.count("*").alias("n"), F.avg("ret").alias("ret"), F.avg("xlocal").alias("xlocal"))


def consistent_features(terciles: DataFrame, bins: int = 3, effect: float = 0.005) -> DataFrame:
    at = lambda p, b: F.max(F.when((F.col("period") == p) & (F.col("bin") == b), F.col("xlocal")))
    wide = terciles.groupBy("feature").agg(*[(at(p, bins) - at(p, 1)).alias(f"{p}_gap") for p in ("train", "test")])
    same = (F.signum("train_gap") == F.signum("test_gap")) & (F.least(F.abs("train_gap"), F.abs("test_gap")) >= effect)
    return wide.withColumn("consistent", F.coalesce(same, F.lit(False)))


def performance(returns: DataFrame, by: list[str], per_year: float, r: str = "r", order: str = "date") -> DataFrame:
    """Annual return and volatility, Sharpe ratio, t, hit rate, largest fall from a high, total return."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = returns.where(F.col(r).isNotNull()).withColumn("__equity", F.exp(F.sum(F.log1p(r)).over(w)))
    rows = rows.withColumn("__fall", F.col("__equity") / F.max("__equity").over(w) - 1)
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.avg((F.col(r) > 0).cast("double")).alias("hit"), F.min("__fall").alias("max_drawdown"), F.exp(F.sum(F.log1p(r))).alias("growth"))
    n = F.col("n")
    ratio = F.try_divide(F.col("mean"), F.col("sd"))
    return out.where("n >= 2").select(
        *by, "n", (F.pow("growth", per_year / n) - 1).alias("ann_return"), (F.col("sd") * per_year**0.5).alias("ann_vol"), (ratio * per_year**0.5).alias("sharpe"),
        (ratio * F.sqrt(n)).alias("t_stat"), "hit", "max_drawdown", F.col("mean").alias("mean_period"), (F.col("growth") - 1).alias("total_return"),
    )


#: Counts of p-values: number of lines below them, and how many there are.
BINS = "place bigint, number bigint"


def in_bins(parts: Iterable[np.ndarray], lines: np.ndarray) -> pa.RecordBatch:
    """p-values of all parts counted by the lines, in ascending order, that are below them."""
    number = np.zeros(len(lines) + 1, np.int64)
    for p in parts:
        some = p[p <= lines[-1]]
        number += np.bincount(np.searchsorted(lines, some), minlength=len(number))
        number[-1] += len(p) - len(some)
    place = np.flatnonzero(number)
    return pa.RecordBatch.from_arrays([pa.array(place), pa.array(number[place])], ["place", "number"])


def line_by_counts(counts: Callable[[np.ndarray], DataFrame], n: int, q: float, steps: int = 4096) -> float:
    """The threshold at or below which p-values are found at a false discovery rate q; below 0 if none is.

    counts(lines) gives BINS of all p-values, and n is their expected number. The threshold is q k / n for the
    largest k with k values at or below it. Between two neighbours of some k there can be such a one only if
    the count at the upper one is above the lower one, and it is no larger than that count. So each round
    narrows the highest gap that can have it; no value is sorted or kept.
    """
    low, floor, high = 0, 0, n  # low is such a k, if not the largest; none is above high; the gap begins after floor
    while low < high:
        each, thin = np.arange(low + 1, min(high, low + steps) + 1), np.geomspace(1, high - low, steps).astype(np.int64)
        k = np.unique(np.concatenate([each, low + thin, floor + np.linspace(1, high - floor, steps).astype(np.int64), [high]]))
        bins = dict(counts(q * k / n).groupBy("place").agg(F.sum("number")).collect())
        if (told := sum(bins.values())) != n:
            n, low, floor, high = told, 0, 0, told
            continue
        within, before = np.cumsum([bins.get(i, 0) for i in range(len(k))]), np.append(low, k[:-1])
        low = int(max(k[within >= k], default=low))
        i = max(np.flatnonzero(within > before), default=None)
        if i is None or within[i] >= k[i]:
            break
        floor, high = max(low, int(before[i])), int(within[i])
    return q * low / n if low else -1.0


def step_up(tests: DataFrame, p: str, q: float) -> float:
    """The threshold at or below which p-values are found at a false discovery rate q; below 0 if none is."""
    values = tests.select(F.coalesce(F.col(p).cast("double"), F.lit(np.nan)).alias(p))
    return line_by_counts(lambda lines: values.mapInArrow(lambda batches: [in_bins((b.column(0).to_numpy() for b in batches), lines)], BINS), tests.count(), q)


def benjamini_hochberg(tests: DataFrame, p: str, q: float) -> DataFrame:
    """tests with `found`: whether the p-value is at or below the largest one that is within q times its rank over n."""
    ranked = tests.withColumns({"__rank": F.row_number().over(Window.orderBy(p)), "__n": F.count("*").over(Window.partitionBy())})
    line = F.max(F.when(F.col(p) <= q * F.col("__rank") / F.col("__n"), F.col(p))).over(Window.partitionBy())
    return ranked.withColumn("found", F.coalesce(F.col(p) <= line, F.lit(False))).drop("__rank", "__n")
