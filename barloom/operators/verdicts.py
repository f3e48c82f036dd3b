"""From matches to events, live lists, and the tables and verdicts that studies end with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frames import change, own, rolling, shift
from ..functions.scores import conditional, periods, profit_factor, t_stat, welch
from . import events as E
from . import indicators as I
from . import paths as P

#: What a match's score is multiplied by for its status. Fixed values.
PENALTY = {"failed": 0.6, "expired": 0.7}
#: Upper edges and labels of breakout volume. Fixed values.
VOLUME_BINS = [(0.8, "<0.8x"), (1.1, "0.8-1.1x"), (1.5, "1.1-1.5x"), (2.5, "1.5-2.5x")]


# --- matches to events -----------------------------------------------------


def raw_score() -> Column:
    """A match's score before its status lowered it."""
    return F.col("score") / F.coalesce(*[F.when(F.col("status") == s, F.lit(p)) for s, p in PENALTY.items()], F.lit(1.0))


def complete_idx() -> Column:
    """The bar at which a match's shape could be known: its last key point and as many bars as its scale."""
    return (F.coalesce(F.array_max(F.transform("key_points", lambda p: p["idx"])), F.col("start_idx")) + F.coalesce("scale", F.lit(0))).cast("int")


def structures(matches: DataFrame, bars: DataFrame, max_hold: int = 60, least_score: float = 0.5) -> DataFrame:
    """Shapes of any status that were complete max_hold bars before the last one, judged by their raw score."""
    last = bars.groupBy("symbol").agg(F.max("bar_idx").alias("__last"))
    rows = matches.withColumns({"complete_idx": complete_idx(), "raw_score": raw_score()}).join(last, "symbol")
    return rows.where((F.col("__last") - F.col("complete_idx") >= max_hold) & (F.col("raw_score") >= least_score)).select("symbol", "pattern", "status", "raw_score", "complete_idx")


def pattern_events(matches: DataFrame, bars: DataFrame, bench: DataFrame, horizons: list[int] = [5, 20]) -> DataFrame:  # noqa: B006
    """Confirmed matches with a direction, entered at the open after breakout and shape were both known, with what followed in their direction."""
    known = I.with_volume_ratio(bars)
    rich = E.with_forward(E.align_benchmark(known, bench), horizons, E.PATTERN)
    sign = F.when(F.col("direction") == "bullish", 1).when(F.col("direction") == "bearish", -1)
    rows = matches.where((F.col("status") == "confirmed") & F.col("breakout_idx").isNotNull() & sign.isNotNull())
    rows = rows.withColumns({"dir": sign, "signal_idx": F.greatest("breakout_idx", complete_idx())})
    at = rich.select("symbol", F.col("bar_idx").alias("signal_idx"), "date", "entry", *[f"{c}_{h}" for h in horizons for c in ("ret", "bench", "local")])
    out = rows.join(at, ["symbol", "signal_idx"]).join(known.select("symbol", F.col("bar_idx").alias("breakout_idx"), F.col("volume_ratio").alias("breakout_volume")), ["symbol", "breakout_idx"])
    signed = {}
    for h in horizons:
        signed |= {f"xbench_{h}": F.col("dir") * (F.col(f"ret_{h}") - F.col(f"bench_{h}")), f"xlocal_{h}": F.col("dir") * (F.col(f"ret_{h}") - F.col(f"local_{h}")), f"ret_{h}": F.col("dir") * F.col(f"ret_{h}")}
    out = out.where(F.col("entry").isNotNull()).withColumns(signed).drop(*[f"{c}_{h}" for h in horizons for c in ("bench", "local")])
    return out.withColumns({"delay": F.col("signal_idx") - F.col("breakout_idx"), "gap_from_level": (F.try_divide(F.col("entry"), F.col("level")) - 1) * F.col("dir"), "year": F.year("date")})


def with_trades(events: DataFrame, bars: DataFrame, max_hold: int = 60) -> DataFrame:
    """events (signal_idx, dir, target, stop) with the trade that follows: exit_reason, bars_held, trade_ret, mfe, mae, r_multiple."""
    path = P.paths_of(events.select("symbol", F.col("signal_idx").alias("bar_idx")).distinct(), bars, max_hold).withColumnRenamed("bar_idx", "signal_idx").drop("entry")
    return P.simulate_trade(events.join(path, ["symbol", "signal_idx"]).withColumn("direction", F.col("dir")), max_hold).drop("path")


def walk_forward_matches(seen: DataFrame) -> DataFrame:
    """What patterns.walk_forward gives as matches: confirmed, broken out at the bar that saw them, with nothing left to wait for."""
    return seen.select("symbol", "pattern", "direction", F.lit("confirmed").alias("status"), F.lit(0).alias("scale"), "start_idx", F.col("seen_at").alias("end_idx"), F.col("seen_at").alias("breakout_idx"), "score", "level", "target", "stop", F.lit(None).cast("array<struct<idx:int,price:double,label:string>>").alias("key_points"))


def pattern_verdicts(events: DataFrame, bars: DataFrame, h: int = 20, least: int = 100, reps: int = 500) -> DataFrame:
    """pattern, n, mean excess and its bootstrap interval, the p of the mean return among random entries in the same stocks, profit factor, mean R and the verdict.

    events are pattern_events with trades. The random entries of a stock are all its bars; their mean
    and variance make the law of the mean of one draw an event, so p needs no replicates.
    """
    from .stats import bootstrap_ci

    w = Window.partitionBy("symbol").orderBy("bar_idx")
    later = bars.select("symbol", (F.try_divide(F.lead("close", h).over(w), F.lead("open").over(w)) - 1).alias("r")).groupBy("symbol").agg(F.avg("r").alias("m"), F.var_pop("r").alias("v"))
    rows = events.where(F.col(f"ret_{h}").isNotNull()).join(later, "symbol", "left")
    told = rows.groupBy("pattern").agg(
        F.count("*").alias("n"), F.avg(f"xlocal_{h}").alias("excess"), profit_factor(F.col("trade_ret")).alias("profit_factor"), F.avg("r_multiple").alias("avg_r"),
        F.try_divide(F.sum(F.col(f"ret_{h}") - F.col("dir") * F.col("m")), F.sqrt(F.sum("v"))).alias("z"),
    )
    spans = bootstrap_ci(rows.select("pattern", "symbol", "signal_idx", F.col(f"xlocal_{h}").alias("x")), "x", ["pattern"], reps)
    # one-sided normal tail by a rational approximation of the error function
    a = F.abs("z") / 2**0.5
    k = 1 / (1 + 0.3275911 * a)
    tail = k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429)))) * F.exp(-a * a) / 2
    p = F.when(F.col("z") >= 0, tail).otherwise(1 - tail)
    return told.withColumn("p", p).drop("z").join(spans, "pattern", "left").withColumn("verdict", research_verdict(least))


def structure_table(rows: DataFrame) -> DataFrame:
    """How many complete shapes of each pattern, and of ALL, were confirmed, failed or expired."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = rows.rollup("pattern").agg(F.grouping("pattern").alias("__g"), *map(n, ("confirmed", "failed", "expired")))
    out = out.withColumns({"pattern": F.when(F.col("__g") == 1, "ALL").otherwise(F.col("pattern")), "n": F.col("confirmed") + F.col("failed") + F.col("expired")}).drop("__g")
    return out.withColumns({f"{k}_rate": F.try_divide(F.col(c), F.col("n")) for k, c in (("confirm", "confirmed"), ("fail", "failed"), ("expire", "expired"))})


def hindsight_match(hindsight: DataFrame, seen: DataFrame, within: int = 3) -> DataFrame:
    """One row: events of each table (symbol, pattern, signal_idx), and of the first those with one of the second within so many bars."""
    keys = ["symbol", "pattern", "signal_idx"]
    a, b = hindsight.select(*keys).distinct(), seen.select(*keys).distinct()
    near = a.select("*", F.explode(F.sequence(F.col("signal_idx") - within, F.col("signal_idx") + within)).alias("__at"))
    met = near.join(b.withColumnRenamed("signal_idx", "__at"), ["symbol", "pattern", "__at"], "left_semi").select(*keys).distinct()
    told = a.join(met.withColumn("__met", F.lit(1)), keys, "left").agg(F.count("*").alias("hindsight_events"), F.count("__met").alias("matched"))
    return told.join(b.agg(F.count("*").alias("seen_events"))).withColumn("match_rate", F.try_divide(F.col("matched"), F.col("hindsight_events")))


def conditional_table(events: DataFrame, h: int = 20, least: int = 100, least_year: int = 30) -> DataFrame:
    """Mean excess of each pattern under conditions that overlap, where there are enough events, and in how many years it was positive."""
    x = F.col(f"xlocal_{h}")
    rows = events.where(F.col(f"ret_{h}").isNotNull())
    told = {"loud": F.col("breakout_volume") >= 1.5, "same_bar": F.col("delay") <= 0, "extended": F.col("gap_from_level") > 0.03}
    sides = {"loud": told["loud"], "quiet": ~told["loud"], "same_bar": told["same_bar"], "delayed": ~told["same_bar"], "extended": told["extended"], "near_level": ~told["extended"]}
    held = {k: F.coalesce(c, F.lit(k in ("quiet", "delayed", "near_level"))) for k, c in sides.items()}
    cols = [F.count_if(c).alias(f"n_{k}") for k, c in held.items()] + [F.when(F.count_if(c) >= least, F.avg(F.when(c, x))).alias(f"x_{k}") for k, c in held.items()]
    out = rows.groupBy("pattern").agg(F.count("*").alias("n"), F.avg(x).alias("x_all"), *cols)
    yearly = rows.groupBy("pattern", "year").agg(F.count("*").alias("k"), F.avg(x).alias("m")).where(F.col("k") >= least_year)
    return out.join(yearly.groupBy("pattern").agg(F.count("*").alias("years"), F.count_if(F.col("m") > 0).alias("years_positive")), "pattern", "left").fillna(0, ["years", "years_positive"])


def volume_bucket(ratio: Column) -> Column:
    out = F.when(ratio.isNull() | (ratio <= 0), F.lit(None).cast("string"))
    for edge, label in VOLUME_BINS:
        out = out.when(ratio <= edge, label)
    return out.otherwise(">2.5x")


def research_verdict(least: int = 100) -> Column:
    """A verdict in words from n, low and high (of the excess), p, profit_factor and avg_r."""
    return (
        F.when(F.col("n") < least, "insufficient data").when((F.col("low") > 0) & (F.col("p") < 0.05), "edge").when(F.col("high") < 0, "worse than random")
        .when((F.col("profit_factor") > 1.1) & (F.col("avg_r") > 0.05), "unproven").otherwise("no edge")
    )


def agreement(table: DataFrame, by: list[str], needed: tuple[str, ...] = ("train", "test"), threshold: float = 0.005, least: int = 30) -> DataFrame:
    """Whether the excess (xlocal) of each group is beyond the threshold, on one side, in every period that is needed, with enough events in each."""
    at = lambda p, c: F.max(F.when(F.col("period") == p, F.col(c)))
    wide = table.groupBy(*by).agg(*[at(p, c).alias(f"{p}_{c}") for p in needed for c in ("n", "xlocal")])
    enough, up, down = F.lit(True), F.lit(True), F.lit(True)
    for p in needed:
        enough &= F.col(f"{p}_n") >= least
        up &= F.col(f"{p}_xlocal") >= threshold
        down &= F.col(f"{p}_xlocal") <= -threshold
    return wide.withColumn("direction", F.when(enough & up, "up").when(enough & down, "down").otherwise("none")).withColumn("passed", F.col("direction") != "none")


def cost_sensitivity(events: DataFrame, costs: list[float], by: list[str], h: int = 20) -> DataFrame:
    """Net return, hit rate, excess and profit factor of each group at each cost."""
    rows = events.where((F.col("h") == h) & F.col("ret").isNotNull()).select("*", F.explode(F.array(*map(F.lit, costs))).alias("cost")).withColumn("net", F.col("ret") - F.col("cost"))
    return rows.groupBy("cost", *by).agg(F.count("*").alias("n"), F.avg("net").alias("net_ret"), F.avg((F.col("net") > 0).cast("int")).alias("hit"), F.avg(F.col("xlocal") - F.col("cost")).alias("excess"), profit_factor(F.col("net")).alias("profit_factor"))


def base_directions(bases: DataFrame, edges: list[float], split: str, horizons: list[int] = [20, 60], cost: float = 0.001) -> DataFrame:  # noqa: B006
    """How often bases of each volume bucket were left upward or broken, and the net return, in train and test."""
    bucket = F.lit(0)
    for e in edges:
        bucket = bucket + (F.col("base_volume") > e).cast("int")
    period = F.when(F.col("date") < F.lit(split).cast("date"), "train").otherwise("test")
    cols = [c for h in horizons for c in (F.avg(F.col(f"up_{h}").cast("int")).alias(f"up_{h}"), F.avg(F.col(f"down_{h}").cast("int")).alias(f"down_{h}"), (F.avg(f"ret_{h}") - cost).alias(f"net_{h}"))]
    return bases.groupBy(bucket.alias("bucket"), period.alias("period")).agg(F.count("*").alias("n"), *cols)


def downtrends(rows: DataFrame) -> list[tuple[str, Column]]:
    """Names and conditions of what may come before a candle; rows of events.every_bar with above_ma50 and ma10_slope."""
    c = F.col
    below = ~c("above_ma50") & (c("ma10_slope") <= 0)
    return [
        ("all", F.lit(True)), ("quarter under -10%", c("ret_q") < -0.10), ("quarter under -20%", c("ret_q") < -0.20), ("half under -15%", c("ret_h") < -0.15), ("20% below the high", c("from_high") <= -0.20),
        ("mean falls 4+ bars", c("ma_down_run") >= 4), ("3+ falling bars", c("down_run") >= 3), ("falling and below", below), ("quarter under -10%, falling and below", (c("ret_q") < -0.10) & below), ("uptrend", c("ret_q") > 0.10),
        ("mean rises", c("ma10_slope") > 0), ("mean falls", c("ma10_slope") <= 0), ("above the 50-bar mean", c("above_ma50")), ("below the 50-bar mean", ~c("above_ma50")),
    ]


def candle_control(population: DataFrame, labels: list[tuple[str, Column]], h: int, least: int = 5) -> DataFrame:
    """Candles against all other bars with the same label: counts, means, hit rates, and Welch's t; labels overlap."""
    r = F.col(f"ret_{h}")
    rows = population.where(r.isNotNull()).select("is_doji", r.alias("r"), F.explode(conditional(labels)).alias("label"))
    a, b = F.when(F.col("is_doji"), F.col("r")), F.when(~F.col("is_doji"), F.col("r"))
    hit = lambda x: F.avg((x > 0).cast("int"))
    out = rows.groupBy("label").agg(F.count(a).alias("n_doji"), F.count(b).alias("n_rest"), F.avg(a).alias("doji"), F.avg(b).alias("rest"), hit(a).alias("hit_doji"), hit(b).alias("hit_rest"), welch(a, b).alias("t"))
    return out.where(F.col("n_doji") >= least)


# --- live lists ------------------------------------------------------------


def newsday_live(bars: DataFrame, gap_min: float = 0.04, times: float = 3.0, max_age: int = 5, deep: float | None = -0.08, hold: int = 60, least_bars: int = 260) -> DataFrame:
    """Of each symbol the first of its last max_age bars that opened far from the close before on much volume, below the 200-bar mean and, with deep, far below the close of half a year before."""
    s = bars.withColumns({
        "gap": F.try_divide(F.col("open"), shift("close")) - 1, "volume_ratio": F.try_divide(F.col("volume"), rolling("volume", 20, lag=1)), "day_return": change("close", 1), "ret_6m": change("close", 126),
        "dist_ma200": F.try_divide(F.col("close"), rolling("close", 200)) - 1, "__n": F.count("*").over(Window.partitionBy("symbol")), "last_close": F.last("close").over(own().rowsBetween(0, Window.unboundedFollowing)),
    }).withColumn("bars_ago", (F.col("__n") - 1 - F.col("bar_idx")).cast("int"))
    hit = (F.abs("gap") >= gap_min) & (F.col("volume_ratio") >= times) & (F.col("dist_ma200") < 0) & (F.col("bars_ago") < max_age) & (F.col("__n") >= least_bars)
    if deep is not None:
        hit &= F.col("ret_6m") < deep
    first = s.where(hit).withColumn("__r", F.row_number().over(own("bar_idx"))).where("__r = 1")
    return first.select("symbol", F.col("date").alias("news_date"), "bars_ago", "gap", "day_return", "volume_ratio", "ret_6m", "dist_ma200", F.col("close").alias("news_close"), "last_close", (F.try_divide(F.col("last_close"), F.col("close")) - 1).alias("since_news"), (F.lit(hold) - F.col("bars_ago")).alias("bars_left"))


def rally_live(bars: DataFrame, rules: tuple[str, ...] = E.WINDOW_RULES, max_age: int = 1, least_bars: int = 300) -> DataFrame:
    """The last firing of each rule within the last max_age bars of each symbol, with its context."""
    rich = I.with_beaten(I.with_volume_ratio(bars)).withColumns({
        "day_ret": change("close", 1), "ret_10": change("close", 10), "ret_6m": change("close", 126), "from_52w_high": F.try_divide(F.col("close"), rolling("close", 252, F.max)) - 1,
        "dist_ma50": F.try_divide(F.col("close"), rolling("close", 50)) - 1, "dist_ma200": F.try_divide(F.col("close"), rolling("close", 200)) - 1, "__n": F.count("*").over(Window.partitionBy("symbol")), "last": F.last("close").over(own().rowsBetween(0, Window.unboundedFollowing)),
    }).withColumn("bars_ago", (F.col("__n") - 1 - F.col("bar_idx")).cast("int"))
    hits = E.rally_hits(rich, rules).where((F.col("bars_ago") < max_age) & (F.col("__n") >= least_bars))
    newest = hits.withColumn("__r", F.row_number().over(Window.partitionBy("symbol", "rule").orderBy("bars_ago"))).where("__r = 1")
    return newest.select("symbol", "rule", F.col("date").alias("signal_date"), "bars_ago", "close", "last", "day_ret", "ret_10", "ret_6m", "from_52w_high", "dist_ma50", "dist_ma200", "volume_ratio", (F.col("dist_ma200") < 0).alias("below_ma200"), "beaten")


def early_rally(live: DataFrame) -> DataFrame:
    """One row for each beaten-down symbol of a live list: its rules, newest first, and the newest one's context."""
    rows = live.where("beaten")
    order = F.array_sort(F.collect_list(F.struct("bars_ago", "rule")))
    told = rows.groupBy("symbol").agg(F.array_join(F.transform(order, lambda x: x["rule"]), ", ").alias("rules"), F.count("*").cast("int").alias("n_rules"))
    newest = rows.withColumn("__r", F.row_number().over(Window.partitionBy("symbol").orderBy("bars_ago", "rule"))).where("__r = 1").drop("__r", "rule", "below_ma200", "beaten")
    return told.join(newest, "symbol")


# --- journal and reports ---------------------------------------------------


def journal_verdicts(marked: DataFrame, expected: dict[str, float], least: int = 10) -> DataFrame:
    """Per rule the realised results of done and open trades, and whether they are on the track that was expected (a hit rate by rule)."""
    hit = F.coalesce(*[F.when(F.col("rule") == r, F.lit(p)) for r, p in expected.items()], F.lit(None).cast("double")) if expected else F.lit(None).cast("double")
    done, left = F.when(F.col("done"), F.col("ret")), F.when(~F.col("done"), F.col("ret"))
    rate = lambda x: F.avg((x > 0).cast("int"))
    out = marked.groupBy("rule").agg(
        F.count("*").alias("logged"), F.count_if("done").alias("closed"), F.count_if(~F.col("done")).alias("open"), F.avg(done).alias("mean_closed"), rate(done).alias("hit_closed"),
        F.avg(done - F.col("bench_ret")).alias("xbench_closed"), F.avg(left).alias("mean_open"), rate(left).alias("hit_open"), F.avg("ret").alias("mean_all"), rate(F.col("ret")).alias("hit_all"),
    ).withColumn("expected_hit", hit)
    good = (F.col("mean_closed") > 0) & (F.col("hit_closed") >= F.coalesce(F.col("expected_hit") - 0.10, F.lit(0.5)))
    return out.withColumn("verdict", F.when(F.col("closed") < least, "early").when(good, "on_track").otherwise("below"))


def half_stability(rows: DataFrame, by: list[str], date: str = "signal_date", x: str = "excess", least: int = 8) -> DataFrame:
    """Mean of x in the first and the second half of each group's span of days, and whether both have the same sign with enough rows."""
    w = Window.partitionBy(*by)
    first = F.unix_date(F.min(date).over(w))
    mid = first + (F.unix_date(F.max(date).over(w)) - first) / 2
    early = rows.where(F.col(x).isNotNull()).withColumn("__early", F.unix_date(date) <= mid)
    a, b = F.when(F.col("__early"), F.col(x)), F.when(~F.col("__early"), F.col(x))
    out = early.groupBy(*by).agg(F.count(a).alias("n1"), F.avg(a).alias("half1"), F.count(b).alias("n2"), F.avg(b).alias("half2"))
    return out.withColumn("stable", F.coalesce((F.col("n1") >= least) & (F.col("n2") >= least) & (F.signum("half1") == F.signum("half2")), F.lit(False)))


def days_listed(reports: DataFrame, today: str, look: int = 30) -> DataFrame:
    """On how many of the last `look` report days before today each section listed each symbol. reports: date, section, symbol."""
    before = reports.where(F.col("date") < F.lit(today).cast("date"))
    days = before.select("date").distinct().orderBy(F.desc("date")).limit(look)
    return before.select("date", "section", "symbol").distinct().join(F.broadcast(days), "date").groupBy("section", "symbol").agg(F.count("*").alias("days"))


def checklist(rows: DataFrame, warnings: list[str], top: int = 10) -> DataFrame:
    """The `top` rows (symbol, signal, flags, read, group, score) with a signal and no warning among their flags, by how many checks they pass."""
    deep = F.array_contains("flags", "D")
    kept = rows.where(F.col("signal") & ~F.arrays_overlap("flags", F.array(*map(F.lit, warnings))))
    told = kept.withColumn("passes", (F.lit(2) + deep.cast("int") + F.col("group").cast("int") + F.col("read").cast("int")).cast("int"))
    return told.orderBy(F.desc("passes"), F.desc("score"), "symbol").limit(top).select("symbol", "passes", "score")


def first_by(rows: DataFrame, flag: Column, order: list[Column], by: list[str]) -> DataFrame:
    """rows with `place`: those with the flag first, each part in the order that it had."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.coalesce(flag, F.lit(False)).desc(), *order)))


# --- series ----------------------------------------------------------------


def rolling_correlation(rows: DataFrame, x: str, y: str, n: int, order: str = "date") -> DataFrame:
    """rows with `corr` of the last n pairs; null with fewer."""
    frame = own(order).rowsBetween(-(n - 1), 0)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return rows.withColumn("corr", F.when(F.count(F.when(both, 1)).over(frame) >= n, F.corr(x, y).over(frame)))


def forward_sum(rows: DataFrame, x: str, n: int, order: str = "date") -> DataFrame:
    """rows with `ahead`, the sum of the next n values; null where there are fewer."""
    frame = own(order).rowsBetween(1, n)
    return rows.withColumn("ahead", F.when(F.count(x).over(frame) >= n, F.sum(x).over(frame)))


def growth_price_features(bars: DataFrame) -> DataFrame:
    """Per symbol at its last bar: momentum without the last month, the last month, distance from the 200-bar mean, range and volatility."""
    s = I.with_atr(bars).withColumns({"__r": change("close", 1)})
    s = s.withColumns({
        "mom_12_1": F.try_divide(shift("close", 21), shift("close", 252)) - 1, "mom_6_1": F.try_divide(shift("close", 21), shift("close", 126)) - 1, "ret_21": change("close", 21),
        "dist_ma200": F.try_divide(F.col("close"), rolling("close", 200)) - 1, "atr_pct": F.try_divide(F.col("atr"), F.col("close")), "vol_1y": rolling("__r", 252, F.stddev_samp) * (252**0.5),
    })
    last = s.withColumn("__k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("bar_idx")))).where("__k = 1")
    return last.select("symbol", "date", "mom_12_1", "mom_6_1", "ret_21", "dist_ma200", "atr_pct", "vol_1y")


def breakout_context(bars: DataFrame) -> DataFrame:
    """bars with the context of a deep look: returns, distances from means, where the close lies in the bar, and the bar's volume."""
    s = I.with_volume_ratio(bars)
    return s.withColumns({
        "ret_126": change("close", 126), "dist_ma200": F.try_divide(F.col("close"), rolling("close", 200)) - 1, "dist_ma50": F.try_divide(F.col("close"), rolling("close", 50)) - 1,
        "close_strength": F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")),
    })


def shifted_events(events: DataFrame, dense: DataFrame, reach: int = 126, hold: int = 20, seed: int = 0) -> DataFrame:
    """events (symbol, t) moved by a hashed number of days, up to reach to either side and kept within the series: the control of an event portfolio."""
    last = dense.groupBy("symbol").agg(F.max("t").alias("__last"))
    step = F.pmod(F.xxhash64(F.lit(seed), "symbol", "t"), F.lit(2 * reach + 1)).cast("int") - reach
    return events.join(last, "symbol").withColumn("t", F.least(F.greatest(F.col("t") + step, F.lit(0)), F.col("__last") - hold - 1).cast("int")).drop("__last")
