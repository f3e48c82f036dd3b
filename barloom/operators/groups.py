"""Peer groups over time: the groups of each year, where a stock stood against its group at an event, and groups as one stock.

Nothing of a year enters its own groups: they come from the years before it. All models are built by
one grouped job, and what events need of them are trailing windows, so no event is joined with days.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frames import change, rolling
from . import events as E
from . import patterns as C
from . import peers as P
from . import stats as S
from . import verdicts as V

#: Least members of a group, years behind a basket, and bars within which a group's signal is near. Fixed values.
MEMBERS, BASKET_YEARS, NEAR = 3, 3, 10


def yearly(dense: DataFrame, first: int, last: int, years: list[int] | None = None) -> DataFrame:
    """dense with `year`: a row for each year from first to last years after its own; without years, those up to the calendar's last."""
    own = F.year("date")
    tagged = dense.withColumn("year", F.explode(F.sequence(own + first, own + last)))
    if years is not None:
        return tagged.where(F.col("year").isin(years))
    end = dense.agg(F.max(F.year("date"))).first()[0] or 0
    return tagged.where(F.col("year") <= end)


def point_in_time_groups(dense: DataFrame, years: list[int] | None = None, lookback_years: int = 3, per_group: int = 8, least_groups: int = 5, least_bars: int = 400, guard: float = 0.58) -> DataFrame:
    """year, symbol, grp, beta, vol and group_corr: the groups of each year, of stocks with least_bars closes in the years before it."""
    tagged = yearly(dense.select("symbol", "t", "date", "close"), 1, lookback_years, years)
    enough = tagged.groupBy("year", "symbol").agg(F.count("close").alias("n")).where(F.col("n") >= least_bars)
    full = enough.groupBy("year").agg(F.count("*").alias("k")).where(F.col("k") >= 2 * MEMBERS).select("year")
    rows = tagged.join(enough.join(F.broadcast(full), "year").select("year", "symbol"), ["year", "symbol"])  # full has a row a year
    return P.build_groups(P.log_returns(rows, guard=guard, by=["year"]), per_group, least_groups, by=["year"])


def divergence_at(events: DataFrame, models: DataFrame, dense: DataFrame, window: int = 20, history: int = 252, tail: int = 312, guard: float = 0.58) -> DataFrame:
    """events (symbol, date) with grp, n_group, rel and z, from days numbered from 0: the stock's last window days against the mean of its year's group, beta-adjusted, and its place in its own trailing history.

    Beta comes from the tail's returns, the history from up to `history` windows before. With 200
    days or fewer, or under MEMBERS members, rel and z are null; z also with under 126 windows before.
    """
    returns = P.log_returns(dense, None, guard).select("symbol", "t", "r")
    grid = dense.select("symbol", "t", "date").where("t > 0").join(returns, ["symbol", "t"], "left").withColumn("r", F.coalesce("r", F.lit(0.0)))
    rows = yearly(grid, 0, 2).join(models.select("year", "symbol", "grp"), ["year", "symbol"])
    day = rows.groupBy("year", "grp", "t").agg(F.sum("r").alias("total"), F.count("*").alias("n_group"))
    rows = rows.join(day, ["year", "grp", "t"]).where(F.col("n_group") >= MEMBERS).withColumn("p", (F.col("total") - F.col("r")) / (F.col("n_group") - 1))
    w = Window.partitionBy("year", "symbol").orderBy("t")
    # every trailing moment is a difference of running sums, so a day costs the same whatever the windows
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    running = lambda of: {f"c_{k}": F.sum(F.coalesce(x, F.lit(0.0))).over(so_far) for k, x in of.items()}
    within = lambda k, n, skip=0: F.coalesce(F.lag(f"c_{k}", skip).over(w) if skip else F.col(f"c_{k}"), F.lit(0.0)) - F.coalesce(F.lag(f"c_{k}", n + skip).over(w), F.lit(0.0))
    r, p = F.col("r"), F.col("p")
    rows = rows.withColumns({"place": F.row_number().over(w), **running({"r": r, "p": p, "rp": r * p, "pp": p * p})})
    span = tail - 1
    rows = rows.withColumns({"days": F.least("place", F.lit(span)), **{f"w_{k}": within(k, span) for k in ("r", "p", "rp", "pp")}, **{f"{k}s": F.when(F.col("place") >= window, within(k, window)) for k in ("r", "p")}})
    spread_p = F.col("w_pp") - F.col("w_p") ** 2 / F.col("days")
    rows = rows.withColumn("b", F.when(spread_p > 1e-18, (F.col("w_rp") - F.col("w_r") * F.col("w_p") / F.col("days")) / spread_p).otherwise(1.0))
    rs, ps = F.col("rs"), F.col("ps")
    rows = rows.withColumns(running({"k": rs.isNotNull().cast("double"), "rs": rs, "ps": ps, "rs2": rs * rs, "ps2": ps * ps, "rps": rs * ps}))
    rows = rows.withColumns({f"h_{k}": within(k, history, 1) for k in ("k", "rs", "ps", "rs2", "ps2", "rps")})
    b, k = F.col("b"), F.col("h_k")
    moment = lambda xy, x, y: (F.col(f"h_{xy}") - F.col(f"h_{x}") * F.col(f"h_{y}") / k) / (k - 1)
    spread = F.when(k >= 2, moment("rs2", "rs", "rs") + b * b * moment("ps2", "ps", "ps") - 2 * b * moment("rps", "rs", "ps"))
    rows = rows.withColumns({"past": k, "mu": F.when(k > 0, (F.col("h_rs") - b * F.col("h_ps")) / k), "spread": spread})
    now = F.when(F.col("days") >= 200, F.col("rs") - b * F.col("ps"))
    z = F.when((F.col("past") >= 126) & (F.col("spread") > 1e-18), (now - F.col("mu")) / F.sqrt("spread"))
    told = rows.where(F.year("date") == F.col("year")).select("symbol", "date", "grp", "n_group", F.expm1(now).alias("rel"), z.alias("z"))
    return events.join(told, ["symbol", "date"], "left")


def universe_key(dense: DataFrame, least_bars: int = 260) -> str:
    """A fingerprint of the stocks with least_bars closes: it doesn't depend on their order."""
    held = dense.groupBy("symbol").agg(F.count("close").alias("n")).where(F.col("n") >= least_bars)
    r = held.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("symbol")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "symbol")).alias("b")).first()
    return f"{r['n']}-{(r['a'] or 0) & (1 << 64) - 1:016x}{(r['b'] or 0) & (1 << 64) - 1:016x}"


def load_groups(spark: SparkSession, dense: DataFrame, path: str, today: str, max_age_days: int = 7, refresh: bool = False, build: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The groups of a table of versions: those of this universe that are no older than max_age_days, or new ones, which are added to it.

    A version is a folder named by the universe and its day, written as a whole before it is read;
    one that a lost job left unfinished has no _SUCCESS and is not seen. Old versions stay.
    """
    key = universe_key(dense)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop.Path(f"{path}/universe={key}/built=*/_SUCCESS")) or []
    days = sorted(str(f.getPath().getParent().getName()).split("=")[1] for f in found)
    oldest = str(spark.range(1).select(F.date_sub(F.lit(today).cast("date"), max_age_days)).first()[0])
    fresh = [d for d in days if oldest < d <= today]
    at = f"{path}/universe={key}/built={fresh[-1] if fresh else today}"
    if refresh or not fresh:
        at = f"{path}/universe={key}/built={today}"
        (build or (lambda d: P.build_groups(P.log_returns(d))))(dense).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


# --- groups as one stock ---------------------------------------------------


def named(baskets: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Baskets as bars: symbol is the group, after its year if there is one."""
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in (*by, "grp")])
    w = Window.partitionBy(*by, "grp").orderBy("t")
    return baskets.select(*by, "grp", key.alias("symbol"), (F.row_number().over(w) - 1).cast("int").alias("bar_idx"), "date", "open", "high", "low", "close", "volume", "n_members")


def yearly_baskets(dense: DataFrame, models: DataFrame, years: int = BASKET_YEARS, least_bars: int = 300) -> DataFrame:
    """Bars of each year's groups, from so many years before it to its end, where there are least_bars."""
    rows = yearly(dense.select("symbol", "t", "date", "open", "high", "low", "close", "volume"), 0, years)
    bars = named(P.basket(rows, models, MEMBERS, ["year"]), ["year"])
    return bars.withColumn("__n", F.count("*").over(Window.partitionBy("symbol"))).where(F.col("__n") >= least_bars).drop("__n")


def state(bars: DataFrame) -> DataFrame:
    """bars with ret_126, dist_ma200 and beaten of each bar; null and false before the 200th."""
    ready = F.col("bar_idx") >= 200
    s = bars.withColumns({"ret_126": F.when(ready, change("close", 126, "bar_idx")), "dist_ma200": F.when(ready, F.try_divide(F.col("close"), rolling("close", 200, order="bar_idx")) - 1)})
    return s.withColumn("beaten", F.coalesce((F.col("ret_126") < -0.08) & (F.col("dist_ma200") < 0), F.lit(False)))


def wedges(baskets: DataFrame, cfg: C.Settings = C.Settings()) -> DataFrame:  # noqa: B008
    """Falling wedges of baskets (bars with symbol), with the days of their start, end and breakout."""
    found = C.scan(baskets, ["Falling Wedge"], cfg=cfg)
    day = lambda i, d: baskets.select("symbol", F.col("bar_idx").alias(i), F.col("date").alias(d))
    return found.join(day("start_idx", "start_date"), ["symbol", "start_idx"]).join(day("end_idx", "end_date"), ["symbol", "end_idx"]).join(day("breakout_idx", "breakout_date"), ["symbol", "breakout_idx"], "left")


def signals_today(baskets: DataFrame, groups: DataFrame, bars: DataFrame, recent: int = 5, least_bars: int = 260, cfg: C.Settings = C.Settings()) -> DataFrame:  # noqa: B008
    """Beaten-down groups that are in a falling wedge at their last bar or have just left one, with their members and the share of them that is beaten down."""
    w = Window.partitionBy("symbol")
    last = state(baskets).withColumns({"last_idx": F.max("bar_idx").over(w), "__n": F.count("*").over(w)}).where("bar_idx = last_idx")
    down = last.where(F.col("beaten") & (F.col("__n") >= least_bars)).select("symbol", "grp", "last_idx", "ret_126", "dist_ma200")
    near = wedges(baskets, cfg).join(down, "symbol").where(F.col("status").isin("forming", "confirmed") & (F.col("last_idx") - F.col("end_idx") <= recent))
    one = near.withColumn("__r", F.row_number().over(w.orderBy("end_idx", F.desc("score")))).where("__r = 1")
    own = state(bars).withColumn("__l", F.max("bar_idx").over(w)).where("bar_idx = __l").select("symbol", "beaten")
    members = groups.select("grp", "symbol").join(own, "symbol").groupBy("grp").agg(F.count("*").alias("n_members"), F.array_sort(F.collect_list("symbol")).alias("members"), F.avg(F.col("beaten").cast("int")).alias("share_beaten"))
    return one.select("grp", "status", "score", "start_date", "breakout_date", "ret_126", "dist_ma200").join(members, "grp")


def context_today(baskets: DataFrame, groups: DataFrame, bars: DataFrame, cfg: C.Settings = C.Settings()) -> DataFrame:  # noqa: B008
    """Per member of a group: whether the group is beaten down, the share of the other members that are, and the group's wedge near its last bar."""
    w = Window.partitionBy("symbol")
    last = state(baskets).withColumns({"last_idx": F.max("bar_idx").over(w), "last_date": F.max("date").over(w)}).where("bar_idx = last_idx").select("symbol", "grp", "last_idx", "last_date", F.col("beaten").alias("g_beaten"), F.col("ret_126").alias("g_ret_126"), F.col("dist_ma200").alias("g_dist_ma200"))
    found = wedges(baskets, cfg).join(last.select("symbol", "grp", "last_idx", "last_date"), "symbol")
    near = found.where(F.col("status").isin("forming", "confirmed") & (F.col("last_idx") - F.col("end_idx") <= NEAR)).withColumn("__r", F.row_number().over(w.orderBy("end_idx", F.desc("score")))).where("__r = 1").select("grp", F.col("status").alias("g_wedge"), F.col("breakout_date").alias("g_breakout"))
    broke = found.where((F.col("status") == "confirmed") & (F.datediff("last_date", "breakout_date") <= NEAR * 1.5)).select("grp").distinct().withColumn("g_wedge_breakout", F.lit(True))
    own = state(bars).withColumn("__l", F.max("bar_idx").over(w)).where("bar_idx = __l").select("symbol", "beaten").join(groups.select("symbol", "grp"), "symbol")
    g = Window.partitionBy("grp")
    own = own.withColumns({"n_group": F.count("*").over(g), "__b": F.sum(F.col("beaten").cast("int")).over(g)})
    share = F.try_divide((F.col("__b") - F.col("beaten").cast("int")).cast("double"), F.col("n_group") - 1)
    return own.select("symbol", "grp", "n_group", share.alias("share_beaten")).join(last.drop("symbol", "last_idx", "last_date"), "grp").join(near, "grp", "left").join(broke, "grp", "left").withColumn("g_wedge_breakout", F.coalesce("g_wedge_breakout", F.lit(False)))


def group_events(baskets: DataFrame, models: DataFrame, bars: DataFrame, bench: DataFrame, horizons: list[int] = [5, 20, 60], matches: DataFrame | None = None) -> DataFrame:  # noqa: B006
    """Events of yearly baskets' wedges in the baskets' own year, with the group's state and what the members did from their next open."""
    found = (wedges(baskets) if matches is None else matches).withColumnRenamed("points", "key_points")
    ev = V.pattern_events(found, baskets.drop("year", "grp", "n_members"), bench, horizons)
    own = state(baskets).select("symbol", F.col("bar_idx").alias("signal_idx"), F.col("year").alias("model_year"), "grp", "n_members", F.col("ret_126").alias("g_ret_126"), F.col("dist_ma200").alias("g_dist_ma200"), F.col("beaten").alias("g_beaten"))
    ev = ev.join(own, ["symbol", "signal_idx"]).where("year = model_year").drop("model_year")
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    ahead = state(bars).select(F.col("symbol").alias("member"), "date", "beaten", *[(F.try_divide(F.lead("close", h).over(w), F.lead("open").over(w)) - 1).alias(f"r_{h}") for h in horizons])
    each = ev.select("year", "grp", "date").distinct().join(models.select("year", "grp", F.col("symbol").alias("member")), ["year", "grp"]).join(ahead, ["member", "date"], "left")
    told = each.groupBy("year", "grp", "date").agg((F.sum(F.coalesce(F.col("beaten").cast("int"), F.lit(0))) / F.count("*")).alias("share_beaten"), *[a for h in horizons for a in (F.avg(f"r_{h}").alias(f"mem_ret_{h}"), F.avg((F.col(f"r_{h}") > 0).cast("int")).alias(f"mem_hit_{h}"))])
    return ev.join(told, ["year", "grp", "date"])


def confirmation(events: DataFrame, models: DataFrame, baskets: DataFrame, found: DataFrame, bars: DataFrame, dense: DataFrame) -> DataFrame:
    """events (symbol, date) with their group's state: beaten down, a breakout within NEAR bars before, in a wedge, the share of the other members that are beaten down, those that signal near, and the divergence from it.

    baskets and found (their wedges) are the yearly ones. Events of stocks without a group of
    MEMBERS keep nulls, and false where it is a flag.
    """
    keyed = events.withColumn("year", F.year("date")).join(models.select("year", "symbol", "grp"), ["year", "symbol"], "left")
    sizes = models.groupBy("year", "grp").agg(F.count("*").alias("n_members"))
    keyed = keyed.join(sizes, ["year", "grp"], "left")
    b = Window.partitionBy("symbol").orderBy("bar_idx").rowsBetween(-NEAR, 0)
    out_at = found.where("status = 'confirmed' AND breakout_idx IS NOT NULL").select("symbol", F.col("breakout_idx").alias("bar_idx"), F.lit(1).alias("__out")).distinct()
    # a wedge is open from its start to its end: +1 and, on the bar after, -1, summed along the bars
    spans = found.where(F.col("status").isin("forming", "confirmed"))
    steps = spans.select("symbol", F.explode(F.array(F.struct(F.col("start_idx").alias("bar_idx"), F.lit(1).alias("step")), F.struct((F.col("end_idx") + 1).alias("bar_idx"), F.lit(-1).alias("step")))).alias("x")).select("symbol", "x.*").groupBy("symbol", "bar_idx").agg(F.sum("step").alias("__step"))
    so_far = Window.partitionBy("symbol").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    own = state(baskets).join(out_at, ["symbol", "bar_idx"], "left").join(steps, ["symbol", "bar_idx"], "left")
    own = own.withColumns({"g_wedge_breakout": F.coalesce(F.max("__out").over(b) == 1, F.lit(False)), "g_in_wedge": F.coalesce(F.sum("__step").over(so_far), F.lit(0)) > 0})
    own = own.where(F.year("date") == F.col("year")).select("year", "grp", "date", F.col("ret_126").alias("g_ret_126"), F.col("dist_ma200").alias("g_dist_ma200"), F.col("beaten").alias("g_beaten"), "g_wedge_breakout", "g_in_wedge")
    out = keyed.join(own, ["year", "grp", "date"], "left")
    # the others' state on the first bar of theirs on or after the day, or their last one
    lined = dense.select("symbol", "date").join(state(bars).select("symbol", "date", "beaten"), ["symbol", "date"], "left")
    ahead = Window.partitionBy("symbol").orderBy("date")
    known = F.coalesce(F.first("beaten", ignorenulls=True).over(ahead.rowsBetween(0, Window.unboundedFollowing)), F.last("beaten", ignorenulls=True).over(ahead.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    day = lined.withColumn("__down", known.cast("int")).withColumn("year", F.year("date")).join(models.select("year", "symbol", "grp"), ["year", "symbol"])
    day = day.withColumn("__all", F.sum("__down").over(Window.partitionBy("year", "grp", "date"))).select("symbol", "date", (F.col("__all") - F.col("__down")).alias("__others"))
    out = out.join(day, ["symbol", "date"], "left").withColumn("share_beaten", F.when(F.col("n_members") >= MEMBERS, F.coalesce("__others", F.lit(0)) / F.greatest(F.lit(1), F.col("n_members") - 1))).drop("__others")
    # members with a signal within NEAR bars' worth of days, the stock itself left out
    d = out.withColumn("__d", F.unix_date("date"))
    close = Window.partitionBy("year", "grp").orderBy("__d").rangeBetween(-int(NEAR * 1.5), int(NEAR * 1.5))
    others = F.size(F.array_remove(F.collect_set("symbol").over(close), F.col("symbol")))
    out = d.withColumn("co_signals", F.when(F.col("n_members") >= MEMBERS, others)).drop("__d")
    out = divergence_at(out.drop("n_group"), models, dense).drop("n_group") if "z" not in out.columns else out
    return out.fillna(False, ["g_beaten", "g_wedge_breakout", "g_in_wedge"])


# --- tables ----------------------------------------------------------------


def condition_table(events: DataFrame, conditions: dict[str, Column], split: str, h: int = 20, reps: int = 0) -> DataFrame:
    """condition, period, state: n, ret, hit and excess of narrow events with and without each condition, in train and test; with reps also the bootstrap interval of the excess."""
    state_of = F.explode(F.array(*[F.struct(F.lit(k).alias("condition"), F.when(F.coalesce(c, F.lit(False)), "yes").otherwise("no").alias("state")) for k, c in conditions.items()]))
    rows = events.where((F.col("h") == h) & F.col("ret").isNotNull()).select("*", state_of.alias("s"), F.when(F.col("date") < F.lit(split).cast("date"), "train").otherwise("test").alias("period")).select("*", "s.condition", "s.state")
    keys = ["condition", "period", "state"]
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("ret").alias("ret"), F.avg((F.col("ret") > 0).cast("int")).alias("hit"), F.avg("xlocal").alias("excess"))
    if reps:
        out = out.join(S.bootstrap_ci(rows.select(*keys, "symbol", "date", "xlocal"), "xlocal", keys, reps), keys, "left")
    return out


def findings_table(events: DataFrame, conditions: dict[str, Column], split: str, h: int = 20, h2: int = 60, gap: float = 0.005, least_year: int = 5) -> DataFrame:
    """Per condition the excess of yes less that of no, in train and test at h and h2, in how many years it was positive, and whether it is at least gap in both periods at h."""
    state_of = F.explode(F.array(*[F.struct(F.lit(k).alias("condition"), F.coalesce(c, F.lit(False)).alias("yes")) for k, c in conditions.items()]))
    rows = events.where(F.col("h").isin(h, h2) & F.col("ret").isNotNull()).select("h", "date", "xlocal", state_of.alias("s"), F.when(F.col("date") < F.lit(split).cast("date"), "train").otherwise("test").alias("period")).select("*", "s.condition", "s.yes")
    side = lambda p, k, yes: F.when((F.col("period") == p) & (F.col("h") == k) & (F.col("yes") == yes), F.col("xlocal"))
    n = lambda p, k, yes: F.count_if((F.col("period") == p) & (F.col("h") == k) & (F.col("yes") == yes))
    cells = [a for p in ("train", "test") for k in (h, h2) for a in ((F.avg(side(p, k, True)) - F.avg(side(p, k, False))).alias(f"{p}_diff_{k}"), n(p, k, True).alias(f"{p}_n_yes_{k}"))]
    out = rows.groupBy("condition").agg(*cells)
    both = lambda yes: (F.col("h") == h) & (F.col("yes") == yes)
    yearly_ = rows.groupBy("condition", F.year("date").alias("y")).agg(F.count_if(both(True)).alias("a"), F.count_if(both(False)).alias("b"), (F.avg(F.when(both(True), F.col("xlocal"))) - F.avg(F.when(both(False), F.col("xlocal")))).alias("d"))
    years = yearly_.where((F.col("a") >= least_year) & (F.col("b") >= least_year)).groupBy("condition").agg(F.count("*").alias("years"), F.count_if(F.col("d") > 0).alias("years_positive"))
    told = out.join(years, "condition", "left").fillna(0, ["years", "years_positive"])
    return told.withColumn("consistent", F.coalesce((F.col(f"train_diff_{h}") >= gap) & (F.col(f"test_diff_{h}") >= gap), F.lit(False)))


def filter_table(events: DataFrame, split: str, h: int = 20, ret: str = "ret_126", distance: str = "dist_ma200", volatility: str = "atr_pct", market: str | None = None) -> DataFrame:
    """filter, period: results of a grid of filters on narrow events; thresholds are the terciles and the median of the events before split, and hold in both periods.

    Columns ret, distance and volatility are of the signal bar; market tells whether the benchmark was above its own mean.
    """
    own = events.where(F.col("h") == h).withColumn("period", F.when(F.col("date") < F.lit(split).cast("date"), "train").otherwise("test"))
    cuts = own.where("period = 'train'").agg(F.expr(f"percentile({ret}, array(1 / 3D, 2 / 3D))").alias("q"), F.expr(f"percentile({volatility}, 0.5)").alias("v"))
    rows = own.join(F.broadcast(cuts))  # one row
    low, high = F.col("q")[0], F.col("q")[1]
    down, below = F.col(ret) < low, F.col(distance) < 0
    rules = [("all", F.lit(True)), ("beaten down", down), ("below mean", below), ("beaten down and below mean", down & below), ("beaten down and volatile", down & (F.col(volatility) > F.col("v"))), ("uptrend", F.col(ret) > high), ("above mean", F.col(distance) >= 0)]
    if market:
        rules.append(("market below mean", ~F.col(market)))
    met = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules]), lambda x: x.isNotNull())
    span = rows.groupBy("period").agg(F.greatest(F.datediff(F.max("date"), F.min("date")) / 365.25, F.lit(1e-9)).alias("__years"))
    each = rows.select("*", F.explode(met).alias("filter"))
    out = each.groupBy("filter", "period").agg(
        F.count("*").alias("events"), F.count("ret").alias("n"), F.avg("ret").alias("ret"), F.avg(F.when(F.col("ret").isNotNull(), (F.col("ret") > 0).cast("int"))).alias("hit"),
        F.avg(F.when(F.col("ret").isNotNull(), F.col("xbench"))).alias("xbench"), F.avg(F.when(F.col("ret").isNotNull(), F.col("xlocal"))).alias("xlocal"), F.first("q").alias("q"), F.first("v").alias("median_volatility"),
    )
    return out.join(F.broadcast(span), "period").select("filter", "period", "n", "ret", "hit", "xbench", "xlocal", (F.col("events") / F.col("__years")).alias("per_year"), F.col("q")[0].alias("low_cut"), F.col("q")[1].alias("high_cut"), "median_volatility")
