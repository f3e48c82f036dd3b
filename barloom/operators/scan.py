"""A scan of a whole universe by groups: how close members are and whether that changes, what shocks do to peers, and whether stocks that strayed come back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import peers as P
from .stats import spearman


def cohesion(values: DataFrame, groups: DataFrame, x: str = "e", least: int = 2) -> DataFrame:
    """grp, pairs and intra, the mean correlation of a group's pairs; only pairs within a group are made."""
    rows = values.join(groups.select("symbol", "grp"), "symbol")
    pairs = P.correlation_blocks(rows, x, ["grp"]).select("grp", F.explode(F.arrays_zip("n", "corr")).alias("p")).where(F.col("p.n") >= least)
    return pairs.groupBy("grp").agg(F.count("p.corr").alias("pairs"), F.avg("p.corr").alias("intra"))


def cohesion_change(values: DataFrame, groups: DataFrame, window: int = 63, x: str = "e") -> DataFrame:
    """grp, full, recent and delta: cohesion over all days and over the last `window` of them."""
    last = values.agg(F.max("t")).first()[0]
    full = cohesion(values, groups, x).select("grp", F.col("intra").alias("full"))
    recent = cohesion(values.where(F.col("t") > (last or 0) - window), groups, x).select("grp", F.col("intra").alias("recent"))
    return full.join(recent, "grp", "left").withColumn("delta", F.col("recent") - F.col("full"))


def group_profiles(values: DataFrame, groups: DataFrame, labels: DataFrame, x: str = "e") -> DataFrame:
    """grp, n, intra, and the commonest label (labels: symbol, label) with its share and how many there are; ties go to the first by name."""
    named = groups.select("symbol", "grp").join(labels, "symbol", "left").withColumn("label", F.coalesce("label", F.lit("Unclassified")))
    counts = named.groupBy("grp", "label").count()
    top = counts.groupBy("grp").agg(F.sum("count").alias("n"), F.min_by("label", F.struct(-F.col("count"), F.col("label"))).alias("label"), F.max("count").alias("k"), F.count("*").alias("labels"))
    return top.join(cohesion(values, groups, x), "grp", "left").select("grp", "n", "label", (F.col("k") / F.col("n")).alias("label_share"), "labels", "intra")


def shock_spillover(values: DataFrame, groups: DataFrame, least_z: float = 2.5, x: str = "e", after: int = 5, least: int = 3) -> DataFrame:
    """span (day, next, later) with n, mean and t: what the other members of a group do on the day of a shock, the next one, and from then up to `after` days on, signed as the shock.

    A shock is a residual beyond least_z of its own deviations with `after` days to follow. Days count
    along the panel's t; sums over a group's days stand for its members, so no event meets its peers.
    """
    rows = values.join(groups.select("symbol", "grp"), "symbol").select("symbol", "grp", "t", F.col(x).alias("e"))
    size = groups.groupBy("grp").agg(F.count("*").alias("members")).where(F.col("members") >= least)
    day = rows.groupBy("grp", "t").agg(F.sum("e").alias("total"), F.count("e").alias("there"))
    g = Window.partitionBy("grp").orderBy("t")
    ahead = g.rangeBetween(2, after)
    day = day.withColumns({"next_total": F.sum("total").over(g.rangeBetween(1, 1)), "next_there": F.sum("there").over(g.rangeBetween(1, 1)), "later_total": F.sum("total").over(ahead)})
    w = Window.partitionBy("symbol").orderBy("t")
    last = values.agg(F.max("t")).first()[0] or 0
    sd = rows.groupBy("symbol").agg(F.stddev_samp("e").alias("sd"))
    own = rows.withColumns({"next_e": F.sum("e").over(w.rangeBetween(1, 1)), "later_e": F.sum("e").over(w.rangeBetween(2, after))}).join(sd, "symbol")
    hit = own.where((F.abs("e") > least_z * F.col("sd")) & (F.col("t") + after <= last)).join(day, ["grp", "t"]).join(size, "grp")
    zero = F.lit(0.0)
    sign = F.signum("e")
    spans = {
        "day": F.try_divide(F.col("total") - F.col("e"), F.col("there") - 1), "next": F.try_divide(F.col("next_total") - F.coalesce("next_e", zero), F.col("next_there") - F.col("next_e").isNotNull().cast("int")),
        "later": F.try_divide(F.coalesce("later_total", zero) - F.coalesce("later_e", zero), F.col("members") - 1),
    }
    long = hit.select(F.explode(F.array(*[F.struct(F.lit(k).alias("span"), (sign * v).alias("v")) for k, v in spans.items()])).alias("s")).select("s.*")
    return long.groupBy("span").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.try_divide(F.avg("v"), F.stddev_pop("v") / F.sqrt(F.count("v"))).alias("t"))


def strayed(returns: DataFrame, groups: DataFrame, window: int = 20, history: int = 252, least: int = 126) -> DataFrame:
    """symbol, grp, t, z and ahead: how far a stock's last window days went from its group's, against its own last year, and what the next window days brought.

    returns: symbol, t, r; missing ones count as none. Beta is over the whole span.
    """
    days = returns.select("t").distinct()
    grid = groups.select("symbol", "grp").join(F.broadcast(days)).join(returns.select("symbol", "t", "r"), ["symbol", "t"], "left").withColumn("r", F.coalesce("r", F.lit(0.0)))  # a row a day of the calendar
    g = Window.partitionBy("grp", "t")
    rows = grid.withColumns({"n": F.count("*").over(g), "others": F.sum("r").over(g) - F.col("r")}).where("n >= 3").withColumn("others", F.col("others") / (F.col("n") - 1))
    beta = rows.groupBy("symbol").agg(F.coalesce(F.try_divide(F.covar_samp("r", "others"), F.var_samp("others")), F.lit(1.0)).alias("b"))
    w = Window.partitionBy("symbol").orderBy("t")
    rel = rows.join(beta, "symbol").withColumn("rel", F.col("r") - F.col("b") * F.col("others"))
    near, next_ = w.rowsBetween(1 - window, 0), w.rowsBetween(1, window)
    rel = rel.withColumns({"roll": F.when(F.count("rel").over(near) == window, F.sum("rel").over(near)), "ahead": F.when(F.count("rel").over(next_) == window, F.sum("rel").over(next_)), "day": F.row_number().over(w) - 1})
    past = w.rowsBetween(1 - history, 0)
    rel = rel.withColumns({"mu": F.avg("roll").over(past), "sd": F.stddev_samp("roll").over(past), "k": F.count("roll").over(past)})
    return rel.select("symbol", "grp", "t", "day", F.when((F.col("k") >= least) & (F.col("sd") > 0), (F.col("roll") - F.col("mu")) / F.col("sd")).alias("z"), "ahead")


def stray_study(rows: DataFrame, first: int = 260, step: int = 20, least: int = 100, beyond: float = 2.0, least_side: int = 3) -> DataFrame:
    """what (ic, up, down) with n, mean and t over every step-th day from `first`: the rank correlation of z with what came, and the mean that came to stocks beyond either side."""
    held = rows.where((F.col("day") >= first) & ((F.col("day") - first) % step == 0) & F.col("z").isNotNull() & F.col("ahead").isNotNull())
    ic = spearman(held, "z", "ahead", ["t"]).where(F.col("n") > least).select(F.lit("ic").alias("what"), F.col("rho").alias("v"))
    side = held.withColumn("what", F.when(F.col("z") > beyond, "up").when(F.col("z") < -beyond, "down")).where(F.col("what").isNotNull())
    means = side.groupBy("what", "t").agg(F.count("*").alias("k"), F.avg("ahead").alias("v")).where(F.col("k") >= least_side).select("what", "v")
    both = ic.unionByName(means)
    return both.groupBy("what").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.try_divide(F.avg("v"), F.stddev_samp("v") / F.sqrt(F.count("v"))).alias("t"))


def rolling_sector_correlation(values: DataFrame, groups: DataFrame, window: int = 63, x: str = "e") -> DataFrame:
    """a, b, t, corr: the rolling correlation of the mean series of two groups over the last `window` days that both have."""
    series = values.join(groups.select("symbol", "grp"), "symbol").groupBy("grp", "t").agg(F.avg(x).alias("v"))
    wide = series.groupBy("t").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("grp", "v")))).alias("m"))  # a few groups a day
    names = F.array_sort(F.map_keys("m"))
    pairs = F.flatten(F.transform(names, lambda a: F.transform(F.filter(names, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = wide.select("t", "m", F.explode(pairs).alias("p")).select("t", F.col("p.a").alias("a"), F.col("p.b").alias("b"), F.col("m")[F.col("p.a")].alias("x"), F.col("m")[F.col("p.b")].alias("y"))
    frame = Window.partitionBy("a", "b").orderBy("t").rowsBetween(1 - window, 0)
    return rows.withColumn("corr", F.when(F.count("*").over(frame) >= window, F.corr("x", "y").over(frame))).where(F.col("corr").isNotNull()).select("a", "b", "t", "corr")
