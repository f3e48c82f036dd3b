"""Queries on groups over time, and on the matches that the detectors find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frames import change
from ..operators import events as E
from ..operators import groups as G
from ..operators import indicators as I
from ..operators import patterns as C
from ..operators import decisions as D
from ..operators import peers as P
from ..operators import scan as N
from ..operators import verdicts as V
from ..sources import bars as B
from . import tables as T
from .desk import _RET, _returns, _sectors
from .happenings import HS, SQL_NARROW, SQL_RALLY, _R, rally, rally_narrow
from .tables import SPLIT, lag, roll, rounded, sql_bars

PH = [5, 20]


def _nations(spark: SparkSession, sf: str) -> DataFrame:
    return T.bars_nation(spark, sf).drop("sector")


def _sector_years(spark: SparkSession, sf: str) -> DataFrame:
    """The regions as the groups of every year: given groups, so that what is built on them has SQL."""
    years = T.bars_nation(spark, sf).select(F.year("date").alias("year")).distinct()
    return _sectors(spark, sf).crossJoin(F.broadcast(years)).select("year", "symbol", "grp")  # a few years


def yearly_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of each year from the two years before it."""
    return rounded(G.point_in_time_groups(B.densify(_nations(spark, sf)), lookback_years=2, per_group=5, least_groups=4, guard=10.0))


def pair_stability(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.pair_stability(P.residuals(_returns(spark, sf)), least=60))


def _big_days(spark: SparkSession, sf: str) -> DataFrame:
    return _nations(spark, sf).withColumn("move", change("close", 1)).where(F.abs("move") >= 0.5).select("symbol", "date")


def divergence_at_events(spark: SparkSession, sf: str) -> DataFrame:
    """Where each nation stood against its region on its big days."""
    rows = G.divergence_at(_big_days(spark, sf), _sector_years(spark, sf), B.densify(_nations(spark, sf)), guard=10.0)
    return rounded(rows.select("symbol", "date", "grp", "n_group", "rel", "z"), 5)


def _group_state(spark: SparkSession, sf: str) -> DataFrame:
    """Rally events with the share of the other brands of their maker that were beaten down at their last bar."""
    bars = T.bars_brand(spark, sf)
    own = I.with_beaten(bars).select("symbol", "date", F.col("beaten").cast("int").alias("down"))
    calendar = B.densify(bars).select("symbol", "date").join(own, ["symbol", "date"], "left")
    known = F.coalesce(F.last("down", ignorenulls=True).over(Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    maker = Window.partitionBy(F.substring("symbol", 1, 7), "date")
    state = calendar.withColumn("down", known).withColumns({"all": F.sum("down").over(maker), "n": F.count("*").over(maker)})
    share = F.try_divide((F.col("all") - F.col("down")).cast("double"), F.col("n") - 1)
    return rally_narrow(spark, sf).join(state.select("symbol", "date", share.alias("others_beaten")), ["symbol", "date"])


def _group_conditions() -> dict:
    return {"most others beaten": F.col("others_beaten") > 0.5, "none beaten": F.col("others_beaten") == 0, "beaten with the group": F.col("beaten") & (F.col("others_beaten") > 0.5), "loud": F.col("volume_ratio") >= 1.5}


def group_confirmation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.condition_table(_group_state(spark, sf), _group_conditions(), SPLIT))


def group_findings(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.findings_table(_group_state(spark, sf), _group_conditions(), SPLIT, 20, 10))


def filter_table(spark: SparkSession, sf: str) -> DataFrame:
    """Filters on rally events with thresholds from the events before the split."""
    atr = I.with_atr(T.bars_brand(spark, sf)).select("symbol", "bar_idx", F.try_divide(F.col("atr"), F.col("close")).alias("atr_pct"))
    ev = rally(spark, sf).withColumn("dist_ma200", F.try_divide(F.col("close"), F.col("ma200")) - 1).join(atr, ["symbol", "bar_idx"])
    return rounded(G.filter_table(E.narrow(ev, HS, ["rule", "symbol", "date", "ret_126", "dist_ma200", "atr_pct"]), SPLIT))


# --- what the detectors find -----------------------------------------------


def _smooth_brands(spark: SparkSession, sf: str) -> DataFrame:
    """Brands over 20-bar means: raw trade prices swing too far for shapes."""
    w = Window.partitionBy("symbol").orderBy("bar_idx").rowsBetween(-19, 0)
    return T.bars_brand(spark, sf).select("symbol", "bar_idx", "date", *[F.avg(f).over(w).alias(f) for f in ("open", "high", "low", "close", "volume")])


def _found(bars: DataFrame, least: float = 0.60) -> DataFrame:
    return C.scan(bars, cfg=C.Settings(least_score=least)).withColumnRenamed("points", "key_points")


def _scan_events(spark: SparkSession, sf: str) -> DataFrame:
    bars = _smooth_brands(spark, sf)
    return V.pattern_events(_found(bars), bars, B.benchmark(bars), PH)


def scan_events(spark: SparkSession, sf: str) -> DataFrame:
    """Confirmed matches of every detector as events."""
    return rounded(_scan_events(spark, sf).select("symbol", "pattern", "dir", "scale", "signal_idx", "date", "entry", "delay", "gap_from_level", "breakout_volume", *[f"{c}_{h}" for h in PH for c in ("ret", "xbench", "xlocal")]))


def scan_trades(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.with_trades(_scan_events(spark, sf), _smooth_brands(spark, sf), 60)
    return rounded(rows.select("symbol", "pattern", "scale", "signal_idx", "exit_reason", "bars_held", "trade_ret", "mfe", "mae", "r_multiple"))


def scan_structures(spark: SparkSession, sf: str) -> DataFrame:
    """How often shapes that were complete came to be confirmed, failed or expired; they are judged by their scores before the status lowers them."""
    bars = _smooth_brands(spark, sf)
    return rounded(V.structure_table(V.structures(_found(bars, 0.0), bars, 60, 0.60)))


def scan_volume_buckets(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scan_events(spark, sf).where("ret_20 IS NOT NULL")
    return rounded(rows.groupBy(V.volume_bucket(F.col("breakout_volume")).alias("bucket")).agg(F.count("*").alias("n"), F.avg("ret_20").alias("ret"), F.avg("xlocal_20").alias("xlocal")))


def scan_conditions(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.conditional_table(_scan_events(spark, sf), 20, 5, 5))


def scan_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """A verdict on each pattern from its excess' bootstrap interval, its place among random entries, its profit factor and its mean R."""
    bars = _smooth_brands(spark, sf)
    ev = V.with_trades(_scan_events(spark, sf), bars, 60)
    return rounded(V.pattern_verdicts(ev, bars, 20, least=20, reps=200))


def _seen(bars: DataFrame) -> DataFrame:
    return V.walk_forward_matches(C.walk_forward(bars, window=400, step=1, most_lag=15))


def _smooth_flags(spark: SparkSession, sf: str) -> DataFrame:
    from .shapes import _smooth

    return _smooth(spark, sf)


def walk_forward_events(spark: SparkSession, sf: str) -> DataFrame:
    """Matches as they were first seen, as events from the bar that saw them."""
    bars = _smooth_flags(spark, sf)
    ev = V.pattern_events(_seen(bars), bars, B.benchmark(bars), PH)
    return rounded(ev.select("symbol", "pattern", "dir", "signal_idx", "date", "entry", "delay", *[f"{c}_{h}" for h in PH for c in ("ret", "xbench", "xlocal")]))


def walk_forward_match(spark: SparkSession, sf: str) -> DataFrame:
    """How many of the events that a scan of the whole series finds were seen at the time."""
    bars = _smooth_flags(spark, sf)
    scanned = V.pattern_events(_found(bars), bars, B.benchmark(bars), PH).where("signal_idx >= 400")
    return rounded(V.hindsight_match(scanned, V.pattern_events(_seen(bars), bars, B.benchmark(bars), PH)))


def _smooth_nations(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("bar_idx").rowsBetween(-19, 0)
    return _nations(spark, sf).select("symbol", "bar_idx", "date", *[F.avg(f).over(w).alias(f) for f in ("open", "high", "low", "close", "volume")])


def group_wedge_events(spark: SparkSession, sf: str) -> DataFrame:
    """Falling wedges of each year's regions as one stock, with what the nations did after."""
    smooth, models = _smooth_nations(spark, sf), _sector_years(spark, sf)
    dense = B.densify(smooth)
    ev = G.group_events(G.yearly_baskets(dense, models), models, smooth, B.benchmark(smooth), PH)
    return rounded(ev.select("year", "grp", "pattern", "signal_idx", "date", "ret_20", "xlocal_20", "g_ret_126", "g_beaten", "n_members", "share_beaten", "mem_ret_20", "mem_hit_20"))


def group_context(spark: SparkSession, sf: str) -> DataFrame:
    """Each nation's region at the last bar, and its wedge if it is near one."""
    bars, groups = _smooth_nations(spark, sf), _sectors(spark, sf)
    baskets = G.named(P.basket(B.densify(bars), groups))
    return rounded(G.context_today(baskets, groups, bars))


# --- the whole universe ----------------------------------------------------


def cohesion_change(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(N.cohesion_change(P.residuals(_returns(spark, sf)), _sectors(spark, sf)))


def shock_spillover(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(N.shock_spillover(P.residuals(_returns(spark, sf)), _sectors(spark, sf)))


def stray_study(spark: SparkSession, sf: str) -> DataFrame:
    """Whether nations that strayed from their region came back, over every 20th day."""
    return rounded(N.stray_study(N.strayed(_returns(spark, sf), _sectors(spark, sf)), least=10, least_side=1))


def sector_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(N.rolling_sector_correlation(P.residuals(_returns(spark, sf)), _sectors(spark, sf)), 5)


def volume_context_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Rally events by the volume of their day and of the ten days before."""
    rows = D.volume_at(T.bars_brand(spark, sf)).select("symbol", "bar_idx", "day_bucket", "climax_bucket")
    ev = rally_narrow(spark, sf).where("h = 20 AND ret IS NOT NULL").join(rows, ["symbol", "bar_idx"])
    each = ev.select("ret", "xlocal", F.explode(F.array(F.struct(F.lit("day").alias("kind"), F.col("day_bucket").alias("bucket")), F.struct(F.lit("climax").alias("kind"), F.col("climax_bucket").alias("bucket")))).alias("b"))
    return rounded(each.groupBy("b.kind", "b.bucket").agg(F.count("*").alias("n"), F.avg("ret").alias("ret"), F.avg("xlocal").alias("xlocal")))


def stock_states(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.stock_state(T.bars_brand(spark, sf)), last_close=9)


QUERIES = {f.__name__: f for f in (
    cohesion_change, shock_spillover, stray_study, sector_correlation, volume_context_buckets, stock_states, yearly_groups, pair_stability, divergence_at_events, group_confirmation, group_findings, filter_table, scan_events, scan_trades, scan_structures, scan_volume_buckets, scan_conditions, scan_verdicts,
    walk_forward_events, walk_forward_match, group_wedge_events, group_context,
)}

_SHARE = SQL_NARROW + f""", wb AS (SELECT symbol, date, (close < ({roll('avg', 'close', 200)}) AND close / ({lag('close', 126)}) - 1 < -0.08)::INT AS down FROM bars),
cal AS (SELECT s.symbol, d.date, coalesce(last_value(coalesce(w.down, CASE WHEN w.date IS NOT NULL THEN 0 END) IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY d.date), 0) AS down FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN (SELECT DISTINCT date FROM bars) d LEFT JOIN wb w ON w.symbol = s.symbol AND w.date = d.date),
sh AS (SELECT symbol, date, (sum(down) OVER m - down) / nullif(count(*) OVER m - 1, 0) AS others_beaten FROM cal WINDOW m AS (PARTITION BY substr(symbol, 1, 7), date)),
gc AS MATERIALIZED (SELECT nv.*, c.condition, coalesce(c.v, false) AS v, CASE WHEN nv.date < DATE '{SPLIT}' THEN 'train' ELSE 'test' END AS period FROM nv JOIN sh USING (symbol, date), LATERAL (VALUES ('most others beaten', others_beaten > 0.5), ('none beaten', others_beaten = 0), ('beaten with the group', beaten AND others_beaten > 0.5), ('loud', volume_ratio >= 1.5)) c(condition, v) WHERE ret IS NOT NULL)"""


def _cells() -> str:
    at = lambda p, h, v: f"FILTER (period = '{p}' AND h = {h} AND {'' if v else 'NOT '}v)"
    return ", ".join(f"{_R(f'avg(xlocal) {at(p, h, True)} - avg(xlocal) {at(p, h, False)}')} AS {p}_diff_{h}, count(*) {at(p, h, True)} AS {p}_n_yes_{h}" for p in ("train", "test") for h in (20, 10))


ORACLES = {
    "cohesion_change": _RET + f""", se AS (SELECT rs.*, s.sector AS grp FROM rs JOIN (SELECT DISTINCT symbol, sector FROM dense) s USING (symbol)), cp AS (SELECT a.grp, corr(a.e, b.e) AS c, CASE WHEN count(*) FILTER (a.t > (SELECT max(t) FROM rs) - 63) >= 2 THEN corr(a.e, b.e) FILTER (a.t > (SELECT max(t) FROM rs) - 63) END AS r FROM se a JOIN se b ON a.grp = b.grp AND a.t = b.t AND a.symbol < b.symbol GROUP BY a.grp, a.symbol, b.symbol)
SELECT grp, {_R('avg(c)')} AS full, {_R('avg(r)')} AS recent, {_R('avg(r) - avg(c)')} AS delta FROM cp GROUP BY grp""",
    "shock_spillover": _RET + f""", se AS MATERIALIZED (SELECT rs.symbol, rs.t, rs.e, s.sector AS grp, stddev_samp(e) OVER (PARTITION BY rs.symbol) AS sd FROM rs JOIN (SELECT DISTINCT symbol, sector FROM dense) s USING (symbol)), gm AS (SELECT grp, count(DISTINCT symbol) AS m FROM se GROUP BY grp),
sv AS (SELECT symbol, grp, t, e, sign(e) AS sg FROM se WHERE abs(e) > 2.5 * sd AND t + 5 <= (SELECT max(t) FROM rs)),
sx AS (SELECT sv.symbol, sv.t, any_value(sg) AS sg, any_value(m) AS m, avg(o.e) FILTER (o.t = sv.t) AS d0, avg(o.e) FILTER (o.t = sv.t + 1) AS d1, coalesce(sum(o.e) FILTER (o.t BETWEEN sv.t + 2 AND sv.t + 5), 0.0) AS d2 FROM sv JOIN gm USING (grp) LEFT JOIN se o ON o.grp = sv.grp AND o.symbol <> sv.symbol AND o.t BETWEEN sv.t AND sv.t + 5 GROUP BY sv.symbol, sv.t),
sl AS (SELECT s.span, s.v FROM sx, LATERAL (VALUES ('day', sg * d0), ('next', sg * d1), ('later', sg * d2 / (m - 1))) s(span, v))
SELECT span, count(v) AS n, {_R('avg(v)')} AS mean, {_R('avg(v) / (stddev_pop(v) / sqrt(count(v)))')} AS t FROM sl GROUP BY span""",
    "stray_study": _RET + f""", gd AS (SELECT s.symbol, s.sector AS grp, d.t, coalesce(lr.r, 0.0) AS r FROM (SELECT DISTINCT symbol, sector FROM dense) s CROSS JOIN (SELECT DISTINCT t FROM lr) d LEFT JOIN lr ON lr.symbol = s.symbol AND lr.t = d.t),
go AS (SELECT *, count(*) OVER (PARTITION BY grp, t) AS n, sum(r) OVER (PARTITION BY grp, t) - r AS o FROM gd), gp AS (SELECT *, o / (n - 1) AS others FROM go WHERE n >= 3), gb AS (SELECT symbol, coalesce(covar_samp(r, others) / nullif(var_samp(others), 0), 1.0) AS b FROM gp GROUP BY symbol),
gq AS (SELECT gp.symbol, gp.t, r - b * others AS rel FROM gp JOIN gb ON gb.symbol = gp.symbol), gr AS (SELECT *, row_number() OVER w - 1 AS day, CASE WHEN count(rel) OVER k = 20 THEN sum(rel) OVER k END AS roll, CASE WHEN count(rel) OVER f = 20 THEN sum(rel) OVER f END AS ahead FROM gq WINDOW w AS (PARTITION BY symbol ORDER BY t), k AS (PARTITION BY symbol ORDER BY t ROWS 19 PRECEDING), f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)),
gz AS (SELECT *, CASE WHEN count(roll) OVER p >= 126 AND stddev_samp(roll) OVER p > 0 THEN (roll - avg(roll) OVER p) / stddev_samp(roll) OVER p END AS z FROM gr WINDOW p AS (PARTITION BY symbol ORDER BY t ROWS 251 PRECEDING)),
gh AS (SELECT *, rank() OVER (PARTITION BY t ORDER BY z) + (count(*) OVER (PARTITION BY t, z) - 1) / 2 AS rz, rank() OVER (PARTITION BY t ORDER BY ahead) + (count(*) OVER (PARTITION BY t, ahead) - 1) / 2 AS ra FROM gz WHERE day >= 260 AND (day - 260) % 20 = 0 AND z IS NOT NULL AND ahead IS NOT NULL),
gi AS (SELECT 'ic' AS what, corr(rz, ra) AS v FROM gh GROUP BY t HAVING count(*) > 10 UNION ALL SELECT 'up', avg(ahead) FROM gh WHERE z > 2 GROUP BY t UNION ALL SELECT 'down', avg(ahead) FROM gh WHERE z < -2 GROUP BY t)
SELECT what, count(v) AS n, {_R('avg(v)')} AS mean, {_R('avg(v) / nullif(stddev_samp(v) / sqrt(count(v)), 0)')} AS t FROM gi GROUP BY what""",
    "sector_correlation": _RET + f""", sm AS (SELECT sector AS grp, t, avg(e) AS v FROM rs GROUP BY ALL), sp AS (SELECT a.grp AS a, b.grp AS b, a.t, count(*) OVER w AS n, corr(a.v, b.v) OVER w AS c FROM sm a JOIN sm b ON a.t = b.t AND a.grp < b.grp WINDOW w AS (PARTITION BY a.grp, b.grp ORDER BY a.t ROWS 62 PRECEDING))
SELECT a, b, CAST(t AS INT) AS t, {_R('c', 5)} AS corr FROM sp WHERE n >= 63 AND c IS NOT NULL""",
    "volume_context_buckets": SQL_NARROW + f""", va AS (SELECT symbol, bar_idx, volume / nullif(CASE WHEN count(volume) OVER d >= 15 THEN avg(volume) OVER d END, 0) AS vd, volume / nullif(CASE WHEN count(volume) OVER c >= 40 THEN avg(volume) OVER c END, 0) AS vc FROM bars WINDOW d AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), c AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
vb AS (SELECT symbol, bar_idx, vd, max(vc) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS 9 PRECEDING) AS vc FROM va), vk AS (SELECT nv.ret, nv.xlocal, k.kind, k.bucket FROM nv JOIN vb USING (symbol, bar_idx), LATERAL (VALUES ('day', CASE WHEN vd IS NULL OR vd <= 0 THEN NULL WHEN vd <= 0.8 THEN '< 0.8x' WHEN vd <= 1.2 THEN '0.8-1.2x' WHEN vd <= 2 THEN '1.2-2x' WHEN vd <= 3 THEN '2-3x' ELSE '> 3x' END), ('climax', CASE WHEN vc IS NULL OR vc <= 0 THEN NULL WHEN vc <= 1.5 THEN '< 1.5x' WHEN vc <= 3 THEN '1.5-3x' WHEN vc <= 5 THEN '3-5x' ELSE '> 5x' END)) k(kind, bucket) WHERE h = 20 AND ret IS NOT NULL)
SELECT kind, bucket, count(*) AS n, {_R('avg(ret)')} AS ret, {_R('avg(xlocal)')} AS xlocal FROM vk GROUP BY kind, bucket""",
    "stock_states": sql_bars("brand") + f""", ss AS (SELECT symbol, close, close / ({lag('close', 126)}) - 1 AS r, avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 199 PRECEDING) AS m, bar_idx = max(bar_idx) OVER (PARTITION BY symbol) AS is_last FROM bars) SELECT symbol, {_R('close', 9)} AS last_close, {_R('r')} AS ret_6m, {_R('close / m - 1')} AS dist_ma200, coalesce(close < m AND r < -0.08, false) AS beaten_down FROM ss WHERE is_last""",
    "pair_stability": _RET + f""", md AS (SELECT (min(t) + max(t)) // 2 AS m FROM rs), hv AS (SELECT symbol, t, e, t <= m AS early FROM rs, md),
hp AS (SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, CASE WHEN count(*) >= 60 THEN corr(a.e, b.e) ELSE 0 END AS c, count(*) FILTER (a.early) AS n1, CASE WHEN count(*) FILTER (a.early) >= 60 THEN corr(a.e, b.e) FILTER (a.early) ELSE 0 END AS c1, count(*) FILTER (NOT a.early) AS n2, CASE WHEN count(*) FILTER (NOT a.early) >= 60 THEN corr(a.e, b.e) FILTER (NOT a.early) ELSE 0 END AS c2 FROM hv a JOIN hv b ON a.t = b.t AND a.symbol < b.symbol GROUP BY ALL)
SELECT a, b, n, {_R('c')} AS corr, {_R('CASE WHEN n1 > 0 THEN c1 END')} AS corr_first, {_R('CASE WHEN n2 > 0 THEN c2 END')} AS corr_second, coalesce(n1 > 0 AND n2 > 0 AND sign(c1) = sign(c2) AND abs(c1 - c2) <= greatest(abs(c1), abs(c2)) / 2, false) AS stable FROM hp""",
    "divergence_at_events": sql_bars("nation", dense=True) + f""", cf AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS c FROM dense),
r0 AS (SELECT symbol, sector AS grp, t, date, ln(c / ({lag('c', 1, 't')})) AS r FROM cf), r1 AS (SELECT * REPLACE (CASE WHEN abs(r) < 10 THEN r ELSE 0.0 END AS r) FROM r0),
ry AS MATERIALIZED (SELECT r1.*, y FROM r1, LATERAL (VALUES (year(date)), (year(date) + 1), (year(date) + 2)) v(y) WHERE t > 0 AND y IN (SELECT DISTINCT year(date) FROM bars)),
dp AS (SELECT *, sum(r) OVER g AS total, count(*) OVER g AS n_group FROM ry WINDOW g AS (PARTITION BY y, grp, t)), dq AS (SELECT *, (total - r) / (n_group - 1) AS p FROM dp WHERE n_group >= 3),
dw AS (SELECT *, CASE WHEN count(*) OVER n = 20 THEN sum(r) OVER n END AS rs, CASE WHEN count(*) OVER n = 20 THEN sum(p) OVER n END AS ps, count(*) OVER h AS days, CASE WHEN var_samp(p) OVER h > 0 THEN covar_samp(r, p) OVER h / var_samp(p) OVER h ELSE 1.0 END AS b FROM dq WINDOW n AS (PARTITION BY y, symbol ORDER BY t ROWS 19 PRECEDING), h AS (PARTITION BY y, symbol ORDER BY t ROWS 310 PRECEDING)),
dz AS (SELECT *, count(rs) OVER q AS k, avg(rs) OVER q - b * avg(ps) OVER q AS mu, var_samp(rs) OVER q + b * b * var_samp(ps) OVER q - 2 * b * covar_samp(rs, ps) OVER q AS sp FROM dw WINDOW q AS (PARTITION BY y, symbol ORDER BY t ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)),
bd AS (SELECT symbol, date, close / ({lag('close')}) - 1 AS move FROM bars)
SELECT bd.symbol, bd.date, grp, n_group, {_R('CASE WHEN days >= 200 THEN exp(rs - b * ps) - 1 END', 5)} AS rel, {_R('CASE WHEN days >= 200 AND k >= 126 AND sp > 1e-18 THEN (rs - b * ps - mu) / sqrt(sp) END', 5)} AS z FROM bd LEFT JOIN dz ON dz.symbol = bd.symbol AND dz.date = bd.date AND dz.y = year(bd.date) WHERE abs(move) >= 0.5""",
    "group_confirmation": _SHARE + f" SELECT condition, period, CASE WHEN v THEN 'yes' ELSE 'no' END AS state, count(*) AS n, {_R('avg(ret)')} AS ret, {_R('avg((ret > 0)::INT)')} AS hit, {_R('avg(xlocal)')} AS excess FROM gc WHERE h = 20 GROUP BY ALL",
    "group_findings": _SHARE + f""", gf AS (SELECT condition, {_cells()} FROM gc WHERE h IN (10, 20) GROUP BY condition),
gy AS (SELECT condition, count(*) AS years, count(*) FILTER (d > 0) AS years_positive FROM (SELECT condition, year, avg(xlocal) FILTER (v) - avg(xlocal) FILTER (NOT v) AS d FROM gc WHERE h = 20 GROUP BY ALL HAVING count(*) FILTER (v) >= 5 AND count(*) FILTER (NOT v) >= 5) GROUP BY condition)
SELECT gf.*, coalesce(years, 0) AS years, coalesce(years_positive, 0) AS years_positive, coalesce(train_diff_20 >= 0.005 AND test_diff_20 >= 0.005, false) AS consistent FROM gf LEFT JOIN gy USING (condition)""",
    "filter_table": SQL_RALLY + f""", ax AS (SELECT symbol, bar_idx, avg(tr) OVER (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING) / close AS atr_pct, close / ({roll('avg', 'close', 200)}) - 1 AS dist FROM (SELECT *, greatest(high - low, coalesce(abs(high - ({lag('close')})), 0), coalesce(abs(low - ({lag('close')})), 0)) AS tr FROM bars)),
fe AS MATERIALIZED (SELECT ev.date, ret_126, dist, atr_pct, ret_20 AS ret, ret_20 - bench_20 AS xbench, ret_20 - local_20 AS xlocal, CASE WHEN ev.date < DATE '{SPLIT}' THEN 'train' ELSE 'test' END AS period FROM ev JOIN ax ON ax.symbol = ev.symbol AND ax.bar_idx = ev.bar_idx),
fq AS (SELECT quantile_cont(ret_126, {1 / 3}) AS q1, quantile_cont(ret_126, {2 / 3}) AS q2, quantile_cont(atr_pct, 0.5) AS v FROM fe WHERE period = 'train'), fs AS (SELECT period, greatest((max(date) - min(date)) / 365.25, 1e-9) AS years FROM fe GROUP BY period),
fx AS (SELECT fe.*, fq.*, l.filter FROM fe, fq, LATERAL (VALUES ('all', true), ('beaten down', ret_126 < q1), ('below mean', dist < 0), ('beaten down and below mean', ret_126 < q1 AND dist < 0), ('beaten down and volatile', ret_126 < q1 AND atr_pct > v), ('uptrend', ret_126 > q2), ('above mean', dist >= 0)) l(filter, f) WHERE f)
SELECT filter, period, count(ret) AS n, {_R('avg(ret)')} AS ret, {_R('avg((ret > 0)::INT)')} AS hit, {_R('avg(xbench) FILTER (ret IS NOT NULL)')} AS xbench, {_R('avg(xlocal) FILTER (ret IS NOT NULL)')} AS xlocal, {_R('count(*) / any_value(years)')} AS per_year, {_R('any_value(q1)')} AS low_cut, {_R('any_value(q2)')} AS high_cut, {_R('any_value(v)')} AS median_volatility FROM fx JOIN fs USING (period) GROUP BY filter, period""",
}
