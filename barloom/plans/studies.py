"""Queries that study events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import shift
from ..functions.scores import periods, t_stat, welch, wilson
from ..operators import events as E
from ..operators import indicators as I
from ..operators import stats as S
from ..sources import bars as B
from . import tables as T
from .happenings import SQL_NARROW, NEXT_OPEN, _R, rally_narrow, sql_bench, sql_forward
from .tables import rounded

SPLIT = T.SPLIT


def study_summary_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.summary(rally_narrow(spark, sf)))


def rally_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.by_period(rally_narrow(spark, sf), ["rule"], SPLIT, least=10))


def rally_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.verdicts(S.by_period(rally_narrow(spark, sf), ["rule"], SPLIT, least=10)))


def calibration_bins(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.calibration(rally_narrow(spark, sf), "volume_ratio"))


def spearman_rank(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.spearman(rally_narrow(spark, sf), "volume_ratio", "xlocal", ["rule", "h"]))


def score_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.thresholds(rally_narrow(spark, sf), "volume_ratio", [0.5, 1.0, 1.5, 2.0]))


def breakdown_year(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.breakdown(rally_narrow(spark, sf), "year"))


def permutation_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Returns of rally events against the other events of the same symbol as draws."""
    ev = rally_narrow(spark, sf).where("h = 20")
    a = ev.select("rule", "symbol", F.concat_ws("|", "symbol", F.col("bar_idx").cast("string")).alias("event"), F.col("ret").alias("actual"))
    draws = a.join(ev.select("symbol", F.col("ret").alias("r")), "symbol").where(F.col("r").isNotNull() & F.col("actual").isNotNull())
    return rounded(S.permutation_moments(draws, ["rule"]))


def condition_study(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.condition_study(rally_narrow(spark, sf), _conditions(), SPLIT))


def condition_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.condition_verdicts(S.condition_study(rally_narrow(spark, sf), _conditions(), SPLIT), least=20))


def _conditions() -> dict:
    return {"beaten": F.col("beaten"), "deep": F.col("ret_126") < -0.5, "volume": F.col("volume_ratio") >= 1.5, "strong day": F.col("day_ret") > 1.0}


def labelled_groups(spark: SparkSession, sf: str) -> DataFrame:
    labels = [("all", F.lit(True)), ("beaten", F.col("beaten")), ("volume", F.col("volume_ratio") >= 1.5), ("beaten + volume", F.col("beaten") & (F.col("volume_ratio") >= 1.5))]
    return rounded(S.labelled(rally_narrow(spark, sf), labels, 20, 4))


def feature_terciles(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.feature_terciles(rally_narrow(spark, sf), ["volume_ratio", "ret_126", "day_ret"], SPLIT))


def feature_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.consistent_features(S.feature_terciles(rally_narrow(spark, sf), ["volume_ratio", "ret_126", "day_ret"], SPLIT)))


def welch_doji_vs_rest(spark: SparkSession, sf: str) -> DataFrame:
    """Dojis on the mean against all other bars, by horizon."""
    bars = T.bars_flag(spark, sf)
    rows = E.every_bar(bars, B.benchmark(bars), [1, 5, 21])
    long = rows.select("is_doji", F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"ret_{h}").alias("r")) for h in (1, 5, 21)])).alias("x")).select("is_doji", "x.*").where(F.col("r").isNotNull())
    a, b = F.when(F.col("is_doji"), F.col("r")), F.when(~F.col("is_doji"), F.col("r"))
    return rounded(long.groupBy("h").agg(F.count(a).alias("n_doji"), F.count(b).alias("n_rest"), F.avg(a).alias("doji"), F.avg(b).alias("rest"), welch(a, b).alias("t")))


def bootstrap_interval(spark: SparkSession, sf: str) -> DataFrame:
    ev = rally_narrow(spark, sf).where("h = 20").select("rule", "symbol", "bar_idx", "ret")
    return rounded(S.bootstrap_ci(ev, "ret", ["rule"], 200))


def year_by_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Years down, rules across: mean excess after 20 bars."""
    ev = rally_narrow(spark, sf).where("h = 20")
    return rounded(ev.groupBy("year").pivot("rule", list(E.WINDOW_RULES)).agg(F.avg("xlocal")))


def sma_cross_study(spark: SparkSession, sf: str, fast: int = 5, slow: int = 20) -> DataFrame:
    """Closes of the fast mean above the slow one, entered at the next open: results by horizon in all, train and test."""
    bars = T.bars_flag(spark, sf)
    rich = E.with_forward(E.align_benchmark(I.with_sma(bars, fast, slow), B.benchmark(bars)), [5, 10, 20])
    above = F.col(f"sma{fast}") > F.col(f"sma{slow}")
    crossed = rich.withColumns({"above": above, "above_before": shift(above)}).where("above AND NOT above_before").withColumn("rule", F.lit("cross"))
    rows = E.narrow(crossed, [5, 10, 20], ["rule", "symbol", "date"]).where(F.col("ret").isNotNull())
    out = rows.select("*", F.explode(periods(F.col("date"), SPLIT)).alias("period")).groupBy("period", "h").agg(
        F.count("*").alias("n"), F.count_if(F.col("ret") > 0).alias("hits"), F.avg("ret").alias("mean"), F.avg("xbench").alias("xbench"), F.avg("xlocal").alias("xlocal"), t_stat(F.col("xlocal")).alias("t")
    )
    low, high = wilson(F.col("hits"), F.col("n"))
    return rounded(out.select("period", "h", "n", "mean", (F.col("hits") / F.col("n")).alias("hit"), low.alias("hit_low"), high.alias("hit_high"), "xbench", "xlocal", "t"))


QUERIES = {f.__name__: f for f in (
    sma_cross_study, study_summary_rollup, rally_table, rally_verdicts, calibration_bins, spearman_rank, score_thresholds, breakdown_year, permutation_moments, condition_study,
    condition_verdicts, labelled_groups, feature_terciles, feature_consistency, welch_doji_vs_rest, bootstrap_interval, year_by_rule,
)}

_T = "CASE WHEN count(xlocal) >= 3 AND stddev_pop(xlocal) > 0 THEN avg(xlocal) / nullif(stddev_samp(xlocal), 0) * sqrt(count(xlocal)) END"
_PF = "sum(CASE WHEN ret > 0 THEN ret END) / nullif(-sum(CASE WHEN ret < 0 THEN ret END), 0)"
_PERIODS = f", pr AS (SELECT *, unnest(['all', CASE WHEN date < DATE '{SPLIT}' THEN 'train' ELSE 'test' END]) AS period FROM nv)"
_BY_PERIOD = _PERIODS + f""", yr AS (SELECT period, rule, h, year, count(ret) AS n, sum(ret) AS s, count(*) FILTER (ret > 0.001) AS hits, avg(xlocal) AS ye FROM pr GROUP BY ALL),
bp AS MATERIALIZED (SELECT period, rule, h, count(ret) AS n, avg(ret) - 0.001 AS net, count(*) FILTER (ret > 0.001) / count(ret) AS hit, avg(xbench) AS xbench, avg(xlocal) AS xlocal, CASE WHEN count(xlocal) > 2 THEN avg(xlocal) / nullif(stddev_samp(xlocal), 0) * sqrt(count(xlocal)) END AS t FROM pr GROUP BY ALL HAVING count(ret) >= 10),
bt AS MATERIALIZED (SELECT bp.*, (SELECT count(*) FROM yr WHERE yr.period = bp.period AND yr.rule = bp.rule AND yr.h = bp.h AND yr.n >= 30 AND ye > 0) AS years_positive, (SELECT count(*) FROM yr WHERE yr.period = bp.period AND yr.rule = bp.rule AND yr.h = bp.h AND yr.n >= 30) AS years FROM bp)"""
_STUDY = f""", cs AS (SELECT nv.*, c.condition, coalesce(c.v, false) AS v, CASE WHEN date < DATE '{SPLIT}' THEN 'train' ELSE 'test' END AS period FROM nv, LATERAL (VALUES ('beaten', beaten), ('deep', ret_126 < -0.5), ('volume', volume_ratio >= 1.5), ('strong day', day_ret > 1.0)) c(condition, v) WHERE ret IS NOT NULL),
st AS MATERIALIZED (SELECT condition, period, CASE WHEN v THEN 'yes' ELSE 'no' END AS state, h, count(*) AS n, avg(ret) - 0.001 AS net, avg((ret > 0.001)::INT) AS hit, avg(xlocal) AS excess FROM cs GROUP BY ALL)"""
_TERC = f""", lf AS (SELECT nv.date, nv.xlocal, nv.ret, f.feature, f.value, CASE WHEN date < DATE '{SPLIT}' THEN 'train' ELSE 'test' END AS period FROM nv, LATERAL (VALUES ('volume_ratio', volume_ratio), ('ret_126', ret_126), ('day_ret', day_ret)) f(feature, value) WHERE h = 20 AND xlocal IS NOT NULL AND value IS NOT NULL),
ed AS (SELECT feature, quantile_cont(value, {1 / 3}) AS e1, quantile_cont(value, {2 / 3}) AS e2 FROM lf WHERE period = 'train' GROUP BY feature),
tc AS MATERIALIZED (SELECT lf.feature, period, CAST(1 + (e1 < value)::INT + (e2 < value)::INT AS INT) AS bin, count(*) AS n, avg(ret) AS ret, avg(xlocal) AS xlocal FROM lf JOIN ed USING (feature) GROUP BY ALL)"""

ORACLES = {
    "sma_cross_study": T.sql_bars("flag", bench=True) + sql_bench("bars") + sql_forward("al", [5, 10, 20], *NEXT_OPEN) + f""", sm AS (SELECT *, ({T.roll('avg', 'close', 5)}) > ({T.roll('avg', 'close', 20)}) AS ab FROM fw), sx AS (SELECT *, {T.lag('ab')} AS ab1 FROM sm),
sn AS (SELECT date, x.h, x.r AS ret, x.r - x.b AS xbench, x.r - x.l AS xlocal, unnest(['all', CASE WHEN date < DATE '{SPLIT}' THEN 'train' ELSE 'test' END]) AS period FROM sx, LATERAL (VALUES (5, ret_5, bench_5, local_5), (10, ret_10, bench_10, local_10), (20, ret_20, bench_20, local_20)) x(h, r, b, l) WHERE ab AND NOT ab1 AND x.r IS NOT NULL),
sg AS (SELECT period, h, count(*) AS n, count(*) FILTER (ret > 0) AS hits, avg(ret) AS mean, avg(xbench) AS xbench, avg(xlocal) AS xlocal, {_T} AS t FROM sn GROUP BY period, h)
SELECT period, h, n, {_R('mean')} AS mean, {_R('hits / n')} AS hit, {_R('(hits/n + 1.96*1.96/(2*n) - 1.96*sqrt(hits/n*(1-hits/n)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n)')} AS hit_low, {_R('(hits/n + 1.96*1.96/(2*n) + 1.96*sqrt(hits/n*(1-hits/n)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n)')} AS hit_high, {_R('xbench')} AS xbench, {_R('xlocal')} AS xlocal, {_R('t')} AS t FROM sg""",
    "study_summary_rollup": SQL_NARROW + f""", sm AS (SELECT CASE WHEN grouping(rule) = 1 THEN 'ALL' ELSE rule END AS rule, h, count(*) AS n, count(DISTINCT symbol) AS symbols, avg(ret) AS mean, quantile_cont(ret, 0.5) AS median, count(*) FILTER (ret > 0) AS hits, avg(xbench) AS xbench, avg(xlocal) AS xlocal, {_T} AS t, {_PF} AS profit_factor FROM nv WHERE ret IS NOT NULL GROUP BY GROUPING SETS ((rule, h), (h)))
SELECT rule, h, n, symbols, {_R('mean')} AS mean, {_R('median')} AS median, {_R('hits / n')} AS hit, {_R('(hits/n + 1.96*1.96/(2*n) - 1.96*sqrt(hits/n*(1-hits/n)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n)')} AS hit_low, {_R('(hits/n + 1.96*1.96/(2*n) + 1.96*sqrt(hits/n*(1-hits/n)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n)')} AS hit_high, {_R('xbench')} AS xbench, {_R('xlocal')} AS xlocal, {_R('t')} AS t, {_R('profit_factor')} AS profit_factor FROM sm""",
    "rally_table": SQL_NARROW + _BY_PERIOD + f" SELECT period, rule, h, CAST(n AS BIGINT) AS n, {_R('net')} AS net, {_R('hit')} AS hit, {_R('xbench')} AS xbench, {_R('xlocal')} AS xlocal, years_positive, years, {_R('t')} AS t FROM bt",
    "rally_verdicts": SQL_NARROW + _BY_PERIOD + f""", vw AS (SELECT rule, max(n) FILTER (period = 'train') AS train_n, max(xlocal) FILTER (period = 'train') AS train_xlocal, max(t) FILTER (period = 'train') AS train_t, max(n) FILTER (period = 'test') AS test_n, max(xlocal) FILTER (period = 'test') AS test_xlocal, max(t) FILTER (period = 'test') AS test_t FROM bt WHERE h = 20 GROUP BY rule),
vg AS (SELECT *, train_xlocal > 0.01 AND train_t > 2 AS g1, test_xlocal > 0.01 AND test_t > 2 AS g2, train_xlocal < -0.01 AND train_t < -2 AS b1, test_xlocal < -0.01 AND test_t < -2 AS b2 FROM vw)
SELECT rule, CAST(train_n AS BIGINT) AS train_n, {_R('train_xlocal')} AS train_xlocal, {_R('train_t')} AS train_t, CAST(test_n AS BIGINT) AS test_n, {_R('test_xlocal')} AS test_xlocal, {_R('test_t')} AS test_t, CASE WHEN g1 AND g2 THEN 'holds' WHEN b1 AND b2 THEN 'negative' WHEN g1 OR g2 THEN 'one period only' ELSE 'none' END AS verdict FROM vg""",
    "calibration_bins": SQL_NARROW + f""", cg AS (SELECT * FROM nv WHERE h = 20 AND ret IS NOT NULL AND volume_ratio IS NOT NULL), ce AS (SELECT list_distinct(quantile_cont(volume_ratio, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS e FROM cg), cb AS (SELECT cg.*, greatest(1, len(list_filter(e, lambda x: x < volume_ratio))) AS bin FROM cg, ce)
SELECT CAST(bin AS INT) AS bin, count(*) AS n, {_R('min(volume_ratio)')} AS score_min, {_R('max(volume_ratio)')} AS score_max, {_R('avg(ret)')} AS ret, {_R('avg(xlocal)')} AS xlocal, {_R('avg((ret > 0)::INT)')} AS hit FROM cb GROUP BY bin""",
    "spearman_rank": SQL_NARROW + f""", sp AS (SELECT rule, h, rank() OVER (PARTITION BY rule, h ORDER BY volume_ratio) + (count(*) OVER (PARTITION BY rule, h, volume_ratio) - 1) / 2 AS x, rank() OVER (PARTITION BY rule, h ORDER BY xlocal) + (count(*) OVER (PARTITION BY rule, h, xlocal) - 1) / 2 AS y FROM nv WHERE volume_ratio IS NOT NULL AND xlocal IS NOT NULL)
SELECT rule, h, {_R('corr(x, y)')} AS rho, count(*) AS n FROM sp GROUP BY rule, h""",
    "score_thresholds": SQL_NARROW + f" SELECT cut, count(*) AS n, {_R('avg(ret)')} AS ret, {_R('avg(xlocal)')} AS xlocal, {_R('avg((ret > 0)::INT)')} AS hit, {_R(_PF)} AS profit_factor FROM nv JOIN (VALUES (0.5::DOUBLE), (1.0), (1.5), (2.0)) c(cut) ON volume_ratio >= cut WHERE h = 20 AND ret IS NOT NULL GROUP BY cut",
    "breakdown_year": SQL_NARROW + f" SELECT CAST(year AS INT) AS year, count(*) AS n, {_R('avg(ret)')} AS ret, {_R('avg(xbench)')} AS xbench, {_R('avg(xlocal)')} AS xlocal, {_R('avg((ret > 0)::INT)')} AS hit FROM nv WHERE h = 20 AND ret IS NOT NULL GROUP BY year",
    "permutation_moments": SQL_NARROW + f""", pm AS (SELECT a.rule, a.symbol || '|' || a.bar_idx AS event, a.ret AS actual, b.ret AS r FROM nv a JOIN nv b ON b.symbol = a.symbol AND b.h = 20 WHERE a.h = 20 AND a.ret IS NOT NULL AND b.ret IS NOT NULL),
pe AS (SELECT rule, event, first(actual) AS actual, avg(r) AS m, var_pop(r) AS v FROM pm GROUP BY ALL), po AS (SELECT rule, count(*) AS n, avg(actual) AS actual, avg(m) AS mu, sqrt(sum(v)) / count(*) AS sd FROM pe GROUP BY rule)
SELECT rule, n, {_R('actual')} AS actual, {_R('mu')} AS null_mean, {_R('sd')} AS null_sd, {_R('(actual - mu) / nullif(sd, 0)')} AS z FROM po WHERE n >= 5""",
    "condition_study": SQL_NARROW + _STUDY + f" SELECT condition, period, state, h, n, {_R('net')} AS net, {_R('hit')} AS hit, {_R('excess')} AS excess FROM st",
    "condition_verdicts": SQL_NARROW + _STUDY + f""", cv AS (SELECT condition, max(excess) FILTER (period = 'train' AND state = 'yes') - max(excess) FILTER (period = 'train' AND state = 'no') AS d1, max(excess) FILTER (period = 'test' AND state = 'yes') - max(excess) FILTER (period = 'test' AND state = 'no') AS d2, min(n) >= 20 AND count(*) = 4 AS u FROM st WHERE h = 20 GROUP BY condition)
SELECT condition, {_R('d1')} AS train_diff, {_R('d2')} AS test_diff, coalesce(u AND d1 >= 0.005 AND d2 >= 0.005, false) AS consistent, coalesce(u AND d1 <= -0.005 AND d2 <= -0.005, false) AS consistent_negative FROM cv""",
    "labelled_groups": SQL_NARROW + f""", lb AS (SELECT nv.*, l.label FROM nv, LATERAL (VALUES ('all', true), ('beaten', beaten), ('volume', volume_ratio >= 1.5), ('beaten + volume', beaten AND volume_ratio >= 1.5)) l(label, v) WHERE h = 20 AND ret IS NOT NULL AND v)
SELECT label, count(*) AS n, {_R('avg(ret)')} AS ret, {_R('avg(xbench)')} AS xbench, {_R('avg(xlocal)')} AS xlocal, {_R('avg((ret > 0)::INT)')} AS hit, {_R(_T)} AS t FROM lb GROUP BY label HAVING count(*) >= 4""",
    "feature_terciles": SQL_NARROW + _TERC + f" SELECT feature, period, bin, n, {_R('ret')} AS ret, {_R('xlocal')} AS xlocal FROM tc",
    "feature_consistency": SQL_NARROW + _TERC + f""", fg AS (SELECT feature, max(xlocal) FILTER (period = 'train' AND bin = 3) - max(xlocal) FILTER (period = 'train' AND bin = 1) AS g1, max(xlocal) FILTER (period = 'test' AND bin = 3) - max(xlocal) FILTER (period = 'test' AND bin = 1) AS g2 FROM tc GROUP BY feature)
SELECT feature, {_R('g1')} AS train_gap, {_R('g2')} AS test_gap, coalesce(sign(g1) = sign(g2) AND least(abs(g1), abs(g2)) >= 0.005, false) AS consistent FROM fg""",
    "welch_doji_vs_rest": T.sql_bars("flag") + f""", m0 AS (SELECT *, {T.roll('avg', 'close', 10)} AS ma10 FROM bars), m1 AS (SELECT *, (high - low > 0 AND high - low >= 0.01 * close AND abs(close - open) <= 0.1 * (high - low)) AND coalesce(ma10 BETWEEN low AND high, false) AS dj, ({T.lag('close', -1)}) / close - 1 AS r1, ({T.lag('close', -5)}) / close - 1 AS r5, ({T.lag('close', -21)}) / close - 1 AS r21 FROM m0),
m2 AS (SELECT dj, x.h, x.r, CASE WHEN dj THEN x.r END AS a, CASE WHEN NOT dj THEN x.r END AS b FROM m1, LATERAL (VALUES (1, r1), (5, r5), (21, r21)) x(h, r) WHERE x.r IS NOT NULL)
SELECT h, count(a) AS n_doji, count(b) AS n_rest, {_R('avg(a)')} AS doji, {_R('avg(b)')} AS rest, {_R('CASE WHEN count(a) >= 3 AND count(b) >= 3 THEN (avg(a) - avg(b)) / nullif(sqrt(var_samp(a) / count(a) + var_samp(b) / count(b)), 0) END')} AS t FROM m2 GROUP BY h""",
    "year_by_rule": SQL_NARROW + " SELECT CAST(year AS INT) AS year, " + ", ".join(f"{_R(f'avg(xlocal) FILTER (rule = {chr(39)}{r}{chr(39)})')} AS {r}" for r in E.WINDOW_RULES) + " FROM nv WHERE h = 20 GROUP BY year",
}
