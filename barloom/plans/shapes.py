"""Queries on swing points and patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import patterns as P
from . import tables as T
from .happenings import _R
from .tables import rounded, sql_bars


def _smooth(spark: SparkSession, sf: str) -> DataFrame:
    """The three dense symbols over 20-bar means: raw trade prices swing too far for shapes."""
    bars = T.bars_flag(spark, sf)
    w = Window.partitionBy("symbol").orderBy("bar_idx").rowsBetween(-19, 0)
    return bars.select("symbol", "bar_idx", "date", *[F.avg(f).over(w).alias(f) for f in ("open", "high", "low", "close", "volume")])


def extrema_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Bars that hold the highest high or lowest low of five bars to either side."""
    around = Window.partitionBy("symbol").orderBy("bar_idx").rowsBetween(-5, 5)
    bars = T.bars_flag(spark, sf).withColumns({"top": F.max("high").over(around) == F.col("high"), "bottom": F.min("low").over(around) == F.col("low")})
    return bars.where(F.col("top") | F.col("bottom")).select("symbol", "bar_idx", "top", "bottom")


def pivots_by_scale(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.pivots(T.bars_flag(spark, sf)), 9)


def hs_gates_from_pivots(spark: SparkSession, sf: str) -> DataFrame:
    """Head-and-shoulders gates over the swing points of all symbols and scales, with wide tolerances, as raw trade prices swing far."""
    return rounded(P.head_gates(P.pivots(T.bars_flag(spark, sf)), WIDE))


#: Tolerances for raw trade prices.
WIDE = P.Settings(hs_prominence=0.05, hs_shoulders=0.8, hs_neckline=0.5, hs_gap=0.0)


def level_gates_from_pivots(spark: SparkSession, sf: str) -> DataFrame:
    """Gates of double and triple tops and bottoms over the same swing points."""
    return rounded(P.level_gates(P.pivots(T.bars_flag(spark, sf)), P.Settings(level_tolerance=0.2)))


def patterns_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = P.scan(_smooth(spark, sf))
    return rounded(found.select("symbol", "pattern", "direction", "status", "scale", "start_idx", "end_idx", "score", "level", "target", "stop"))


def patterns_current(spark: SparkSession, sf: str) -> DataFrame:
    found = P.best_current(P.scan(_smooth(spark, sf), mode="current"))
    return rounded(found.select("symbol", "pattern", "status", "score"))


def walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Point-in-time looks at every bar."""
    return rounded(P.walk_forward(_smooth(spark, sf), window=400, step=1, most_lag=15))


QUERIES = {f.__name__: f for f in (extrema_candidates, pivots_by_scale, hs_gates_from_pivots, level_gates_from_pivots, patterns_scan, patterns_current, walk_forward)}



def _pivots_sql(kind: str = "flag") -> str:
    """Swing points: extremes by scale, the better of runs of one kind, and the weakest swing taken out again and again; ends with `pv`."""
    scales = P.Settings().scales
    each = " UNION ALL ".join(f"SELECT symbol, {s} AS s, bar_idx AS i, high, low, greatest(atr, 0.01 * close) AS need, high = max(high) OVER w AS hi, low = min(low) OVER w AS lo FROM tb WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN {s} PRECEDING AND {s} FOLLOWING)" for s in scales)
    once = lambda x, side, k: f"SELECT symbol, s, i, {k} AS k FROM (SELECT *, lag(i) OVER q AS pi, lag({x}) OVER q AS px FROM cd WHERE {side} WINDOW q AS (PARTITION BY symbol, s ORDER BY i)) WHERE pi IS NULL OR i - pi > s OR {x} <> px"
    return sql_bars(kind) + f""", ta AS (SELECT *, coalesce({T.lag('close', order='bar_idx')}, close) AS c1 FROM bars), tb AS MATERIALIZED (SELECT *, avg(greatest(high - low, abs(high - c1), abs(low - c1))) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS 13 PRECEDING) AS atr FROM ta),
cd AS MATERIALIZED ({each}), fo AS ({once('high', 'hi', 1)} UNION ALL {once('low', 'lo', -1)}),
mg AS (SELECT symbol, s, i, count(*) = 2 AS twice, max(k) AS k FROM fo GROUP BY symbol, s, i), mh AS (SELECT *, sum(twice::INT) OVER q AS cb, last_value(CASE WHEN NOT twice THEN k END IGNORE NULLS) OVER q AS ls FROM mg WINDOW q AS (PARTITION BY symbol, s ORDER BY i)),
mi AS (SELECT *, last_value(CASE WHEN NOT twice THEN cb END IGNORE NULLS) OVER (PARTITION BY symbol, s ORDER BY i) AS cs FROM mh), mk AS (SELECT symbol, s, i, CAST(CASE WHEN NOT twice THEN k ELSE coalesce(ls, -1) * CASE WHEN (cb - coalesce(cs, 0)) % 2 = 1 THEN -1 ELSE 1 END END AS INT) AS k FROM mi),
mp AS (SELECT mk.*, CASE WHEN k = 1 THEN high ELSE low END AS p, need, row_number() OVER (PARTITION BY symbol, s ORDER BY i) - row_number() OVER (PARTITION BY symbol, s, k ORDER BY i) AS run FROM mk JOIN cd USING (symbol, s, i)),
mq AS (SELECT symbol, s, arg_max(struct_pack(i := i, p := p, k := k, need := need), (p * k, i)) AS e FROM mp GROUP BY symbol, s, k, run), ps AS (SELECT symbol, s, list(e ORDER BY e.i) AS l, 0 AS it FROM mq GROUP BY symbol, s),
rm AS (SELECT symbol, s, l, it FROM ps UNION ALL SELECT symbol, s, CASE WHEN d = len(l) THEN l[1:d - 1] ELSE list_concat(list_concat(l[1:d - 2], [CASE WHEN l[d + 1].p * l[d + 1].k >= l[d - 1].p * l[d - 1].k THEN l[d + 1] ELSE l[d - 1] END]), l[d + 2:]) END, it + 1
FROM (SELECT *, list_position(sh, list_min(sh)) + 1 AS d FROM (SELECT *, list_transform(range(2, len(l) + 1), lambda j: CASE WHEN l[j].need > 0 THEN abs(l[j].p - l[j - 1].p) / l[j].need ELSE 1.0 END) AS sh FROM rm) WHERE len(l) >= 2 AND list_min(sh) < 1)),
rl AS (SELECT symbol, s, arg_max(l, it) AS l FROM rm GROUP BY symbol, s), pv AS MATERIALIZED (SELECT symbol, s AS scale, j - 1 AS seq, l[j].i AS idx, l[j].p AS price, l[j].k AS kind FROM (SELECT *, unnest(range(1, len(l) + 1)) AS j FROM rl))"""


ORACLES = {
    "pivots_by_scale": _pivots_sql() + f" SELECT symbol, CAST(scale AS INT) AS scale, CAST(seq AS INT) AS seq, CAST(idx AS INT) AS idx, {_R('price', 9)} AS price, kind FROM pv",
    "extrema_candidates": sql_bars("flag") + """, x AS (SELECT symbol, bar_idx, max(high) OVER w = high AS top, min(low) OVER w = low AS bottom FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))
SELECT symbol, CAST(bar_idx AS INT) AS bar_idx, top, bottom FROM x WHERE top OR bottom""",
    "level_gates_from_pivots": _pivots_sql() + f""", ll AS (SELECT symbol, scale, kind, idx AS x0, kind * price AS p0, {', '.join(f'lead(idx, {i}) OVER w AS x{i}, kind * lead(price, {i}) OVER w AS p{i}' for i in range(1, 5))} FROM pv WINDOW w AS (PARTITION BY symbol, scale ORDER BY seq)),
lg AS (SELECT symbol, scale, kind, 2 AS peaks, x0, x2 AS x, (greatest(p0, p2) - least(p0, p2)) / abs((p0 + p2) / 2) AS spread, ((p0 + p2) / 2 - p1) / abs((p0 + p2) / 2) AS depth, x2 - x0 AS gap, 0.0::DOUBLE AS even FROM ll WHERE x2 IS NOT NULL UNION ALL
SELECT symbol, scale, kind, 3, x0, x4, (greatest(p0, p2, p4) - least(p0, p2, p4)) / abs((p0 + p2 + p4) / 3), ((p0 + p2 + p4) / 3 - greatest(p1, p3)) / abs((p0 + p2 + p4) / 3), least(x2 - x0, x4 - x2), (greatest(p1, p3) - least(p1, p3)) / abs((p0 + p2 + p4) / 3) FROM ll WHERE x4 IS NOT NULL)
SELECT symbol, CAST(scale AS INT) AS scale, kind, peaks, CAST(x0 AS INT) AS start_idx, CAST(x AS INT) AS end_idx, {_R('spread')} AS spread, {_R('depth')} AS depth, CAST(gap AS INT) AS min_gap FROM lg WHERE spread <= 0.2 AND depth >= 0.03 AND gap >= 8 AND even <= 0.2""",
    "hs_gates_from_pivots": _pivots_sql() + f""", ld AS (SELECT symbol, scale, kind, idx AS x0, kind * price AS p0, {', '.join(f'lead(idx, {i}) OVER w AS x{i}, kind * lead(price, {i}) OVER w AS p{i}' for i in range(1, 5))} FROM pv WINDOW w AS (PARTITION BY symbol, scale ORDER BY seq)),
gt AS (SELECT *, (p2 - greatest(p0, p4)) / abs(p2) AS prominence, abs(p0 - p4) / ((abs(p0) + abs(p4)) / 2) AS uneven, abs(p1 - p3) / abs(p2) AS tilt, (least(p0, p4) - greatest(p1, p3)) / abs(p2) AS gap, (x2 - x0) / (x4 - x2) AS time_ratio FROM ld WHERE x4 IS NOT NULL)
SELECT symbol, CAST(scale AS INT) AS scale, kind, CAST(x0 AS INT) AS start_idx, CAST(x4 AS INT) AS end_idx, {_R('prominence')} AS prominence, {_R('uneven')} AS uneven, {_R('tilt')} AS tilt, {_R('time_ratio')} AS time_ratio FROM gt WHERE prominence >= 0.05 AND uneven <= 0.8 AND tilt <= 0.5 AND gap >= 0.0 AND time_ratio BETWEEN 1 / 2.5 AND 2.5""",
}
