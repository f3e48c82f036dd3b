"""Queries on folds over single series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extras as X
from ..sources import bars as B
from . import tables as T
from .happenings import SQL_RALLY, _R, rally
from .tables import lag, roll, rounded, sql_bars


def macd_touch(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.macd_touch(T.bars_brand(spark, sf)).select("symbol", "n", "status", "macd", "signal", "touch_price", "cross_price", "required", "probability", "alert")
    return rounded(rows, 4)


def zigzag_legs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.zigzag(T.bars_flag(spark, sf), 0.5))


def late_entry(spark: SparkSession, sf: str) -> DataFrame:
    ev = rally(spark, sf).select("rule", "symbol", "bar_idx")
    return rounded(X.late_entry(ev, T.bars_brand(spark, sf)))


def entry_variants(spark: SparkSession, sf: str) -> DataFrame:
    ev = rally(spark, sf).select("symbol", "bar_idx", F.col("close").alias("level")).distinct()
    return rounded(X.entry_variants(ev, T.bars_brand(spark, sf)), price=9)


def slot_portfolio(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.slot_portfolio(B.densify(T.bars_brand(spark, sf)), 0.03, 0.05, 10, 40)
    return rounded(rows.select("date", "r", "positions"))


def price_context(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.price_context(T.bars_brand(spark, sf)).withColumn("worst_days", F.concat_ws(",", F.transform("worst_days", lambda d: d.cast("string"))))
    return rounded(rows, 4, close=9, high_52w=9, low_52w=9)


QUERIES = {f.__name__: f for f in (macd_touch, zigzag_legs, late_entry, entry_variants, slot_portfolio, price_context)}

ORACLES = {
    "slot_portfolio": sql_bars("brand", dense=True) + f""", mm AS MATERIALIZED (SELECT symbol, t, date, open, high, low, close, lag(close) OVER (PARTITION BY symbol ORDER BY t) AS before FROM dense),
offer AS MATERIALIZED (SELECT symbol, t, open AS entry, md5(concat_ws('|', '0', symbol, CAST(t AS VARCHAR))) AS pick FROM mm WHERE t > 200 AND before IS NOT NULL AND open IS NOT NULL),
way AS (SELECT o.symbol, o.t, m.t - o.t AS k, CASE WHEN m.close IS NULL THEN m.before WHEN m.low <= entry * (1 - 0.05::DOUBLE) THEN CASE WHEN m.t = o.t THEN entry * (1 - 0.05::DOUBLE) ELSE least(m.open, entry * (1 - 0.05::DOUBLE)) END WHEN m.high >= entry * (1 + 0.03::DOUBLE) THEN CASE WHEN m.t = o.t THEN entry * (1 + 0.03::DOUBLE) ELSE greatest(m.open, entry * (1 + 0.03::DOUBLE)) END WHEN m.t - o.t = 39 THEN m.close END AS x FROM offer o JOIN mm m ON m.symbol = o.symbol AND m.t BETWEEN o.t AND o.t + 39),
leave AS (SELECT symbol, t, min(k) AS k, arg_min(x, k) AS x FROM way WHERE x IS NOT NULL GROUP BY symbol, t),
day AS MATERIALIZED (SELECT o.t, list(struct_pack(s := o.symbol, e := CASE WHEN l.k IS NULL THEN 2147483647 ELSE o.t + l.k END, p := entry, x := l.x) ORDER BY pick) AS offers FROM offer o LEFT JOIN leave l ON l.symbol = o.symbol AND l.t = o.t GROUP BY o.t),
cal AS MATERIALIZED (SELECT DISTINCT t, date FROM dense WHERE t > 200),
walk AS (SELECT CAST(200 AS BIGINT) AS t, list_filter(offers, lambda o: false) AS held, list_filter(offers, lambda o: false) AS made FROM day WHERE t = (SELECT min(t) FROM day) UNION ALL
SELECT t, list_concat(h, w), w FROM (SELECT t, h, list_filter(coalesce(offers, []), lambda o: NOT list_contains(hs, o.s))[1:10 - len(h)] AS w FROM (SELECT t, h, offers, list_transform(h, lambda y: y.s) AS hs FROM (SELECT c.t, d.offers, list_filter(k.held, lambda y: y.e >= k.t + 1) AS h FROM walk k JOIN cal c ON c.t = k.t + 1 LEFT JOIN day d ON d.t = c.t)))),
made AS (SELECT t AS since, m.s AS symbol, m.e AS e, m.p AS entry, m.x AS x FROM (SELECT t, unnest(made) AS m FROM walk)),
gain AS (SELECT d.t, sum(CASE WHEN d.t = e THEN x ELSE d.close END / CASE WHEN d.t = since THEN entry ELSE d.before END - 1 - CASE WHEN d.t = since THEN 0.0005 ELSE 0 END) AS g, count(*) FILTER (d.t < e) AS n FROM made JOIN mm d ON d.symbol = made.symbol AND d.t BETWEEN since AND least(e, since + 39) GROUP BY d.t)
SELECT date, {_R('coalesce(g, 0) / 10')} AS r, CAST(coalesce(n, 0) AS INT) AS positions FROM cal LEFT JOIN gain USING (t)""",
    "zigzag_legs": sql_bars("flag") + f""", th AS (SELECT k, 0.5::DOUBLE * 1.4::DOUBLE ** k AS lim FROM range(5) AS r(k)), ln AS (SELECT symbol, max(bar_idx) AS last FROM bars GROUP BY symbol),
zz AS (SELECT symbol, k, lim, bar_idx AS i, 0 AS way, bar_idx AS edge, close AS ep, close AS c0, CAST(NULL AS BIGINT) AS pv FROM bars, th WHERE bar_idx = 0 UNION ALL
SELECT z.symbol, z.k, z.lim, b.bar_idx, CASE WHEN way = 0 THEN CASE WHEN abs(b.close / c0 - 1) >= lim THEN sign(b.close - c0)::INT ELSE 0 END WHEN way * (b.close - ep) < 0 AND -way * (b.close / ep - 1) >= lim THEN -way ELSE way END,
CASE WHEN (way = 0 AND abs(b.close / c0 - 1) >= lim) OR (way <> 0 AND (way * (b.close - ep) >= 0 OR -way * (b.close / ep - 1) >= lim)) THEN b.bar_idx ELSE edge END, CASE WHEN (way = 0 AND abs(b.close / c0 - 1) >= lim) OR (way <> 0 AND (way * (b.close - ep) >= 0 OR -way * (b.close / ep - 1) >= lim)) THEN b.close ELSE ep END, c0,
CASE WHEN way <> 0 AND way * (b.close - ep) < 0 AND -way * (b.close / ep - 1) >= lim THEN edge END FROM zz z JOIN bars b ON b.symbol = z.symbol AND b.bar_idx = z.i + 1),
zp AS MATERIALIZED (SELECT DISTINCT symbol, k, lim, p FROM (SELECT symbol, k, lim, pv AS p FROM zz WHERE pv IS NOT NULL UNION ALL SELECT symbol, k, lim, 0 FROM zz WHERE i = 0 UNION ALL SELECT z.symbol, k, lim, edge FROM zz z JOIN ln ON ln.symbol = z.symbol AND z.i = ln.last WHERE way <> 0 UNION ALL SELECT z.symbol, k, lim, last FROM zz z JOIN ln ON ln.symbol = z.symbol WHERE z.i = 0)),
zc AS (SELECT symbol, k, count(*) - 1 AS legs FROM zp GROUP BY ALL), zk AS (SELECT symbol, coalesce(min(k) FILTER (legs <= 12), 4) AS k FROM zc GROUP BY symbol),
zq AS (SELECT zp.*, b.close, row_number() OVER w AS n, count(*) OVER (PARTITION BY zp.symbol) AS m, lead(b.close) OVER w AS nc FROM zp JOIN zk USING (symbol, k) JOIN bars b ON b.symbol = zp.symbol AND b.bar_idx = zp.p WINDOW w AS (PARTITION BY zp.symbol ORDER BY p)),
zr AS (SELECT * FROM zq WHERE NOT (n = m - 1 AND m >= 3 AND abs(nc / close - 1) < lim / 2)), zl AS (SELECT symbol, row_number() OVER w - 1 AS leg, p AS start_idx, lead(p) OVER w AS end_idx, lead(close) OVER w / close - 1 AS ret, lim FROM zr WINDOW w AS (PARTITION BY symbol ORDER BY p))
SELECT symbol, CAST(leg AS INT) AS leg, CAST(start_idx AS INT) AS start_idx, CAST(end_idx AS INT) AS end_idx, {_R('ret')} AS ret, {_R('lim')} AS threshold FROM zl WHERE end_idx IS NOT NULL""",
    "macd_touch": sql_bars("brand") + f""", ct AS MATERIALIZED (SELECT symbol, bar_idx, close, count(*) OVER (PARTITION BY symbol) AS n, close / ({lag('close')}) - 1 AS ch FROM bars),
em AS (SELECT symbol, bar_idx, close AS f, close AS s, 0.0::DOUBLE AS sig FROM ct WHERE bar_idx = 0 UNION ALL SELECT c.symbol, c.bar_idx, e.f + (c.close - e.f) * (2.0::DOUBLE / 13), e.s + (c.close - e.s) * (2.0::DOUBLE / 27), e.sig + ((e.f + (c.close - e.f) * (2.0::DOUBLE / 13)) - (e.s + (c.close - e.s) * (2.0::DOUBLE / 27)) - e.sig) * 0.2::DOUBLE FROM em e JOIN ct c ON c.symbol = e.symbol AND c.bar_idx = e.bar_idx + 1),
vo AS (SELECT symbol, CASE WHEN max(n) > 60 THEN stddev_samp(ch) END AS vol FROM ct WHERE bar_idx >= n - 60 GROUP BY symbol),
la AS (SELECT em.symbol, n, close, f - s AS macd, sig, (sig - (1 - 2.0::DOUBLE / 13) * f + (1 - 2.0::DOUBLE / 27) * s) / (2.0::DOUBLE / 13 - 2.0::DOUBLE / 27) AS crossing, vol FROM em JOIN ct ON ct.symbol = em.symbol AND ct.bar_idx = em.bar_idx JOIN vo ON vo.symbol = em.symbol WHERE em.bar_idx = n - 1),
lb AS (SELECT *, crossing - 0.05 * abs(sig) / ((1 - 0.2) * (2.0::DOUBLE / 13 - 2.0::DOUBLE / 27)) AS touch, CASE WHEN n < 200 THEN 'insufficient_data' WHEN macd - sig >= 0 THEN 'above_signal' WHEN macd - sig >= -0.05 * abs(sig) THEN 'touching' ELSE 'apart' END AS status FROM la),
lc AS (SELECT *, CASE WHEN status = 'apart' THEN touch / close - 1 END AS required FROM lb), lz AS (SELECT *, required / nullif(vol, 0) AS z FROM lc),
lp AS (SELECT *, {'CASE ' + ' '.join([f'WHEN z <= {X.REACH[0][0]} THEN {X.REACH[0][1]}'] + [f'WHEN z <= {b} THEN {p} + (z - ({a})) * {(q - p) / (b - a)}' for (a, p), (b, q) in zip(X.REACH, X.REACH[1:])]) + f' WHEN z > {X.REACH[-1][0]} THEN {X.REACH[-1][1]} END'} AS probability FROM lz)
SELECT symbol, CAST(n AS INT) AS n, status, CASE WHEN n >= 200 THEN {_R('macd', 4)} END AS macd, CASE WHEN n >= 200 THEN {_R('sig', 4)} END AS signal, CASE WHEN n >= 200 THEN {_R('touch', 4)} END AS touch_price, CASE WHEN n >= 200 THEN {_R('crossing', 4)} END AS cross_price, {_R('required', 4)} AS required, {_R('probability', 4)} AS probability, probability >= 0.7 AS alert FROM lp""",
    "late_entry": SQL_RALLY + f""", up AS MATERIALIZED (SELECT symbol, bar_idx, CASE WHEN close > ({lag('high')}) THEN bar_idx END AS u, {lag('open', -1)} AS o1, {lag('close', -20)} AS c20, {lag('close', -60)} AS c60 FROM bars),
fu AS (SELECT ev.rule, ev.symbol, ev.bar_idx, min(up.u) AS late_idx FROM ev JOIN up ON up.symbol = ev.symbol AND up.bar_idx BETWEEN ev.bar_idx + 1 AND ev.bar_idx + 10 GROUP BY ALL)
SELECT fu.rule, fu.symbol, CAST(fu.bar_idx AS INT) AS bar_idx, CAST(late_idx AS INT) AS late_idx, {_R('o1')} AS late_entry, {_R('c20 / o1 - 1')} AS late_ret_20, {_R('c60 / o1 - 1')} AS late_ret_60 FROM fu JOIN up ON up.symbol = fu.symbol AND up.bar_idx = fu.late_idx""",
    "entry_variants": SQL_RALLY + f""", pb AS MATERIALIZED (SELECT symbol, bar_idx, close, {lag('open', -1)} AS o1, {lag('close', -20)} AS ex, min(low) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS lo FROM bars),
pv AS (SELECT pb.symbol, pb.bar_idx, x.entry, x.price, ex FROM (SELECT DISTINCT symbol, bar_idx FROM ev) ev JOIN pb ON pb.symbol = ev.symbol AND pb.bar_idx = ev.bar_idx, LATERAL (VALUES ('close', pb.close), ('next_open', pb.o1), ('retest', CASE WHEN lo <= pb.close * 1.01 THEN least(pb.close * 1.01, pb.o1) END)) x(entry, price))
SELECT symbol, CAST(bar_idx AS INT) AS bar_idx, entry, {_R('price', 9)} AS price, {_R('ex / price - 1')} AS ret FROM pv""",
    "price_context": sql_bars("brand") + f""", pc AS (SELECT symbol, date, bar_idx, {', '.join(f"{roll('avg', 'close', n)} AS ma{n}" for n in (20, 50, 200))}, {', '.join(f"close / ({lag('close', n)}) - 1 AS ret_{n}" for n in (21, 63, 126, 252))}, close, max(high) OVER y AS high_52w, min(low) OVER y AS low_52w, arg_max(date, high) OVER y AS high_day, arg_min(date, low) OVER y AS low_day, close / ({lag('close')}) - 1 AS r1, max(bar_idx) OVER (PARTITION BY symbol) AS last_at FROM bars WINDOW y AS (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING)),
pw AS (SELECT symbol, string_agg(CAST(date AS VARCHAR), ',' ORDER BY r1, date) AS worst_days FROM (SELECT * FROM pc WHERE bar_idx > last_at - 63 AND r1 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY r1, date) <= 5) GROUP BY symbol)
SELECT symbol, date, worst_days, high_day, low_day, {', '.join(f"{_R(c, 9 if c in ('close', 'high_52w', 'low_52w') else 4)} AS {c}" for c in ('close', 'high_52w', 'low_52w', 'ma20', 'ma50', 'ma200', 'ret_21', 'ret_63', 'ret_126', 'ret_252'))} FROM pc JOIN pw USING (symbol) WHERE bar_idx = last_at""",
}
