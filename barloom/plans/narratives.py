"""Queries on stories, falls and reviews: orders stand for filings, documents for headlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import word_pattern
from ..operators import ledger as L
from ..operators import review as V
from ..operators import story as S
from ..sources import bars as B
from . import tables as T
from .desk import _MTM
from .happenings import _R
from .tables import lag, rounded, sql_bars

#: The item that a filing of an order's priority has.
ITEMS = {"1-URGENT": "2.02", "2-HIGH": "5.02", "3-MEDIUM": "1.01", "4-NOT SPECIFIED": "9.01", "5-LOW": "2.03"}
#: Causes in the texts' invented language, where no English word stands.
CAUSES = {"that": word_pattern(["that", "this"]), "with": word_pattern(["with", "from"]), "of": word_pattern(["of", "by"]), S.MOVE: word_pattern(["was", "are"])}
#: The report section that an order's priority stands for.
SECTIONS = {"1-URGENT": "briefs", "2-HIGH": "newsday", "3-MEDIUM": "early_rally", "4-NOT SPECIFIED": "jev", "5-LOW": "checklist"}


def _nations(spark: SparkSession, sf: str) -> DataFrame:
    return T.bars_nation(spark, sf).drop("sector")


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    own = T.read(spark, sf, "orders").join(T.read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(T.read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return own.select(F.col("n_name").alias("symbol"), F.to_date("o_orderdate").alias("date"), "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderkey")


def _item(priority: F.Column) -> F.Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in ITEMS.items() for x in kv]), priority)


def _filings(spark: SparkSession, sf: str) -> DataFrame:
    """The orders of a nation's day are one filing with their items."""
    return _orders(spark, sf).groupBy("symbol", "date").agg(F.array_sort(F.collect_set(_item(F.col("o_orderpriority")))).alias("items"))


def story_events(spark: SparkSession, sf: str) -> DataFrame:
    bars = _nations(spark, sf)
    rows = S.story_events(_filings(spark, sf), bars, B.benchmark(bars)).withColumn("codes", F.array_join("codes", ","))
    return rounded(rows)


def story_legs(spark: SparkSession, sf: str) -> DataFrame:
    """Legs of 20-bar means: raw trade prices turn on nearly every day."""
    w = Window.partitionBy("symbol").orderBy("bar_idx").rowsBetween(-19, 0)
    bars = _nations(spark, sf).select("symbol", "bar_idx", "date", *[F.avg(f).over(w).alias(f) for f in ("open", "high", "low", "close", "volume")])
    actions = _orders(spark, sf).where("o_orderstatus = 'P'").select("symbol", "date", F.when(F.col("o_totalprice") > 200000, "up").otherwise("down").alias("action"))
    rows = S.assemble(bars, S.story_events(_filings(spark, sf), bars), actions, B.benchmark(bars))
    return rounded(rows.withColumn("events", F.array_join(F.transform("events", lambda e: F.concat_ws(":", e["kind"], e["session"].cast("string"))), ",")))


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    bars = _nations(spark, sf)
    filings = _filings(spark, sf)
    docs = T.read(spark, sf, "documents").where(F.col("text").isNotNull())
    heads = docs.select(
        F.concat(F.lit("NATION_"), (F.col("doc_id") % 25).cast("string")).alias("symbol"), F.date_add(F.lit("2000-10-01").cast("date"), (F.col("doc_id") % 450).cast("int")).alias("date"),
        F.substring("text", 1, 60).alias("title"), F.substring("text", 61, 120).alias("summary"), F.col("source").alias("publisher"), F.lit("feed").alias("source"),
    )
    tokens = bars.select("symbol").distinct().withColumn("tokens", F.array(F.lit("er"), F.lit("an")))
    actions = _orders(spark, sf).where("o_orderpriority = '2-HIGH'").select("symbol", "date", F.when(F.col("o_totalprice") > 250000, "down").otherwise("main").alias("action"), F.lit(None).cast("string").alias("target_action"))
    return S.fall_evidence(S.falls(bars, filings), heads, tokens, filings, actions, B.benchmark(bars), CAUSES)


def fall_days(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.falls(_nations(spark, sf), _filings(spark, sf)))


def fall_evidence(spark: SparkSession, sf: str) -> DataFrame:
    join = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return rounded(_evidence(spark, sf).select("symbol", "day", "kind", "ret", "spy", F.coalesce(F.size("titles"), F.lit(0)).alias("n_titles"), join("codes").alias("codes"), join("tags").alias("tags")))


def decline_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.decline_reasons(_evidence(spark, sf), _nations(spark, sf)))


def _listed(spark: SparkSession, sf: str) -> DataFrame:
    """A nation's orders of a day and priority as a listed name, with report cells from the largest one's price and what its entry earned."""
    o = _orders(spark, sf).withColumnRenamed("date", "signal_date")
    hold = F.when(F.col("o_orderpriority") == "1-URGENT", 5).when(F.col("o_orderpriority") == "2-HIGH", 10).otherwise(20)
    own = o.groupBy(F.col("o_orderpriority").alias("rule"), "symbol", "signal_date", hold.alias("hold_bars")).agg((F.floor(F.max("o_totalprice") / 6000) % 100).cast("int").alias("p"))
    bars = _nations(spark, sf)
    marked = L.mark_to_market(own.select("rule", "symbol", "signal_date", "hold_bars"), bars, B.benchmark(bars)).where("ret IS NOT NULL").select("rule", "symbol", "signal_date", "ret", "bench_ret")
    p, text = F.col("p"), lambda x: x.cast("string")
    cells = {
        "P(buy)": F.concat(F.lit("0."), F.lpad(text(p), 2, "0")), "6m": F.concat(text(p - 70), F.lit("%")), "from 52w high": F.concat(text(p - 70), F.lit("%")), "MACD pre-touch": F.concat(text(p), F.lit("%")),
        "checks passed": F.concat(text(p % 6), F.lit("/5")), "rules fired": text(p % 4), "read": F.when(p % 2 == 0, "signs of a bottom").otherwise("still falling"), "group": F.when(p % 3 == 0, "beaten").when(p % 3 == 1, "fine").otherwise(""),
    }
    flags = F.filter(F.array(F.when(p % 5 == 0, "Z"), F.when(p % 7 == 0, "S"), F.when(p % 3 == 1, "T"), F.when(p < 20, "D")), lambda x: x.isNotNull())
    section = F.element_at(F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv]), F.col("rule"))
    return own.join(marked, ["rule", "symbol", "signal_date"]).select(
        section.alias("section"), "symbol", F.col("signal_date").alias("date"), flags.alias("flags"), F.size(flags).alias("n_flags"), (p % 8).alias("n_days"), (p % 10 == 0).alias("market_wide"),
        F.create_map(*[x for k, v in cells.items() for x in (F.lit(k), v)]).alias("cells"), F.col("ret").alias("ret_20"), (F.col("ret") - F.col("bench_ret")).alias("xbasket_20"),
    )


def review_conditions(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.condition_lines(_listed(spark, sf), V.catalogue(), ("20",)))


def review_tables(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.table_lines(_listed(spark, sf), list(SECTIONS.values()), ("20",)))


QUERIES = {f.__name__: f for f in (story_events, story_legs, fall_days, fall_evidence, decline_reasons, review_conditions, review_tables)}

_ITEM = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ITEMS.items()) + " END"
_OWN = f"""oo AS (SELECT n_name AS symbol, CAST(o_orderdate AS DATE) AS date, o_orderpriority, o_orderstatus, o_totalprice, {_ITEM} AS item FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
fl AS MATERIALIZED (SELECT symbol, date, list_sort(list(DISTINCT item)) AS items FROM oo GROUP BY symbol, date)"""
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_MV = f""", mv AS MATERIALIZED (SELECT *, close / ({lag('close')}) - 1 AS ret, CASE WHEN count(volume) OVER v >= 20 THEN volume / nullif(quantile_cont(volume, 0.5) OVER v, 0) END AS vol, max(bar_idx) OVER (PARTITION BY symbol) AS last FROM bars WINDOW v AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
mn AS MATERIALIZED (SELECT *, {lag('date', -1)} AS next_date, {lag('ret', -1)} AS next_ret, {lag('vol', -1)} AS next_vol FROM mv),
bsp AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS spy FROM bench)"""
_FALLS = sql_bars("nation", bench=True) + ", " + _OWN + _MV + """, rc AS (SELECT * FROM mv WHERE bar_idx > last - 252 AND ret IS NOT NULL), wd AS (SELECT symbol, date AS day, 'drop' AS kind, ret, vol FROM rc QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ret, date) <= 5),
rn AS (SELECT *, lead(date) OVER (PARTITION BY symbol ORDER BY date) AS d2, lead(ret) OVER (PARTITION BY symbol ORDER BY date) AS r2, lead(vol) OVER (PARTITION BY symbol ORDER BY date) AS v2 FROM rc),
ea AS (SELECT DISTINCT r.symbol, CASE WHEN r2 < ret THEN d2 ELSE r.date END AS day, 'earnings' AS kind, CASE WHEN r2 < ret THEN r2 ELSE ret END AS ret, CASE WHEN r2 < ret THEN v2 ELSE vol END AS vol FROM fl ASOF JOIN rn r ON r.symbol = fl.symbol AND r.date >= fl.date WHERE list_contains(fl.items, '2.02')),
fd AS MATERIALIZED (SELECT * FROM (SELECT * FROM wd UNION ALL SELECT * FROM ea WHERE ret <= -0.01 AND NOT EXISTS (SELECT 1 FROM wd WHERE wd.symbol = ea.symbol AND wd.day = ea.day)) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ret, day) <= 6)"""
_CAUSE_OF = "CASE c " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.ITEM_CAUSE.items()) + " END"
_NAMED = lambda x: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({x}, '{p}') THEN '{k}' END" for k, p in CAUSES.items()) + "], lambda k: k IS NOT NULL)"
_CONTAINS = lambda x, ws: "(" + " OR ".join("contains({}, '{}')".format(x, w.replace("'", "''")) for w in ws) + ")"
_EVIDENCE = _FALLS + f""", hd AS (SELECT 'NATION_' || (doc_id % 25) AS symbol, DATE '2000-10-01' + CAST(doc_id % 450 AS INT) AS date, substr(text, 1, 60) AS title, lower(substr(text, 1, 60)) AS lo, lower(substr(text, 61, 120)) AS br FROM documents WHERE text IS NOT NULL),
hs AS (SELECT *, {_NAMED('lo')} AS t, list_filter({_NAMED('br')}, lambda k: NOT list_contains({_NAMED('lo')}, k)) AS s FROM hd WHERE {_CONTAINS("(lo || ' ' || br)", ['er', 'an'])} AND NOT {_CONTAINS('lo', S.NOISE)}),
hp AS (SELECT *, 2 * len(list_filter(t, lambda k: k <> '{S.MOVE}')) + len(list_filter(s, lambda k: k <> '{S.MOVE}')) + CASE WHEN list_contains(t, '{S.MOVE}') THEN 2 WHEN list_contains(s, '{S.MOVE}') THEN 1 ELSE 0 END - CASE WHEN {_CONTAINS('lo', S.RISES)} THEN 3 ELSE 0 END AS score, list_filter(list_concat(t, s), lambda k: k <> '{S.MOVE}') AS named FROM hs WHERE len(t) > 0),
hq AS (SELECT * FROM (SELECT DISTINCT fd.symbol, fd.day, hp.date, hp.title, hp.score, hp.named, abs(hp.date - fd.day) AS gap FROM fd JOIN hp ON hp.symbol = fd.symbol AND hp.date - fd.day BETWEEN -1 AND 2 WHERE score > 0) QUALIFY row_number() OVER (PARTITION BY symbol, day ORDER BY score DESC, gap, date, title) <= 3),
hh AS (SELECT symbol, day, count(*) AS n_titles, flatten(list(CASE WHEN len(named) > 0 THEN named ELSE ['news'] END ORDER BY score DESC, gap, date, title)) AS heads FROM hq GROUP BY symbol, day),
ff AS (SELECT fd.symbol, fd.day, flatten(list(list_filter(items, lambda c: list_contains({_LIST(S.ITEM_CAUSE)}, c)) ORDER BY fl.date)) AS codes FROM fd JOIN fl ON fl.symbol = fd.symbol AND fd.day - fl.date BETWEEN 0 AND 1 GROUP BY fd.symbol, fd.day),
fc AS (SELECT DISTINCT fd.symbol, fd.day, true AS cut FROM fd JOIN oo ON oo.symbol = fd.symbol AND oo.date - fd.day BETWEEN -1 AND 3 WHERE o_orderpriority = '2-HIGH' AND o_totalprice > 250000),
ft AS (SELECT fd.*, coalesce(n_titles, 0) AS n_titles, coalesce(codes, []) AS codes, spy, list_concat(list_concat(list_transform(coalesce(codes, []), lambda c: {_CAUSE_OF}), coalesce(heads, [])), list_concat(CASE WHEN cut THEN ['rating cut'] ELSE [] END, CASE WHEN spy <= -0.015 THEN ['market-wide'] ELSE [] END)) AS raw
FROM fd LEFT JOIN hh USING (symbol, day) LEFT JOIN ff USING (symbol, day) LEFT JOIN fc USING (symbol, day) LEFT JOIN bsp ON bsp.date = fd.day),
fu AS (SELECT *, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS tg FROM ft), fe AS MATERIALIZED (SELECT *, CASE WHEN len(tg) = 0 AND vol >= 2.5 THEN ['company event'] ELSE tg END AS tags FROM fu)"""
_LISTED = _MTM + f""", og AS (SELECT o_orderpriority AS rule, n_name AS symbol, CAST(o_orderdate AS DATE) AS signal_date, CAST(floor(max(o_totalprice) / 6000) AS INT) % 100 AS p FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
lr AS MATERIALIZED (SELECT CASE og.rule {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SECTIONS.items())} END AS section, og.symbol, og.signal_date AS date, p, ret, ret - bench_ret AS x FROM og JOIN mt ON mt.rule = og.rule AND mt.symbol = og.symbol AND mt.signal_date = og.signal_date WHERE ret IS NOT NULL)"""
_MET = {
    "flag_Z": ("section = 'briefs'", "p % 5 = 0", 1), "flag_S": ("section = 'briefs'", "p % 7 = 0", 1), "flag_T": ("section = 'briefs'", "p % 3 = 1", 1), "flag_D": ("section = 'briefs'", "p < 20", 1),
    "no_warning": ("section = 'briefs'", "p % 5 <> 0 AND p % 7 <> 0 AND p % 3 <> 1 AND p >= 20", 1), "read_bottom": ("section = 'briefs'", "p % 2 = 0", 1), "read_falling": ("section = 'briefs'", "p % 2 = 1", 1), "market_wide": ("section = 'briefs'", "p % 10 = 0", 1),
    "sent_pos": ("section = 'briefs'", "false", 1), "consensus_buy": ("section = 'briefs'", "false", 1), "deep_dd": ("section = 'briefs'", "p - 70 <= -30", 1), "peers_up": ("section = 'briefs'", "false", 1),
    "jev_buy_brief": ("section = 'briefs'", "p >= 60", 12), "macd70_brief": ("section = 'briefs'", "p >= 70", 12), "checklist4": ("section = 'checklist'", "p % 6 >= 4", 24), "fresh": ("section IN ('newsday', 'early_rally')", "p % 8 <= 3", 1),
    "group_beaten": ("section IN ('newsday', 'early_rally') AND p % 3 < 2", "p % 3 = 0", 24), "depth30": ("section IN ('newsday', 'early_rally')", "p - 70 <= -30", 1), "macd70": ("section IN ('newsday', 'early_rally')", "p >= 70", 24),
    "rules2": ("section = 'early_rally'", "p % 4 >= 2", 24), "jev_pick": ("section = 'jev'", "p >= 60", 1), "jev_low": ("section = 'jev'", "p < 20", 1),
}
_T = "CASE WHEN count({0}) >= 3 AND count({1}) >= 3 THEN (avg({0}) - avg({1})) / nullif(sqrt(var_samp({0}) / count({0}) + var_samp({1}) / count({1})), 0) END".format("CASE WHEN y THEN x END", "CASE WHEN NOT y THEN x END")

ORACLES = {
    "story_events": sql_bars("nation", bench=True) + ", " + _OWN + _MV + f""", nn AS (SELECT symbol, max(bar_idx) + 1 AS n FROM bars GROUP BY symbol),
c0 AS (SELECT symbol, c.*, greatest(0, n - 1 - back0) AS a, n - back1 - 1 AS z, n FROM nn, (VALUES {', '.join(f"('{k}', {b0}, {b1}, {big}::DOUBLE, {most})" for k, b0, b1, _, big, most in S.CHAPTERS)}) c(chapter, back0, back1, big, most)),
ch AS MATERIALIZED (SELECT c0.*, f.date AS from_date, t.date AS to_date FROM c0 JOIN bars f ON f.symbol = c0.symbol AND f.bar_idx = a JOIN bars t ON t.symbol = c0.symbol AND t.bar_idx = z WHERE z - a >= 4 AND n - 1 >= 0.25 * back0),
ra AS (SELECT fl.symbol, fl.date, items, m.date AS d1, m.ret AS r1, m.vol AS v1, m.next_date AS d2, m.next_ret AS r2, m.next_vol AS v2 FROM fl ASOF JOIN mn m ON m.symbol = fl.symbol AND m.date >= fl.date),
rb AS (SELECT symbol, date, items, CASE WHEN ok2 AND (NOT ok1 OR abs(r2) > abs(r1)) THEN d2 ELSE d1 END AS session, CASE WHEN ok2 AND (NOT ok1 OR abs(r2) > abs(r1)) THEN r2 ELSE r1 END AS ret, CASE WHEN ok2 AND (NOT ok1 OR abs(r2) > abs(r1)) THEN v2 ELSE v1 END AS vol FROM (SELECT *, r1 IS NOT NULL AND d1 - date <= 4 AS ok1, coalesce(r2 IS NOT NULL AND d2 - date <= 4, false) AS ok2 FROM ra) WHERE ok1 OR ok2),
rx AS (SELECT *, list_filter(items, lambda i: list_contains({_LIST(S.CORPORATE)}, i)) AS cc FROM rb),
ev AS (SELECT symbol, 'earnings' AS kind, date, session, ret, vol, CAST(NULL AS VARCHAR) AS codes FROM rx WHERE list_contains(items, '2.02') UNION ALL SELECT symbol, 'corporate', date, session, ret, vol, array_to_string(cc, ',') FROM rx WHERE len(cc) > 0 AND (abs(ret) >= 0.02 OR len(list_filter(cc, lambda i: NOT list_contains({_LIST(S.LIGHT)}, i))) > 0)),
ei AS (SELECT ev.*, chapter FROM ev JOIN ch ON ch.symbol = ev.symbol AND ev.date BETWEEN from_date AND to_date), ez AS (SELECT *, last_value(CASE WHEN kind = 'corporate' THEN codes END IGNORE NULLS) OVER (PARTITION BY symbol, chapter, session ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lc FROM ei),
em AS MATERIALIZED (SELECT symbol, chapter, kind, date, session, ret, vol, CASE WHEN kind = 'earnings' THEN lc ELSE codes END AS codes FROM ez QUALIFY row_number() OVER (PARTITION BY symbol, chapter, session ORDER BY kind <> 'earnings', date) = 1),
bg AS (SELECT m.symbol, chapter, 'bigday' AS kind, m.date, m.date AS session, m.ret, m.vol, CAST(NULL AS VARCHAR) AS codes FROM mv m JOIN ch ON ch.symbol = m.symbol AND m.bar_idx BETWEEN a AND z WHERE abs(m.ret) >= big AND NOT EXISTS (SELECT 1 FROM em WHERE em.symbol = m.symbol AND em.chapter = ch.chapter AND em.session = m.date) QUALIFY row_number() OVER (PARTITION BY m.symbol, chapter ORDER BY abs(m.ret) DESC, m.date) <= any_value(most) OVER (PARTITION BY m.symbol, chapter)),
al AS (SELECT * FROM em UNION ALL SELECT * FROM bg)
SELECT symbol, chapter, kind, al.date, session, {_R('ret')} AS ret, {_R('vol')} AS vol, codes, {_R('spy')} AS spy FROM al LEFT JOIN bsp ON bsp.date = al.session""",
    "fall_days": _FALLS + f" SELECT symbol, day, kind, {_R('ret')} AS ret, {_R('vol')} AS vol FROM fd",
    "fall_evidence": _EVIDENCE + f" SELECT symbol, day, kind, {_R('ret')} AS ret, {_R('spy')} AS spy, CAST(n_titles AS INT) AS n_titles, array_to_string(codes, ',') AS codes, array_to_string(tags, ',') AS tags FROM fe",
    "decline_reasons": _EVIDENCE + f""", pk AS (SELECT symbol, max(close) AS high, arg_min(date, (-close, date)) AS high_date, arg_max(close, bar_idx) AS lastc FROM mv WHERE bar_idx > last - 252 GROUP BY symbol),
fx AS (SELECT fe.*, high, high_date, lastc, day >= high_date AND (kind = 'earnings' OR list_contains(codes, '2.02')) AS earned FROM fe JOIN pk USING (symbol)),
fz AS (SELECT symbol, flatten(list(tags ORDER BY ret, day)) AS raw, any_value(high_date) AS high_date, any_value(lastc / high) - 1 AS drawdown, count(*) FILTER (earned) AS k, coalesce(exp(sum(ln(1 + ret)) FILTER (earned)) - 1, 0.0) AS er FROM fx GROUP BY symbol),
fy AS (SELECT *, list_filter(list_filter(raw, lambda x, i: list_position(raw, x) = i), lambda x: x <> 'company event') AS sure FROM fz)
SELECT symbol, CASE WHEN len(sure) > 0 THEN array_to_string(sure, ', ') WHEN len(raw) > 0 THEN 'heavy volume, cause not found' ELSE 'not found' END AS cause, high_date, {_R('drawdown')} AS drawdown, k AS n_earnings_days, {_R('er')} AS earnings_ret FROM fy""",
    "review_conditions": _LISTED + ", cm AS (" + " UNION ALL ".join(f"SELECT '{k}' AS key, {least} AS least, ret, x, {met} AS y FROM lr WHERE {pop}" for k, (pop, met, least) in _MET.items()) + f"""), cl AS (SELECT key, '20' AS h, count(x) FILTER (y) AS n_yes, count(x) FILTER (NOT y) AS n_no, avg(x) FILTER (y) AS a, avg(x) FILTER (NOT y) AS b, avg(ret) FILTER (y) AS ra, avg(ret) FILTER (NOT y) AS rb, avg((ret > 0)::INT) FILTER (y) AS ha, avg((ret > 0)::INT) FILTER (NOT y) AS hb, {_T} AS t FROM cm GROUP BY key HAVING count(*) >= any_value(least))
SELECT key, h, n_yes, n_no, {_R('a')} AS excess_yes, {_R('b')} AS excess_no, {_R('ra')} AS ret_yes, {_R('rb')} AS ret_no, {_R('ha')} AS hit_yes, {_R('hb')} AS hit_no, {_R('t')} AS t, {_R('a - b')} AS diff, CASE WHEN n_yes < 12 OR n_no < 12 OR t IS NULL THEN 'early' WHEN t >= 2 THEN 'better_yes' WHEN t <= -2 THEN 'better_no' ELSE 'noise' END AS verdict FROM cl""",
    "review_tables": _LISTED + f""", tb AS (SELECT *, (date - DATE '1970-01-01') <= min(date - DATE '1970-01-01') OVER s + (max(date - DATE '1970-01-01') OVER s - min(date - DATE '1970-01-01') OVER s) / 2 AS early FROM lr WINDOW s AS (PARTITION BY section)),
tl AS (SELECT section, '20' AS h, count(ret) AS n, avg(ret) AS ret, avg((ret > 0)::INT) AS hit, avg(x) AS excess, CASE WHEN count(x) >= 3 AND stddev_pop(x) > 0 THEN avg(x) / nullif(stddev_samp(x), 0) * sqrt(count(x)) END AS t, count(ret) FILTER (early) AS n_first, avg(x) FILTER (early) AS excess_first, count(ret) FILTER (NOT early) AS n_second, avg(x) FILTER (NOT early) AS excess_second FROM tb GROUP BY section)
SELECT section, h, n, {_R('ret')} AS ret, {_R('hit')} AS hit, {_R('excess')} AS excess, {_R('t')} AS t, n_first, {_R('excess_first')} AS excess_first, n_second, {_R('excess_second')} AS excess_second, coalesce(n_first >= 8 AND n_second >= 8 AND sign(excess_first) = sign(excess_second), false) AS stable, CASE WHEN n < 20 OR t IS NULL THEN 'early' WHEN excess > 0 AND t >= 2 THEN 'works' WHEN excess < 0 AND t <= -2 THEN 'fails' ELSE 'noise' END AS verdict FROM tl""",
}
