"""Queries on peers, journals, insider trades, growth, texts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.scores import t_stat
from ..operators import ledger as L
from ..operators import peers as P
from ..sources import bars as B
from ..sources import reports as R
from . import tables as T
from .happenings import _R, sql_bench, sql_cooldown
from .tables import lag, rounded, sql_bars

#: Word lists of the texts' invented language. Fixed values.
GOOD, BAD = ["the", "and", "with"], ["of", "was", "not"]
THEMES = {"articles": r"(?i)(?:^|[^A-Za-zÀ-ÿ])(?:the|der|la|el)(?:$|[^A-Za-zÀ-ÿ])", "links": r"https?://", "digits": r"[0-9]{3}"}


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as residual series: a symbol for each of the first 60 vectors' ids, a day for each dimension."""
    e = T.read(spark, sf, "embeddings")
    return e.select(F.concat(F.lit("V"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("symbol"), F.posexplode("embedding").alias("t", "e")).withColumn("e", F.col("e").cast("double"))


def _returns(spark: SparkSession, sf: str) -> DataFrame:
    return P.log_returns(B.densify(T.bars_nation(spark, sf).drop("sector")), guard=10.0)


def beta_residuals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.residuals(_returns(spark, sf)).groupBy("symbol").agg(F.first("beta").alias("beta"), F.stddev_samp("e").alias("sd"), F.count("*").alias("n")))


def pair_correlations(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.pair_correlations(P.residuals(_returns(spark, sf)), least=60))


def peer_top5(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.nearest(_vectors(spark, sf), least=10))


def peer_groups_ward(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.build_groups(_returns(spark, sf), 5, 4))


def _sectors(spark: SparkSession, sf: str) -> DataFrame:
    return T.bars_nation(spark, sf).select("symbol", F.col("sector").alias("grp")).distinct()


def divergence_z(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.divergence(_returns(spark, sf), _sectors(spark, sf)))


def basket_index(spark: SparkSession, sf: str) -> DataFrame:
    dense = B.densify(T.bars_nation(spark, sf).drop("sector"))
    rows = P.basket(dense, _sectors(spark, sf))
    return rounded(rows.select("grp", "t", F.log("close").alias("log_close"), (F.col("high") / F.col("close")).alias("top"), "n_members"))


def leadlag_bh(spark: SparkSession, sf: str) -> DataFrame:
    groups = T.read(spark, sf, "embeddings").select(F.concat(F.lit("V"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("symbol"), F.col("label").cast("string").alias("grp"))
    return P.lead_lag(_vectors(spark, sf), groups, digits=5).select("grp", "leader", "follower", "n", "slope", "t_stat", "found")


def sector_cohesion(spark: SparkSession, sf: str) -> DataFrame:
    """Mean correlation of pairs within each sector."""
    pairs = P.pair_correlations(P.residuals(_returns(spark, sf)), least=60)
    s = _sectors(spark, sf)
    same = pairs.join(s.select(F.col("symbol").alias("a"), F.col("grp").alias("ga")), "a").join(s.select(F.col("symbol").alias("b"), F.col("grp").alias("gb")), "b").where("ga = gb")
    return rounded(same.groupBy(F.col("ga").alias("sector")).agg(F.avg("corr").alias("cohesion"), F.count("*").alias("pairs")))


def _journal(spark: SparkSession, sf: str) -> DataFrame:
    orders = T.read(spark, sf, "orders").join(T.read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(T.read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    hold = F.when(F.col("o_orderpriority") == "1-URGENT", 5).when(F.col("o_orderpriority") == "2-HIGH", 10).otherwise(20)
    return orders.select(F.col("o_orderpriority").alias("rule"), F.col("n_name").alias("symbol"), F.to_date("o_orderdate").alias("signal_date"), hold.alias("hold_bars")).distinct()


def journal_mtm(spark: SparkSession, sf: str) -> DataFrame:
    bars = T.bars_nation(spark, sf).drop("sector")
    return rounded(L.mark_to_market(_journal(spark, sf), bars, B.benchmark(bars)), entry_price=9)


def journal_summary(spark: SparkSession, sf: str) -> DataFrame:
    bars = T.bars_nation(spark, sf).drop("sector")
    return rounded(L.rule_summary(L.mark_to_market(_journal(spark, sf), bars, B.benchmark(bars))))


def journal_new_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    """All signals against a journal of those before the split, of which the last ones are still open there."""
    j = _journal(spark, sf)
    split = F.lit(T.SPLIT).cast("date")
    logged = j.where(F.col("signal_date") < split).withColumn("done", F.date_add("signal_date", 2 * F.col("hold_bars")) <= split)
    return L.new_signals(j, logged).select("rule", "symbol", "signal_date")


def ledger_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    e = T.read(spark, sf, "events").select(F.to_date("ts").alias("date"), F.col("event_type").alias("section"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), F.round("value", 2).alias("value"), "event_id")
    return rounded(L.first_seen(e.select("date", "event_id", "section", "symbol", "value")))


def scorecard_labels(spark: SparkSession, sf: str) -> DataFrame:
    bars = T.bars_nation(spark, sf).drop("sector")
    m = L.mark_to_market(_journal(spark, sf), bars, B.benchmark(bars)).select("*", F.lit(1).alias("h"), (F.col("ret") - F.col("bench_ret")).alias("xbench"), (F.col("ret") - F.col("bench_ret")).alias("xlocal"))
    labels = [("all", F.lit(True)), ("urgent", F.col("rule") == "1-URGENT"), ("long", F.col("hold_bars") == 20), ("done", F.col("done")), ("urgent and done", (F.col("rule") == "1-URGENT") & F.col("done"))]
    return rounded(L.scorecard(m, labels, 1))


def review_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of two halves of the journal by rule and symbol, where they differ."""
    bars = T.bars_nation(spark, sf).drop("sector")
    m = L.mark_to_market(_journal(spark, sf), bars, B.benchmark(bars)).where(F.col("ret").isNotNull())
    told = lambda w: m.where(w).groupBy("rule", "symbol").agg(F.when(F.avg(F.col("ret") - F.col("bench_ret")) > 0, "ahead").otherwise("behind").alias("verdict"))
    split = F.lit(T.SPLIT).cast("date")
    return L.changes(told(F.col("signal_date") >= split), told(F.col("signal_date") < split), ["rule", "symbol"], "verdict")


def _insider(spark: SparkSession, sf: str) -> DataFrame:
    e = T.read(spark, sf, "events")
    return e.select(F.col("event_type").alias("symbol"), F.col("user_id").alias("owner"), F.to_date("ts").alias("filing_date"), F.col("value"), F.when(F.col("event_id") % 2 == 0, "P").otherwise("S").alias("code"), (F.col("value") / 10).alias("shares"))


def insider_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.insider_clusters(_insider(spark, sf), 5, 3, 100.0))


def insider_singles(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.insider_singles(_insider(spark, sf), 100.0, gap_days=4))


def insider_signals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.insider_signals(_insider(spark, sf), 50.0, 10))


def growth_rank_score(spark: SparkSession, sf: str) -> DataFrame:
    rows = _growth(spark, sf)
    return rounded(rows.select("symbol", "sector", "size_score", "value_score", "score"))


def _growth(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers with sums of their lines as fundamentals."""
    li = T.read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("revenue"), F.avg("l_discount").alias("discount"), F.count("*").alias("lines"))
    rows = li.join(T.read(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_name").alias("symbol"), F.col("s_nationkey").alias("sector"), F.round("revenue", 2).alias("revenue"), "lines", F.round("discount", 9).alias("discount"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("balance"))
    return L.block_score(rows, {"size": [("revenue", True), ("lines", True)], "value": [("discount", False), ("balance", True)]}, {"size": 0.6, "value": 0.4})


def sector_cap_topn(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.capped_top(_growth(spark, sf), 10, 2).select("symbol", "sector", "score"))


def headline_tone(spark: SparkSession, sf: str) -> DataFrame:
    d = T.read(spark, sf, "conversations")
    return d.select("conv_id", "turn", X.tone(F.col("text"), GOOD, BAD).alias("tone"))


def theme_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = T.read(spark, sf, "documents")
    return d.select("source", F.explode(X.themes(F.col("text"), THEMES)).alias("theme")).groupBy("source", "theme").agg(F.count("*").alias("n"))


def flags_array(spark: SparkSession, sf: str) -> DataFrame:
    o = T.read(spark, sf, "orders")
    f = X.flags({"Z": F.col("o_totalprice") > 300000, "D": F.col("o_orderstatus") == "P", "S": F.col("o_orderpriority").startswith("1")})
    return o.select("o_orderkey", F.array_join(f, " ").alias("flags"), X.signal_label(F.array(F.when(F.col("o_totalprice") > 300000, 1).otherwise(-1), F.when(F.col("o_orderstatus") == "P", -1).otherwise(0))).alias("label"))


def html_links(spark: SparkSession, sf: str) -> DataFrame:
    return R.link_targets(T.read(spark, sf, "pages"))


def json_props_extract(spark: SparkSession, sf: str) -> DataFrame:
    e = T.read(spark, sf, "events").withColumn("k", F.from_json("props", "k int")["k"])
    return rounded(e.groupBy("event_type").agg(F.count("k").alias("n"), F.avg("k").alias("mean"), F.max("k").alias("most"), t_stat(F.col("k").cast("double")).alias("t")))


def hourly_event_bars(spark: SparkSession, sf: str) -> DataFrame:
    """The batch form of the streaming bars."""
    e = T.read(spark, sf, "events").groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("hour"))
    return rounded(e.agg(F.min_by("value", F.struct("ts", "event_id")).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.count("*").alias("n")).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH")))


QUERIES = {f.__name__: f for f in (
    beta_residuals, pair_correlations, peer_top5, peer_groups_ward, divergence_z, basket_index, leadlag_bh, sector_cohesion, journal_mtm, journal_summary, journal_new_antijoin, ledger_first_seen, scorecard_labels,
    review_changes, insider_clusters, insider_singles, insider_signals, growth_rank_score, sector_cap_topn, headline_tone, theme_counts, flags_array, html_links, json_props_extract, hourly_event_bars,
)}

_RET = sql_bars("nation", dense=True) + f""", lr0 AS (SELECT symbol, sector, t, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS c FROM dense WHERE t >= (SELECT max(t) FROM dense) - 756), lr1 AS (SELECT symbol, sector, t, ln(c / ({lag('c', 1, 't')})) AS r FROM lr0),
lr AS MATERIALIZED (SELECT symbol, sector, t, r FROM lr1 WHERE abs(r) < 10.0), mk AS (SELECT t, avg(r) AS m FROM lr GROUP BY t),
bt AS (SELECT symbol, CASE WHEN count(*) >= 61 THEN regr_slope(r, m) ELSE 1.0 END AS beta FROM lr JOIN mk USING (t) GROUP BY symbol), rs AS MATERIALIZED (SELECT lr.symbol, sector, t, beta, r - beta * m AS e FROM lr JOIN mk USING (t) JOIN bt ON bt.symbol = lr.symbol),
pc AS MATERIALIZED (SELECT a.symbol AS a, b.symbol AS b, a.sector AS sa, b.sector AS sb, count(*) AS n, CASE WHEN count(*) >= 60 THEN corr(a.e, b.e) ELSE 0.0 END AS corr FROM rs a JOIN rs b ON a.t = b.t AND a.symbol < b.symbol GROUP BY ALL)"""
_VEC = "WITH ve AS MATERIALIZED (SELECT 'V' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS symbol, label, unnest(embedding)::DOUBLE AS e, unnest(range(len(embedding))) AS t FROM embeddings)"
_JOURNAL = sql_bars("nation", bench=True) + sql_bench("bars") + """, jn AS MATERIALIZED (SELECT DISTINCT o_orderpriority AS rule, n_name AS symbol, CAST(o_orderdate AS DATE) AS signal_date, CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 10 ELSE 20 END AS hold_bars FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
_MTM = _JOURNAL + """, ls AS (SELECT symbol, max(bar_idx) AS last FROM bars GROUP BY symbol), ja AS (SELECT jn.*, b.bar_idx + 1 AS e, least(ls.last, b.bar_idx + hold_bars) AS x, ls.last FROM jn ASOF LEFT JOIN al b ON b.symbol = jn.symbol AND b.date >= jn.signal_date LEFT JOIN ls ON ls.symbol = jn.symbol),
mt AS MATERIALIZED (SELECT ja.rule, ja.symbol, ja.signal_date, ja.hold_bars, be.date AS entry_date, be.open AS entry_price, CASE WHEN be.date IS NOT NULL THEN x - e + 1 END AS bars_elapsed, bx.close / be.open - 1 AS ret, bx.bench_close / be.bench_open - 1 AS bench_ret, coalesce(e <= last AND e + hold_bars - 1 <= last, false) AS done
FROM ja LEFT JOIN al be ON be.symbol = ja.symbol AND be.bar_idx = ja.e LEFT JOIN al bx ON bx.symbol = ja.symbol AND bx.bar_idx = ja.x AND ja.e <= ja.last)"""
_TX = "WITH RECURSIVE tx AS MATERIALIZED (SELECT event_type AS symbol, user_id AS owner, CAST(ts AS DATE) AS filing_date, CAST(ts AS DATE) - DATE '1970-01-01' AS day, value, CASE WHEN event_id % 2 = 0 THEN 'P' ELSE 'S' END AS code, value / 10 AS shares FROM events)"
_GROW = """WITH gl AS (SELECT s_name AS symbol, s_nationkey AS sector, round(sum(l_extendedprice), 2) AS revenue, round(avg(l_discount), 9) AS discount, count(*) AS lines, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS balance FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_name, s_nationkey, s_acctbal),
gr AS (SELECT *, (rank() OVER (ORDER BY revenue) + (count(*) OVER (PARTITION BY revenue) - 1) / 2) / count(*) OVER () AS r1, (rank() OVER (ORDER BY lines) + (count(*) OVER (PARTITION BY lines) - 1) / 2) / count(*) OVER () AS r2, (rank() OVER (ORDER BY -discount) + (count(*) OVER (PARTITION BY discount) - 1) / 2) / count(*) OVER () AS r3,
CASE WHEN balance IS NOT NULL THEN (rank() OVER (ORDER BY balance NULLS LAST) + (count(*) OVER (PARTITION BY balance) - 1) / 2) / count(balance) OVER () END AS r4 FROM gl),
gs AS MATERIALIZED (SELECT symbol, sector, (r1 + r2) / 2 AS size_score, CASE WHEN r4 IS NULL THEN r3 ELSE (r3 + r4) / 2 END AS value_score FROM gr), sc AS MATERIALIZED (SELECT *, 0.6 * size_score + 0.4 * value_score AS score FROM gs)"""
_WORDS = lambda ws: "(?i)\\b(?:" + "|".join(ws) + ")\\b"
_LAB = "(VALUES ('all', true), ('urgent', rule = '1-URGENT'), ('long', hold_bars = 20), ('done', done), ('urgent and done', rule = '1-URGENT' AND done)) l(label, v)"

ORACLES = {
    "beta_residuals": _RET + f" SELECT symbol, {_R('first(beta)')} AS beta, {_R('stddev_samp(e)')} AS sd, count(*) AS n FROM rs GROUP BY symbol",
    "pair_correlations": _RET + f" SELECT a, b, n, {_R('corr')} AS corr FROM pc",
    "sector_cohesion": _RET + f" SELECT sa AS sector, {_R('avg(corr)')} AS cohesion, count(*) AS pairs FROM pc WHERE sa = sb GROUP BY sa",
    "peer_top5": _VEC + f""", pp AS (SELECT a.symbol AS a, b.symbol AS b, corr(a.e, b.e) AS corr FROM ve a JOIN ve b ON a.t = b.t AND a.symbol < b.symbol GROUP BY ALL), bo AS (SELECT a AS symbol, b AS peer, corr FROM pp UNION ALL SELECT b, a, corr FROM pp), rk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY corr DESC, peer) AS rank FROM bo)
SELECT symbol, peer, {_R('corr')} AS corr, CAST(rank AS INT) AS rank FROM rk WHERE rank <= 5""",
    "divergence_z": _RET + f""", gd AS (SELECT s.symbol, s.sector AS grp, d.t, coalesce(lr.r, 0.0) AS r FROM (SELECT DISTINCT symbol, sector FROM dense) s CROSS JOIN (SELECT DISTINCT t FROM lr) d LEFT JOIN lr ON lr.symbol = s.symbol AND lr.t = d.t),
go AS (SELECT *, count(*) OVER (PARTITION BY grp, t) AS n, sum(r) OVER (PARTITION BY grp, t) - r AS o FROM gd), gp AS (SELECT *, o / (n - 1) AS others FROM go WHERE n >= 3), gb AS (SELECT symbol, coalesce(covar_samp(r, others) / nullif(var_samp(others), 0), 1.0) AS b FROM gp GROUP BY symbol),
gr AS (SELECT gp.symbol, grp, t, r - b * others AS rel FROM gp JOIN gb ON gb.symbol = gp.symbol), gq AS (SELECT *, CASE WHEN count(rel) OVER (PARTITION BY symbol ORDER BY t ROWS 19 PRECEDING) = 20 THEN sum(rel) OVER (PARTITION BY symbol ORDER BY t ROWS 19 PRECEDING) END AS roll FROM gr),
gz AS (SELECT *, avg(roll) OVER p AS mu, stddev_samp(roll) OVER p AS sd, count(roll) OVER p AS k, max(t) OVER (PARTITION BY symbol) AS last_t FROM gq WINDOW p AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING))
SELECT symbol, grp, {_R('CASE WHEN k >= 126 AND sd > 0 THEN (roll - mu) / sd END')} AS z, {_R('exp(roll) - 1')} AS rel20 FROM gz WHERE t = last_t""",
    "basket_index": sql_bars("nation", dense=True) + f""", bk AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS c FROM dense), bp AS (SELECT *, {lag('c', 1, 't')} AS prev FROM bk),
bd AS (SELECT sector AS grp, t, count(*) AS n_members, avg(open / prev - 1) AS o, avg(high / prev - 1) AS h, avg(low / prev - 1) AS l, avg(c / prev - 1) AS ret FROM bp WHERE c IS NOT NULL AND prev IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
be AS (SELECT *, 100 * exp(sum(ln(1 + ret)) OVER (PARTITION BY grp ORDER BY t)) AS close FROM bd), bf AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY grp ORDER BY t), 100.0) AS before FROM be)
SELECT grp, CAST(t AS INT) AS t, {_R('ln(close)')} AS log_close, {_R('greatest(before * (1 + coalesce(h, 0)), before * (1 + coalesce(o, 0)), close) / close')} AS top, n_members FROM bf""",
    "leadlag_bh": _VEC.replace("WITH ve", "WITH ve") + f""", vl AS (SELECT symbol, label::VARCHAR AS grp, t, e AS y, lag(e) OVER (PARTITION BY symbol ORDER BY t) AS x FROM ve), pr AS MATERIALIZED (SELECT a.grp, a.symbol AS leader, b.symbol AS follower, a.x, b.y FROM vl a JOIN vl b ON a.t = b.t AND a.grp = b.grp AND a.symbol <> b.symbol WHERE a.x IS NOT NULL),
ft AS (SELECT grp, leader, follower, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS a, avg(x) AS mx, regr_sxx(y, x) AS sxx FROM pr GROUP BY ALL),
mt AS (SELECT ft.grp, ft.leader, ft.follower, n, slope, slope * sxx / sqrt(sum((x - mx) * (x - mx) * (y - a - slope * x) * (y - a - slope * x))) AS t_stat FROM pr JOIN ft ON ft.leader = pr.leader AND ft.follower = pr.follower GROUP BY ft.grp, ft.leader, ft.follower, n, slope, sxx),
pz AS (SELECT *, abs(t_stat) / sqrt(2) AS z FROM mt), pk AS (SELECT *, 1 / (1 + 0.3275911 * z) AS k FROM pz), pp AS (SELECT *, k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429)))) * exp(-z * z) AS p FROM pk),
rk AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM pp), cut AS (SELECT max(p) AS c FROM rk WHERE p <= 0.05 * r / m)
SELECT grp, leader, follower, n, {_R('slope', 5)} AS slope, {_R('t_stat', 5)} AS t_stat, coalesce(p <= c, false) AS found FROM rk, cut""",
    "journal_mtm": _MTM + f" SELECT rule, symbol, signal_date, hold_bars, entry_date, {_R('entry_price', 9)} AS entry_price, CAST(bars_elapsed AS INT) AS bars_elapsed, {_R('ret')} AS ret, {_R('bench_ret')} AS bench_ret, done FROM mt",
    "journal_summary": _MTM + f" SELECT rule, count(*) AS n, count(*) FILTER (done) AS closed, {_R('avg(ret)')} AS mean, {_R('quantile_cont(ret, 0.5)')} AS median, {_R('avg((ret > 0)::INT)')} AS hit, {_R('max(ret)')} AS best, {_R('min(ret)')} AS worst, {_R('avg(ret - bench_ret)')} AS excess FROM mt WHERE ret IS NOT NULL GROUP BY rule",
    "journal_new_antijoin": _JOURNAL + f""", lg AS (SELECT *, signal_date + CAST(2 * hold_bars AS INT) <= DATE '{T.SPLIT}' AS done FROM jn WHERE signal_date < DATE '{T.SPLIT}') SELECT DISTINCT rule, symbol, signal_date FROM jn WHERE NOT EXISTS (SELECT 1 FROM lg WHERE lg.rule = jn.rule AND lg.symbol = jn.symbol AND lg.signal_date = jn.signal_date) AND NOT EXISTS (SELECT 1 FROM lg WHERE lg.rule = jn.rule AND lg.symbol = jn.symbol AND NOT lg.done)""",
    "ledger_first_seen": f"""WITH rp AS (SELECT CAST(ts AS DATE) AS date, event_type AS section, 'U' || user_id AS symbol, round(value, 2) AS value, event_id FROM events), ag AS (SELECT section, symbol, count(DISTINCT date) AS n_days, min(ROW(date, event_id)) AS f FROM rp GROUP BY section, symbol)
SELECT ag.section, ag.symbol, n_days, rp.date, rp.event_id, {_R('rp.value')} AS value FROM ag JOIN rp ON rp.section = ag.section AND rp.symbol = ag.symbol AND ROW(rp.date, rp.event_id) = f""",
    "scorecard_labels": _MTM + f""", lb AS (SELECT l.label, ret, ret - bench_ret AS xlocal FROM mt, LATERAL {_LAB} WHERE ret IS NOT NULL AND v)
SELECT label, count(*) AS n, {_R('avg(ret)')} AS ret, {_R('avg(xlocal)')} AS xbench, {_R('avg(xlocal)')} AS xlocal, {_R('avg((ret > 0)::INT)')} AS hit, {_R('avg(xlocal) / nullif(stddev_samp(xlocal), 0) * sqrt(count(xlocal))')} AS t FROM lb GROUP BY label HAVING count(*) >= 4""",
    "review_changes": _MTM + f""", vd AS (SELECT signal_date >= DATE '{T.SPLIT}' AS late, rule, symbol, CASE WHEN avg(ret - bench_ret) > 0 THEN 'ahead' ELSE 'behind' END AS verdict FROM mt WHERE ret IS NOT NULL GROUP BY ALL), a AS (SELECT * FROM vd WHERE late), b AS (SELECT * FROM vd WHERE NOT late)
SELECT coalesce(a.rule, b.rule) AS rule, coalesce(a.symbol, b.symbol) AS symbol, a.verdict AS now, b.verdict AS before FROM a FULL JOIN b ON a.rule = b.rule AND a.symbol = b.symbol WHERE a.verdict IS DISTINCT FROM b.verdict""",
    "insider_clusters": _TX + """, tp AS (SELECT * FROM tx WHERE code = 'P' AND value >= 100), ag AS (SELECT a.symbol, a.filing_date AS date, a.day, count(DISTINCT b.owner) AS n_insiders, count(*) AS n_trades, sum(b.value) AS total_value FROM (SELECT DISTINCT symbol, filing_date, day FROM tp) a JOIN tp b ON b.symbol = a.symbol AND b.day BETWEEN a.day - 4 AND a.day GROUP BY ALL),
hh AS MATERIALIZED (SELECT * FROM ag WHERE n_insiders >= 3)""" + sql_cooldown("hh", "symbol", 5, "day") + f" SELECT symbol, date, CAST(n_insiders AS INT) AS n_insiders, n_trades, {_R('total_value')} AS total_value FROM kept",
    "insider_singles": _TX + ", hh AS MATERIALIZED (SELECT symbol, filing_date AS date, day, max(value) AS total_value FROM tx WHERE code = 'P' AND value >= 100 GROUP BY ALL)" + sql_cooldown("hh", "symbol", 4, "day") + f" SELECT symbol, date, {_R('total_value')} AS total_value FROM kept",
    "insider_signals": _TX + f""", bu AS (SELECT *, max(filing_date) OVER (PARTITION BY symbol) AS last_filing FROM tx WHERE code = 'P' AND value >= 50) SELECT symbol, last_filing, count(DISTINCT owner) FILTER (filing_date > last_filing - 10) AS n_insiders_30d, count(*) AS n_buys, {_R('sum(value)')} AS total_value, {_R('sum(value) / sum(shares)')} AS avg_price, count(DISTINCT owner) FILTER (filing_date > last_filing - 10) >= 2 AS cluster FROM bu GROUP BY symbol, last_filing""",
    "growth_rank_score": _GROW + f" SELECT symbol, sector, {_R('size_score')} AS size_score, {_R('value_score')} AS value_score, {_R('score')} AS score FROM sc",
    "sector_cap_topn": _GROW + f", cp AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY score DESC, symbol) AS r FROM sc) SELECT symbol, sector, {_R('score')} AS score FROM (SELECT * FROM cp WHERE r <= 2 ORDER BY score DESC, symbol LIMIT 10)",
    "headline_tone": f"SELECT conv_id, turn, CAST(sign(len(regexp_extract_all(text, '{_WORDS(GOOD)}')) - len(regexp_extract_all(text, '{_WORDS(BAD)}'))) AS INT) AS tone FROM conversations",
    "theme_counts": "WITH th AS (SELECT source, t.theme FROM documents, LATERAL (VALUES " + ", ".join(f"('{k}', regexp_matches(text, '{p}'))" for k, p in THEMES.items()) + ") t(theme, v) WHERE v) SELECT source, theme, count(*) AS n FROM th GROUP BY source, theme",
    "flags_array": """SELECT o_orderkey, concat_ws(' ', CASE WHEN o_totalprice > 300000 THEN 'Z' END, CASE WHEN o_orderstatus = 'P' THEN 'D' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'S' END) AS flags, CASE WHEN s <= -2 THEN 'negative' WHEN s >= 2 THEN 'positive' ELSE 'mixed' END AS label FROM (SELECT *, CASE WHEN o_totalprice > 300000 THEN 1 ELSE -1 END + CASE WHEN o_orderstatus = 'P' THEN -1 ELSE 0 END AS s FROM orders)""",
    "html_links": """SELECT page_id, CAST(len(l) AS INT) AS n_links, CAST(len(list_distinct(l)) AS INT) AS n_targets FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1) AS l FROM pages)""",
    "json_props_extract": f"WITH k AS (SELECT event_type, CAST(props->>'k' AS INT) AS k FROM events) SELECT event_type, count(k) AS n, {_R('avg(k)')} AS mean, max(k) AS most, {_R('avg(k) / nullif(stddev_samp(k), 0) * sqrt(count(k))')} AS t FROM k GROUP BY event_type",
    "hourly_event_bars": f"SELECT event_type AS symbol, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, {_R('first(value ORDER BY ts, event_id)')} AS open, {_R('max(value)')} AS high, {_R('min(value)')} AS low, {_R('last(value ORDER BY ts, event_id)')} AS close, count(*) AS n FROM events GROUP BY ALL",
}
