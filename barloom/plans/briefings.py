"""Queries on briefs and reads, collected signals, and tables of event families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import briefs as P
from ..operators import events as E
from ..operators import lookback as L
from ..operators import stats as S
from ..operators import verdicts as V
from ..sources import bars as B
from . import tables as T
from .happenings import ORACLES as _EVENTS
from .happenings import _R, sql_bench, sql_cooldown, sql_forward
from .reports import _live
from .tables import SPLIT, lag, roll, rounded, sql_bars

REVERSAL_HS, GAP_HS = [1, 2, 3, 5, 10], [1, 5, 10, 20]


def _stocks(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as stocks: their lines stand for prices, ratings and actions."""
    lines = T.read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("symbol")).agg(
        (F.round(F.avg("l_discount"), 9) - 0.05).alias("dist_ma50"), (F.round(F.avg("l_quantity"), 9) / 25 - 1).alias("upside"), F.count_if(F.col("l_returnflag") == "R").alias("n_up"), F.count_if(F.col("l_returnflag") == "A").alias("n_down"),
        F.count_if(F.col("l_linestatus") == "O").alias("n_target_cuts"), F.count_if(F.col("l_linestatus") == "F").alias("n_target_raises"), F.count_if(F.col("l_quantity") > 40).alias("up_30"), F.count_if(F.col("l_quantity") < 11).alias("down_30"),
        (F.round(F.avg("l_tax"), 9) * 25 - 1).alias("year_rev_30d"), (F.round(F.stddev_samp("l_discount"), 9) * 30 - 0.95).alias("surprise"), F.count("*").alias("lines"),
    )
    own = T.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_acctbal").alias("free_cashflow"))
    rows = lines.join(own, "symbol")
    mean = 1 + (F.col("lines") % 40) / 10
    return rows.withColumns({"rating": P.rating_of(mean), "debt_to_equity": F.col("lines") % 7 / 2.0, "pe": (F.col("n_up") % 5).cast("double"), "forward_pe": (F.col("n_down") % 5).cast("double"), "new_low": F.col("n_down") % 3 == 0})


def brief_reads(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.summary_order(P.read(_stocks(spark, sf)))
    return rounded(rows.select("symbol", F.array_join("fired", ",").alias("fired"), "score", "read", "place"))


def reversal_table(spark: SparkSession, sf: str) -> DataFrame:
    bars = T.bars_flag(spark, sf)
    ev = E.reversals(B.densify(bars), B.benchmark(bars), horizons=REVERSAL_HS)
    return rounded(S.event_table(E.narrow(ev, REVERSAL_HS, ["symbol", "date", "threshold", "direction", "move"]), ["threshold", "direction"], SPLIT, 0.0005, ["move"]))


def news_gap_table(spark: SparkSession, sf: str) -> DataFrame:
    bars = T.bars_flag(spark, sf)
    ev = E.news_gaps(B.densify(bars), B.benchmark(bars), GAP_HS, times=1.8).withColumnRenamed("direction", "dir")
    return rounded(S.event_table(E.narrow(ev, GAP_HS, ["symbol", "date", "dir", "gap", "day_ret"]), ["dir"], SPLIT, means=["gap", "day_ret"]))


def doji_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    bars = T.bars_flag(spark, sf)
    return rounded(E.doji_sensitivity(bars, B.benchmark(bars), [0.05, 0.10, 0.20], 0.05))


def collected_signals(spark: SparkSession, sf: str) -> DataFrame:
    """What the journal takes from a year's early rallies."""
    live = V.early_rally(V.rally_live(T.bars_brand(spark, sf), max_age=250))
    return L.collect_signals("2001-12-31", rallies=live).select("logged", "rule", "symbol", "signal_date", "status", "entry_date", "entry_price", "hold_bars")


QUERIES = {f.__name__: f for f in (brief_reads, reversal_table, news_gap_table, doji_sensitivity, collected_signals)}

_RULES = [
    ("above_ma50", 1.0, "dist_ma50 > 0"), ("below_ma50", -1.0, "dist_ma50 <= 0"), ("new_low", -1.0, "n_down % 3 = 0"), ("consensus_buy", 1.0, "mean < 2.5"), ("consensus_sell", -1.0, "mean >= 3.5"), ("target_far", 1.0, "upside > 0.20"), ("target_near", -1.0, "upside < 0.05"),
    ("more_upgrades", 1.0, "n_up > n_down"), ("more_downgrades", -1.0, "n_down > n_up"), ("target_cuts", -1.0, "n_cuts >= n_raises + 3"), ("target_raises", 1.0, "n_raises >= n_cuts + 3"), ("revisions_down", -0.5, "down_30 >= up_30 + 3"), ("revisions_up", 0.5, "up_30 >= down_30 + 3"),
    ("eps_raised", 1.0, "rev > 0.01"), ("eps_cut", -1.0, "rev < -0.01"), ("beat", 0.5, "surprise > 0"), ("miss", -1.0, "surprise < 0"), ("fcf_positive", 0.5, "fcf > 0"), ("fcf_negative", -0.5, "fcf < 0"), ("leverage", -0.5, "lines % 7 / 2.0 > 2"),
    ("forward_pe_lower", 0.5, "n_up % 5 <> 0 AND n_down % 5 <> 0 AND n_down % 5 < n_up % 5"),
]
_TSTAT = "CASE WHEN count(xlocal) >= 3 AND stddev_pop(xlocal) > 0 THEN avg(xlocal) / nullif(stddev_samp(xlocal), 0) * sqrt(count(xlocal)) END"


def _narrow_table(events: str, hs: list[int], keys: str, sign: str, cost: float, means: list[str]) -> str:
    each = " UNION ALL ".join(f"SELECT symbol, date, {keys}, {', '.join(means)}, {h} AS h, {sign} * ret_{h} AS ret, {sign} * (ret_{h} - bench_{h}) AS xbench, {sign} * (ret_{h} - local_{h}) AS xlocal FROM {events}" for h in hs)
    return f""", nt AS ({each}), np AS (SELECT *, unnest(['all', CASE WHEN date < DATE '{SPLIT}' THEN 'train' ELSE 'test' END]) AS period FROM nt WHERE ret IS NOT NULL)
SELECT period, {keys}, h, count(*) AS n, count(DISTINCT symbol) AS n_symbols, {', '.join(f"{_R(f'avg({m})')} AS avg_{m}" for m in means)}, {_R(f'avg(ret) - {cost}')} AS net, {_R(f'avg((ret > {cost})::INT)')} AS hit, {_R('avg(xbench)')} AS xbench, {_R('avg(xlocal)')} AS xlocal, {_R(_TSTAT)} AS t FROM np GROUP BY period, {keys}, h"""


def _until(name: str, cut: str) -> str:
    """An event query's SQL up to its last SELECT."""
    sql = _EVENTS[name]
    return sql[: sql.rindex(cut)]


def _dojis() -> str:
    parts, out = "", []
    for k, body in enumerate((0.05, 0.10, 0.20)):
        parts += f", dj{k} AS (SELECT * FROM m0 WHERE high - low > 0 AND high - low >= 0.01 * close AND abs(close - open) <= {body} * (high - low) AND ma10 BETWEEN low AND high AND bar_idx + 21 < last_at + 1 AND bar_idx >= 55)" + sql_cooldown(f"dj{k}", "symbol", 5, name=f"dk{k}")
        out.append(f"SELECT CAST({body} AS DOUBLE) AS body, unnest(CASE WHEN abs(ma10 - (open + close) / 2) <= 0.05 * close THEN ['inside', 'line'] ELSE ['inside'] END) AS position, ret_1, ret_21 AS ret, ret_21 - local_21 AS xlocal FROM dk{k}")
    return parts + f", da AS ({' UNION ALL '.join(out)}) SELECT body, position, count(*) AS n, {_R('avg(ret)')} AS ret, {_R('avg((ret > 0)::INT)')} AS hit, {_R('avg(xlocal)')} AS xlocal, {_R(_TSTAT)} AS t, {_R('avg(ret_1)')} AS ret_1, {_R('avg((ret_1 > 0)::INT)')} AS hit_1 FROM da GROUP BY body, position HAVING count(*) >= 5"


ORACLES = {
    "brief_reads": f"""WITH br AS (SELECT l_suppkey AS symbol, s_acctbal AS fcf, round(avg(l_discount), 9) - 0.05 AS dist_ma50, round(avg(l_quantity), 9) / 25 - 1 AS upside, count(*) FILTER (l_returnflag = 'R') AS n_up, count(*) FILTER (l_returnflag = 'A') AS n_down, count(*) FILTER (l_linestatus = 'O') AS n_cuts, count(*) FILTER (l_linestatus = 'F') AS n_raises,
count(*) FILTER (l_quantity > 40) AS up_30, count(*) FILTER (l_quantity < 11) AS down_30, round(avg(l_tax), 9) * 25 - 1 AS rev, round(stddev_samp(l_discount), 9) * 30 - 0.95 AS surprise, count(*) AS lines, 1 + (count(*) % 40) / 10 AS mean FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_suppkey, s_acctbal),
sg AS (SELECT symbol, s.k, s.code, s.p FROM br, LATERAL (VALUES {', '.join(f"({k}, '{c}', {p}::DOUBLE, {w})" for k, (c, p, w) in enumerate(_RULES))}) s(k, code, p, w) WHERE w),
sc AS (SELECT br.symbol, coalesce(string_agg(code, ',' ORDER BY k), '') AS fired, coalesce(sum(p), 0.0) AS score FROM br LEFT JOIN sg USING (symbol) GROUP BY br.symbol), sr AS (SELECT *, CASE WHEN score >= 3 THEN 'up' WHEN score <= -2 THEN 'down' ELSE 'flat' END AS read FROM sc)
SELECT symbol, fired, {_R('score')} AS score, read, CAST(row_number() OVER (ORDER BY CASE read WHEN 'up' THEN 0 WHEN 'flat' THEN 1 ELSE 2 END, score DESC, symbol) AS INT) AS place FROM sr""",
    "reversal_table": _until("reversal_events", " SELECT symbol, date, CAST(threshold") + _narrow_table("kept", REVERSAL_HS, "threshold, direction", "direction", 0.0005, ["move"]).replace("SELECT period, threshold,", "SELECT period, CAST(threshold AS DOUBLE) AS threshold,"),
    "news_gap_table": sql_bars("flag", bench=True, dense=True) + sql_bench("dense") + sql_forward("al", GAP_HS, "close", 0, 0, "close", 0, 126, 2, 0, "t") + f""", g AS (SELECT *, open / ({lag('close', 1, 't')}) - 1 AS gap, close / ({lag('close', 1, 't')}) - 1 AS day_ret, {roll('avg', 'volume', 20, None, 1, 't')} AS av FROM fw), hit AS MATERIALIZED (SELECT *, CASE WHEN gap > 0 THEN 1 ELSE -1 END AS dir FROM g WHERE abs(gap) >= 0.04 AND volume >= 1.8 * av AND t + 20 < last_at + 1 AND t >= 260)""" + sql_cooldown("hit", "symbol", 5, "t") + _narrow_table("kept", GAP_HS, "dir", "1", 0.001, ["gap", "day_ret"]),
    "doji_sensitivity": sql_bars("flag", bench=True) + sql_bench("bars") + sql_forward("al", [1, 5, 21], "close", 0, 0, "close", 0, 63, 1) + f", m0 AS MATERIALIZED (SELECT *, {roll('avg', 'close', 10)} AS ma10 FROM fw)" + _dojis(),
    "collected_signals": _live(250) + ", eb AS (SELECT * FROM lv WHERE beaten), en AS (SELECT * FROM eb QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bars_ago, rule) = 1) SELECT '2001-12-31' AS logged, 'early_rally_beaten_down' AS rule, symbol, CAST(signal_date AS VARCHAR) AS signal_date, 'open' AS status, '' AS entry_date, '' AS entry_price, '20' AS hold_bars FROM en",
}
