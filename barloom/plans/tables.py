"""Bars and other inputs of the registered queries, made from the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import bars as B

TRADE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
SPLIT = "1999-01-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(*TRADE_ORDER, "l_quantity", "l_shipdate", "l_returnflag")


def _bars(trades: DataFrame, symbol: str, keep: list[str] | None = None) -> DataFrame:
    """Bars of a symbol column. A query reads them many times over, and they are a row a symbol and day however many the trades, so they are persisted: trades are read once."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return B.from_trades(trades, F.col(symbol), F.col("l_shipdate"), price, F.col("l_quantity"), TRADE_ORDER, [F.col(k) for k in keep or []]).persist()


def bars_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three symbols with a bar on nearly every day."""
    return _bars(_trades(spark, sf_dir), "l_returnflag")


def bars_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol for each brand; days without trades have no bar."""
    brand = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return _bars(_trades(spark, sf_dir).join(brand, "l_partkey"), "p_brand")


def bars_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol for each nation of the suppliers, with its region as sector."""
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    supplier = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    supplier = supplier.select(F.col("s_suppkey").alias("l_suppkey"), "n_name", F.col("r_name").alias("sector"))
    return _bars(_trades(spark, sf_dir).join(supplier, "l_suppkey"), "n_name", ["sector"])


_SOURCE = {
    "flag": ("lineitem", "l_returnflag", ""),
    "brand": ("lineitem JOIN part ON p_partkey = l_partkey", "p_brand", ""),
    "nation": ("lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey", "n_name", "r_name"),
}


def sql_bars(kind: str, bench: bool = False, dense: bool = False) -> str:
    """The start of a WITH clause that defines bars, and bench or dense if wanted."""
    source, symbol, sector = _SOURCE[kind]
    order = ", ".join(TRADE_ORDER)
    out = f"""WITH RECURSIVE trades AS (
  SELECT {symbol} AS symbol, {f'{sector} AS sector, ' if sector else ''}CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS p, l_quantity AS q, {order}
  FROM {source}
), bars AS MATERIALIZED (
  SELECT symbol, {'sector, ' if sector else ''}date, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS bar_idx, open, high, low, close, volume FROM (
    SELECT symbol, {'sector, ' if sector else ''}date, first(p ORDER BY {order}) AS open, max(p) AS high, min(p) AS low, last(p ORDER BY {order}) AS close, sum(q) AS volume
    FROM trades GROUP BY symbol, {'sector, ' if sector else ''}date)
)"""
    if bench:
        out += """, bench AS MATERIALIZED (
  SELECT date, avg(open) AS open, avg(high) AS high, avg(low) AS low, avg(close) AS close, sum(volume) AS volume FROM bars GROUP BY date
)"""
    if dense:
        out += f""", days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM bars)),
names AS (SELECT DISTINCT symbol{', sector' if sector else ''} FROM bars),
dense AS MATERIALIZED (
  SELECT n.symbol, {'n.sector, ' if sector else ''}d.t, d.date, b.open, b.high, b.low, b.close, b.volume FROM names n CROSS JOIN days d LEFT JOIN bars b ON b.symbol = n.symbol AND b.date = d.date
)"""
    return out


def roll(fn: str, x: str, n: int, least: int | None = None, lag: int = 0, order: str = "date") -> str:
    """A rolling statistic with a full count of values, as functions.frames.rolling makes it."""
    frame = f"OVER (PARTITION BY symbol ORDER BY {order} ROWS BETWEEN {n - 1 + lag} PRECEDING AND {f'{lag} PRECEDING' if lag else 'CURRENT ROW'})"
    return f"CASE WHEN count({x}) {frame} >= {n if least is None else least} THEN {fn}({x}) {frame} END"


def lag(x: str, n: int = 1, order: str = "date") -> str:
    return f"{'lag' if n >= 0 else 'lead'}({x}, {abs(n)}) OVER (PARTITION BY symbol ORDER BY {order})"


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded, so that engines that add in another order give the same values; -0.0 becomes 0.0."""
    return df.select(*[(F.round(F.col(c), special.get(c, digits)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
