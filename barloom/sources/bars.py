"""Daily bars: the canonical table, and what makes it.

bars(symbol, date, bar_idx, open, high, low, close, volume): a row a symbol and day, numbered from 0
by date within the symbol (the symbol's own clock). All operators take and return such tables;
columns that they don't know stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIELDS = ["open", "high", "low", "close", "volume"]
BAR_SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double"


def own() -> Window:
    return Window.partitionBy("symbol").orderBy("date")


def with_index(bars: DataFrame) -> DataFrame:
    return bars.withColumn("bar_idx", F.row_number().over(own()) - 1)


def normalise(raw: DataFrame, symbol: Column | None = None) -> DataFrame:
    """Canonical bars from a table with columns named in any case.

    The date may be called date, datetime, timestamp or index. Of several rows of a day the last by
    `order` (if there is such a column) is kept; rows without a price among the four are dropped, a
    missing volume column is null, NaN counts as missing, and a missing price column is an error.
    """
    named = {c.lower().replace(" ", "_"): c for c in raw.columns}
    day = next((named[k] for k in ("date", "datetime", "timestamp", "index") if k in named), None)
    missing = [f for f in FIELDS[:4] if f not in named]
    if day is None or missing:
        raise ValueError(f"not a price table: without {missing or 'a date column'}")
    number = lambda f: F.nanvl(F.col(f"`{named[f]}`").cast("double"), F.lit(None)) if f in named else F.lit(None).cast("double")
    sign = symbol if symbol is not None else F.col(f"`{named['symbol']}`") if "symbol" in named else F.lit("")
    order = F.col(f"`{named['order']}`") if "order" in named else F.monotonically_increasing_id()
    out = raw.select(sign.alias("symbol"), F.to_date(F.col(f"`{day}`")).alias("date"), *[number(f).alias(f) for f in FIELDS], order.alias("__order"))
    latest = out.groupBy("symbol", "date").agg(F.max_by(F.struct(*FIELDS), "__order").alias("bar")).select("symbol", "date", "bar.*")
    return with_index(latest.dropna(subset=["date", *FIELDS[:4]]))


def read_csv_directory(spark: SparkSession, path: str) -> DataFrame:
    """SYMBOL.csv files of a folder; the symbol is the file's name."""
    rows = spark.read.option("header", True).csv(path).withColumn("__file", F.input_file_name())
    name = F.upper(F.regexp_extract("__file", r"([^/]+)\.csv(?:\.gz)?$", 1))
    return normalise(rows.drop("symbol"), name)


def read_chart_json(spark: SparkSession, path: str) -> DataFrame:
    """Chart documents {chart: {result: [{meta, timestamp, indicators}]}}; prices are adjusted by adjclose / close."""
    quote = "open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>"
    schema = f"chart struct<result:array<struct<meta:struct<symbol:string>,timestamp:array<bigint>,indicators:struct<quote:array<struct<{quote}>>,adjclose:array<struct<adjclose:array<double>>>>>>>"
    found = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("chart.result").alias("r"))
    q, a = F.col("r.indicators.quote")[0], F.get(F.col("r.indicators.adjclose"), F.lit(0))["adjclose"]
    rows = found.select(F.col("r.meta.symbol").alias("symbol"), F.posexplode("r.timestamp").alias("i", "ts"), *[q[f].alias(f"__{f}") for f in FIELDS], a.alias("__adj"))
    at = {f: F.get(F.col(f"__{f}"), F.col("i")) for f in FIELDS}
    ratio = F.coalesce(F.try_divide(F.get(F.col("__adj"), F.col("i")), at["close"]), F.lit(1.0))
    priced = {f: (at[f] * ratio if f != "volume" else at[f]).alias(f) for f in FIELDS}
    return normalise(rows.select("symbol", F.timestamp_seconds("ts").alias("date"), *priced.values()))


def from_trades(trades: DataFrame, symbol: Column, day: Column, price: Column, quantity: Column, order: list[str], keep: list[Column] | None = None) -> DataFrame:
    """Bars from single trades, ordered within a day by `order`; partial aggregation before the only shuffle."""
    keep = keep or []
    rows = trades.select(symbol.alias("symbol"), F.to_date(day).alias("date"), price.alias("p"), quantity.cast("double").alias("q"), F.struct(*order).alias("o"), *keep)
    names = [rows.columns[5 + i] for i in range(len(keep))]
    bars = rows.groupBy("symbol", "date", *names).agg(
        F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum("q").alias("volume")
    )
    return with_index(bars)


def benchmark(bars: DataFrame) -> DataFrame:
    """The equal-weight mean of all symbols of a day, under the symbol *."""
    mean = bars.groupBy("date").agg(*[F.avg(f).alias(f) for f in FIELDS[:4]], F.sum("volume").alias("volume"))
    return with_index(mean.withColumn("symbol", F.lit("*")))


def densify(bars: DataFrame, fill: bool = False, least_bars: int = 0) -> DataFrame:
    """Every symbol on every day of the calendar, t being the day's number (the panel's clock).

    Prices are null where the symbol has no bar, or with fill the last known ones. The calendar's
    days are few, so each symbol gets an array of them and no pairs are shuffled.
    """
    days = bars.select("date").distinct()
    calendar = days.agg(F.array_sort(F.collect_list("date")).alias("days"))
    symbols = bars.groupBy("symbol").agg(F.count("*").alias("n")).where(F.col("n") >= least_bars).select("symbol")
    grid = symbols.join(F.broadcast(calendar)).select("symbol", F.posexplode("days").alias("t", "date"))
    dense = grid.join(bars, ["symbol", "date"], "left")
    if fill:
        back = Window.partitionBy("symbol").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
        dense = dense.withColumns({f: F.last(f, ignorenulls=True).over(back) for f in FIELDS[:4]})
    return dense


def weekly(bars: DataFrame, least_days: int = 3) -> DataFrame:
    """Weeks from Saturday to Friday, dated by their Friday; short weeks are dropped, and a symbol's last one before Friday."""
    friday = F.date_add(F.next_day(F.date_sub("date", 1), "FRI"), 0)
    rows = bars.withColumns({"week": friday, "__last": F.max("date").over(Window.partitionBy("symbol"))})
    out = rows.groupBy("symbol", "week", "__last").agg(
        F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"),
        F.sum("volume").alias("volume"), F.count("*").alias("days"),
    )
    done = out.where((F.col("days") >= least_days) & ~((F.col("week") >= F.col("__last")) & (F.weekday("__last") < 4)))
    return with_index(done.select("symbol", F.col("week").alias("date"), *FIELDS))


def split_known_bad(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with sound prices, and errors(symbol, message) for the others."""
    wrong = F.when(F.col("close").isNull() | (F.col("close") <= 0), "no positive close").when(F.col("high") < F.col("low"), "high below low")
    told = rows.withColumn("message", wrong)
    return told.where(F.col("message").isNull()).drop("message"), told.where(F.col("message").isNotNull()).select("symbol", "date", "message")
