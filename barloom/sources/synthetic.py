"""Made-up bars: piecewise-linear paths with hashed noise, and random walks. Fixtures only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bars import with_index

#: Corner points (bar, price) of textbook shapes. Fixed values.
SHAPES: dict[str, list[tuple[int, float]]] = {
    "Head and Shoulders": [(0, 70), (40, 100), (55, 90), (75, 112), (95, 91), (112, 101), (135, 80), (150, 76)],
    "Inverse Head and Shoulders": [(0, 130), (40, 100), (55, 110), (75, 88), (95, 109), (112, 99), (135, 120), (150, 124)],
    "Double Top": [(0, 70), (40, 100), (60, 88), (82, 100), (105, 80), (120, 75)],
    "Double Bottom": [(0, 130), (40, 100), (60, 112), (82, 100), (105, 120), (120, 126)],
    "Ascending Triangle": [(0, 70), (30, 100), (45, 85), (60, 100), (72, 91), (85, 100), (94, 95), (102, 100), (120, 115)],
    "Falling Wedge": [(0, 130), (20, 120), (35, 96), (52, 110), (66, 90), (80, 101), (92, 87), (102, 94), (112, 86), (130, 110)],
    "Bull Flag": [(0, 80), (40, 82), (52, 105), (66, 101), (80, 125)],
}


def _noise(seed: int, *parts: object) -> F.Column:
    """About normal, with deviation 1: the sum of hashed uniform numbers."""
    u = [F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *parts), F.lit(1 << 20)) / float(1 << 20) for k in range(4)]
    return (u[0] + u[1] + u[2] + u[3] - 2.0) * 3.0**0.5


def _priced(rows: DataFrame, noise: float, seed: int, start: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("i")
    priced = rows.withColumn("close", F.col("path") * (1 + noise * _noise(seed, "symbol", "i"))).withColumn("open", F.coalesce(F.lag("close").over(w), F.col("close")))
    wick = lambda k: F.abs(_noise(seed + k, "symbol", "i")) * noise
    out = priced.select("symbol", F.date_add(F.lit(start).cast("date"), F.col("i").cast("int")).alias("date"), "open", (F.greatest("open", "close") * (1 + wick(1))).alias("high"), (F.least("open", "close") * (1 - wick(2))).alias("low"), "close", (1e6 * (1.5 + 0.25 * _noise(seed + 3, "symbol", "i"))).alias("volume"))
    return with_index(out)


def shape(spark: SparkSession, name: str, noise: float = 0.003, seed: int = 1, start: str = "2024-01-01") -> DataFrame:
    corners = SHAPES[name]
    path = F.lit(None).cast("double")
    for (a, p), (b, q) in reversed(list(zip(corners, corners[1:]))):
        path = F.when(F.col("i") <= b, p + (F.col("i") - a) * ((q - p) / (b - a))).otherwise(path)
    return _priced(spark.range(corners[-1][0] + 1).select(F.lit(name).alias("symbol"), F.col("id").alias("i"), path.alias("path")), noise, seed, start)


def random_walk(spark: SparkSession, symbols: int = 1, n: int = 500, noise: float = 0.012, seed: int = 1, start: str = "2020-01-01") -> DataFrame:
    rows = spark.range(symbols).select(F.concat(F.lit("W"), "id").alias("symbol"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    w = Window.partitionBy("symbol").orderBy("i")
    return _priced(rows.withColumn("path", 100 * F.exp(F.sum(noise * _noise(seed + 9, "symbol", "i")).over(w))), noise / 3, seed, start)
