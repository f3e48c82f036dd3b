"""A daily index that grows: days that can still change are read again, settled ones are not.

The index of a business day fills up during the day, and what comes in the evening is dated the next
one. So a day is settled once it is before the last business day. What has been read is kept in a
table by day, and each run writes the days that it read as a whole.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def business_day_before(day: Column) -> Column:
    """The last day before that is no Saturday or Sunday."""
    back = F.when(F.weekday(day) == 0, 3).when(F.weekday(day) == 6, 2).otherwise(1)
    return F.date_sub(day, back)


def is_settled(day: Column, today: Column) -> Column:
    return day < business_day_before(today)


def days_to_read(spark: SparkSession, first: str, today: str, held: DataFrame) -> DataFrame:
    """Business days from first to today that are not settled, or not among the days of held."""
    line = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(today).cast("date"))).alias("day")).where(F.weekday("day") < 5)
    open_days = line.where(~is_settled(F.col("day"), F.lit(today).cast("date")))
    return open_days.unionByName(line.join(held.select("day").distinct(), "day", "left_anti")).distinct()


class GrowingIndex:
    """Entries of a daily index in a table partitioned by day, under a path that all executors see.

    The high-water mark is the table itself: a day's folder. A day that was read and had no entry
    leaves a row of nulls, so that it is known to have been read. A day whose reading fails keeps what
    it had.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        """schema: of an entry, without its day."""
        self.spark, self.path, self.schema = spark, path, schema

    def held(self) -> DataFrame:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        fs = hadoop.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        kind = f"{self.schema}, __entry boolean, day date"
        if not (fs.globStatus(hadoop.Path(f"{self.path}/day=*")) or []):
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(self.path)

    def entries(self) -> DataFrame:
        return self.held().where("__entry").drop("__entry")

    def refresh(self, first: str, today: str, read: Callable[[list[dt.date]], DataFrame | None]) -> list[dt.date]:
        """Reads what is due and gives its days; read(days) returns rows of the schema with a day, or None if it can't be read now. Days are few: a row a business day."""
        due = sorted(r["day"] for r in days_to_read(self.spark, first, today, self.held()).collect())
        rows = read(due) if due else None
        if rows is None:
            return []
        names = [c.strip().split()[0] for c in self.schema.split(",")]
        marks = self.spark.createDataFrame([(d,) for d in due], "day date")
        known = rows.select(*names, F.lit(True).alias("__entry"), F.col("day").cast("date").alias("day")).join(F.broadcast(marks), "day", "left_semi")
        empty = marks.join(known.select("day").distinct(), "day", "left_anti").select(*[F.lit(None).cast(c.strip().split(" ", 1)[1]).alias(n) for c, n in zip(self.schema.split(","), names)], F.lit(False).alias("__entry"), "day")
        told = known.unionByName(empty)
        told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path)
        return due


def unsettled_batches(index: GrowingIndex, stream: DataFrame, today: Callable[[], str], first: str, checkpoint: str):  # noqa: ANN201
    """A streaming query that takes a stream of index files' rows (entry columns and day) and keeps the table up to date.

    Each batch holds whole days, as files of a day are replaced as a whole. Rows of settled days that
    are already held are left out, so that a file that comes again late changes nothing; all others
    replace their day.
    """

    def take(batch: DataFrame, _: int) -> None:
        due = {r["day"] for r in days_to_read(index.spark, first, today(), index.held()).collect()}
        seen = sorted(r["day"] for r in batch.select(F.col("day").cast("date").alias("day")).distinct().collect() if r["day"] in due)
        if seen:
            names = [c.strip().split()[0] for c in index.schema.split(",")]
            rows = batch.select(*names, F.lit(True).alias("__entry"), F.col("day").cast("date").alias("day")).where(F.col("day").isin(seen))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(index.path)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def recent_trades(entries: DataFrame, trades: DataFrame, today: str, days: int = 45) -> DataFrame:
    """Open-market trades (code P or S) of officers and directors from filings of the last `days` days: each trade once.

    entries: file, day. trades: file, symbol, owner, is_officer, is_director, trans_date, code, shares, price.
    """
    near = entries.where(F.col("day").between(F.date_sub(F.lit(today).cast("date"), days), F.lit(today).cast("date"))).select("file", F.col("day").alias("filing_date")).distinct()
    rows = trades.join(near, "file").withColumn("value", F.col("shares") * F.col("price"))
    kept = rows.where(F.col("code").isin("P", "S") & (F.col("is_officer") | F.col("is_director")) & (F.col("value") > 0))
    keys = ["symbol", "owner", "trans_date", "code", "shares", "price"]
    return kept.groupBy(*keys).agg(F.min("filing_date").alias("filing_date"), F.min("value").alias("value"), F.bool_or("is_officer").alias("is_officer"), F.bool_or("is_director").alias("is_director"))
