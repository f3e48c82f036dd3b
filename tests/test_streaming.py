"""Streams give what their batch forms give."""

import datetime as dt

from pyspark.sql import functions as F

from barloom.operators import events as E
from barloom.streaming import jobs


def run(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)


def test_cooldown_and_signals(spark, tmp_path):
    hits = [("A", x) for x in (1, 3, 6, 20, 21, 40)] + [("B", x) for x in (5, 9, 30)]
    spark.createDataFrame(hits, "symbol string, at long").coalesce(1).write.parquet(str(tmp_path / "hits"))
    run(jobs.cooldown(spark.readStream.schema("symbol string, at long").parquet(str(tmp_path / "hits")), 5), "cool")
    want = E.cooldown(spark.createDataFrame(hits, "symbol string, at long"), ["symbol"], 5, "at")
    assert sorted(map(tuple, spark.table("cool").collect())) == sorted((r["symbol"], r["at"]) for r in want.collect())

    now = dt.datetime(2024, 1, 2)
    rows = [("r", "A", "2024-01-02", now), ("r", "A", "2024-01-02", now), ("r", "B", "2024-01-02", now)]
    spark.createDataFrame(rows, "rule string, symbol string, day string, ts timestamp").write.parquet(str(tmp_path / "signals"))
    run(jobs.new_signals(spark.readStream.schema("rule string, symbol string, day string, ts timestamp").parquet(str(tmp_path / "signals"))), "signals")
    assert spark.table("signals").count() == 2


def test_hourly_bars(spark, tmp_path):
    at = dt.datetime(2024, 1, 2, 9, 0)
    rows = [("A", at + dt.timedelta(minutes=m), float(p), 1.0) for m, p in ((0, 5), (10, 7), (59, 6), (61, 9), (600, 1))]
    spark.createDataFrame(rows, "symbol string, ts timestamp, price double, quantity double").coalesce(1).write.parquet(str(tmp_path / "t"))
    run(jobs.hourly_bars(spark.readStream.schema("symbol string, ts timestamp, price double, quantity double").parquet(str(tmp_path / "t"))), "hours", "complete")
    got = spark.table("hours").where(F.col("ts") < F.lit("2024-01-02 11:00:00")).orderBy("ts").collect()
    assert [(r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in got] == [(5.0, 7.0, 5.0, 6.0, 3.0), (9.0, 9.0, 9.0, 9.0, 1.0)]


def test_one_open_position(spark, tmp_path):
    rows = [("r", "A", 1, 5), ("r", "A", 3, 5), ("r", "A", 6, 2), ("q", "A", 3, 9), ("r", "B", 2, 1), ("r", "B", 3, 1), ("r", "A", 7, 1), ("r", "A", 8, 1)]
    kinds = "rule string, symbol string, at long, hold long"
    spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(str(tmp_path / "s"))
    run(jobs.one_open(spark.readStream.schema(kinds).parquet(str(tmp_path / "s"))), "open")
    assert sorted(tuple(r)[:3] for r in spark.table("open").collect()) == [("q", "A", 3), ("r", "A", 1), ("r", "A", 6), ("r", "A", 8), ("r", "B", 2), ("r", "B", 3)]
