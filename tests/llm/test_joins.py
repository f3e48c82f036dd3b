"""The join with a small table, when that is not small."""

import pytest
from pyspark.sql import functions as F

from barloom.llm import common, line_dedup, near_dup


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("salts", [1, 32])
def test_a_long_side_is_shuffled_and_gives_the_same_rows(spark, monkeypatch, how, salts):
    left = spark.range(2000).select(F.when(F.col("id") % 11 > 0, F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id"))).alias("k"), F.lit(1).alias("x"))
    small = spark.range(0, 500, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("y")).unionByName(spark.sql("SELECT CAST(NULL AS LONG) AS k, 5L AS y UNION ALL SELECT 7L, 6L"))
    told = rows(common.join_small(left, small, ["k"], how))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    far = common.join_small(left, small, ["k"], how, salts)
    assert rows(far) == told and len(told) > 1000
    assert "Broadcast" not in far._jdf.queryExecution().executedPlan().toString()


def test_a_repeated_row_is_spread_over_salts(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    left = spark.range(0, 64, 1, 64).select(F.lit(7).cast("long").alias("k"), F.lit(1).alias("x"))
    far = common.join_small(left, spark.sql("SELECT 7L AS k, 6L AS y"), ["k"])
    assert far.count() == 64 and far.where("y = 6").count() == 64


def test_dedup_gives_the_same_rows_beyond_the_broadcast(spark, monkeypatch):
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    texts = [(i, f"{' '.join(words[i % 4 :])} tail\nline number {i % 5} of a text\n") for i in range(24)]
    docs = spark.createDataFrame([*texts, (100, None), (None, texts[3][1])], "doc_id long, text string")
    want = rows(near_dup.near_duplicates(docs)), rows(line_dedup.dedup_report(docs))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert (rows(near_dup.near_duplicates(docs)), rows(line_dedup.dedup_report(docs))) == want
