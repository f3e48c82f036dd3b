"""Some registered queries against their SQL, on the smallest tables."""

import datetime
import math
import os

import pytest

SF = "/root/testdata/sf0.001"
NAMES = ["bars_daily", "bars_weekly", "context_126_200", "rally_combined", "doji_on_ma10", "news_gap_events", "sma_cross_study", "condition_study", "vol_managed", "tpsl_trades", "journal_mtm", "insider_clusters", "growth_rank_score", "leadlag_bh", "macd_touch", "price_context", "pattern_events", "pattern_trades", "structure_outcomes", "hindsight_match", "rally_live", "candle_control", "journal_verdicts", "rolling_correlation"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, datetime.datetime):
        return v.date()
    return v


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    import duckdb

    import __spark_entry__

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    found = __spark_entry__.queries()[name](spark, SF)
    cols = sorted(found.columns)
    rel = con.sql(__spark_entry__.oracle_sql()[name])
    assert cols == sorted(rel.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted((tuple(plain(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()), key=key)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in found.collect()), key=key) == want


def test_every_oracle_has_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[:2] == ["period", "h"]
