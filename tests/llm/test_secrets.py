"""Secret scans: cost of long tokens and of many matches, and alarms on identifiers that no sample holds."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from barloom.llm import secrets as S


@pytest.fixture(scope="module")
def ratios(spark):
    """Half of the vocabulary teaches; the other half is asked for."""
    words = spark.createDataFrame([(i, "the river and the mountain were seen from an old house near the harbour in winter") for i in range(50)], "doc_id int, text string")
    return S.train(S.random_samples(spark, 800).unionByName(S.ordinary_samples(words)).unionByName(S.identifier_samples(spark, 4000, S.VOCABULARY[::2])))


def found(df, ratios):
    return {r["doc_id"]: [r["text"][x["start"] : x["end"]] for x in r["extra"]] for r in S.scan(df, ratios).collect()}


def test_random_strings_of_every_kind_and_held_out_identifiers(spark, ratios):
    rng = random.Random(5)
    secrets = [(i, "".join(rng.choice(S.RANDOM[k]) for _ in range(rng.choice([12, 13, 14, 16, 20, 28])))) for i, k in enumerate(list(S.RANDOM) * 40)]
    secrets = [(i, t) for i, t in secrets if re.search("[A-Za-z]", t)]
    got = found(spark.createDataFrame(secrets, "doc_id int, text string"), ratios)
    assert sum(got[i] == [t] for i, t in secrets) >= 0.95 * len(secrets)
    held = S.identifier_samples(spark, 4000, S.VOCABULARY[1::2], seed=9).where(F.length("token") >= 12).withColumn("doc_id", F.monotonically_increasing_id()).select("doc_id", F.col("token").alias("text"))
    told = found(held, ratios)
    assert len(told) > 2500 and sum(map(bool, told.values())) <= 0.025 * len(told)  # of words that were not taught; half the vocabulary teaches


def test_names_from_elsewhere(spark, ratios):
    names = [
        "get_user_profile_by_id", "MAX_CONNECTION_TIMEOUT", "AbstractSingletonProxyFactoryBean", "org-springframework-context", "/usr/local/share/applications", "covid-19-vaccination-rates", "getElementsByClassName",
        "2024-01-15T12", "ISBN-978-3-16-148410-0", "internationalization", "SELECT_FROM_WHERE", "/etc/nginx/sites-available", "README_CONTRIBUTING_GUIDE", "Donaudampfschifffahrtsgesellschaft",
    ]
    got = found(spark.createDataFrame(list(enumerate(names)), "doc_id int, text string"), ratios)
    assert sum(map(bool, got.values())) <= 1


def test_a_long_token_costs_in_proportion(spark, ratios):
    rng = random.Random(1)
    took = []
    for n in (1000, 100_000, 1_000_000):
        df = spark.createDataFrame([(1, "x " + "".join(rng.choice(S.RANDOM["base 64"]) for _ in range(n)) + " y")], "doc_id int, text string")
        began = time.time()
        rows = S.scan(df, ratios).select("extra").collect()
        took.append(time.time() - began)
        assert [(x["start"], x["end"]) for x in rows[0]["extra"]] == [(2, n + 2)]
    assert took[2] < 30 and took[2] - took[0] < 25 * max(0.4, took[1] - took[0])


def test_many_matches_in_parts(spark, ratios):
    text = " ".join(f"token=abcdefgh{i:07d} é" for i in range(3000))
    rows = S.scan(spark.createDataFrame([(1, text)], "doc_id int, text string"), ratios).collect()
    want = [(m.start(), m.end()) for m in re.finditer(S.PATTERNS["assign"].replace("(?i)", "").replace("((?:", "(?:(?:"), text)]
    assert [(x["start"], x["end"]) for x in rows[0]["base"]] == want and len(want) == 3000
