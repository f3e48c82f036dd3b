"""Many languages, and tables that a failed job leaves."""

import os
import random

import pytest
from pyspark.sql import functions as F

from barloom.llm import common, language


def test_many_languages(spark):
    """Each has an alphabet of its own choice; families of four hold their counts."""
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{i:03d}": rng.sample(letters, 6) for i in range(90)}
    text = lambda k: " ".join("".join(rng.choice(own[k]) for _ in range(rng.randrange(3, 8))) for _ in range(40))
    rows = [(i * 100 + j, text(k), k) for i, k in enumerate(own) for j in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(4)
    model = language.fit(df.where("doc_id % 100 < 3"))
    assert model.langs == sorted(own) and max(len(p.langs) for p in model.parts) == language.FAMILY
    held = language.identify(df.where("doc_id % 100 = 3"), model)
    assert held.where(F.col("lang_pred") == F.col("lang")).count() >= 85


def test_a_failed_job_leaves_no_tables(spark):
    folder = common.checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with pytest.raises(ValueError), common.scratch() as keep:
        keep.append(common.cut(spark.range(3).toDF("x")))
        common.cut(spark.range(4).toDF("x"))
        raise ValueError
    assert set(os.listdir(folder)) <= before | {f for f in os.listdir(folder) if not f.startswith("cut-")}
