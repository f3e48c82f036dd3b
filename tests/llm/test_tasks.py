"""Small tables are worked through in few tasks, however many partitions a shuffle has."""

import random

import pytest

from barloom.llm import components, line_dedup


@pytest.fixture
def many_partitions(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in held.items():
        spark.conf.set(k, v)


def test_few_links_take_few_tasks(many_partitions):
    spark, sc = many_partitions, many_partitions.sparkContext
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 7), (7, 3)], "a long, b long").coalesce(1)
    sc.setJobGroup("few links", "components")
    try:
        got = {r["node"]: r["component"] for r in components.components(links).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    told = sc.statusTracker()
    n_tasks = sum(told.getStageInfo(s).numCompletedTasks for j in told.getJobIdsForGroup("few links") for s in told.getJobInfo(j).stageIds if told.getStageInfo(s))
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 9: 1, 4: 4, 5: 4}
    assert 0 < n_tasks < 24


def test_few_and_many_links_have_the_same_components(spark, monkeypatch):
    rng = random.Random(6)
    for n_nodes, n_links in ((40, 30), (200, 150), (30, 0)):
        links = spark.createDataFrame([(rng.randrange(n_nodes), rng.randrange(n_nodes)) for _ in range(n_links)] + [(i, i + 1) for i in range(300, 300 + n_links)], "a long, b long")
        told = []
        for few in (10_000, 0):
            monkeypatch.setattr(components, "FEW_LINKS", few)
            told.append(sorted(map(tuple, components.components(links).collect())))
        assert told[0] == told[1] and bool(told[0]) == bool(n_links)


def test_written_tables_of_few_lines_have_few_files(many_partitions, monkeypatch):
    """Tables of lines were written in a file a shuffle partition."""
    spark, sizes = many_partitions, []
    rng = random.Random(14)
    lines = ["the same words begin each line " + "".join(rng.choice("abcdefgh") for _ in range(15)) for _ in range(90)]
    lines += [x[:-1] + "z" for x in lines[:40]]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").coalesce(2)
    cut = line_dedup.cut

    def counted(df, *rows):
        out = cut(df, *rows)
        sizes.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(line_dedup, "cut", counted)
    dropped = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_report(docs).collect()}
    assert dropped == {i: int(i >= 90) for i in range(130)}
    assert sum(n > 2 for n in sizes) <= 2, sizes  # the keys of all lines, and blocks of large keys, whose number isn't known before
