"""Every operator on nulls, empty and very long texts, ties, repeated rows, extra columns and empty tables."""

import pytest
from pyspark.sql import functions as F

from barloom.llm import convnet, decontaminate, html_text, language, line_dedup, mixing, near_dup, rules, secrets, sharding

PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions"
LONG = " ".join(f"word{i % 977} token{i % 31}" for i in range(30_000))
ROWS = [
    (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, None, "en", "a"), (4, "", None, "b"), (5, " \n\t ", "de", None), (6, LONG, "en", "b"),
    (None, PROSE + " again", "en", "b"), (None, None, None, None), (7, "one two", "de", "c"), (8, "12345 !!!", "de", "c"), (9, "der hund und die katze sind im haus und der garten ist gross", "de", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    clashing = {c: F.lit(1) for c in ("size", "score", "h", "n", "sid", "shard", "base", "extra", "copies", "target", "quality", "pattern", "row", "key", "block", "rank", "u", "words", "label", "component_id", "kept")}
    return rows.withColumns(clashing)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_mixing(docs, empty):
    rows = mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies").collect()
    assert len(rows) == len(ROWS) and all(0 <= r["copies"] <= 3 for r in rows)
    assert all(r["size"] == 0 for r in rows if r["doc_id"] in (3, 4, 5))
    total = {r["source"]: r["source_size"] for r in rows}
    assert abs(sum({r["source"]: r["target"] for r in rows}.values()) - sum(total.values())) < 1e-6
    assert mixing.mix(empty).count() == 0
    assert sorted(map(str, mixing.mix(docs).select("doc_id", "copies").collect())) == sorted(map(str, mixing.mix(docs.repartition(3)).select("doc_id", "copies").collect()))


def test_sharding(docs, empty):
    rows = sharding.assign_shards(docs, shards=3).collect()
    assert len(rows) == len(ROWS)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert len({r["shard"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert {r["size"] for r in rows if r["doc_id"] == 3} == {8}
    assert sharding.assign_shards(empty).count() == 0


def test_near_duplicates(docs, empty):
    rows = near_dup.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["component_id"] for r in by[2]] == [1, 1] and not by[2][0]["kept"] and by[1][0]["kept"]
    assert by[3][0]["n_shingles"] == 0 and by[3][0]["kept"] and by[7][0]["n_shingles"] == 1
    assert {r["component_id"] for r in by[None] if r["n_shingles"]} == {1}
    assert near_dup.near_duplicates(empty).count() == 0


def test_lines(docs, empty):
    rows = line_dedup.dedup_report(docs).collect()
    assert len(rows) == len(ROWS)
    assert sorted((r["n_lines"], r["n_dropped"]) for r in rows if r["doc_id"] == 2) == [(1, 1), (1, 1)]
    assert all(r["n_lines"] == 0 for r in rows if r["doc_id"] in (3, 4, 5))
    assert line_dedup.dedup_report(empty).count() == 0


def test_language(docs, empty):
    model = language.fit(docs)
    rows = language.identify(docs, model).select("doc_id", "text", "lang_pred", "score").collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        letters = any(map(str.isalpha, r["text"] or ""))
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    assert {r["lang_pred"] for r in rows if r["doc_id"] == 9} == {"de"}
    nothing = language.fit(empty)
    assert {r["lang_pred"] for r in language.identify(docs, nothing).select("lang_pred").collect()} == {"und"}
    assert language.identify(empty, model).count() == 0


def test_convnet(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (6, 1), (8, 0), (7, 0), (None, 1), (9, None)], "doc_id long, label int")
    net = convnet.fit(docs.select("doc_id", "text"), labels, epochs=3)
    rows = convnet.classify(docs, net).select("doc_id", "score").collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert convnet.classify(empty, net).count() == 0
    blank = convnet.fit(docs.select("doc_id", "text"), labels.limit(0))
    assert {r["score"] for r in convnet.classify(docs, blank).select("score").collect()} == {0.5}


def test_rules(docs, empty):
    rows = rules.assess(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["quality"] <= 1 for r in rows)
    assert rules.assess(empty).count() == 0


def test_secrets(spark, docs, empty):
    ratios = secrets.train(secrets.random_samples(spark, 50).unionByName(secrets.ordinary_samples(docs.select("doc_id", "text"))))
    rows = secrets.scan(docs.select("doc_id", "text", "base", "extra", "key"), ratios).collect()
    assert len(rows) == len(ROWS) and all(r["base"] == [] and r["extra"] == [] for r in rows)
    assert secrets.scan(empty.select("doc_id", "text"), ratios).count() == 0
    flat = secrets.train(spark.createDataFrame([], "token string, random boolean"))
    assert set(flat.tables["random"]) == {0.0}


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(1, PROSE), (2, None), (3, ""), (4, "one two"), (5, "!!! ...")], "item_id long, text string")
    rows = decontaminate.contaminated(docs, bench).collect()
    assert sorted((str(r["doc_id"]), r["item_id"], r["edits"]) for r in rows) == [("1", 1, 0), ("2", 1, 0), ("2", 1, 0), ("7", 4, 0), ("None", 1, 0)]
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", None, 1), (2, "u", "", 1), (3, None, "<p>Hello &amp; bye.</p>", 1), (3, None, "<p>Hello &amp; bye.</p>", 1), (4, "v", "<div><p>" + "x" * 200_000, 1)], "page_id long, url string, html string, text int")
    rows = html_text.extract(pages).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in rows) == [(1, 0), (2, 0), (3, 12), (3, 12), (4, 200_000)]
    assert html_text.extract(pages.limit(0)).count() == 0
