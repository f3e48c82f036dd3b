"""The pipeline's stages against plain Python, and models on held-out rows."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import decontaminate, mixing, registry
from barloom.llm.tokens import find_words

from .test_exact import changed, near_brute, text, water

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(3)
    bench = [text(rng, rng.randint(15, 30)) for _ in range(6)]
    base = [text(rng, rng.randint(20, 90)) for _ in range(60)]
    texts = base + [" ".join(changed(rng, t.split(), 1)) for t in base[:15]] + base[:10]
    texts += [text(rng, 20) + " " + " ".join(changed(rng, b.split(), 2)) + " " + text(rng, 20) for b in bench]
    texts += ["12 345 !!!", "", None]
    rows = [(i + 1, t, "xx", rng.choice(["a", "a", "a", "b", "c", None]), len(t or "")) for i, t in enumerate(texts)]
    sf = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, rows, bench


def test_stages(spark, tables):
    sf, rows, bench = tables
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.cut(stage(spark, docs, sf))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns and out.schema == docs.schema
        kept[name], docs = out.collect(), out
    text_of = {r[0]: r[1] for r in rows}
    ids = {k: [r["doc_id"] for r in v] for k, v in kept.items()}
    assert sorted(ids["language"]) == [d for d, t in text_of.items() if any(map(str.isalpha, t or ""))]

    parts = near_brute([(d, text_of[d]) for d in ids["language"]])
    assert sorted(ids["near_duplicates"]) == sorted(d for d, (_, c) in parts.items() if c == d)

    words = lambda t: find_words([decontaminate.plain(t.encode())], lower=True).hash
    hit = {d for d in ids["near_duplicates"] for b in bench if decontaminate.edit_distance(words(b), words(text_of[d]))[0] <= int(0.2 * len(words(b)))}
    assert hit and sorted(ids["decontamination"]) == sorted(set(ids["near_duplicates"]) - hit)

    copies = Counter(ids["mixing"])
    assert set(copies) <= set(ids["decontamination"]) and max(copies.values()) <= 3
    assert copies == Counter({r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame([r for r in kept["decontamination"]], docs_schema()), weight=mixing.by_length()).collect()})

    shards = kept["sharding"]
    assert Counter(ids["sharding"]) == copies
    for s in {r["shard"] for r in shards}:
        assert sorted(r["slot"] for r in shards if r["shard"] == s) == list(range(sum(r["shard"] == s for r in shards)))
    assert len({(r["doc_id"], r["shard"]) for r in shards}) == len(copies)


def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_with_null_and_shared_ids(spark, tables):
    """Decisions hold for the row that they were made on: not only for rows with an id, and not for all that share one."""
    sf, _, bench = tables
    rng = random.Random(8)
    one, two, three, four, five = (text(rng, 60) for _ in range(5))
    near = " ".join(changed(rng, one.split(), 1))
    rows = [(-7, one), (3, one), (None, one), (None, near), (2, near), (2, two), (None, three), (None, three), (None, "  "), (None, None), (None, None), (4, four), (4, bench[0]), (None, five), (None, bench[1]), (12, two)]
    docs = spark.createDataFrame([(d, t, "xx", "a", 0) for d, t in rows], docs_schema())
    key = lambda r: (str(r[0]), str(r[1]))
    told = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=key)
    apart = corpus_pipeline.cut(corpus_pipeline.drop_near_duplicates(spark, docs, sf))
    assert apart.schema == docs.schema
    want = [(-7, one), (2, two), (None, three), (None, "  "), (None, None), (None, None), (4, four), (4, bench[0]), (None, five), (None, bench[1])]
    assert told(apart) == sorted(want, key=key)
    assert told(corpus_pipeline.decontaminate_benchmark(spark, apart, sf)) == sorted((r for r in want if r[1] not in bench), key=key)


def test_keys_sort_like_ids(spark):
    docs = spark.createDataFrame([(d, "x") for d in (-(1 << 63), -10, -9, 0, 2, 10, (1 << 63) - 1, None)], "doc_id long, text string")
    keys = [r[0] for r in docs.select(corpus_pipeline.row_key(docs)).collect()]
    assert None not in keys and keys == sorted(set(keys))


def test_run_gives_the_last_stage(spark, tables):
    rows = corpus_pipeline.run(spark, tables[0])
    assert rows.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and rows.count() > 0


def test_mix_takes_what_ranks_say(spark):
    """Against the rule in plain Python: lowest ranks that fit, then smaller documents of higher rank, at last one of which half fits."""
    rng = random.Random(14)
    docs = [(i, " ".join("w" for _ in range(rng.randint(1, 120))), rng.choice("ab")) for i in range(160)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["copies"] for r in mixing.mix(frame).collect()}
    u = {r["doc_id"]: r["u"] for r in mixing.with_rank(frame, 7, None).collect()}
    size = {i: len(t.split()) for i, t, _ in docs}
    names = sorted({s for *_, s in docs})
    total = [sum(size[i] for i, _, s in docs if s == n) for n in names]
    want = {}
    states = []
    for n, target, whole in zip(names, water(total, [5, 2, 1][: len(names)]), total):
        sure, p = int(target / whole), target / whole - int(target / whole)
        own = [i for i, _, s in docs if s == n]
        want.update({i: sure for i in own})
        rank = {i: (o := u[i] / (1 - u[i]) / (p / (1 - p))) / (1 + o) for i in own} if p > 0 else {}
        states.append({"rank": sorted(rank, key=rank.get), "after": 0, "most": 10**9, "wanted": target - sure * whole, "target": target})
    half = False
    while True:
        took = False
        for s in states:
            run, last, got_words = 0, s["after"], 0
            for place, i in enumerate(s["rank"]):
                if place < s["after"] or size[i] > s["most"]:
                    continue
                if run + size[i] / (2 if half else 1) <= s["wanted"]:
                    want[i] += 1
                    last, got_words = place + 1, run + size[i]
                elif run > s["wanted"] or run + size[i] > s["wanted"]:
                    break
                run += size[i]
            took = took or last > s["after"]
            s["after"], s["wanted"] = last, s["wanted"] - got_words
            s["most"] = min(s["most"], int(s["wanted"] // 1))
        if half or all(s["wanted"] <= 0.0005 * s["target"] for s in states):
            break
        if not took:
            half = True
            for s in states:
                s["most"] = int(2 * max(0, s["wanted"]))
    assert got == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_held_out_languages_and_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = registry.op9_ppm_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    scored = registry.op10_byte_convnet(spark, SF).join(labels, "doc_id").where("held_out").select("quality", "predicted").collect()
    assert sum(r["quality"] == r["predicted"] for r in scored) / len(scored) > 0.93
    assert all(r["predicted"] for r in scored if r["quality"] == 1 and r["predicted"] is None) and sum(r["quality"] == 1 and not r["predicted"] for r in scored) <= 0.03 * len(scored)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_rules_keep_good_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("good"))
    rows = registry.op6_weak_supervision(spark, SF).join(labels, "doc_id").where("NOT base_failed").collect()
    good, bad = [r["kept"] for r in rows if r["good"]], [r["kept"] for r in rows if not r["good"]]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.1
