"""The queries of the text operators, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, convnet, decontaminate, html_text, language, line_dedup, mixing, near_dup, rules, secrets, sharding, substrings, tries
from .common import table


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), weight=mixing.by_length())
    return mixed.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_pass_join_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op3_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratios = secrets.train(secrets.random_samples(spark).unionByName(secrets.ordinary_samples(docs)).unionByName(secrets.identifier_samples(spark)))
    found = secrets.scan(docs, ratios)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"),
        secrets.listed(F.array_sort(F.concat("base", "extra"))).alias("spans"), F.size("extra").cast("long").alias("n_markov"),
    )


def op6_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = rules.assess(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rated.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("quality") >= 0.5)).alias("kept"), "quality",
    )


def op7_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(language.crc_of_id(3) != 1))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (language.crc_of_id(3) == 1).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op10_byte_convnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    net = convnet.fit(docs, labels.where(language.crc_of_id(5) != 0))
    scored = convnet.classify(docs, net)
    return scored.select("doc_id", (language.crc_of_id(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_louds_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_fm_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.drop_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_hamerly_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))
    if found is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    return found.vectors.select(
        "vec_id", "cluster", "distance", centroids.by_cluster([F.lit(x).cast("long") for x in found.inertia]).alias("cluster_inertia"),
        F.lit(sum(found.inertia)).cast("long").alias("inertia"), centroids.by_cluster([F.lit(x) for x in digests]).alias("centroid_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_pass_join_lines": op2_pass_join_lines,
    "op3_tag_paths": op3_tag_paths,
    "op4_minimax_shards": op4_minimax_shards,
    "op5_markov_secrets": op5_markov_secrets,
    "op6_weak_supervision": op6_weak_supervision,
    "op7_cgk_decontamination": op7_cgk_decontamination,
    "op8_odd_sketch_dedup": op8_odd_sketch_dedup,
    "op9_ppm_language": op9_ppm_language,
    "op10_byte_convnet": op10_byte_convnet,
    "op11_louds_tries": op11_louds_tries,
    "op12_fm_substrings": op12_fm_substrings,
    "op13_hamerly_centroids": op13_hamerly_centroids,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The other queries' methods (hash families, trained models, edit joins, folds) have no SQL; tests hold them against plain Python.
ORACLES: dict[str, str] = {
    "op8_odd_sketch_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
e AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
l AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS d, doc_id AS o FROM documents UNION SELECT r.d, l.b FROM r JOIN l ON l.a = r.o),
c AS (SELECT d, min(o) AS component_id FROM r GROUP BY d)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON c.d = s.doc_id""",
}


def _centroid_rounds(rounds: int = centroids.ROUNDS) -> str:
    """The rounds of op13 written out, an assignment and a replacement each."""
    near = lambda r: f"""a{r} AS MATERIALIZED (SELECT k.rid, any_value(k.vec_id) AS vec_id, any_value(k.v) AS v, min(struct_pack(d := list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.c[i]) * (k.v[i] - c.c[i]))), j := c.j)) AS b FROM k, c{r} c GROUP BY k.rid)"""
    step = lambda r: f"""s{r} AS (SELECT a.b.j AS j, i, sum(a.v[i]) AS s, count(*) AS n FROM a{r} a, range(1, 65) AS g(i) GROUP BY a.b.j, i),
c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{r} GROUP BY j) m ON m.j = c.j)"""  # noqa: E731
    parts = [near(0)]
    for r in range(rounds):
        parts += [step(r), near(r + 1)]
    return f"""WITH k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v AS c FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, v FROM k ORDER BY h, v LIMIT 8)),
{", ".join(parts)}
SELECT vec_id, CAST(a.b.j AS INTEGER) AS cluster, CAST(a.b.d AS BIGINT) AS distance, CAST(sum(a.b.d) OVER (PARTITION BY a.b.j) AS BIGINT) AS cluster_inertia, CAST(sum(a.b.d) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.j = a.b.j"""


ORACLES["op13_hamerly_centroids"] = _centroid_rounds()

_CRC_BIT = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
_CRC = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: {_CRC_BIT})), 4294967295)"

ORACLES["op11_louds_tries"] = f"""WITH own AS MATERIALIZED (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l, {_CRC} % 9 AS h FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
built AS MATERIALIZED (SELECT o.conv_id, list_concat(coalesce(b.l[1:o.h], []), o.l[o.h + 1:]) AS l FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
step AS MATERIALIZED (SELECT conv_id, len(l) AS n, d, md5(CAST(to_json(l[1:d]) AS VARCHAR)) AS k, CASE WHEN d > 0 THEN md5(CAST(to_json(l[1:d - 1]) AS VARCHAR)) END AS p, CASE WHEN d > 0 THEN strlen(l[d].t) ELSE 0 END AS b FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM built)),
node AS MATERIALIZED (SELECT d, k, any_value(p) AS p, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(b) AS saved, coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (n = d), '') AS ends FROM step GROUP BY d, k),
kids AS (SELECT d - 1 AS d, p AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY d, p),
told AS MATERIALIZED (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (d, k)),
sums AS (SELECT s.d, s.k, sum(t.saved) AS saved, count(*) FILTER (t.n_children = 0) AS leaves FROM told t JOIN step s ON s.conv_id = t.conv_id AND s.d <= t.d GROUP BY s.d, s.k)
SELECT t.conv_id, CAST(t.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, t.n_convs, CAST(t.n_children AS BIGINT) AS n_children, CAST(sums.leaves AS BIGINT) AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(t.ends) AS ends_sha256
FROM told t JOIN sums USING (d, k) LEFT JOIN node u ON u.d = t.d - 1 AND u.k = t.p"""

ORACLES["op12_fm_substrings"] = """WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM win JOIN least USING (h) WHERE m < doc_id),
word AS (SELECT doc_id, i, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""
