"""From raw documents to shards: five stages, each one operator of barloom.llm.

Each stage works on all that the one before it kept, and its rows are written as Parquet and read
again by the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from barloom.llm import decontaminate, language, mixing, near_dup, sharding
from barloom.llm.common import cut, join_small, release, scratch, table

#: A text whose shortest code is longer than its bytes and SPARE_BITS is of no known language; a key or a number in a short text costs some.
MOST_BITS_PER_BYTE, SPARE_BITS = 8.0, 64.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the labelled ones teach. Rejected: null texts, texts without a letter, and those that no model codes in about as few bits as they have."""
    model = language.fit(docs)
    found = language.identify(docs.select(*[F.col(c).alias(f"{c}__own") if c in ("score", "lang_pred", "bits_per_byte") else F.col(c) for c in docs.columns]), model)
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & ((F.col("bits_per_byte") - MOST_BITS_PER_BYTE) * F.octet_length("text") < SPARE_BITS))
    return kept.select(*[F.col(f"{c}__own").alias(c) if c in ("score", "lang_pred", "bits_per_byte") else F.col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id, null coming last.

    Documents without a doc_id that have the same text share their key, so one of them is left.
    """
    dropped = near_dup.near_duplicates(keyed(docs)).where(~F.col("kept"))
    left = without(docs, dropped)
    nameless = left.where(F.col("doc_id").isNull() & F.col("text").isNotNull())
    one = nameless.groupBy(row_key(docs).alias("__key")).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")).select("row.*")
    return left.where(F.col("doc_id").isNotNull() | F.col("text").isNull()).unionByName(one)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, exactly or with few edits."""
    return without(docs, decontaminate.contaminated(keyed(docs), table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source"), weight=mixing.by_length())
    return mixed.where(F.col("copies") > 0).select("row.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("__copy")).drop("__copy")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row."""
    return sharding.assign_shards(docs)


def row_key(docs: DataFrame) -> Column:
    """A text of doc_id and a hash of the row's text that is never null and sorts like doc_id, nulls last.

    Numbers are padded, so that they sort as text; other kinds sort as their texts do.
    """
    own = F.col("doc_id")
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        own = F.lpad((own.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.concat(F.coalesce(F.concat(F.lit("0"), own.cast("string")), F.lit("1")), F.lit("\0"), F.coalesce(F.md5("text"), F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with the row's key as doc_id, which tells rows with a null or shared doc_id apart."""
    return docs.select(row_key(docs).alias("doc_id"), "text")


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs less the rows whose key is among the doc_ids of dropped; dropped ones are broadcast only if few."""
    told = cut(dropped.select(F.col("doc_id").alias("__key")).distinct().withColumn("__gone", F.lit(True)))
    return join_small(docs.withColumn("__key", row_key(docs)), told, ["__key"], salts=1).where(F.col("__gone").isNull()).select(*docs.columns)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The language models and the hash families of the stages can't be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is deleted when the next one's is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch() as keep:
            before, docs = docs, cut(stage(spark, docs, sf_dir))
            keep.append(docs)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
