"""Results as files: tables in a format of choice, and a study's folder with a description of how it was made."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def flat(df: DataFrame) -> DataFrame:
    """df with arrays, maps and structs as JSON text, for formats that have none."""
    return df.select(*[F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else F.col(f.name) for f in df.schema.fields])


def save_table(df: DataFrame, path: str, kind: str = "parquet", files: int | None = None) -> None:
    """Writes a table as csv (with a header), json (a row a line) or parquet, in place of what is there; in so many files, if that is given for a small one."""
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"unknown kind {kind!r}")
    out = flat(df) if kind == "csv" else df
    out = out if files is None else out.coalesce(files)
    writer = out.write.mode("overwrite")
    (writer.option("header", True).csv if kind == "csv" else writer.json if kind == "json" else writer.parquet)(path)


def save_study(folder: str, tables: dict[str, DataFrame], meta: dict[str, object], kind: str = "parquet") -> None:
    """A study's tables, each in a folder of its name, and meta (one line of JSON), which is written last: with it the study is whole."""
    if not tables:
        raise ValueError("a study has a table at least")
    for name, df in tables.items():
        save_table(df, f"{folder}/{name}", kind)
    spark = next(iter(tables.values())).sparkSession
    told = {**meta, "tables": {name: df.columns for name, df in tables.items()}, "kind": kind}
    spark.createDataFrame([(json.dumps(told, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta")


def load_study(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict[str, object]]:
    meta = json.loads(spark.read.text(f"{folder}/meta").first()["value"])
    read = {"csv": lambda p: spark.read.option("header", True).csv(p), "json": spark.read.json, "parquet": spark.read.parquet}[meta["kind"]]
    return {name: read(f"{folder}/{name}") for name in meta["tables"]}, meta


def result_view(matches: DataFrame) -> DataFrame:
    """matches as a flat table: their own columns, the first and last of their points, and their metrics as JSON."""
    at = lambda k, f: F.try_element_at("points", F.lit(k))[f]
    keep = [c for c in matches.columns if c not in ("points", "metrics")]
    return matches.select(*keep, F.size("points").alias("n_points"), at(1, "idx").alias("first_idx"), at(1, "price").alias("first_price"), at(-1, "idx").alias("last_idx"), at(-1, "price").alias("last_price"), F.to_json("metrics").alias("metrics"))
