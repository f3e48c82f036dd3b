"""Pieces that several text operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the space and the ASCII controls 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a joined side up to which it is broadcast; longer sides are joined by a salted shuffle.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Where none is set, a local session gets one of its own; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = os.path.join(tempfile.gettempdir(), "barloom-checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Rows a file of narrow tables whose number of rows is known before they are written.
FILE_ROWS = 100_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The same rows with their lineage cut, kept in the shared checkpoint folder.

    Written as Parquet, so that a lost executor costs a read and not a recomputation, and so that
    later passes read only the columns they need. A narrow table of at most `rows` rows, if that is
    given, is written in few files.
    """
    spark = df.sparkSession
    df = df if rows is None else df.coalesce(1 + rows // FILE_ROWS)
    path = f"{checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (out, path)  # holding the table keeps its id from being given to another
    return out


_PATHS: dict[int, tuple[DataFrame, str]] = {}


def release(*cuts: DataFrame | None) -> None:
    """Deletes what cut() wrote for tables that nothing will read again."""
    for df in cuts:
        held = _PATHS.pop(id(df), None)
        if held is not None:
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(held[1])
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes the tables that are cut inside when it ends, but for those put on the list it gives; all of them if it fails."""
    before, keep, held = set(_PATHS), [], set()
    try:
        yield keep
        held = {id(df) for df in keep}
    finally:
        release(*[df for key, (df, _) in list(_PATHS.items()) if key not in before and key not in held])


def bound_batches(spark: SparkSession, rows: int = 500, size: int = 1 << 22) -> None:
    """Texts can be long, so Python workers get few at a time: so many rows and, of long rows, so many bytes."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = re.fullmatch(r"(-?\d+)b?", spark.conf.get(key))
        if now and not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) from the MD5 of seed and parts: the same in any engine and on any rerun."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def join_small(left: DataFrame, small: DataFrame, keys: list[str], how: str = "left", salts: int = 32) -> DataFrame:
    """left joined with a table of a row a key, null keys being equal.

    A counted size decides: up to BROADCAST_ROWS rows small is broadcast; beyond, both are shuffled:
    the rows of a key are dealt over salts, and small is repeated once a salt. Spark's estimate of
    small knows neither the repeats nor what compression hides, so it must not choose to broadcast.
    """
    hidden = [f"__k{i}" for i in range(len(keys))]
    renamed = small.select(*[F.col(k).alias(h) for k, h in zip(keys, hidden)], *[c for c in small.columns if c not in keys])
    match = lambda a, b: [a[k].eqNullSafe(b[h]) for k, h in zip(keys, hidden)]
    if renamed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        right = F.broadcast(renamed)
        return left.join(right, match(left, right), how).drop(*hidden)
    # rows that are equal in all columns are told apart by the partition that they come from
    a = left.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in left.columns if c not in keys], F.spark_partition_id()), F.lit(salts)))
    b = renamed.withColumn("__salt_r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))).hint("merge")
    return a.join(b, [a["__salt"] == b["__salt_r"], *match(a, b)], how).drop("__salt", "__salt_r", *hidden)
