"""Sharding by a minimax contiguous partition.

Rows of equal text form one atomic group. Groups stand in one fixed order, and a shard is a run
of that order, so a partition is given by its cuts. The best cuts are those of the smallest
capacity at which a greedy filling needs no more than the wanted number of shards; that capacity
is found by binary search.

The order can hold billions of groups, so the search never sees them all. Groups of at least one
part in `atoms` of all bytes come first, each an atom of its own (there can be no more than
`atoms` of them); the others follow by hash, gathered into `atoms` ranges of the hash. The search
runs over these atoms. Only ranges in which a cut of some capacity that is still possible may
fall are then divided further by more bits of the hash, until each such range is one group. The
driver holds no more than about three times `atoms` numbers in any round.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, join_small

#: Bits of the hash that orders the groups.
BITS = 60
#: What a row costs besides its text.
ROW_BYTES = 8


def order_hash(text: Column) -> Column:
    """60 bits of the text's MD5; null has its own value, the hash of no text at all."""
    return F.conv(F.substring(F.md5(F.coalesce(F.concat(F.lit("t"), text), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def ends(prefix: list[int], capacity: int, shards: int) -> list[int] | None:
    """Greedy filling: for each shard the number of atoms in it and before it, or None if they don't fit."""
    out, at, n = [], 0, len(prefix) - 1
    for _ in range(shards):
        at = bisect_right(prefix, prefix[at] + capacity, lo=at) - 1
        out.append(at)
        if at == n:
            return out + [n] * (shards - len(out))
    return None


def smallest_capacity(prefix: list[int], shards: int, low: int, high: int) -> int:
    while low < high:
        mid = (low + high) // 2
        if ends(prefix, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def plan_cuts(groups: DataFrame, shards: int, atoms: int) -> tuple[list[int], int, list[int]]:
    """Cuts in the order key, the capacity, and the hashes of the heavy groups.

    groups: a row for each hash h with its bytes. A heavy group's order key is its hash less
    2^BITS, so that heavy groups come first.
    """
    total, largest, n = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0)), F.count("*")).first()
    if not n:
        return [], 0, []
    heavy_from = max(1, -(-total // atoms))
    heavy = sorted((r.h, r.bytes) for r in groups.where(F.col("bytes") >= heavy_from).select("h", "bytes").collect())
    light = groups.where(F.col("bytes") < heavy_from)
    bits = max(1, atoms.bit_length() - 1)

    def gathered(df: DataFrame, to_bits: int) -> list[list[int]]:
        at = F.shiftrightunsigned("h", BITS - to_bits)
        found = df.groupBy(at.alias("at")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"), F.min("h").alias("first")).collect()
        return sorted([r["first"], r.b, r.n, r.at, to_bits] for r in found)

    #: first order key, bytes, groups, prefix of the hash, its bits
    row = [[h - (1 << BITS), b, 1, h, BITS] for h, b in heavy] + gathered(light, bits)
    while True:
        prefix = [0, *accumulate(r[1] for r in row)]
        low = max(largest, -(-total // shards))
        high = smallest_capacity(prefix, shards, low, max(low, max(r[1] for r in row) + -(-total // shards)))
        # where the i-th cut may fall: between greedy fillings that lose, and that gain, all of the range at a cut
        unsure, early, late = set(), 0, 0
        if any(r[2] > 1 for r in row):
            for _ in range(shards - 1):
                a = bisect_right(prefix, early + low) - 1
                b = min(bisect_right(prefix, late + high), len(row))
                unsure.update(i for i in range(a, b) if row[i][2] > 1)
                early, late = prefix[min(a, len(row))], min(total, late + high)
        if not unsure:
            return [row[i][0] if i < len(row) else 1 << BITS for i in ends(prefix, high, shards)[:-1]], high, [h for h, _ in heavy]
        # a range is divided as finely as the driver's bound allows; the rest of the windows waits for the next round
        chosen = sorted(unsure)[:atoms]
        finer = min(BITS, max(row[i][4] for i in chosen) + max(1, (atoms // len(chosen)).bit_length() - 1))
        spans = groups.sparkSession.createDataFrame([(row[i][3], row[i][4]) for i in chosen], "p long, bits int")
        inside = None
        for k in {row[i][4] for i in chosen}:
            part = light.withColumn("p", F.shiftrightunsigned("h", BITS - k)).join(F.broadcast(spans.where(F.col("bits") == k).select("p")), "p", "left_semi").drop("p")
            inside = part if inside is None else inside.unionByName(part)
        gone = set(chosen)
        row = sorted([r for i, r in enumerate(row) if i not in gone] + gathered(inside, finer))


def assign_shards(docs: DataFrame, shards: int = 24, atoms: int = 1 << 14, rows_a_slot_block: int = 50_000) -> DataFrame:
    """Each row's shard and slot under the law `bytes`: near equal sizes, equal texts together.

    docs needs doc_id and text; other columns are left out. Returns doc_id, size (UTF-8 bytes and
    ROW_BYTES), text_crc32, law, shard, slot and grown_shard (null under this law). A null text
    has no bytes and the CRC of an empty text, but is a group apart from empty texts. Repeated
    rows keep a slot each. An empty table gives no rows. The largest shard is as small as any cut
    of the order allows; where one group holds more than its share, that group sets the size.
    Slots count from 0 without gaps: by block of a hash of the row, then doc_id.
    """
    text = F.col("text")
    narrow = cut(docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        order_hash(text).alias("h"),
    ))
    groups = cut(narrow.groupBy("h").agg(F.sum("size").alias("bytes")))
    cuts, _, heavy = plan_cuts(groups, shards, atoms)
    spark = docs.sparkSession
    key = F.col("h")
    placed = narrow
    if heavy:
        first = spark.createDataFrame([(h,) for h in heavy], "h long").withColumn("heavy", F.lit(True))
        placed = narrow.join(F.broadcast(first), "h", "left")
        key = F.when(F.col("heavy"), F.col("h") - F.lit(1 << BITS)).otherwise(F.col("h"))
    passed = F.lit(0)
    for c in cuts:
        passed = passed + F.when(key >= F.lit(c), 1).otherwise(0)
    rows = narrow.count()
    blocks = max(1, -(-rows // (shards * rows_a_slot_block)))
    block = F.pmod(F.xxhash64("doc_id", "h"), F.lit(blocks)).cast("int")
    placed = placed.select("doc_id", "size", "text_crc32", passed.cast("int").alias("shard"), block.alias("block"))
    before = placed.groupBy("shard", "block").agg(F.count("*").alias("n")).withColumn(
        "offset", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("n")
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size")) - 1
    numbered = join_small(placed.withColumn("inside", inside), before, ["shard", "block"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("inside") + F.col("offset")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
