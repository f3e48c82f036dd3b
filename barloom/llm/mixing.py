"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. A document of a source is to appear r times on average, r
being its weight times a factor of the source, MOST at the most; the factor is the one with which
the expected words are the target. The document is taken floor(r) times for certain; what is left
is the probability that one more copy of it is included. These extra copies are drawn by Pareto order sampling: with u uniform in (0, 1) and p
the inclusion probability, documents are ranked by [u / (1 - u)] / [p / (1 - p)], and the lowest
ranks are taken until the words that the source still wants are filled.

Ranks are cut per source without sorting a source: words are summed over fine bins of the rank, a
running sum over at most `bins` bins finds the bin in which the source fills up, and only that
bin's ranks are looked at one by one. A long document at the edge leaves a gap, which the next
ranks that are small enough fill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, join_small, n_words, release, unit_hash

#: Most copies of a document, and most times its own size that a source may fill.
MOST = 3
#: The n-th source weighs WEIGHTS[n mod 3].
WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size -> the same with target.

    Sources share the sum of all sizes by weight. No target passes `most` times its source's size;
    what a source can't take is shared by weight among the others, again and again. The end of
    that process is known without repeating it: with sources ordered by most * size / weight, the
    first ones are full, and the others have the same words a unit of weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double"))
    full = F.lit(float(most)) * F.col("source_size")
    by_need = Window.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    level = F.try_divide(
        F.sum("source_size").over(whole) - F.coalesce(F.sum(full).over(before), F.lit(0.0)),
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    )
    # the level that holds if this source and all after it are not full: the first source that it suits
    # has the true one, and from there on it falls
    guess = weighed.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= full)
    level_true = F.max(F.when(F.col("fits"), F.col("level"))).over(whole)
    return guess.select("source", "source_size", F.least(full, F.coalesce(level_true * F.col("weight"), full)).alias("target"))


def by_length(half: float = 50.0) -> Column:
    """A weight between 0 and 1 that grows with a document's words: fragments of a few words teach little. `half` words weigh a half."""
    return F.col("size") / (F.col("size") + F.lit(float(half)))


def with_rank(docs: DataFrame, seed: int, weight: Column | None) -> DataFrame:
    """docs with size, u and weight, which is rounded to a sixteenth of an octave between 2^-32 and 2^32."""
    sized = docs.withColumns({"size": n_words(F.col("text")), "u": unit_hash(seed, F.col("doc_id"))})
    if weight is None:
        return sized.withColumn("weight", F.lit(1.0))
    octave = F.greatest(F.lit(-512.0), F.least(F.lit(512.0), F.rint(F.log2(weight.cast("double")) * 16)))
    return sized.withColumn("weight", F.when(weight > 0, F.pow(F.lit(2.0), octave / 16)).otherwise(0.0))


def factors(levels: DataFrame) -> DataFrame:
    """source and factor: a document's copies are factor * weight, and MOST at the most.

    levels: source, target, weight, words; a row for each source and weight. The heaviest documents
    are those that MOST stops; of the levels that aren't stopped if all heavier ones are, the
    heaviest one tells the factor. It is null where all are stopped.
    """
    own = Window.partitionBy("source")
    heavier = own.orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, -1)
    rest = own.orderBy(F.desc("weight")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = F.lit(float(MOST)) * F.col("words")
    factor = F.try_divide(F.col("target") - F.coalesce(F.sum(full).over(heavier), F.lit(0.0)), F.sum(F.col("words") * F.col("weight")).over(rest))
    told = levels.withColumn("factor", factor)
    return told.groupBy("source").agg(F.max(F.when(F.col("factor") * F.col("weight") <= MOST, F.col("factor"))).alias("factor"))


def inclusion() -> dict[str, Column]:
    """Certain copies, and the Pareto rank of one more copy, mapped to (0, 1)."""
    full = F.when((F.col("target") > 0) & (F.col("weight") > 0), float(MOST)).otherwise(0.0)
    copies = F.when(F.col("factor").isNull(), full).otherwise(F.least(F.lit(float(MOST)), F.col("factor") * F.col("weight")))
    sure = F.floor(copies + 1e-9)
    p = F.greatest(F.lit(0.0), copies - sure)
    odds = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    return {"sure": sure.cast("long"), "rank": F.when(p > 1e-9, odds / (1 + odds))}


def fill(ranked: DataFrame, state: DataFrame, last: bool, bins: int) -> DataFrame:
    """A row a source: source, upto, got.

    state: source, after, most, wanted. Of the documents with a rank above `after` and a size of
    `most` or less, the lowest ranks are taken up to `upto`, so that their words, `got`, stay
    within `wanted`; in the last round a rank is taken also if only half of it still fits.
    """
    held = join_small(ranked, state, ["source"], "inner").where((F.col("rank") > F.col("after")) & (F.col("size") <= F.col("most")))
    own = Window.partitionBy("source")
    before = Window.unboundedPreceding, -1
    of_bin = held.groupBy("source", F.floor(F.col("rank") * bins).cast("int").alias("bin")).agg(F.sum("size").alias("words"), F.max("rank").alias("rank"), F.first("wanted").alias("wanted"))
    of_bin = cut(of_bin.withColumn("start", F.coalesce(F.sum("words").over(own.orderBy("bin").rowsBetween(*before)), F.lit(0))))
    over = of_bin.where((F.col("start") <= F.col("wanted")) & (F.col("start") + F.col("words") > F.col("wanted"))).groupBy("source").agg(F.min("bin").alias("edge"), F.min_by("start", "bin").alias("base"))
    over = cut(over)
    whole = join_small(of_bin, over, ["source"]).where(F.col("edge").isNull() | (F.col("bin") < F.col("edge"))).select("source", "rank", F.col("start").alias("s"), "words", F.lit(True).alias("fits"))
    one_by_one = (
        join_small(held, over, ["source"], "inner").where(F.floor(F.col("rank") * bins) == F.col("edge"))
        .groupBy("source", "rank", "base", "wanted").agg(F.sum("size").alias("words"))
        .withColumn("s", F.col("base") + F.coalesce(F.sum("words").over(own.orderBy("rank").rowsBetween(*before)), F.lit(0)))
        .select("source", "rank", "s", "words", (F.col("s") + F.col("words") / (2 if last else 1) <= F.col("wanted")).alias("fits"))
    )
    return whole.unionByName(one_by_one).where("fits").groupBy("source").agg(F.max("rank").alias("upto"), F.max(F.col("s") + F.col("words")).alias("got"))


def plan_mix(narrow: DataFrame, bins: int = 1 << 14, near: float = 0.0005) -> DataFrame:
    """A row a source: source_size, factor, target and rules for which extra copies are taken.

    narrow: source, size, u, weight. The first document by rank that no longer fits leaves a gap.
    While some gap is above `near` of its target, a further round fills gaps with documents of
    higher rank that are small enough; when none is left, the next rank is taken where half of it
    fits. Every round takes a document or is the last one.
    """
    levels = cut(narrow.groupBy("source", "weight").agg(F.sum("size").alias("words")))
    per = cut(targets(levels.groupBy("source").agg(F.sum("words").alias("source_size"))))
    found = factors(join_small(levels, per, ["source"]))
    per = cut(join_small(per, found, ["source"]))
    with_copies = join_small(narrow, per, ["source"]).withColumns(inclusion())
    sure = with_copies.groupBy("source").agg(F.sum(F.col("size") * F.col("sure")).alias("sure_words"))
    ranked = cut(with_copies.where(F.col("rank").isNotNull()).select("source", "size", "rank"))
    none = F.array().cast("array<struct<after:double,upto:double,most:bigint>>")
    plan = cut(join_small(per, sure, ["source"]).select("source", "source_size", "factor", "target", F.lit(0.0).alias("after"), F.lit((1 << 63) - 1).alias("most"), (F.col("target") - F.col("sure_words")).alias("wanted"), none.alias("rules")))
    last = False
    while True:
        got = cut(fill(ranked, plan.select("source", "after", "most", "wanted"), last, bins))
        rule = F.struct("after", F.col("upto"), "most")
        before, plan = plan, cut(
            join_small(plan, got, ["source"])
            .withColumns({"rules": F.when(F.col("upto").isNotNull(), F.array_append("rules", rule)).otherwise(F.col("rules")), "wanted": F.col("wanted") - F.coalesce("got", F.lit(0)), "after": F.coalesce("upto", "after")})
            .withColumn("most", F.least("most", F.floor("wanted").cast("long"))).drop("upto", "got")
        )
        took = bool(got.limit(1).count())
        release(before, got)
        if last or not plan.where(F.col("wanted") > near * F.col("target")).limit(1).count():
            break
        if not took:
            # every rank above `after` that fits is taken; now any rank may, of which half fits
            last = True
            plan = plan.withColumn("most", (2 * F.greatest(F.lit(0.0), F.col("wanted"))).cast("long"))
    release(levels, per, ranked)
    return plan.select("source", "source_size", "factor", "target", "rules")


def copies_taken() -> Column:
    extra = F.exists("rules", lambda r: (F.col("rank") > r["after"]) & (F.col("rank") <= r["upto"]) & (F.col("size") <= r["most"]))
    return (F.col("sure") + F.when(F.col("rank").isNotNull() & extra, 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, seed: int = 7, weight: Column | None = None) -> DataFrame:
    """docs with source_size, target, size and copies: how often the mix takes each document.

    Needs doc_id, text and source; other columns stay. `weight` (0 or more, null as 0; it may use
    the words of a document, `size`) makes some documents likelier than others of their source, up
    to MOST copies; of weight 0 none are taken. Where the words of positive weight can't fill a
    target, all of them are taken MOST times. Null texts have no words, and are taken or not by the
    same rule, which costs the mix nothing. Extra columns with names of the result's are replaced. Rows with the same doc_id have the same u, so
    that of one source they are taken or left together. A source without words has target 0.
    Reruns agree: u depends on seed and doc_id alone.
    """
    held = with_rank(docs.drop("size", "u", "weight", "source_size", "weighed_size", "target", "factor", "rules", "sure", "rank", "copies"), seed, weight)
    narrow = cut(held.select("source", "size", "u", "weight"))
    plan = plan_mix(narrow)
    mixed = join_small(held, plan, ["source"]).withColumns(inclusion())
    return mixed.withColumn("copies", copies_taken()).drop("u", "weight", "factor", "rules", "sure", "rank")
