"""Secret scans: fixed patterns, and character Markov models for what no pattern names.

First-order Markov models of characters, one of each kind of random strings (hexadecimal digits,
base 64, letters and so on) and one of each kind of ordinary ones (words of the corpus, identifiers
of code, dates and numbers), are trained from labelled samples. A token is a secret if the
log-likelihood ratio of the likeliest random kind against the likeliest ordinary one is high enough.
Everything is an expression of DataFrame functions: the log probability of each pair of characters
is one entry of an array, and a token's is a sum over its pairs. A token is cut into characters
once, so its cost is in proportion to its length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD

#: Kinds in the order in which spans with the same start are listed, and their patterns. Fixed values.
KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": r"""((?i)(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
#: Least length, of group 2 for assign and of the match for the others. Fixed values.
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: The same matches as of PATTERNS where only long ones count; a run of either class can't be entered midway.
LONG = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
ALPHABET = _UPPER + _LOWER + _DIGITS + "+/_=-"
#: The characters of each kind of random strings.
RANDOM = {
    "hex": _DIGITS + "abcdef", "upper hex": _DIGITS + "ABCDEF", "base 64": _UPPER + _LOWER + _DIGITS + "+/", "base 64 of links": _UPPER + _LOWER + _DIGITS + "-_", "letters and digits": _UPPER + _LOWER + _DIGITS,
    "letters": _UPPER + _LOWER, "lower": _LOWER, "upper": _UPPER, "lower and digits": _LOWER + _DIGITS, "upper and digits": _UPPER + _DIGITS,
}
#: Words that identifiers of code, files and places are made of. Fixed values.
VOCABULARY = """
    get set add new old put has can use run log map key val out end max min sum avg all any not and for the from with into user name id ids type list item data date time day year month hour
    test file path line text word page row column table index value count number size length width height color style class object array string integer float double char byte bool null true
    false error message event handler listener factory builder manager service client server request response session cache queue stack thread process system config option setting default
    local global public private static final abstract interface package import export module library version build release update create delete insert select query search find filter sort
    order group join left right start stop begin first last next previous open close read write load save send receive connect timeout retry profile account address email phone city country
    product price customer report window button image strasse kunde nummer haus garten prix nombre fecha usuario calle maison temps ville
""".split()
#: Shapes of dates, versions and numbers: a digit stands for any digit. Fixed values.
NUMBERED = ("2000-00-00", "2000-00-00T00", "20000000T000000Z", "ISBN-978-0-00-000000-0", "v0-00-00", "IMG_20000000_000000", "covid-19", "A0000-000", "RFC-0000", "build-00000", "0000x0000px", "COM_000_000")
SIZE = 128
#: Pairs that the frequencies of single characters count as.
WEIGHT = 20.0
#: Matches that are walked as one part.
PART = 512
SPAN = "array<struct<start:int,kind:int,end:int>>"


@dataclass(frozen=True)
class Ratios:
    """random[kind][a * 128 + b] and ordinary[kind][...]: log probability of b after a in strings of a kind."""

    random: dict[str, tuple[float, ...]]
    ordinary: dict[str, tuple[float, ...]]

    @property
    def tables(self) -> dict[str, tuple[float, ...]]:
        return {**self.ordinary, **self.random}


def _literal(values: tuple[float, ...]) -> Column:
    """The numbers as one array, from one string; the optimiser folds it into one constant."""
    return F.split(F.lit(",".join(f"{v:.4f}" for v in values)), ",").cast("array<double>")


def codes_of(token: Column) -> Column:
    """A number for each pair of neighbouring characters, from 1; the token is cut into characters once."""
    chars = F.transform(F.split(token, ""), F.ascii)
    return F.transform(F.array(chars), lambda c: F.zip_with(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda x, y: x * SIZE + y + 1))[0]


def train(samples: DataFrame) -> Ratios:
    """Models from samples with columns token, random (boolean) and, where there is more than one, kind.

    Pairs are counted where the data are; the driver gets one count for each pair of ALPHABET and
    kind. Other characters are left out, as are nulls. A side without samples has one kind that
    tells nothing.
    """
    named = F.when(F.col("random"), "random").otherwise("ordinary")
    kind = F.coalesce(F.col("kind"), named) if "kind" in samples.columns else named
    held = samples.where(F.col("random").isNotNull() & (F.length("token") >= 2) & F.col("token").rlike(f"^[{ALPHABET}]+$"))
    pairs = held.select("random", kind.alias("kind"), F.explode(codes_of(F.col("token"))).alias("pair"))
    counts: dict[tuple[bool, str], dict[int, int]] = {}
    for r in pairs.groupBy("random", "kind", "pair").count().collect():
        counts.setdefault((r["random"], r["kind"]), {})[r["pair"] - 1] = r["count"]
    letters = [ord(c) for c in ALPHABET]

    def logs(own: dict[int, int]) -> tuple[float, ...]:
        """Log probabilities by pair; one leans on how frequent its second character is at all, as a rare first one tells little."""
        alone = [sum(own.get(a * SIZE + b, 0) for a in letters) + 0.5 for b in letters]
        share, out = [n / sum(alone) for n in alone], [0.0] * (SIZE * SIZE)
        for a in letters:
            row = [own.get(a * SIZE + b, 0) for b in letters]
            for b, n, s in zip(letters, row, share):
                out[a * SIZE + b] = math.log((n + WEIGHT * s) / (sum(row) + WEIGHT))
        return tuple(out)

    side = lambda of: {k: logs(own) for (r, k), own in sorted(counts.items()) if r == of}
    if not side(True) or not side(False):
        return Ratios({"random": (0.0,) * (SIZE * SIZE)}, {"ordinary": (0.0,) * (SIZE * SIZE)})
    return Ratios(side(True), side(False))


def random_samples(spark: SparkSession, n: int = 1500, length: int = 40) -> DataFrame:
    """n tokens of each kind in RANDOM, their characters drawn by a hash: the same ones on any rerun."""
    kinds = F.explode(F.create_map(*[F.lit(x) for pair in RANDOM.items() for x in pair])).alias("kind", "among")
    char = lambda i: F.substring("among", F.pmod(F.xxhash64("id", "kind", i), F.length("among")).cast("int") + 1, F.lit(1))
    return spark.range(n).select("id", kinds).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), char), "").alias("token"), F.lit(True).alias("random"), "kind")


def identifier_samples(spark: SparkSession, n: int = 6000, words: list[str] = VOCABULARY, seed: int = 0) -> DataFrame:
    """n identifiers of one to four words in the styles of code and files, and n / 2 dates and numbers; drawn by a hash, the same ones on any rerun."""
    draw = lambda *of: F.pmod(F.xxhash64(F.lit(seed), "id", *of), F.lit(1 << 30))
    among = F.array(*map(F.lit, words))
    parts = F.transform(F.sequence(F.lit(1), F.lit(1) + (draw(F.lit("n")) % 4).cast("int")), lambda i: F.element_at(among, F.pmod(F.xxhash64(F.lit(seed), "id", i), F.lit(len(words))).cast("int") + 1))
    rows = spark.range(n).withColumn("p", parts)
    big = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 100))
    pascal = F.array_join(F.transform("p", big), "")
    styles = [F.array_join("p", "_"), F.array_join("p", "-"), F.concat(F.lower(F.substring(pascal, 1, 1)), F.substring(pascal, 2, 1000)), pascal, F.upper(F.array_join("p", "_")), F.concat(F.lit("/"), F.array_join("p", "/")), F.array_join("p", "")]
    styled = F.element_at(F.array(*styles), (draw(F.lit("style")) % len(styles)).cast("int") + 1)
    ending = F.when(draw(F.lit("tail")) % 5 == 0, F.concat(F.element_at(F.array(F.lit("_"), F.lit("-"), F.lit("")), (draw(F.lit("mark")) % 3).cast("int") + 1), (draw(F.lit("number")) % 3000).cast("string"))).otherwise("")
    named = rows.select(F.concat(styled, ending).alias("token"), F.lit(False).alias("random"), F.lit("identifiers").alias("kind"))
    shape = F.element_at(F.array(*map(F.lit, NUMBERED)), (draw(F.lit("shape")) % len(NUMBERED)).cast("int") + 1)
    filled = F.array_join(F.transform(F.split(shape, ""), lambda c, i: F.when(c == "0", F.pmod(F.xxhash64(F.lit(seed), "id", i, F.lit("digit")), F.lit(10)).cast("string")).otherwise(c)), "")
    numbered = spark.range(n // 2).select(filled.alias("token"), F.lit(False).alias("random"), F.lit("numbers").alias("kind"))
    return named.unionByName(numbered)


def ordinary_samples(docs: DataFrame, sample_docs: int = 2000) -> DataFrame:
    """Runs of ALPHABET from about sample_docs documents, chosen by a hash, in which no pattern finds anything."""
    rows = docs.where(F.col("text").isNotNull())
    share = min(1.0, sample_docs / max(1, rows.count()))
    u = F.pmod(F.xxhash64(F.lit("markov"), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    clean = rows.where(u < share).where(~F.col("text").rlike(PATTERNS["assign"]) & ~F.col("text").rlike(LONG["access"]) & ~F.col("text").rlike(LONG["hex"]))
    words = clean.select(F.explode(F.regexp_extract_all("text", F.lit(f"[{ALPHABET}]{{2,}}"), F.lit(0))).alias("token"))
    return words.withColumns({"random": F.lit(False), "kind": F.lit("words")})


def spans_of(text: Column, pattern: str, kind: int, keep) -> Column:  # noqa: ANN001
    """Start and end of each match, in code points, of those matches for which keep(match) holds.

    What stands between matches comes from split(), the matches from regexp_extract_all(); both
    walk the text in the same way, so their lengths in turn give the places.
    """
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.zip_with(between, found, lambda b, m: F.struct(F.length(b).alias("before"), F.length(m).alias("size"), F.coalesce(keep(m), F.lit(False)).alias("keep")))
    none = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["before"]
        end = start + F.coalesce(x["size"], F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["keep"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def part(acc: Column, xs: Column) -> Column:
        done = F.aggregate(xs, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.transform(F.array(done), lambda d: F.struct(d["at"].alias("at"), F.concat(acc["outs"], F.array(d["out"])).alias("outs")))[0]

    # an array grows by copies, so matches are walked in parts and the parts' arrays joined once
    parts = F.transform(F.array(lengths), lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / PART).cast("int")), lambda k: F.slice(all_, k * PART + 1, F.lit(PART))))[0]
    walked = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("outs")), part, lambda acc: F.flatten(acc["outs"]))
    return F.when(text.rlike(pattern), walked).otherwise(none)


def base_spans(text: Column) -> Column:
    assign = spans_of(text, PATTERNS["assign"], 0, lambda m: F.length(F.regexp_extract(m, PATTERNS["assign"], 2)) >= LEAST["assign"])
    others = [spans_of(text, LONG[k], KINDS.index(k), lambda m: m.isNotNull()) for k in ("access", "hex")]
    return F.array_sort(F.concat(assign, *others))


def scan(docs: DataFrame, ratios: Ratios, least_length: int = 12, threshold: float = 14.0) -> DataFrame:
    """docs with `base` and `extra`, arrays of (start, kind, end) sorted by start, then kind.

    Needs text; other columns stay, but base and extra are replaced. A null text is an empty one.
    Extra spans (kind 3) are runs of least_length or more characters of ALPHABET that hold a letter,
    overlap no base span, and are likelier by threshold nats or more under some kind of random
    strings than under every ordinary one. Whole texts are scanned.
    """
    token = f"[{ALPHABET}]{{{least_length},}}"
    n_random = len(ratios.random)
    tables = [_literal(t) for t in (*ratios.random.values(), *ratios.ordinary.values())]

    def likely(m: Column) -> Column:
        totals = F.transform(F.array(codes_of(m)), lambda codes: F.transform(F.array(*[F.lit(k) for k in range(len(tables))]), lambda k: F.aggregate(codes, F.lit(0.0), lambda acc, c: acc + F.element_at(F.element_at(F.array(*tables), k + 1), c))))
        ratio = F.transform(totals, lambda t: F.array_max(F.slice(t, 1, n_random)) - F.array_max(F.slice(t, n_random + 1, len(tables))))[0]
        return F.when(m.rlike("[A-Za-z]"), ratio >= threshold).otherwise(False)

    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.drop("base", "extra").withColumns({"base": base_spans(text), "__extra": spans_of(text, token, len(KINDS), likely)})
    alone = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    return found.withColumn("extra", F.filter("__extra", alone)).drop("__extra")


def listed(spans: Column, names: tuple[str, ...] = (*KINDS, "markov")) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, names)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
