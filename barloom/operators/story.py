"""A stock's story: what happened in each chapter of its past, leg by leg, and why it fell.

Filings, large days and headlines meet sessions by equi-joins on a symbol and a day; where an event
reaches over several days, its few days are written out before the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frames import own
from ..functions.text import themes, word_pattern
from .events import as_of
from .extras import legs

#: Chapter, bars back at its start and its end, threshold of its legs, of its large days, and most large days. Fixed values.
CHAPTERS = [("5y", 1260, 504, 0.20, 0.06, 3), ("2y", 504, 252, 0.15, 0.05, 3), ("1y", 252, 126, 0.10, 0.04, 3), ("6m", 126, 22, 0.07, 0.035, 3), ("1m", 22, 0, 0.03, 0.025, 3)]
#: Most legs of a chapter and most events of a leg. Fixed values.
MOST_LEGS, MOST_EVENTS = 6, 5
#: Items of filings: earnings, those of corporate events, those of them that count only with a move, and that move. Fixed values.
EARNINGS = "2.02"
CORPORATE = ["1.01", "1.02", "1.03", "2.01", "2.03", "2.05", "2.06", "4.02", "5.01", "5.02"]
LIGHT, LIGHT_MOVE = ["5.02", "2.03"], 0.02
#: Cause that an item of a filing stands for. Fixed values.
ITEM_CAUSE = {
    "2.02": "earnings", "5.02": "management", "2.05": "restructuring", "2.06": "impairment", "1.01": "deal/financing", "1.02": "deal/financing", "2.01": "deal/financing", "2.03": "deal/financing",
    "3.02": "deal/financing", "4.02": "restatement", "1.03": "bankruptcy", "4.01": "auditor change", "7.01": "company disclosure (8-K)", "8.01": "company disclosure (8-K)",
}
#: Words of headlines by cause. Fixed values.
CAUSE_WORDS = {
    "earnings": "earnings results quarter quarterly q1 q2 q3 q4 eps revenue revenues profit profits".split(),
    "guidance": [*"guidance outlook forecast warns warning lowers trims".split(), "cuts forecast", "cut its"],
    "rating cut": [*"downgrade downgrades downgraded".split(), "price target", "target cut", "cuts target", "lowers target"],
    "legal/regulatory": "lawsuit probe investigation sec doj ftc fda recall antitrust regulator regulators fined tariff tariffs subpoena".split(),
    "deal/financing": "acquisition acquire acquires merger offering convertible dilution notes buyout spin-off spinoff".split(),
    "management": [*"ceo cfo resigns resignation departure".split(), "steps down"],
    "demand/competition": "demand competition competitor loses lost contract delay delays slowdown weak weakness".split(),
    "price move": [*"falls fall fell drops drop dropped plunge plunges plunged tumble tumbles tumbled sinks sank slides slid slump slumps sell-off selloff why slammed".split(), "52-week low", "down today", "shares down"],
}
CAUSES = {k: word_pattern(w) for k, w in CAUSE_WORDS.items()}
MOVE = "price move"
#: Words of headlines that tell of a rise, of ones that never state a cause, and of ones about the stock. Fixed values.
RISES = ["jump", "jumps", "soars", "soar", "rally", "rallies", "gains", "climbs", "surges", "strength seen", "up today", "rises", "rebound"]
NOISE = [
    "trending stock", "should you buy", "what to know beyond", "which is the better", "better value stock", "dips more than", "outpaces stock market", "settling at", "zacks rank", "moving average",
    "investors heavily search", "vs.", "here's why you should", "is a great choice", "stock is up today", "stock is down today", "buy the dip",
]
MARKET_WORDS = [
    *"stock stocks shares investors investor earnings analyst analysts nyse nasdaq quarter quarterly results revenue sales profit profits guidance outlook forecast downgrade downgrades upgrade valuation".split(),
    *"sell-off selloff rout plunge plunges tumble tumbles slump slumps sink sinks slide slides dive dives crash crashes lowest 52-week".split(), "share price", "wall street", "price target", "market cap", "low since", "worst day",
]

EVENT = "kind string, date date, session date, ret double, vol double, codes array<string>"


def with_moves(bars: DataFrame) -> DataFrame:
    """bars with ret, the day's return, and vol, the volume over the median of the 20 bars before."""
    w = own("bar_idx")
    before = w.rowsBetween(-20, -1)
    usual = F.when(F.count("volume").over(before) >= 20, F.percentile("volume", F.lit(0.5)).over(before))
    return bars.withColumns({"ret": F.try_divide(F.col("close"), F.lag("close").over(w)) - 1, "vol": F.try_divide(F.col("volume"), F.when(usual > 0, usual))})


def reactions(days: DataFrame, moves: DataFrame, within: int = 4) -> DataFrame:
    """days (symbol, event_date) with session, ret and vol: the first session on or after the day, or the next one if it moved more; neither is later than `within` days. Days without one are left out."""
    w = own("bar_idx")
    side = F.struct(F.col("date").alias("session"), "ret", "vol")
    lined = moves.select("symbol", "date", side.alias("a"), F.struct(F.lead("date").over(w).alias("session"), F.lead("ret").over(w).alias("ret"), F.lead("vol").over(w).alias("vol")).alias("b"))
    met = as_of(days.select("symbol", "event_date").distinct(), moves.select("symbol", "date"), forward=True, strict=False).join(lined, ["symbol", "date"])
    ok = F.filter(F.array("a", "b"), lambda x: x["ret"].isNotNull() & (F.datediff(x["session"], F.col("event_date")) <= within))
    best = F.aggregate(F.slice(ok, 2, 1), F.try_element_at(ok, F.lit(1)), lambda x, y: F.when(F.abs(y["ret"]) > F.abs(x["ret"]), y).otherwise(x))
    return met.where(F.size(ok) > 0).select("symbol", "event_date", best.alias("x")).select("symbol", "event_date", "x.session", "x.ret", "x.vol")


def chapters(bars: DataFrame, of: list[tuple] = CHAPTERS) -> DataFrame:
    """symbol, chapter, threshold, big, most_big, from_idx, to_idx and their days, of the chapters of which a quarter or more has bars."""
    spans = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("chapter", "back0", "back1", "threshold", "big", "most_big"), c)]) for c in of]))
    n = bars.groupBy("symbol").agg((F.max("bar_idx") + 1).alias("n"))
    rows = n.select("symbol", "n", spans.alias("c")).select("symbol", "n", "c.*").withColumns({"from_idx": F.greatest(F.lit(0), F.col("n") - 1 - F.col("back0")).cast("int"), "to_idx": (F.col("n") - F.col("back1") - 1).cast("int")})
    rows = rows.where((F.col("to_idx") - F.col("from_idx") >= 4) & (F.col("n") - 1 >= 0.25 * F.col("back0")))
    day = lambda i, d: bars.select("symbol", F.col("bar_idx").alias(i), F.col("date").alias(d))
    return rows.join(day("from_idx", "from_date"), ["symbol", "from_idx"]).join(day("to_idx", "to_date"), ["symbol", "to_idx"]).select("symbol", "chapter", "threshold", "big", "most_big", "from_idx", "to_idx", "from_date", "to_date")


def story_events(filings: DataFrame, bars: DataFrame, bench: DataFrame | None = None, of: list[tuple] = CHAPTERS) -> DataFrame:
    """symbol, chapter and an event a session: earnings, corporate filings, and the largest days that no filing explains.

    filings: symbol, date, items. A filing counts in the chapter that its date falls in and belongs to
    the session that reacted to it. Of what falls on one session earnings come first, which take over
    the codes of the last corporate filing there, then the first filing; of large days a chapter has
    most_big at most. With bench, spy is its return on the session.
    """
    span = chapters(bars, of)
    moves = with_moves(bars)
    filed = filings.select("symbol", F.col("date").alias("event_date"), "items").distinct()
    met = filed.join(reactions(filed, moves), ["symbol", "event_date"])
    codes = F.filter("items", lambda i: i.isin(*CORPORATE))
    heavy = F.exists(codes, lambda i: ~i.isin(*LIGHT))
    earned = F.when(F.array_contains("items", EARNINGS), F.struct(F.lit("earnings").alias("kind"), F.lit(None).cast("array<string>").alias("codes")))
    business = F.when((F.size(codes) > 0) & ((F.abs("ret") >= LIGHT_MOVE) | heavy), F.struct(F.lit("corporate").alias("kind"), codes.alias("codes")))
    both = F.explode(F.filter(F.array(earned, business), lambda x: x.isNotNull()))
    told = met.select("symbol", "event_date", "session", "ret", "vol", "items", both.alias("e")).select("symbol", F.col("e.kind").alias("kind"), F.col("event_date").alias("date"), "session", "ret", "vol", F.col("e.codes").alias("codes"), F.array_join("items", ",").alias("__items"))
    inside = told.join(span.select("symbol", "chapter", "from_date", "to_date"), "symbol").where(F.col("date").between(F.col("from_date"), F.col("to_date"))).drop("from_date", "to_date")
    rank = F.struct(F.col("kind") != "earnings", F.col("date"), F.col("__items"))
    last_code = F.max_by(F.when(F.col("kind") == "corporate", F.col("codes")), F.when(F.col("kind") == "corporate", F.struct("date", "__items")))
    merged = inside.groupBy("symbol", "chapter", "session").agg(F.min_by(F.struct("kind", "date", "ret", "vol", "codes"), rank).alias("e"), last_code.alias("last"))
    merged = merged.select("symbol", "chapter", "e.kind", "e.date", "session", "e.ret", "e.vol", F.when(F.col("e.kind") == "earnings", F.col("last")).otherwise(F.col("e.codes")).alias("codes"))
    days = moves.select("symbol", "bar_idx", F.col("date").alias("session"), "ret", "vol").join(span.select("symbol", "chapter", "from_idx", "to_idx", "big", "most_big"), "symbol")
    days = days.where(F.col("bar_idx").between(F.col("from_idx"), F.col("to_idx")) & (F.abs("ret") >= F.col("big"))).join(merged.select("symbol", "chapter", "session"), ["symbol", "chapter", "session"], "left_anti")
    order = Window.partitionBy("symbol", "chapter").orderBy(F.desc(F.abs("ret")), "session")
    large = days.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= F.col("most_big")).select("symbol", "chapter", F.lit("bigday").alias("kind"), F.col("session").alias("date"), "session", "ret", "vol", F.lit(None).cast("array<string>").alias("codes"))
    out = merged.unionByName(large)
    if bench is None:
        return out.withColumn("spy", F.lit(None).cast("double"))
    line = bench.select(F.col("date").alias("session"), (F.try_divide(F.col("close"), F.lag("close").over(Window.partitionBy("symbol").orderBy("date"))) - 1).alias("spy"))
    return out.join(line, "session", "left").select(*out.columns, "spy")


def score_headline(title: Column, up: Column | None = None, causes: dict[str, str] = CAUSES, rises: list[str] = RISES) -> tuple[Column, Column]:
    """The causes that a title names, and its score as the headline of a day that rose (up) or fell."""
    low = F.lower(title)
    named = F.filter(themes(low, causes), lambda k: k != MOVE)
    up = F.lit(False) if up is None else up
    rose, fell = F.exists(F.array(*map(F.lit, rises)), lambda w: F.contains(low, w)), low.rlike(causes[MOVE])
    score = 2 * F.size(named) + low.rlike(word_pattern(MARKET_WORDS)).cast("int")
    score += F.when((up & rose) | (~up & fell), 2).otherwise(0) - F.when((up & fell & ~rose) | (~up & rose & ~fell), 3).otherwise(0)
    return named, score


def best_headlines(events: DataFrame, headlines: DataFrame, tokens: DataFrame) -> DataFrame:
    """events with title, publisher and causes of the best headline from a day before to two days after the session; nulls without one of score 2 or more.

    headlines: symbol, date, title, publisher. tokens: symbol, tokens (words that name the company). Ties go to the first date, then the title.
    """
    low = F.lower("title")
    named = headlines.join(tokens, "symbol").where((F.trim("title") != "") & F.exists("tokens", lambda t: F.contains(low, F.lower(t))) & ~F.exists(F.array(*map(F.lit, NOISE)), lambda w: F.contains(low, w)))
    near = named.select("symbol", "title", "publisher", F.col("date").alias("told"), F.explode(F.sequence(F.date_sub("date", 2), F.date_add("date", 1))).alias("session"))
    keys = events.select("symbol", "session", (F.col("ret") > 0).alias("up")).distinct()
    causes, score = score_headline(F.col("title"), F.col("up"))
    scored = keys.join(near, ["symbol", "session"]).withColumns({"causes": causes, "score": score}).where("score >= 2")
    top = scored.groupBy("symbol", "session").agg(F.min_by(F.struct("told", "title", "publisher", "causes"), F.struct(-F.col("score"), F.col("told"), F.col("title"))).alias("h"))
    return events.join(top, ["symbol", "session"], "left").select(*events.columns, F.col("h.title").alias("title"), F.col("h.publisher").alias("publisher"), F.col("h.causes").alias("causes"))


def assemble(bars: DataFrame, events: DataFrame, actions: DataFrame | None = None, bench: DataFrame | None = None, of: list[tuple] = CHAPTERS) -> DataFrame:
    """symbol, chapter, leg: start, end, p0, p1, ret, bars, vol_ratio, spy, upgrades, downgrades and events (kind, session, ret, codes), in the order of sessions.

    A chapter's closes are cut into legs; an event belongs to the leg that its session ends or falls
    into, one on the first day to the first leg. A leg keeps the MOST_EVENTS that moved most. actions:
    symbol, date, action (up or down).
    """
    span = chapters(bars, of)
    part = bars.join(span.select("symbol", "chapter", "threshold", "from_idx", "to_idx"), "symbol").where(F.col("bar_idx").between(F.col("from_idx"), F.col("to_idx")))
    cut = legs(part, ["symbol", "chapter"], "threshold", MOST_LEGS).drop("threshold")
    usual = part.groupBy("symbol", "chapter").agg(F.expr("percentile(volume, 0.5)").alias("usual"))
    w = own("bar_idx")
    at = bars.withColumn("__v", F.sum(F.coalesce("volume", F.lit(0.0))).over(w)).withColumn("__k", F.count("volume").over(w))
    if bench is not None:
        at = at.join(bench.select("date", F.col("close").alias("__b")), "date", "left").withColumn("__b", F.last("__b", ignorenulls=True).over(w))
    else:
        at = at.withColumn("__b", F.lit(None).cast("double"))
    side = lambda k, i: at.select("symbol", F.col("bar_idx").alias(i), F.struct("date", "close", "__v", "__k", "__b").alias(k))
    rows = cut.join(side("a", "start_idx"), ["symbol", "start_idx"]).join(side("b", "end_idx"), ["symbol", "end_idx"]).join(usual, ["symbol", "chapter"])
    mean = F.try_divide(F.col("b.__v") - F.col("a.__v"), F.col("b.__k") - F.col("a.__k"))
    rows = rows.select("symbol", "chapter", "leg", F.col("a.date").alias("start"), F.col("b.date").alias("end"), F.col("a.close").alias("p0"), F.col("b.close").alias("p1"), "ret", (F.col("end_idx") - F.col("start_idx")).alias("bars"), F.try_divide(mean, F.col("usual")).alias("vol_ratio"), (F.try_divide(F.col("b.__b"), F.col("a.__b")) - 1).alias("spy"))
    within = lambda d: ((F.col("start") < F.col(d)) | ((F.col("leg") == 0) & (F.col("start") == F.col(d)))) & (F.col(d) <= F.col("end"))
    place = rows.select("symbol", "chapter", "leg", "start", "end")
    held = events.select("symbol", "chapter", "kind", F.col("date").alias("__date"), "session", F.col("ret").alias("move"), "codes").join(place, ["symbol", "chapter"]).where(within("session"))
    kept = held.withColumn("__r", F.row_number().over(Window.partitionBy("symbol", "chapter", "leg").orderBy(F.desc(F.abs("move")), "session"))).where(F.col("__r") <= MOST_EVENTS)
    listed = kept.groupBy("symbol", "chapter", "leg").agg(F.transform(F.array_sort(F.collect_list(F.struct("__date", "session", "kind", F.col("move").alias("ret"), "codes"))), lambda e: F.struct(e["kind"].alias("kind"), e["session"].alias("session"), e["ret"].alias("ret"), e["codes"].alias("codes"))).alias("events"))
    out = rows.join(listed, ["symbol", "chapter", "leg"], "left")
    if actions is None:
        return out.withColumns({"upgrades": F.lit(0).cast("long"), "downgrades": F.lit(0).cast("long")})
    moved = actions.select("symbol", F.col("date").alias("__day"), "action").join(place, "symbol").where((F.col("start") < F.col("__day")) & (F.col("__day") <= F.col("end")))
    counts = moved.groupBy("symbol", "chapter", "leg").agg(F.count_if(F.col("action") == "up").alias("upgrades"), F.count_if(F.col("action") == "down").alias("downgrades"))
    return out.join(counts, ["symbol", "chapter", "leg"], "left").fillna(0, ["upgrades", "downgrades"])


# --- why it fell -----------------------------------------------------------


def falls(bars: DataFrame, filings: DataFrame, drops: int = 5, span: int = 252, most: int = 6) -> DataFrame:
    """symbol, day, kind, ret, vol: the `drops` worst days of the last span bars, and days on which earnings were answered with a fall of 1 % or more; the worst `most` of both."""
    w = own("bar_idx")
    recent = with_moves(bars).withColumn("__last", F.max("bar_idx").over(Window.partitionBy("symbol"))).where((F.col("bar_idx") > F.col("__last") - span) & F.col("ret").isNotNull())
    worst = recent.withColumn("__r", F.row_number().over(Window.partitionBy("symbol").orderBy("ret", "date"))).where(F.col("__r") <= drops).select("symbol", F.col("date").alias("day"), F.lit("drop").alias("kind"), "ret", "vol")
    pair = recent.select("symbol", "date", F.struct("ret", F.col("date").alias("day"), "vol").alias("a"), F.struct(F.lead("ret").over(w).alias("ret"), F.lead("date").over(w).alias("day"), F.lead("vol").over(w).alias("vol")).alias("b"))
    told = filings.where(F.array_contains("items", EARNINGS)).select("symbol", F.col("date").alias("event_date")).distinct()
    met = as_of(told, recent.select("symbol", "date"), forward=True, strict=False).join(pair, ["symbol", "date"])
    low = F.when(F.col("b.ret") < F.col("a.ret"), F.col("b")).otherwise(F.col("a"))
    earned = met.select("symbol", low.alias("x")).select("symbol", "x.day", F.lit("earnings").alias("kind"), "x.ret", "x.vol").where("ret <= -0.01").distinct().join(worst.select("symbol", "day"), ["symbol", "day"], "left_anti")
    both = worst.unionByName(earned)
    return both.withColumn("__r", F.row_number().over(Window.partitionBy("symbol").orderBy("ret", "day"))).where(F.col("__r") <= most).drop("__r")


def _spread(rows: DataFrame, before: int, after: int) -> DataFrame:
    """rows with `day`: each day on which a row of `date` counts, from `before` days after it back to `after` days before it."""
    return rows.withColumn("day", F.explode(F.sequence(F.date_sub("date", after), F.date_add("date", before))))


def fall_evidence(days: DataFrame, headlines: DataFrame, tokens: DataFrame, filings: DataFrame, actions: DataFrame, bench: DataFrame, causes: dict[str, str] = CAUSES, market_wide: float = -0.015, loud: float = 2.5) -> DataFrame:
    """days (of falls) with titles (the three best), codes, spy and tags: the causes that filings, headlines, rating cuts and the market give.

    headlines: symbol, date, title, summary, publisher, source; they count from a day before to two
    after. A title scores 2 for each cause, 1 for each that only its summary names, 2 (or 1) for telling
    of the fall, less 3 for a rise, and must name something itself. filings count on their day and the
    next, actions (symbol, date, action, target_action) from a day before to three after. Tags come in
    the order filings, headlines, cuts, market; a loud day without any is a company event.
    """
    low, brief = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("summary", F.lit("")))
    in_title, in_brief = themes(low, causes), F.array_except(themes(brief, causes), themes(low, causes))
    count = lambda ks: F.size(F.filter(ks, lambda k: k != MOVE))
    has = lambda ks: F.array_contains(ks, MOVE)
    any_of = lambda words, text: F.exists(F.array(*map(F.lit, words)), lambda x: F.contains(text, x))
    relevant = F.exists("tokens", lambda t: F.contains(F.concat_ws(" ", low, brief), F.lower(t))) & ~any_of(NOISE, low)
    told = ~F.coalesce(F.col("source") == "google", F.lit(False)) | low.rlike(word_pattern(MARKET_WORDS)) | (count(themes(low, causes)) > 0)
    score = 2 * count("__t") + count("__s") + F.when(has("__t"), 2).when(has("__s"), 1).otherwise(0) - F.when(any_of(RISES, low), 3).otherwise(0)
    pool = headlines.join(tokens, "symbol").where(relevant & told).withColumns({"__t": in_title, "__s": in_brief}).withColumn("score", score).where((F.col("score") > 0) & (F.size("__t") > 0))
    named = F.filter(F.concat("__t", "__s"), lambda k: k != MOVE)
    pool = pool.select("symbol", "date", "title", "score", F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("news"))).alias("causes"))
    keys = days.select("symbol", "day").distinct()
    near = keys.join(_spread(pool, 1, 2).dropDuplicates(["symbol", "day", "title", "date"]), ["symbol", "day"]).withColumn("__gap", F.abs(F.datediff("date", "day")))
    three = near.withColumn("__r", F.row_number().over(Window.partitionBy("symbol", "day").orderBy(F.desc("score"), "__gap", "date", "title"))).where("__r <= 3")
    heads = three.groupBy("symbol", "day").agg(F.array_sort(F.collect_list(F.struct("__r", "title", "causes"))).alias("h"))
    heads = heads.select("symbol", "day", F.transform("h", lambda x: x["title"]).alias("titles"), F.flatten(F.transform("h", lambda x: x["causes"])).alias("__heads"))
    known = F.filter("items", lambda i: i.isin(*ITEM_CAUSE))
    cause_of = F.create_map(*[F.lit(x) for kv in ITEM_CAUSE.items() for x in kv])
    near_f = keys.join(_spread(filings.select("symbol", "date", known.alias("codes")).where(F.size("codes") > 0).distinct(), 1, 0), ["symbol", "day"])
    filed = near_f.groupBy("symbol", "day").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("date", "codes"))), lambda x: x["codes"])).alias("codes"))
    cut = (F.col("action") == "down") | (F.col("target_action") == "Lowers")
    cuts = keys.join(_spread(actions.where(F.coalesce(cut, F.lit(False))).select("symbol", "date").distinct(), 1, 3), ["symbol", "day"]).select("symbol", "day").distinct().withColumn("__cut", F.lit(True))
    market = bench.select(F.col("date").alias("day"), (F.try_divide(F.col("close"), F.lag("close").over(Window.partitionBy("symbol").orderBy("date"))) - 1).alias("spy"))
    out = days.join(heads, ["symbol", "day"], "left").join(filed, ["symbol", "day"], "left").join(cuts, ["symbol", "day"], "left").join(market, "day", "left")
    none = F.array().cast("array<string>")
    tags = F.array_distinct(F.concat(
        F.coalesce(F.transform("codes", lambda c: F.element_at(cause_of, c)), none), F.coalesce("__heads", none), F.when(F.col("__cut"), F.array(F.lit("rating cut"))).otherwise(none),
        F.when(F.col("spy") <= market_wide, F.array(F.lit("market-wide"))).otherwise(none),
    ))
    company = F.array(F.lit("company event"))
    return out.withColumn("tags", tags).withColumn("tags", F.when((F.size("tags") == 0) & (F.col("vol") >= loud), company).otherwise(F.col("tags"))).select(*days.columns, "titles", "codes", "spy", "tags")


def decline_reasons(evidence: DataFrame, bars: DataFrame, span: int = 252) -> DataFrame:
    """Per symbol: cause (its days' tags, the worst day's first), drawdown and day of the last span bars' highest close, and how much of the fall since came on days that answered earnings."""
    recent = bars.withColumn("__last", F.max("bar_idx").over(Window.partitionBy("symbol"))).where(F.col("bar_idx") > F.col("__last") - span)
    peak = recent.groupBy("symbol").agg(F.max("close").alias("high"), F.min_by("date", F.struct(-F.col("close"), F.col("date"))).alias("high_date"), F.max_by("close", "bar_idx").alias("last"))
    rows = evidence.join(peak, "symbol")
    earned = (F.col("day") >= F.col("high_date")) & ((F.col("kind") == "earnings") | F.coalesce(F.array_contains("codes", EARNINGS), F.lit(False)))
    told = rows.groupBy("symbol").agg(
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ret", "day", "tags"))), lambda x: x["tags"]))).alias("t"), F.first("high_date").alias("high_date"), (F.first("last") / F.first("high") - 1).alias("drawdown"),
        F.count_if(earned).alias("n_earnings_days"), F.coalesce(F.exp(F.sum(F.when(earned, F.log1p("ret")))) - 1, F.lit(0.0)).alias("earnings_ret"),
    )
    sure = F.array_remove("t", "company event")
    cause = F.when(F.size(sure) > 0, F.array_join(sure, ", ")).when(F.size("t") > 0, "heavy volume, cause not found").otherwise("not found")
    return told.select("symbol", cause.alias("cause"), "high_date", "drawdown", "n_earnings_days", "earnings_ret")
