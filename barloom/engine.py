"""One object for the whole engine; every method returns a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession

from .operators import events as E
from .operators import indicators as I
from .operators import ledger as L
from .operators import paths as P
from .operators import patterns as C
from .operators import peers as G
from .operators import portfolio as R
from .operators import stats as S
from .sources import bars as B


class Engine:
    """Bars, and the studies of them.

    >>> engine = Engine(spark).read_csv("prices/")
    >>> engine.scan(["falling-wedge"], mode="current").show()
    """

    def __init__(self, spark: SparkSession, bars: DataFrame | None = None, bench: DataFrame | None = None) -> None:
        self.spark, self.bars = spark, bars
        self._bench = bench

    def read_csv(self, path: str) -> "Engine":
        return Engine(self.spark, B.read_csv_directory(self.spark, path), self._bench)

    def read_parquet(self, path: str) -> "Engine":
        return Engine(self.spark, B.normalise(self.spark.read.parquet(path)), self._bench)

    @property
    def bench(self) -> DataFrame:
        """The benchmark that was given, or the equal-weight mean of all symbols."""
        return B.benchmark(self.bars) if self._bench is None else self._bench

    def weekly(self) -> "Engine":
        return Engine(self.spark, B.weekly(self.bars), None if self._bench is None else B.weekly(self._bench))

    def indicators(self) -> DataFrame:
        return I.with_volume_context(I.with_context(self.bars))

    def pivots(self, settings: C.Settings = C.Settings()) -> DataFrame:  # noqa: B008
        return C.pivots(self.bars, settings)

    def scan(self, patterns: Iterable[str] | None = None, mode: str = "all", settings: C.Settings = C.Settings()) -> DataFrame:  # noqa: B008
        return C.scan(self.bars, patterns, mode, settings)

    def walk_forward(self, patterns: Iterable[str] | None = None, window: int = 400, step: int = 1) -> DataFrame:
        return C.walk_forward(self.bars, patterns, window, step)

    def events(self, family: str, horizons: list[int] = [5, 10, 20], **options: object) -> DataFrame:  # noqa: B006
        """rally, news, reversal, base, ma200 or doji events with forward returns, or patterns as events."""
        if family == "patterns":
            found = self.scan(options.get("patterns")).where("breakout_idx IS NOT NULL")  # type: ignore[arg-type]
            rich = E.with_forward(E.align_benchmark(self.bars, self.bench), horizons, E.PATTERN)
            return found.join(rich, (found["symbol"] == rich["symbol"]) & (found["breakout_idx"] == rich["bar_idx"])).drop(rich["symbol"])
        if family in ("news", "reversal"):
            dense = B.densify(self.bars)
            return (E.news_gaps if family == "news" else E.reversals)(dense, self.bench, horizons=horizons, **options)
        makers = {"rally": E.rally_events, "base": E.bases, "ma200": E.ma200_cross_events, "doji": E.doji_events}
        return makers[family](self.bars, self.bench, horizons=horizons, **options)

    def study(self, events: DataFrame, by: str, split: str, horizons: list[int] = [5, 10, 20]) -> DataFrame:  # noqa: B006
        return S.by_period(E.narrow(events, horizons, [by, "symbol", "date", "year"]), [by], split)

    def portfolio(self, signal: Column, groups: int = 10, rebalance: str = "month", **options: object) -> DataFrame:
        return R.ranked_backtest(B.densify(self.bars, least_bars=300), signal, groups, rebalance, **options)

    def exits(self, events: DataFrame, rules: list[P.ExitRule] | None = None) -> DataFrame:
        rules = P.default_rules() if rules is None else rules
        trades = P.with_path(self.bars, max(r.hold for r in rules)).join(events.select("symbol", "bar_idx"), ["symbol", "bar_idx"])
        return P.exit_grid(trades, rules)

    def peers(self, per_group: int = 8) -> DataFrame:
        return G.build_groups(G.log_returns(B.densify(self.bars)), per_group)

    def mark_to_market(self, journal: DataFrame) -> DataFrame:
        return L.mark_to_market(journal, self.bars, self.bench)
