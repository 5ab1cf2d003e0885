"""The feature plan: from bars to one row of features per bar."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.lanes import Lane
from barloom.functions.statistics import STATISTICS
from barloom.operators import checks, rolling, stages
from barloom.operators.levels import AtrSmooth, DarvasBox, Hma, HmaAtrSmooth, Level, _whole


class Mode(Enum):
    ATR_SMOOTH = "atrsmooth2"
    DARVAS_BOX = "darvasbox"
    HMA = "hma"
    HMA_ATR_SMOOTH = "hmaatrsmooth"


# The columns of a feature row, in order, and those that modes add.
BARS = ["bar_index", "timestamp", "open", "high", "low", "close", "tick_volume"]
BASE = [
    *BARS, "reference_price", "reference_regime", "distance_signed", "distance_absolute", "scale", "normalized_measurement",
    "statistics_observation_count", "statistics_mean", "statistics_median", "statistics_minimum", "statistics_maximum", "statistics_range", "statistics_mad",
    "statistics_variance", "statistics_standard_deviation", "statistics_skewness", "statistics_kurtosis", "reversal_bars_since", "reversal_direction", "reversal_is_bar",
]
SEGMENT = ["segment_regime", "segment_id", "segment_start_index", "segment_age", "segment_transition"]
BOX = ["darvas_has_box", "darvas_signed_closing_distance", "darvas_absolute_closing_distance", "darvas_mean_signed_distance"]
GEOMETRY = ["mean_hma_atrsmooth_distance", "hma_price_atrsmooth_alignment", "hma_atrsmooth_separation", "hma_atrsmooth_relative_close_position"]


@dataclass(frozen=True)
class FeaturePlan:
    """Parameters of a run. `level` is one of the four sources or a source of your own; what its mode does not publish is never computed.

    Bars have `symbol` (or `key`), a dense `bar_index` from 0, ts, open, high, low, close and volume (null counts as 0). Bars that come twice must be reduced to their last
    version first (`latest`). `part_bars` splits the bars of an instrument over tasks. `scale` (by default the mean true range of `scale_period`), `distance` of close and level and `normalize` of
    absolute distance and scale can be replaced by your own, as can the level.
    """

    level: AtrSmooth | DarvasBox | Hma | HmaAtrSmooth | Level
    scale_period: int = 14
    statistics_window: int = 20
    statistics_source: str = "close"
    statistics: tuple[str, ...] = field(default_factory=lambda: tuple(STATISTICS))
    retain: bool = True
    mean_window: int = 20
    reversal_by_close: bool = False
    key: str = "symbol"
    part_bars: int | None = None
    strict: bool = False
    scale: stages.Scale | None = None
    distance: Callable[[Column, Column], Column] = stages.plain_distance
    normalize: Callable[[Column, Column], Column] = stages.in_scales

    def __post_init__(self):
        for name in ("scale_period", "statistics_window", "mean_window"):
            _whole(name, getattr(self, name), 1)
        if self.level is None:
            raise ValueError("a plan needs a reference level")
        if self.statistics_source not in rolling.SOURCES:
            raise ValueError(f"statistics_source must be one of {rolling.SOURCES}")
        if unknown := [n for n in self.statistics if n not in STATISTICS]:
            raise ValueError(f"unknown statistics {unknown}")

    @property
    def columns(self) -> list[str]:
        """The published columns: a function of the level alone."""
        out = list(BASE)
        if isinstance(self.level, (AtrSmooth, HmaAtrSmooth)):
            out += SEGMENT
        if isinstance(self.level, DarvasBox):
            out += BOX
        if isinstance(self.level, HmaAtrSmooth):
            out += GEOMETRY
        return out

    def apply(self, bars: DataFrame) -> DataFrame:
        """`key` and the published columns for every bar."""
        lane = Lane(self.key, "bar_index", self.part_bars)
        df = bars.select(self.key, F.col("bar_index").cast("int").alias("bar_index"), "ts", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")])
        scale = self.scale or stages.MeanTrueRange(self.scale_period)
        halo = max(self.level.halo, scale.halo, self.statistics_window + 2)
        df = lane.open(df, halo)
        df = self.level.bounded(df, lane)
        df = scale.bounded(df, lane)
        folds, wide = isinstance(self.level, (AtrSmooth, HmaAtrSmooth)), rolling.is_wide(self.statistics_window, self.statistics)
        if self.part_bars:
            df = self._statistics(df, lane)
            df = self.level.carried(lane.close(df), lane)
        elif folds and wide:
            # One pass, sort and exchange for the trailing stop and the statistics.
            df = df.withColumn("_x", rolling.observed(lane, self.statistics_source))
            df = self.level.carried(df, lane, [rolling.wide_step(self.statistics_window, self.statistics_source, self.statistics)])
            df = rolling.published(df, self.statistics_source, self.statistics, self.retain)
        else:
            # Behind the fold, through which nothing is pruned: unasked statistics are not computed.
            df = self._statistics(self.level.carried(df, lane), lane)
        if self.retain:
            df = rolling.retained(df, lane, self.statistics_source, self.statistics)
        df = stages.distances(df, self.distance, self.normalize)
        df = stages.reversals(df, lane, self.reversal_by_close)
        if isinstance(self.level, (AtrSmooth, HmaAtrSmooth)):
            df = stages.segments(df, lane, self.strict)
        if isinstance(self.level, DarvasBox):
            df = stages.box_distances(df)
            df = stages.rolling_mean(df, lane, F.col("darvas_signed_closing_distance"), "darvas_mean_signed_distance", self.mean_window)
        if isinstance(self.level, HmaAtrSmooth):
            df = stages.hma_geometry(df, lane, self.mean_window)
        df = lane.done(df).withColumnsRenamed({"ts": "timestamp", "volume": "tick_volume"})
        absent = {f"statistics_{n}": F.lit(None).cast("double") for n in STATISTICS if n not in self.statistics}
        if self.strict:
            df = checks.strict(df)
        own = [c for c in df.columns if c.startswith("statistics_") and c not in BASE and c not in absent]
        return df.withColumns({c: v for c, v in absent.items() if c in BASE}).select(self.key, *self.columns, *own)

    def _statistics(self, df: DataFrame, lane: Lane) -> DataFrame:
        return rolling.statistics(df, lane, self.statistics_window, self.statistics_source, self.statistics, self.retain)

    def fitted(self, bars: DataFrame, most: int = 1_000_000, part: int = 250_000) -> FeaturePlan:
        """The plan with `part_bars` for these bars: parts of `part` bars if an instrument has more than `most`, whole lanes else. Bars are counted, so `bars` should be cheap to read."""
        longest = bars.groupBy(self.key).count().agg(F.max("count")).collect()[0][0] or 0
        halo = max(self.level.halo, self.scale.halo if self.scale else self.scale_period + 1, self.statistics_window + 2, self.mean_window)
        return replace(self, part_bars=max(part, halo) if longest > most else None)

    def view(self, bars: DataFrame, name: str) -> DataFrame:
        """`apply`, registered as a view for SQL."""
        out = self.apply(bars)
        out.createOrReplaceTempView(name)
        return out


def latest(bars: DataFrame, version: str, key: str = "symbol") -> DataFrame:
    """The last version of each bar: a live bar that was published several times counts once."""
    rest = [c for c in bars.columns if c not in (key, "bar_index")]
    return bars.groupBy(key, "bar_index").agg(F.max_by(F.struct(*rest), version).alias("b")).select(key, "bar_index", "b.*")


def atr_smooth(period: int = 16, multiplier: float = 5.1, smooth: int = 100, **options) -> FeaturePlan:
    return FeaturePlan(AtrSmooth(period, multiplier, smooth), **options)


def darvas_box(length: int = 5, **options) -> FeaturePlan:
    return FeaturePlan(DarvasBox(length), **options)


def hma(period: int = 16, **options) -> FeaturePlan:
    return FeaturePlan(Hma(period), **options)


def hma_atr_smooth(hma_period: int = 16, period: int = 16, multiplier: float = 5.1, smooth: int = 100, **options) -> FeaturePlan:
    return FeaturePlan(HmaAtrSmooth(Hma(hma_period), AtrSmooth(period, multiplier, smooth)), **options)
