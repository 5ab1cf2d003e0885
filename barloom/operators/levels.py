"""Reference levels: volume-weighted trailing-stop equilibrium, box breakouts, Hull moving average, and the composite of the first and last.

Each source has two steps: `bounded` adds the columns that look back a fixed number of bars (`halo`), `carried` those that carry state. All publish
reference_price and reference_regime (-1, 0, 1).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.lanes import Lane, highest, lowest, shifted, wma
from barloom.operators.passes import Step, lane_pass


class Level(Protocol):
    """A reference source of your own: implement these and pass it to a plan."""

    halo: int

    def bounded(self, df: DataFrame, lane: Lane) -> DataFrame: ...

    def carried(self, df: DataFrame, lane: Lane) -> DataFrame: ...


def _whole(name: str, value: int, least: int) -> None:
    if not isinstance(value, int) or isinstance(value, bool) or value < least:
        raise ValueError(f"{name} must be a whole number of at least {least}, not {value!r}")


def true_range(lane: Lane) -> Column:
    """Greatest of the bar's range and its distances to the close before; the range alone at the first bar."""
    before = shifted(lane, F.col("close"))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def trailing_step(stop: float, before: float, close: float, distance: float) -> float:
    """The stop after a bar: it follows while both closes are on one side of it, and starts anew on the side that the close went to."""
    if close > stop and before > stop:
        return max(stop, close - distance)
    if close < stop and before < stop:
        return min(stop, close + distance)
    return close - distance if close > stop else close + distance


def trailing_stops(true_ranges: np.ndarray, closes: np.ndarray, period: int, multiplier: float, state: tuple | None) -> tuple[np.ndarray, np.ndarray, tuple | None]:
    """Stops and sides of successive bars of one instrument and the state after them; `state` is the smoothed range, stop, close and side before them, None at the start.

    The side is that on which the close last crossed the stop of the bar before, 0 until it does. A bar without prices (NaN) has no stop and leaves the state as it is.
    """
    out, sides = np.empty(len(closes)), np.empty(len(closes), np.int32)
    a = 2.0 / (period + 1)
    for i, (tr, c) in enumerate(zip(true_ranges.tolist(), closes.tolist())):
        if tr != tr or c != c:
            out[i], sides[i] = math.nan, state[3] if state else 0
            continue
        if state is None:
            mean, stop, before, side = tr, c, c, 0
        else:
            mean, stop, before, side = a * tr + (1 - a) * state[0], state[1], state[2], state[3]
            if before < stop < c:
                side = 1
            elif before > stop > c:
                side = -1
        stop = trailing_step(stop, before, c, multiplier * mean)
        state = (mean, stop, c, side)
        out[i], sides[i] = stop, side
    return out, sides, state


def stop_step(period: int, multiplier: float) -> Step:
    """`stop` and `side`. The recurrence has resets that depend on data: no window expresses it."""

    def run(inputs: list[np.ndarray], state: tuple | None) -> tuple[list[np.ndarray], tuple | None]:
        stops, sides, state = trailing_stops(*inputs, period, multiplier, state)
        return [stops, sides], state

    return Step(["true_range", "close"], [("stop", T.DoubleType()), ("side", T.IntegerType())], run)


@dataclass(frozen=True)
class AtrSmooth:
    """Mean of a volume-weighted average close and a trailing stop at a multiple of the exponentially smoothed true range."""

    period: int = 16
    multiplier: float = 5.1
    smooth: int = 100

    def __post_init__(self):
        _whole("period", self.period, 1)
        _whole("smooth", self.smooth, 1)
        if not (math.isfinite(self.multiplier) and self.multiplier > 0):
            raise ValueError(f"multiplier must be finite and above 0, not {self.multiplier!r}")

    @property
    def halo(self) -> int:
        return max(self.smooth, 1)

    def bounded(self, df: DataFrame, lane: Lane) -> DataFrame:
        v, w = F.coalesce(F.col("volume"), F.lit(0.0)), lane.rows(self.smooth - 1)
        volume = F.sum(v).over(w)
        return df.withColumns({"true_range": true_range(lane), "vwma": F.when(volume > 0, F.sum(F.col("close") * v).over(w) / volume).otherwise(F.col("close"))})

    def carried(self, df: DataFrame, lane: Lane, also: Sequence[Step] = ()) -> DataFrame:
        # One exchange; the bars of an instrument meet in one task, as the recurrence wants. Other steps over whole instruments share it.
        df = lane_pass(df, lane, [stop_step(self.period, self.multiplier), *also], parts=False)
        price = (F.col("vwma") + F.col("stop")) * 0.5
        return df.withColumns({"reference_price": price, "reference_regime": F.col("side")}).drop("side", "true_range")


@dataclass(frozen=True)
class DarvasBox:
    """Boxes between a breakout high and the low of the bars that confirm it; the level is the middle of the box, the close before there is one."""

    length: int = 5

    def __post_init__(self):
        _whole("length", self.length, 3)

    @property
    def halo(self) -> int:
        return self.length + 1

    def bounded(self, df: DataFrame, lane: Lane) -> DataFrame:
        n, high = self.length, F.col("high")
        df = df.withColumn("_top", highest(lane, high, n))
        return df.withColumns({
            "_break": F.coalesce(high > shifted(lane, F.col("_top")), F.lit(False)),
            "_lower": F.coalesce(highest(lane, high, n - 2) < highest(lane, high, n - 1), F.lit(False)),
            "_floor": lowest(lane, F.col("low"), n),
        }).drop("_top")

    def carried(self, df: DataFrame, lane: Lane) -> DataFrame:
        at = F.col(lane.order)
        df = lane.hold(df, _high=F.when(F.col("_break"), F.col("high")), _since=F.when(F.col("_break"), at))
        confirmed = F.col("_lower") & (at - F.col("_since") == self.length - 2)
        df = lane.hold(df, box_top=F.when(confirmed, F.col("_high")), box_bottom=F.when(confirmed, F.col("_floor")))
        top, bottom, close = F.col("box_top"), F.col("box_bottom"), F.col("close")
        regime = F.when(close > top, 1).when(close < bottom, -1).otherwise(0)
        return df.withColumns({"reference_price": F.coalesce((top + bottom) * 0.5, close), "reference_regime": regime}).drop("_break", "_lower", "_floor", "_high", "_since")


@dataclass(frozen=True)
class Hma:
    """Hull moving average; the level is the close until it is there, the regime the sign of its slope."""

    period: int = 16

    def __post_init__(self):
        _whole("period", self.period, 2)

    @property
    def spans(self) -> tuple[int, int]:
        return max(1, self.period // 2), max(1, math.isqrt(self.period))

    @property
    def halo(self) -> int:
        return self.period + self.spans[1] + 1

    def bounded(self, df: DataFrame, lane: Lane) -> DataFrame:
        half, root = self.spans
        x = F.col("close")
        df = df.withColumn("_raw", wma(lane, x, half) * 2.0 - wma(lane, x, self.period)).withColumn("hma", wma(lane, F.col("_raw"), root))
        # Bars of the halo whose own look-back is cut off must not count: only bars with their full history do.
        return df.withColumn("_hma1", shifted(lane, F.col("hma"))).drop("_raw")

    def carried(self, df: DataFrame, lane: Lane) -> DataFrame:
        slope = F.coalesce(F.signum(F.col("hma") - F.col("_hma1")).cast("int"), F.lit(0))
        return df.withColumns({"reference_price": F.coalesce("hma", "close"), "reference_regime": slope}).drop("_hma1")


@dataclass(frozen=True)
class HmaAtrSmooth:
    """Both the Hull moving average and the trailing-stop level; price and regime are those of the latter."""

    hma: Hma = field(default_factory=Hma)
    atr: AtrSmooth = field(default_factory=AtrSmooth)

    @property
    def halo(self) -> int:
        return max(self.hma.halo, self.atr.halo)

    def bounded(self, df: DataFrame, lane: Lane) -> DataFrame:
        return self.atr.bounded(self.hma.bounded(df, lane).drop("_hma1"), lane)

    def carried(self, df: DataFrame, lane: Lane, also: Sequence[Step] = ()) -> DataFrame:
        return self.atr.carried(df, lane, also)
