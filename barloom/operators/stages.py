"""Stages over a published reference level: distance, scale, normalization, reversal, segments, box distances and HMA geometry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.lanes import Lane, shifted


class Scale(Protocol):
    """A scale of your own: implement these and pass it to a plan."""

    halo: int

    def bounded(self, df: DataFrame, lane: Lane) -> DataFrame: ...


@dataclass(frozen=True)
class MeanTrueRange:
    """`scale`: mean true range of the last `period` bars, the first bar's left out; the close at the first bar."""

    period: int = 14

    @property
    def halo(self) -> int:
        return self.period + 1

    def bounded(self, df: DataFrame, lane: Lane) -> DataFrame:
        before = shifted(lane, F.col("close"))
        tr = F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
        df = df.withColumn("_tr", tr)
        return df.withColumn("scale", F.coalesce(F.avg("_tr").over(lane.rows(self.period - 1)), F.col("close"))).drop("_tr")


def plain_distance(close: Column, reference: Column) -> Column:
    """Signed distance of the close from the level."""
    return close - reference


def in_scales(absolute: Column, scale: Column) -> Column:
    """The absolute distance in units of `scale`, null where that is not above 0."""
    return F.when(scale > 0, absolute / scale)


def distances(df: DataFrame, distance: Callable[[Column, Column], Column] = plain_distance, normalize: Callable[[Column, Column], Column] = in_scales) -> DataFrame:
    """Signed and absolute distance of the close from the level, and the absolute one in units of `scale`."""
    signed = distance(F.col("close"), F.col("reference_price"))
    df = df.withColumns({"distance_signed": signed, "distance_absolute": F.abs(signed)})
    return df.withColumn("normalized_measurement", normalize(F.col("distance_absolute"), F.col("scale")))


def reversals(df: DataFrame, lane: Lane, by_close: bool = False) -> DataFrame:
    """Reversal flag, direction (0 before the first) and bars since (null before the first).

    A reversal is a change of regime, or with `by_close` of the side of the level that the close is on (on the level counts as above).
    """
    state = F.when(F.col("distance_signed") >= 0, 1).otherwise(-1) if by_close else F.col("reference_regime")
    df = lane.back(df.withColumn("_now", state), _before=F.col("_now"))
    turned = F.coalesce(F.col("_now") != F.col("_before"), F.lit(False))
    df = df.withColumn("reversal_is_bar", turned)
    at = F.col(lane.order)
    df = lane.hold(df, _turn=F.when(F.col("reversal_is_bar"), at), _way=F.when(F.col("reversal_is_bar"), F.signum(F.col("_now") - F.col("_before")).cast("int")))
    return df.withColumns({"reversal_bars_since": (at - F.col("_turn")).cast("int"), "reversal_direction": F.coalesce("_way", F.lit(0))}).drop("_now", "_before", "_turn", "_way")


def segments(df: DataFrame, lane: Lane, strict: bool = False) -> DataFrame:
    """Regime segments: regime, id from 0, start, age, and the transition (-1, 1) at a flip.

    The first regime establishes a segment without transition; before it all are null, the transition 0. A regime that falls back to 0 afterwards breaks the contract of
    sources: the segment columns are null there, `quality` reports it, and with `strict` reading the bar fails.
    """
    df = lane.back(df, _before=F.col("reference_regime"))
    now, before = F.col("reference_regime"), F.coalesce("_before", F.lit(0))
    starts = (now != 0) & (now != before)
    df = df.withColumn("_starts", starts)
    df = lane.running(df, _n=F.when(F.col("_starts"), 1).otherwise(0))
    df = lane.hold(df, _start=F.when(F.col("_starts"), F.col(lane.order)))
    within = lambda c: F.when(now != 0, c.cast("int"))
    regime = within(now)
    if strict:
        fell = F.concat(F.lit("rule broken: segment_contract, regime 0 after it was established, at bar "), F.col(lane.order).cast("string"))
        regime = F.when((now == 0) & (F.col("_n") > 0), F.raise_error(fell).cast("int")).otherwise(regime)
    return df.withColumns({
        "segment_regime": regime,
        "segment_id": within(F.col("_n") - 1),
        "segment_start_index": within(F.col("_start")),
        "segment_age": within(F.col(lane.order) - F.col("_start")),
        "segment_transition": F.when(F.col("_starts") & (before != 0), now).otherwise(0).cast("int"),
    }).drop("_before", "_starts", "_n", "_start")


def box_distances(df: DataFrame) -> DataFrame:
    """Distance of the close from the box: beyond its top or bottom, 0 within and on it, null without a box."""
    top, bottom, close = F.col("box_top"), F.col("box_bottom"), F.col("close")
    signed = F.when(top.isNull(), None).when(close > top, close - top).when(close < bottom, close - bottom).otherwise(0.0)
    return df.withColumns({"darvas_has_box": top.isNotNull(), "darvas_signed_closing_distance": signed}).withColumn("darvas_absolute_closing_distance", F.abs("darvas_signed_closing_distance"))


def rolling_mean(df: DataFrame, lane: Lane, x: Column, out: str, n: int) -> DataFrame:
    """Mean of the last `n` available values of `x`, which has nulls only before its first value; null before that.

    In a lane of parts the frame reaches into the part before by a halo of its own.
    """
    if not lane.part_bars:
        return df.withColumn(out, F.avg(x).over(lane.rows(n - 1)))
    lane2 = Lane(lane.key, lane.order, lane.part_bars)
    inner = df.withColumn("_mean_of", x).drop("_lane_part")
    opened = lane2.open(inner, n)
    return lane2.close(opened.withColumn(out, F.avg("_mean_of").over(lane2.rows(n - 1)))).drop("_mean_of")


def hma_geometry(df: DataFrame, lane: Lane, n: int = 20) -> DataFrame:
    """Relation of HMA, trailing-stop level and close: mean distance, separation in units of scale, relative position of the close, alignment.

    Null (alignment 0) while the HMA is not there; the position is null and the alignment 0 where both levels are equal, the alignment also where the close is on the level.
    """
    hma, atr, close = F.col("hma"), F.col("reference_price"), F.col("close")
    df = rolling_mean(df, lane, hma - atr, "mean_hma_atrsmooth_distance", n)
    same = F.when(hma.isNull() | (hma == atr) | (close == atr), 0).when((hma > atr) == (close > atr), 1).otherwise(-1)
    return df.withColumns({
        "hma_price_atrsmooth_alignment": same,
        "hma_atrsmooth_separation": F.when(F.col("scale") > 0, (hma - atr) / F.col("scale")),
        "hma_atrsmooth_relative_close_position": F.when(hma != atr, (close - atr) / (hma - atr)),
    })


def box_exits(df: DataFrame, lane: Lane) -> DataFrame:
    """`is_box_exit`: a reversal bar that leaves regime 0 for 1 or -1."""
    df = lane.back(df, _before=F.col("reference_regime"))
    return df.withColumn("is_box_exit", F.coalesce(F.col("reversal_is_bar") & (F.col("_before") == 0) & (F.col("reference_regime") != 0), F.lit(False))).drop("_before")
