"""Rolling statistics of closes or returns, published bar by bar."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.lanes import Lane, shifted
from barloom.common import settled
from barloom.functions.statistics import STATISTICS, middle
from barloom.operators.passes import Step, lane_pass

SOURCES = ("close", "simple_return", "log_return")


def observed(lane: Lane, source: str) -> Column:
    """What is observed at a bar: the close, or its simple or logarithmic return on the close before; null where a return has no positive closes."""
    c, before = F.col("close"), shifted(lane, F.col("close"))
    if source == "close":
        return c
    legal = (c > 0) & (before > 0)
    return F.when(legal, c / before - 1 if source == "simple_return" else F.ln(c / before))


def statistics(df: DataFrame, lane: Lane, window: int = 20, source: str = "close", names: Sequence[str] | None = None, retain: bool = True) -> DataFrame:
    """`statistics_<name>` of the last `window` observations, and their count; for closes the bar's own close comes on top of the window.

    A statistic without enough observations, or undefined, keeps its last value, 0.0 before the first; without `retain` it is null.
    Of `df` the lane must still be open; `retained` ends what carries state.
    """
    if source not in SOURCES:
        raise ValueError(f"source must be one of {SOURCES}, not {source!r}")
    picked = [STATISTICS[n] for n in (names or STATISTICS)]
    names = [s.name for s in picked]
    df = df.withColumn("_x", observed(lane, source))
    if is_wide(window, names):
        return published(lane_pass(df, lane, [wide_step(window, source, names)]), source, names, retain)
    frame = lane.rows(window if source == "close" else window - 1)
    df = df.withColumns({"statistics_observation_count": F.count("_x").over(frame).cast("int"), **{f"statistics_{s.name}": s.build(F.col("_x"), frame) for s in picked if s.build}})
    if any(s.of_sorted for s in picked):
        # The frame's values are put in order once, for all statistics of rank.
        df = df.withColumn("_values", F.sort_array(F.collect_list("_x").over(frame)))
        df = settled(df, _median=middle(F.col("_values")))
        df = df.withColumns({f"statistics_{s.name}": s.of_sorted(F.col("_values"), F.col("_median")) for s in picked if s.of_sorted}).drop("_values", "_median")
    df = df.withColumns({f"statistics_{s.name}": F.when(F.col("statistics_observation_count") >= s.least, F.col(f"statistics_{s.name}")) for s in picked})
    return published(df, source, names, retain)


def retained(df: DataFrame, lane: Lane, source: str = "close", names: Sequence[str] | None = None) -> DataFrame:
    """Carry the last published value of statistics that can be undefined in between."""
    gaps = [f"statistics_{n}" for n in (names or STATISTICS) if STATISTICS[n].gaps or source != "close"]
    return lane.hold(df, **{c: F.col(c) for c in gaps}).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in gaps}) if gaps else df


WIDE = 32  # from this window on, frames are computed as blocks of arrays: window functions visit every value of a frame for each bar and statistic


def frame_statistics(frames: np.ndarray) -> dict[str, np.ndarray]:
    """All standard statistics of each row of `frames`, NaN where it has no value or the statistic none."""
    seen = ~np.isnan(frames)
    n = seen.sum(1)
    rows = np.arange(len(frames))

    def middle_of(ordered: np.ndarray) -> np.ndarray:
        hi, lo = np.maximum(n // 2, 0), np.maximum((n - 1) // 2, 0)
        return (ordered[rows, np.minimum(hi, ordered.shape[1] - 1)] + ordered[rows, lo]) / 2

    with np.errstate(all="ignore"):
        ordered = np.sort(frames, axis=1)  # missing values come last
        median = middle_of(ordered)
        least, most = ordered[:, 0], ordered[rows, np.maximum(n - 1, 0)]
        k = n.astype(float)
        mean = np.where(seen, frames, 0.0).sum(1) / k
        d = np.where(seen, frames - mean[:, None], 0.0)
        d2 = d * d
        m2 = d2.sum(1)
        flat = ~(least < most)
        b1, b2 = (d2 * d).sum(1) / k / (m2 / k) ** 1.5, (d2 * d2).sum(1) / k / (m2 / k) ** 2
        variance = np.where(n >= 2, np.where(flat, 0.0, m2 / (k - 1)), np.nan)
        return {
            "observation_count": n, "mean": mean, "median": median, "minimum": least, "maximum": most, "range": most - least, "mad": middle_of(np.sort(np.abs(frames - median[:, None]), axis=1)),
            "variance": variance, "standard_deviation": np.sqrt(variance), "skewness": np.where((n >= 3) & ~flat, b1 * np.sqrt(k * (k - 1)) / (k - 2), np.nan),
            "kurtosis": np.where((n >= 4) & ~flat, ((k + 1) * (b2 - 3) + 6) * (k - 1) / ((k - 2) * (k - 3)), np.nan),
        }


def wide_step(window: int, source: str, names: Sequence[str]) -> Step:
    """All statistics of frames of `_x`, which `observed` gives, as window functions give them: the last values are carried from stretch to stretch."""
    width = window + 1 if source == "close" else window

    def run(inputs: list[np.ndarray], carry: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
        whole = np.concatenate([np.full(width - 1, np.nan) if carry is None else carry, inputs[0]])
        frames = np.lib.stride_tricks.sliding_window_view(whole, width)
        found = [frame_statistics(frames[i : i + 4096]) for i in range(0, len(frames), 4096)]
        out = [np.concatenate([f[n] for f in found]) for n in ("observation_count", *names)]
        return [out[0].astype(np.int32), *out[1:]], whole[len(whole) - (width - 1) :]

    return Step(["_x"], [("statistics_observation_count", T.IntegerType()), *[(f"statistics_{n}", T.DoubleType()) for n in names]], run)


def is_wide(window: int, names: Sequence[str]) -> bool:
    return window >= WIDE and all(STATISTICS[n].standard for n in names)


def published(df: DataFrame, source: str, names: Sequence[str], retain: bool = True) -> DataFrame:
    """`df` with 0.0 for statistics of closes that are not there yet, without `_x`. Closes are never missing: only the first bars lack a value."""
    first = [n for n in names if retain and source == "close" and not STATISTICS[n].gaps]
    return df.withColumns({f"statistics_{n}": F.coalesce(f"statistics_{n}", F.lit(0.0)) for n in first}).drop("_x")
