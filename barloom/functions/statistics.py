"""Rolling statistics over the last closes or returns: expressions by name, with the least number of observations each needs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Statistic:
    """A rolling statistic: `build(x, frame)` over a frame, or `of_sorted(values, median)` of the frame's values in order and their median.

    `least` observations; `gaps` if it can be undefined beyond these (then the last value is kept).
    """

    name: str
    least: int
    build: Callable[[Column, WindowSpec], Column] | None = None
    gaps: bool = False
    of_sorted: Callable[[Column, Column], Column] | None = None
    standard: bool = False


def _skewness(x: Column, w: WindowSpec) -> Column:
    """Adjusted Fisher-Pearson skewness; null for equal observations."""
    n = F.count(x).over(w).cast("double")
    return F.when(F.min(x).over(w) < F.max(x).over(w), F.try_divide(F.skewness(x).over(w) * F.sqrt(n * (n - 1)), n - 2))


def _kurtosis(x: Column, w: WindowSpec) -> Column:
    """Adjusted excess kurtosis; null for equal observations."""
    n = F.count(x).over(w).cast("double")
    return F.when(F.min(x).over(w) < F.max(x).over(w), F.try_divide(((n + 1) * F.kurtosis(x).over(w) + 6) * (n - 1), (n - 2) * (n - 3)))


def middle(sorted_: Column) -> Column:
    """Median of a sorted array; the mean of the two in the middle if their number is even."""
    n = F.size(sorted_)
    return (F.get(sorted_, ((n - 1) / 2).cast("int")) + F.get(sorted_, (n / 2).cast("int"))) / 2


STATISTICS: dict[str, Statistic] = {
    s.name: replace(s, standard=True)
    for s in (
        Statistic("mean", 1, lambda x, w: F.avg(x).over(w)),
        Statistic("median", 1, of_sorted=lambda values, median: median),
        Statistic("minimum", 1, of_sorted=lambda values, median: F.get(values, F.lit(0))),
        Statistic("maximum", 1, of_sorted=lambda values, median: F.get(values, F.size(values) - 1)),
        Statistic("range", 1, of_sorted=lambda values, median: F.get(values, F.size(values) - 1) - F.get(values, F.lit(0))),
        Statistic("mad", 1, of_sorted=lambda values, median: middle(F.sort_array(F.transform(values, lambda v: F.abs(v - median))))),
        Statistic("variance", 2, lambda x, w: F.var_samp(x).over(w)),
        Statistic("standard_deviation", 2, lambda x, w: F.stddev_samp(x).over(w)),
        Statistic("skewness", 3, _skewness, gaps=True),
        Statistic("kurtosis", 4, _kurtosis, gaps=True),
    )
}


def register(statistic: Statistic) -> None:
    """Add a statistic of your own; its column is named `statistics_<name>`."""
    STATISTICS[statistic.name] = statistic
