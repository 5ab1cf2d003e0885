"""Rules that published values must keep: a report of violations, or a query that fails at the first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.common import free_names


def _finite(c: str) -> Column:
    x = F.col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def _finite_or_null(c: str) -> Column:
    return F.col(c).isNull() | _finite(c)


def rules(columns: list[str]) -> dict[str, Column]:
    """The rules that the columns present must keep, by name."""
    found = {
        "prices_finite": [_finite(c) for c in ("open", "high", "low", "close") if c in columns],
        "reference_finite": [_finite("reference_price")] if "reference_price" in columns else [],
        "regime_in_range": [F.col("reference_regime").isin(-1, 0, 1)] if "reference_regime" in columns else [],
        "distance_finite": [_finite("distance_signed"), F.col("distance_absolute") >= 0] if "distance_absolute" in columns else [],
        "scale_positive": [_finite("scale"), F.col("scale") > 0] if "scale" in columns else [],
        "normalized_not_negative": [_finite("normalized_measurement"), F.col("normalized_measurement") >= 0] if "normalized_measurement" in columns else [],
        "statistics_finite": [_finite_or_null(c) for c in columns if c.startswith("statistics_") and c != "statistics_observation_count"],
        "box_distance_finite": [_finite_or_null(c) for c in columns if c.startswith("darvas_") and c.endswith("distance")],
        "geometry_finite": [_finite_or_null(c) for c in ("mean_hma_atrsmooth_distance", "hma_atrsmooth_separation", "hma_atrsmooth_relative_close_position") if c in columns],
        "alignment_in_range": [F.col("hma_price_atrsmooth_alignment").isin(-1, 0, 1)] if "hma_price_atrsmooth_alignment" in columns else [],
    }
    if "segment_id" in columns:
        absent = F.col("segment_id").isNull()
        at = F.col("bar_index")
        found["segment_consistent"] = [
            absent == F.col("segment_start_index").isNull(),
            absent == F.col("segment_age").isNull(),
            absent | (F.col("segment_age") == at - F.col("segment_start_index")),
            absent | (F.col("segment_regime") == F.col("reference_regime")),
            (F.col("segment_transition") == 0) | (F.col("segment_transition") == F.col("reference_regime")),
            F.col("reference_regime").isNotNull(),
        ]
    all_true = lambda cs: F.coalesce(reduce(lambda a, b: a & b, cs), F.lit(False))
    return {n: all_true(cs) for n, cs in found.items() if cs}


def quality(df: DataFrame, key: str = "symbol") -> DataFrame:
    """rule, rows, violations: what of `df` breaks which rule.

    Besides the rules of single rows, segment_contract: once established, the regime of an instrument (`key`) does not fall back to none.
    """
    by = rules(df.columns)
    if {"segment_id", "reference_regime", key} <= set(df.columns):
        (first,) = free_names(df, ["established_at"])
        begun = df.filter(F.col("reference_regime") != 0).groupBy(key).agg(F.min("bar_index").alias(first))
        df = df.join(begun, key, "left")
        by["segment_contract"] = ~F.coalesce((F.col("reference_regime") == 0) & (F.col("bar_index") > F.col(first)), F.lit(False))
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.when(~ok, 1)).alias(n) for n, ok in by.items()])
    return counts.select("rows", F.explode(F.map_from_arrays(F.array(*map(F.lit, by)), F.array(*by))).alias("rule", "violations")).select("rule", "rows", "violations")


def strict(df: DataFrame) -> DataFrame:
    """`df`; reading a row that breaks a rule fails with the rule's name. (The contract of segments is kept by `segments` itself, which sees the bars before.)"""
    ok = F.lit(True)
    for n, rule in rules(df.columns).items():
        ok = F.when(rule, ok).otherwise(F.raise_error(F.lit(f"rule broken: {n}")).cast("boolean"))
    return df.filter(ok)
