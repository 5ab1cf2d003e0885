"""Made-up bars for tests and trials: a seeded walk, a ramp, a flat line. Every row follows from its index, so they are made in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _bars(df: DataFrame, close: Column, spread: float, volume: float, symbol: str) -> DataFrame:
    return df.select(
        F.lit(symbol).alias("symbol"), F.col("id").cast("int").alias("bar_index"), F.timestamp_seconds(F.lit(1_577_836_800) + F.col("id") * 3600).alias("ts"),
        close.alias("open"), (close + spread).alias("high"), (close - spread).alias("low"), close.alias("close"), F.lit(volume).alias("volume"),
    )


def walk(spark: SparkSession, n: int, seed: int = 42, start: float = 100.0, step: float = 4.0, symbol: str = "walk") -> DataFrame:
    """A walk that is bounded by design: waves of several lengths and a hashed jitter of up to half a step."""
    i = F.col("id")
    jitter = (F.pmod(F.xxhash64(F.lit(seed), i), F.lit(10_000)) / 10_000 - 0.5) * step
    return _bars(spark.range(n), F.lit(start) + F.sin(i / 17) * step * 2 + F.sin(i / 211) * step * 5 + jitter, 0.5, 100.0, symbol)


def ramp(spark: SparkSession, n: int, start: float = 100.0, step: float = 2.0, symbol: str = "ramp") -> DataFrame:
    return _bars(spark.range(n), F.lit(start) + F.col("id") * step, 0.5, 100.0, symbol)


def flat(spark: SparkSession, n: int, price: float = 100.0, symbol: str = "flat") -> DataFrame:
    return _bars(spark.range(n), F.lit(float(price)), 0.0, 100.0, symbol)


def minute_of(index: str) -> Column:
    """Times of one-minute bars from the first of January 2020, for which the first calendar year has 527,040."""
    return F.timestamp_seconds(F.lit(1_577_836_800) + F.col(index) * 60)


def capture_fields() -> list[Column]:
    """Bars as the fields of a strict capture, times with seven places."""
    token = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0Z'")
    return [token.alias("OpenTimeUtc"), *[F.col(c).alias(n) for c, n in (("open", "Open"), ("high", "High"), ("low", "Low"), ("close", "Close"), ("volume", "TickVolume"))]]
