"""Features as chart series, fixed-point listings, plain frames and streamed files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns of a listing, and the features they show.
LISTING = {
    "close": "close", "reference": "reference_price", "dir": "distance_signed", "abs": "distance_absolute", "scale": "scale", "norm": "normalized_measurement", "mean": "statistics_mean",
    "stddev": "statistics_standard_deviation", "min": "statistics_minimum", "max": "statistics_maximum", "median": "statistics_median", "mad": "statistics_mad",
}


def listing(features: DataFrame, first: int = 0, last: int | None = None, every: int = 1) -> DataFrame:
    """Fixed-point texts (five places) of every `every`-th bar from `first` to `last`, as `bar` and the columns of LISTING."""
    at = F.col("bar_index")
    df = features.filter((at >= first) & ((at <= last) if last is not None else F.lit(True)) & (at % every == 0))
    return df.select("symbol", at.alias("bar"), *[F.format_string("%.5f", F.coalesce(F.col(c), F.lit(float("nan")))).alias(n) for n, c in LISTING.items()])


def chart_series(features: DataFrame) -> DataFrame:
    """All measurements as doubles; NaN is a gap: before the first reversal its columns have gaps, then the reversal flag is 1 or 0."""
    gap = F.lit(float("nan"))
    turned = F.col("reversal_direction") != 0
    df = features.withColumns({
        "reversal_bars_since": F.coalesce(F.col("reversal_bars_since").cast("double"), gap),
        "reversal_is_bar": F.when(turned, F.col("reversal_is_bar").cast("double")).otherwise(gap),
        "reversal_direction": F.when(turned, F.col("reversal_direction").cast("double")).otherwise(gap),
    })
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.coalesce(c, gap) for c in doubles})


def terminal_buffers(features: DataFrame) -> DataFrame:
    """The four lines of a terminal's buffers."""
    return features.select("symbol", "bar_index", *[F.col(c).cast("double").alias(n) for n, c in (("reference", "reference_price"), ("distance", "distance_signed"), ("scale", "scale"), ("normalized", "normalized_measurement"))])


def to_pandas(features: DataFrame) -> pd.DataFrame:
    """Features in memory, in order. For results that fit there."""
    return features.orderBy("symbol", "bar_index").toPandas()


def to_dicts(features: DataFrame) -> list[dict]:
    return [r.asDict() for r in features.orderBy("symbol", "bar_index").collect()]


def stream_csv(rows: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Append a streaming DataFrame to CSV files under `path`; what was written is not written again after a restart."""
    w = rows.writeStream.format("csv").option("header", True).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()
