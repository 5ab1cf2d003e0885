"""Captured bars in delimited text: strict reading, schema detection, a permissive reader, and readers of in-memory series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.common import hadoop_path

# Headers of the three capture schemas, and the names that a data frame's columns may have.
HEADERS = {
    "recorder_v1": "OpenTimeUtc,Open,High,Low,Close,TickVolume",
    "recorder_v1_1": "OpenTimeUtc,Open,High,Low,Close,TickVolume,Spread",
    "fixture_v1": "DateTime,Open,High,Low,Close,Volume",
}
ALIASES = {"open": ["open", "o"], "high": ["high", "h"], "low": ["low", "l"], "close": ["close", "c", "price"], "volume": ["volume", "vol", "v"]}
TIME_NAMES = ["datetime", "timestamp", "time", "date", "ts"]

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,7})?(Z|\+00:00)?$"


def detect_schema(header: str) -> str | None:
    """The schema whose header `header` is, to the letter; None if it is no known one."""
    return next((n for n, h in HEADERS.items() if h == header), None)


def strict_lines(spark: SparkSession, path: str) -> DataFrame:
    """`line_no` from 1 and `text` of the lines of captures, and their `path`. A line that is not UTF-8 fails when it is read, an empty file at once.

    Files are split over tasks; lines are numbered by their place in their block and the lines of the blocks before it, a row a block.
    """
    pattern, fs = hadoop_path(spark, path)
    for found in fs.globStatus(pattern) or []:
        for f in fs.listStatus(found.getPath()) if found.isDirectory() else [found]:
            if f.isFile() and f.getLen() == 0 and f.getPath().getName()[0] not in "._":
                raise ValueError(f"no header: {f.getPath()} is empty")
    raw = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = raw.groupBy("path", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).select("path", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    text = F.expr("CASE WHEN is_valid_utf8(text) THEN text ELSE raise_error(concat('not UTF-8: ', path)) END")
    return raw.join(blocks, ["path", "block"]).select("path", (F.col("id") - F.col("first") + F.col("before") + 1).cast("int").alias("line_no"), F.rtrim(text, F.lit("\r")).alias("text"))


def _demand(ok: Column, value: Column, what: str) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.concat(F.lit(f"{what} in line "), F.col("line_no").cast("string"))))


def read_strict(spark: SparkSession, path: str) -> DataFrame:
    """Bars of captures, their source tokens beside the typed columns: path, line_no, t_<field> as written, ts, open, high, low, close, volume, spread.

    Fails on an unknown header, a wrong number of fields, an empty row or field, quotes, a bad time or number, and a spread that is negative or not finite; volume and
    prices must be finite. Times keep their seventh digit in the token only. An empty file has no header and fails.
    """
    lines = strict_lines(spark, path)
    heads = lines.filter("line_no = 1").select("path", "text")
    names = F.create_map(*[F.lit(x) for n, h in HEADERS.items() for x in (h, n)])
    schema = F.element_at(names, F.col("text"))
    heads = heads.select("path", F.when(schema.isNotNull(), schema).otherwise(F.raise_error(F.concat(F.lit("unknown header: "), "text"))).alias("schema"), F.size(F.split("text", ",")).alias("width"))
    rows = lines.filter("line_no > 1").join(heads, "path")
    fields = F.split("text", ",", -1)
    whole = (F.size(fields) == F.col("width")) & ~F.col("text").contains('"') & ~F.array_contains(fields, "")
    rows = rows.select("path", "schema", "line_no", _demand(whole, fields, "wrong, empty or quoted fields").alias("f"))
    token = {n: F.get("f", F.lit(i)) for i, n in enumerate(("time", "open", "high", "low", "close", "volume"))}
    token["spread"] = F.when(F.col("schema") == "recorder_v1_1", F.get("f", F.lit(6)))
    number = lambda n: _demand(token[n].rlike(_NUMBER), token[n].try_cast("double"), f"bad {n}")
    time = F.try_to_timestamp(F.concat(F.regexp_replace(F.regexp_replace(token["time"], r"(Z|\+00:00)$", ""), r"(\.\d{6})\d$", "$1"), F.lit("Z")))
    spread = F.when(token["spread"].isNotNull(), _demand(token["spread"].rlike(_NUMBER) & (token["spread"].try_cast("double") >= 0), token["spread"].try_cast("double"), "bad spread"))
    return rows.select(
        "path", "schema", "line_no", *[t.alias(f"t_{n}") for n, t in token.items()],
        _demand(token["time"].rlike(_TIME) & time.isNotNull(), time, "bad time").alias("ts"), *[number(n).alias(n) for n in ("open", "high", "low", "close", "volume")], spread.alias("spread"),
    )


def read_permissive(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Bars of a delimited file with six or more columns (time, open, high, low, close, volume); the header is skipped, surplus columns are ignored, what does not parse is null."""
    names = ["_time", "open", "high", "low", "close", "volume"]
    raw = spark.read.csv(path, sep=sep, header=True, inferSchema=False, mode="PERMISSIVE")
    if len(raw.columns) < 6:
        raise ValueError(f"{path} has {len(raw.columns)} columns, not six")
    df = raw.toDF(*[names[i] if i < 6 else f"_{i}" for i in range(len(raw.columns))])
    return df.select(F.expr("try_to_timestamp(_time)").alias("ts"), *[F.expr(f"try_cast({c} AS double)").alias(c) for c in names[1:]])


def resolve_columns(names: Sequence[str], column_map: Mapping[str, str] | None = None) -> dict[str, str]:
    """The column of each of open, high, low, close, volume: the mapped one, or by alias in any case. KeyError for one that is not there."""
    lower = {str(n).lower(): n for n in reversed(list(names))}
    out = {}
    for field, aliases in ALIASES.items():
        wanted = (column_map or {}).get(field)
        hit = (wanted if wanted in names else None) if wanted is not None else next((lower[a] for a in aliases if a in lower), None)
        if hit is None:
            raise KeyError(f"no column for {field}" + (f" named {wanted}" if wanted else ""))
        out[field] = hit
    return out


def from_pandas(spark: SparkSession, pdf: pd.DataFrame, symbol: str = "series", column_map: Mapping[str, str] | None = None) -> DataFrame:
    """Bars of a pandas frame, in its order. Time is a column of a usual name in any case, else a DatetimeIndex, else null. ValueError for an empty frame."""
    if pdf.empty:
        raise ValueError("no rows")
    cols = resolve_columns(list(pdf.columns), column_map)
    at = next((c for n in TIME_NAMES for c in pdf.columns if str(c).lower() == n), None)
    ts = pd.to_datetime(pdf[at], utc=True) if at is not None else pd.Series(pdf.index, index=pdf.index).pipe(pd.to_datetime, utc=True) if isinstance(pdf.index, pd.DatetimeIndex) else None
    return from_arrays(spark, *[pdf[cols[c]].astype(float).tolist() for c in ("open", "high", "low", "close", "volume")], ts=None if ts is None else ts.tolist(), symbol=symbol)


def from_arrays(spark: SparkSession, open: Sequence[float], high: Sequence[float], low: Sequence[float], close: Sequence[float], volume: Sequence[float] | None = None, ts: Sequence | None = None, symbol: str = "series") -> DataFrame:
    """Bars of equal-length arrays, in order; missing times and volumes are null."""
    n = len(close)
    for name, x in (("open", open), ("high", high), ("low", low), ("volume", volume), ("ts", ts)):
        if x is not None and len(x) != n:
            raise ValueError(f"{name} has {len(x)} values, close has {n}")
    pdf = pd.DataFrame({
        "symbol": symbol, "bar_index": range(n), "ts": pd.Series(pd.to_datetime(list(ts), utc=True) if ts is not None else [pd.NaT] * n, dtype="datetime64[ns, UTC]"),
        "open": open, "high": high, "low": low, "close": close, "volume": volume if volume is not None else [None] * n,
    })
    schema = "symbol string, bar_index int, ts timestamp, open double, high double, low double, close double, volume double"
    return spark.createDataFrame(pdf.astype({"volume": float}), schema).withColumn("volume", F.when(~F.isnan("volume"), F.col("volume")))


def from_rates(rates: DataFrame, symbol: str = "series") -> DataFrame:
    """Bars of terminal rates (time in Unix seconds, open, high, low, close, tick_volume), numbered by time; an empty table fails when read."""
    from barloom.operators.bars import numbered

    b = rates.select(F.lit(symbol).alias("symbol"), F.timestamp_seconds(F.col("time")).alias("ts"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")], F.col("tick_volume").cast("double").alias("volume"))
    return numbered(b, "symbol", ["ts"])


def materialize(bars: DataFrame, n: int, key: str = "symbol") -> DataFrame:
    """The first `n` bars of each source, kept in memory; ValueError if one has fewer."""
    kept = bars.filter(F.col("bar_index") < n).cache()
    short = kept.groupBy(key).count().filter(F.col("count") < n).limit(1).collect()
    if short:
        raise ValueError(f"{short[0][0]} has {short[0][1]} bars, not {n}")
    return kept
