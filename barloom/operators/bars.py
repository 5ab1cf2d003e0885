"""Bars from ticks and quotes, their order, and checks of a capture as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.common import carry_last, default_chunk, free_names, with_heads


def numbered(df: DataFrame, key: str, order: list[str], out: str = "bar_index", chunk: Column | None = None) -> DataFrame:
    """Dense number of each row within `key`, from 0, by `order`. With `chunk`, an expression that does not fall along `order` (a day, say),
    rows are sorted per chunk only and counts of the chunks before are added, so that a large key is not sorted in one task.
    """
    if chunk is None:
        return df.withColumn(out, (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("int"))
    c, n = free_names(df, ["chunk_no", "rows_before"])
    df = df.withColumn(c, chunk)
    before = Window.partitionBy(key).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    heads = df.groupBy(key, c).agg(F.count(F.lit(1)).alias(n)).select(key, c, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n))
    df = with_heads(df.withColumn(out, F.row_number().over(Window.partitionBy(key, c).orderBy(*order)) - 1), heads, [key, c])
    return df.withColumn(out, (F.col(out) + F.col(n)).cast("int")).drop(c, n)


def two_sided(quotes: DataFrame, key: str | list[str], order: list[str], bid: str = "bid", ask: str = "ask", chunk: Column | None = None) -> DataFrame:
    """Ticks from one-sided quote messages: the last bid and ask are carried forward, rows before both are known are dropped. Adds `spread`.

    `key` is one column or several. Long keys are split along the first column of `order` (`chunk`, by default as default_chunk has it).
    """
    keys = [key] if isinstance(key, str) else list(key)
    chunk = default_chunk(quotes, order[0]) if chunk is None else chunk
    df = carry_last(quotes, keys, order, [bid, ask], chunk)
    return df.filter(F.col(bid).isNotNull() & F.col(ask).isNotNull()).withColumn("spread", F.col(ask) - F.col(bid))


def messages(entries: DataFrame) -> DataFrame:
    """One row per message (session_id, symbol_id, msg_seq) with the best new bid and ask among its entries, null for a side it does not quote.

    Best is the highest bid and the lowest ask; deletes and entries without price quote nothing. Rows without a key are left out.
    """
    side = F.lower(F.trim("side"))
    priced = entries.filter(~F.lower(F.trim("update")).isin("delete", "2")).dropna(subset=["session_id", "symbol_id", "msg_seq", "price"])
    return priced.groupBy("session_id", "symbol_id", "msg_seq").agg(
        F.max(F.when(side.isin("bid", "0"), F.col("price"))).alias("bid"), F.min(F.when(side.isin("ask", "offer", "1"), F.col("price"))).alias("ask")
    )


def tick_bars(ticks: DataFrame, size: int = 25, key: str = "symbol", order: tuple[str, ...] = ("ts",), price: str = "bid", spread: str | None = "spread", chunk: Column | None = None) -> DataFrame:
    """A bar of every `size` ticks: open, high, low, close of `price`, tick volume, last spread, time of the first tick. The last bar may be partial.

    `order` must be total within `key` for a defined result; ticks without price are no ticks. Ticks are numbered chunk by chunk (days of a time that comes first in `order`, or `chunk`), so that a symbol
    with much of all ticks is not sorted in one task.
    """
    if size < 1:
        raise ValueError(f"size must be at least 1, not {size!r}")
    last = F.struct(*order)
    chunk = default_chunk(ticks, order[0]) if chunk is None else chunk
    t = numbered(ticks.filter(F.col(price).isNotNull()), key, list(order), "tick_no", chunk).withColumn("bar_index", F.floor(F.col("tick_no") / size).cast("int"))
    price_ = F.col(price).cast("double")
    columns = [
        F.min(order[0]).alias("ts"), F.min_by(price_, last).alias("open"), F.max(price_).alias("high"), F.min(price_).alias("low"), F.max_by(price_, last).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    ]
    if spread:
        columns.append(F.max_by(spread, last).alias("spread"))
    return t.groupBy(key, "bar_index").agg(*columns).withColumn("is_partial", F.col("volume") < size)


def time_bars(rows: DataFrame, key: str, at: str, price: str, volume: str | None = None, every: str = "1 day", tie: tuple[str, ...] = ()) -> DataFrame:
    """Bars of equal time: open, high, low, close and volume per `every`. (Ours; sources in the field count ticks.)"""
    last = F.struct(at, *tie)
    p = F.col(price).cast("double")
    v = F.sum(F.col(volume).cast("double")) if volume else F.count(F.lit(1)).cast("double")
    b = rows.filter(F.col(price).isNotNull() & F.col(at).isNotNull()).groupBy(key, F.window(F.col(at).cast("timestamp"), every).start.alias("ts")).agg(
        F.min_by(p, last).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, last).alias("close"), v.alias("volume")
    )
    return numbered(b, key, ["ts"])


def scan_summary(bars: DataFrame, key: str = "symbol", order: str = "line_no", at: str = "ts", chunk: Column | None = None) -> DataFrame:
    """Per source: rows, first and last time in file order, equal successive times, times that fall back (a valid capture has none).

    Rows are compared chunk by chunk along `order` (`chunk`, by default as default_chunk has it); the edges of chunks, a row each, are compared afterwards.
    """
    c, before, first, last = "_chunk", "_before", "_first", "_last"
    chunk = default_chunk(bars, order) if chunk is None else chunk
    rows = bars.select(key, F.col(order).alias("_order"), F.col(at).alias("_at"), (F.lit(0).cast("long") if chunk is None else chunk).alias(c))
    rows = rows.withColumn(before, F.lag("_at").over(Window.partitionBy(key, c).orderBy("_order")))
    parts = rows.groupBy(key, c).agg(
        F.count(F.lit(1)).alias("rows"), F.min_by("_at", "_order").alias(first), F.max_by("_at", "_order").alias(last),
        F.count(F.when(F.col("_at") == F.col(before), 1)).alias("same"), F.count(F.when(F.col("_at") < F.col(before), 1)).alias("back"),
    )
    parts = parts.withColumn(before, F.lag(last).over(Window.partitionBy(key).orderBy(c)))
    return parts.groupBy(key).agg(
        F.sum("rows").alias("rows"), F.min_by(first, c).alias("first_ts"), F.max_by(last, c).alias("last_ts"),
        (F.sum("same") + F.count(F.when(F.col(first) == F.col(before), 1))).alias("duplicates"), (F.sum("back") + F.count(F.when(F.col(first) < F.col(before), 1))).alias("regressions"),
    )


def count_before(bars: DataFrame, boundary: Column, at: str = "ts", inclusive: bool = False) -> int:
    """Rows with a time before `boundary`, or up to it."""
    return bars.filter(F.col(at) <= boundary if inclusive else F.col(at) < boundary).count()


def research_window(bars: DataFrame, key: str = "symbol", at: str = "ts", holdout: bool = False) -> DataFrame:
    """Bars of each source's first calendar year, or with `holdout` those after it. A year from 29 February ends on 28 February at the same time."""
    first = bars.groupBy(key).agg((F.min(at) + F.expr("INTERVAL 1 YEAR")).alias("_end"))
    inside = F.col(at) < F.col("_end")
    return bars.join(first, key).filter(~inside if holdout else inside).drop("_end")
