"""The queries of the core, by name: each takes a session and the folder of the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import feature_queries, repair_sql, source_queries
from barloom.common import cut, table
from barloom.pipeline import change_feed, regrid, schema_drift, spikes, timestamps


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return change_feed.book_at_end(table(spark, sf, "eurusd_quotes"))


def p1_tombstones(spark: SparkSession, sf: str) -> DataFrame:
    """Entries that are not in the book any more, with the greatest sequence that named them."""
    return change_feed.published_book(table(spark, sf, "eurusd_quotes")).filter("NOT live").select("session_id", "symbol_id", "side", "entry_id", "msg_seq")


def p1_state(spark: SparkSession, sf: str) -> DataFrame:
    """The book at the end of every session with price and size."""
    return change_feed.book_at_end(table(spark, sf, "eurusd_quotes"), payload=["price", "size"])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    t = timestamps.table_times(table(spark, sf, "registry"), table(spark, sf, "bars"), table(spark, sf, "eurusd_quotes"), table(spark, sf, "recorders"))
    return t.filter("NOT plain AND utc_us IS NOT NULL").select("source_table", "row_id", "utc_us")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return schema_drift.drift(table(spark, sf, "capture_lines"), table(spark, sf, "registry"), table(spark, sf, "recorders"))


def p3_bars(spark: SparkSession, sf: str) -> DataFrame:
    return schema_drift.bar_table(table(spark, sf, "capture_lines"), table(spark, sf, "registry"), table(spark, sf, "recorders"))


def p3_bar_values(spark: SparkSession, sf: str) -> DataFrame:
    """The bar table with the number of remaining fields and the failed columns as text, as they are compared."""
    rows = p3_bars(spark, sf)
    return rows.select(*[c for c in rows.columns if c not in ("others", "failed")], F.size("others").alias("n_others"), F.concat_ws(",", "failed").alias("failed"))


def p3_types(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "capture_lines")
    heads = cut(schema_drift.headers(lines), "headers")
    return schema_drift.type_statistics(schema_drift.cells(lines, heads), heads)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return spikes.implausible(table(spark, sf, "ticks"), table(spark, sf, "bars")).select("source_table", "row_id")


def p4_unusual(spark: SparkSession, sf: str) -> DataFrame:
    """Half hours in which a symbol moved more than its daily profile has it."""
    return spikes.unusual_tick_hours(table(spark, sf, "ticks"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return regrid.regular_grid(table(spark, sf, "ticks"), table(spark, sf, "instruments")).filter("status <> 'observed'").select("symbol", "slot_s")


def p5_grid(spark: SparkSession, sf: str) -> DataFrame:
    return regrid.regular_grid(table(spark, sf, "ticks"), table(spark, sf, "instruments"))


def p5_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Every period with its status, and the readings of the observed ones."""
    seen = F.col("status") == "observed"
    return p5_grid(spark, sf).select("symbol", "slot_s", "status", *[F.when(seen, F.col(c)).alias(c) for c in ("bid", "ask")])


PIPELINE: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_state, p1_tombstones, p2_found, p3_found, p3_bars, p3_bar_values, p3_types, p4_found, p4_unusual, p5_found, p5_grid, p5_periods)
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return PIPELINE | feature_queries.QUERIES | source_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return feature_queries.SQL | repair_sql.SQL | source_queries.SQL
