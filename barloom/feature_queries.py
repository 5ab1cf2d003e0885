"""Queries of the feature operators over bars made from the test tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.common import table
from barloom.functions.lanes import Lane
from barloom.operators import bars as bar_ops
from barloom.operators import checks, stages
from barloom.plans import FeaturePlan, atr_smooth, darvas_box, hma, hma_atr_smooth
from barloom.sinks import series
from barloom.streaming.live import replay_all

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TICKS = 5  # ticks a bar
WINDOW = 20
NUDGE = 1.234567e-7  # added before rounding, on both sides: means of prices in cents lie on the ties of any number of places, where the last bit would decide


def event_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Tick bars of the events: a symbol is an event type, a price its value."""
    t = table(spark, sf, "events").select(F.col("event_type").alias("symbol"), "ts", "event_id", "value")
    return bar_ops.tick_bars(t, TICKS, order=("ts", "event_id"), price="value", spread=None)


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select("symbol", "bar_index", *[F.round(F.col(c) + NUDGE, places).alias(c) if kinds[c] == "double" else F.col(c) for c in columns])


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# The SQL, in parts that build on each other.
OVER = "PARTITION BY symbol ORDER BY bar_index"
UPTO = f"({OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
BARS = f"""ticks_ AS (SELECT event_type AS symbol, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n FROM events WHERE value IS NOT NULL),
bars_ AS (SELECT symbol, CAST(n // {TICKS} AS INTEGER) AS bar_index, min(ts) AS ts, CAST(arg_min(value, n) AS DOUBLE) AS open, CAST(max(value) AS DOUBLE) AS high,
 CAST(min(value) AS DOUBLE) AS low, CAST(arg_max(value, n) AS DOUBLE) AS close, CAST(count(*) AS DOUBLE) AS volume FROM ticks_ GROUP BY 1, 2)"""
RANGES = f"""lagged_ AS (SELECT *, lag(close) OVER ({OVER}) AS close1 FROM bars_),
ranges_ AS (SELECT *, CASE WHEN close1 IS NULL THEN high - low ELSE greatest(high - low, abs(high - close1), abs(low - close1)) END AS tr FROM lagged_),
scaled_ AS (SELECT *, coalesce(avg(CASE WHEN close1 IS NOT NULL THEN tr END) OVER ({OVER} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), close) AS scale FROM ranges_)"""
BOX = f"""w1_ AS (SELECT *, CASE WHEN bar_index >= 4 THEN max(high) OVER ({OVER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS top5,
 CASE WHEN bar_index >= 2 THEN max(high) OVER ({OVER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS top3,
 CASE WHEN bar_index >= 3 THEN max(high) OVER ({OVER} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END AS top4,
 CASE WHEN bar_index >= 4 THEN min(low) OVER ({OVER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS low5 FROM scaled_),
w2_ AS (SELECT *, lag(top5) OVER ({OVER}) AS top5_1 FROM w1_),
w3_ AS (SELECT *, last_value(CASE WHEN high > top5_1 THEN high END IGNORE NULLS) OVER {UPTO} AS broke,
 last_value(CASE WHEN high > top5_1 THEN bar_index END IGNORE NULLS) OVER {UPTO} AS broke_at FROM w2_),
w4_ AS (SELECT *, coalesce(top3 < top4 AND bar_index - broke_at = 3, false) AS confirmed FROM w3_),
w5_ AS (SELECT *, last_value(CASE WHEN confirmed THEN broke END IGNORE NULLS) OVER {UPTO} AS box_top, last_value(CASE WHEN confirmed THEN low5 END IGNORE NULLS) OVER {UPTO} AS box_bottom FROM w4_),
level_ AS (SELECT *, coalesce((box_top + box_bottom) * 0.5, close) AS reference_price,
 CASE WHEN close > box_top THEN 1 WHEN close < box_bottom THEN -1 ELSE 0 END AS reference_regime FROM w5_)"""


def _wma(x: str, n: int) -> str:
    return "(" + " + ".join(f"{x} * {n}.0" if k == 0 else f"lag({x}, {k}) OVER ({OVER}) * {n - k}.0" for k in reversed(range(n))) + f") / {n * (n + 1) / 2}"


def hull_sql(source: str, into: str) -> str:
    return f"""raw_ AS (SELECT *, {_wma('close', 8)} * 2.0 - {_wma('close', 16)} AS raw FROM {source}),
{into} AS (SELECT *, {_wma('raw', 4)} AS hma FROM raw_)"""


HULL = hull_sql("scaled_", "hull_") + f""",
level_ AS (SELECT *, coalesce(hma, close) AS reference_price, CAST(coalesce(sign(hma - lag(hma) OVER ({OVER})), 0) AS INTEGER) AS reference_regime FROM hull_)"""


def stop_sql(multiplier: float, source: str = "scaled_", smooth: int = 100) -> str:
    a = 2 / 17
    return f"""stops_(symbol, bar_index, mean, stop, close) AS (
 SELECT symbol, bar_index, tr, close + {multiplier} * tr, close FROM {source} WHERE bar_index = 0
 UNION ALL
 SELECT b.symbol, b.bar_index, {a!r} * b.tr + {1 - a!r} * s.mean,
  CASE WHEN b.close > s.stop AND s.close > s.stop THEN greatest(s.stop, b.close - {multiplier} * ({a!r} * b.tr + {1 - a!r} * s.mean))
   WHEN b.close < s.stop AND s.close < s.stop THEN least(s.stop, b.close + {multiplier} * ({a!r} * b.tr + {1 - a!r} * s.mean))
   WHEN b.close > s.stop THEN b.close - {multiplier} * ({a!r} * b.tr + {1 - a!r} * s.mean) ELSE b.close + {multiplier} * ({a!r} * b.tr + {1 - a!r} * s.mean) END, b.close
 FROM stops_ s JOIN {source} b ON b.symbol = s.symbol AND b.bar_index = s.bar_index + 1),
stopped_ AS (SELECT b.*, s.stop, lag(s.stop) OVER (PARTITION BY b.symbol ORDER BY b.bar_index) AS stop1,
 sum(b.volume) OVER (PARTITION BY b.symbol ORDER BY b.bar_index ROWS BETWEEN {smooth - 1} PRECEDING AND CURRENT ROW) AS vol,
 sum(b.close * b.volume) OVER (PARTITION BY b.symbol ORDER BY b.bar_index ROWS BETWEEN {smooth - 1} PRECEDING AND CURRENT ROW) AS worth
 FROM {source} b JOIN stops_ s ON b.symbol = s.symbol AND b.bar_index = s.bar_index),
level_ AS (SELECT *, (CASE WHEN vol > 0 THEN worth / vol ELSE close END + stop) * 0.5 AS reference_price,
 coalesce(last_value(CASE WHEN close1 < stop1 AND close > stop1 THEN 1 WHEN close1 > stop1 AND close < stop1 THEN -1 END IGNORE NULLS) OVER {UPTO}, 0) AS reference_regime FROM stopped_)"""


DISTANCE = """dist_ AS (SELECT *, close - reference_price AS distance_signed, abs(close - reference_price) AS distance_absolute,
 CASE WHEN scale > 0 THEN abs(close - reference_price) / scale END AS normalized_measurement FROM level_)"""


def reversal_sql(state: str) -> str:
    return f"""now_ AS (SELECT *, {state} AS now FROM dist_),
before_ AS (SELECT *, lag(now) OVER ({OVER}) AS before FROM now_),
turned_ AS (SELECT *, coalesce(now <> before, false) AS reversal_is_bar FROM before_),
reversed_ AS (SELECT *, bar_index - last_value(CASE WHEN reversal_is_bar THEN bar_index END IGNORE NULLS) OVER {UPTO} AS reversal_bars_since,
 coalesce(last_value(CASE WHEN reversal_is_bar THEN CASE WHEN now > before THEN 1 ELSE -1 END END IGNORE NULLS) OVER {UPTO}, 0) AS reversal_direction FROM turned_)"""


SEGMENTS = f"""seg1_ AS (SELECT *, coalesce(lag(reference_regime) OVER ({OVER}), 0) AS regime1 FROM dist_),
seg2_ AS (SELECT *, reference_regime <> 0 AND reference_regime <> regime1 AS starts FROM seg1_),
seg_ AS (SELECT *, CASE WHEN reference_regime <> 0 THEN CAST(sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER {UPTO} - 1 AS INTEGER) END AS segment_id,
 CASE WHEN reference_regime <> 0 THEN last_value(CASE WHEN starts THEN bar_index END IGNORE NULLS) OVER {UPTO} END AS segment_start_index,
 CASE WHEN starts AND regime1 <> 0 THEN reference_regime ELSE 0 END AS segment_transition FROM seg2_)"""


def select(columns: list[str], source: str, *parts: str, doubles: set[str] = frozenset(), recursive: bool = False) -> str:
    shown = ", ".join(f"round({c} + {NUDGE}, 6) AS {c}" if c in doubles else c for c in columns)
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} SELECT symbol, bar_index, {shown} FROM {source}"


LEVEL = ["reference_price", "reference_regime", "distance_signed", "distance_absolute", "scale", "normalized_measurement"]
D = {"reference_price", "distance_signed", "distance_absolute", "scale", "normalized_measurement", "stop", "vwma", "hma"}
REVERSAL = ["reversal_bars_since", "reversal_direction", "reversal_is_bar"]


def _plan_query(name: str, plan: FeaturePlan, columns: list[str], sql: str | None) -> None:
    query(name, sql)(lambda spark, sf, p=plan, c=tuple(columns): rounded(p.apply(event_bars(spark, sf)), *c))


_plan_query("f_box_levels", darvas_box(), LEVEL, select(LEVEL, "dist_", BARS, RANGES, BOX, DISTANCE, doubles=D))
_plan_query("f_hull_levels", hma(), LEVEL, select(LEVEL, "dist_", BARS, RANGES, HULL, DISTANCE, doubles=D))
_plan_query("f_trailing_levels", atr_smooth(), LEVEL, select(LEVEL, "dist_", BARS, RANGES, stop_sql(5.1), DISTANCE, doubles=D, recursive=True))
_plan_query("f_trailing_levels_close", atr_smooth(multiplier=1.0), LEVEL, select(LEVEL, "dist_", BARS, RANGES, stop_sql(1.0), DISTANCE, doubles=D, recursive=True))
# Lanes in parts must give what whole lanes give.
_plan_query("f_trailing_levels_in_parts", atr_smooth(multiplier=1.0, part_bars=150), LEVEL, SQL["f_trailing_levels_close"])
_plan_query("f_box_levels_in_parts", darvas_box(part_bars=64), LEVEL, SQL["f_box_levels"])
_plan_query("f_reversals", atr_smooth(multiplier=1.0), REVERSAL, select(REVERSAL, "reversed_", BARS, RANGES, stop_sql(1.0), DISTANCE, reversal_sql("reference_regime"), recursive=True))
_plan_query("f_reversals_by_close", hma(reversal_by_close=True), REVERSAL, select(REVERSAL, "reversed_", BARS, RANGES, HULL, DISTANCE, reversal_sql("CASE WHEN distance_signed >= 0 THEN 1 ELSE -1 END")))
_SEG = ["segment_id", "segment_start_index", "segment_transition"]
_plan_query("f_segments", atr_smooth(multiplier=1.0), _SEG, select(_SEG, "seg_", BARS, RANGES, stop_sql(1.0), DISTANCE, SEGMENTS, recursive=True))

_BOXED = ["darvas_has_box", "darvas_signed_closing_distance", "darvas_absolute_closing_distance", "darvas_mean_signed_distance"]
BOX_DISTANCE = """boxed_ AS (SELECT *, box_top IS NOT NULL AS darvas_has_box,
 CASE WHEN box_top IS NULL THEN NULL WHEN close > box_top THEN close - box_top WHEN close < box_bottom THEN close - box_bottom ELSE 0.0 END AS darvas_signed_closing_distance FROM dist_),
boxed2_ AS (SELECT *, abs(darvas_signed_closing_distance) AS darvas_absolute_closing_distance,
 avg(darvas_signed_closing_distance) OVER (PARTITION BY symbol ORDER BY bar_index ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS darvas_mean_signed_distance FROM boxed_)"""
_plan_query("f_box_distances", darvas_box(), _BOXED, select(_BOXED, "boxed2_", BARS, RANGES, BOX, DISTANCE, BOX_DISTANCE, doubles=set(_BOXED[1:])))

_GEO = ["mean_hma_atrsmooth_distance", "hma_price_atrsmooth_alignment", "hma_atrsmooth_separation", "hma_atrsmooth_relative_close_position"]
GEOMETRY = f"""geo_ AS (SELECT *, avg(hma - reference_price) OVER ({OVER} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS mean_hma_atrsmooth_distance,
 CASE WHEN hma IS NULL OR hma = reference_price OR close = reference_price THEN 0 WHEN (hma > reference_price) = (close > reference_price) THEN 1 ELSE -1 END AS hma_price_atrsmooth_alignment,
 CASE WHEN scale > 0 THEN (hma - reference_price) / scale END AS hma_atrsmooth_separation,
 CASE WHEN hma <> reference_price THEN (close - reference_price) / (hma - reference_price) END AS hma_atrsmooth_relative_close_position FROM dist_)"""
SQL["f_geometry"] = (
    f"WITH RECURSIVE {BARS}, {RANGES}, {hull_sql('scaled_', 'hull_')}, {stop_sql(1.0, 'hull_')}, {DISTANCE}, {GEOMETRY} SELECT symbol, bar_index, "
    + ", ".join(c if "alignment" in c else f"round({c}, {3 if 'position' in c else 6}) AS {c}" for c in _GEO) + " FROM geo_"
)


@query("f_geometry")
def _geometry(spark: SparkSession, sf: str) -> DataFrame:
    df = hma_atr_smooth(multiplier=1.0).apply(event_bars(spark, sf))
    # Near-zero denominators magnify the last digits of the position.
    return df.select(
        "symbol", "bar_index", *[F.col(c) if "alignment" in c else F.round(c, 3 if "position" in c else 6).alias(c) for c in _GEO]
    )


def statistics_parts(source: str, window: int, of: str = "scaled_", into: str = "kept_") -> str:
    """The relation `into`: all of `of` with the rolling statistics, unrounded."""
    x = {"close": "close", "simple_return": "CASE WHEN close > 0 AND close1 > 0 THEN close / close1 - 1 END", "log_return": "CASE WHEN close > 0 AND close1 > 0 THEN ln(close / close1) END"}[source]
    w = f"({OVER} ROWS BETWEEN {window if source == 'close' else window - 1} PRECEDING AND CURRENT ROW)"
    stats = {"mean": ("avg", 1), "median": ("median", 1), "minimum": ("min", 1), "maximum": ("max", 1), "mad": ("mad", 1), "variance": ("var_samp", 2), "standard_deviation": ("stddev_samp", 2), "skewness": ("skewness", 3), "kurtosis": ("kurtosis", 4)}
    raw = ", ".join(f"CASE WHEN count(x) OVER {w} >= {n} AND {'min(x) OVER ' + w + ' < max(x) OVER ' + w if k in ('skewness', 'kurtosis') else 'true'} THEN {f}(x) OVER {w} END AS {k}" for k, (f, n) in stats.items())
    kept = ", ".join(f"coalesce(last_value({k} IGNORE NULLS) OVER {UPTO}, 0.0) AS statistics_{k}" for k in [*stats, "range_"]).replace("statistics_range_", "statistics_range")
    return (
        f"x_ AS (SELECT *, {x} AS x FROM {of}), stats_ AS (SELECT *, CAST(count(x) OVER {w} AS INTEGER) AS statistics_observation_count, {raw}, max(x) OVER {w} - min(x) OVER {w} AS range_ FROM x_),"
        f" {into} AS (SELECT *, {kept} FROM stats_)"
    )


def statistics_sql(source: str, window: int = WINDOW) -> str:
    columns = ", ".join(c if c.endswith("count") else f"round({c} + {NUDGE}, 6) AS {c}" for c in _STATS)
    return f"WITH {BARS}, {RANGES}, {statistics_parts(source, window)} SELECT symbol, bar_index, {columns} FROM kept_"


_STATS = [f"statistics_{k}" for k in ("observation_count", "mean", "median", "minimum", "maximum", "range", "mad", "variance", "standard_deviation", "skewness", "kurtosis")]
for _source in ("close", "simple_return", "log_return"):
    _plan_query(f"f_statistics_{_source}", hma(statistics_window=WINDOW, statistics_source=_source), _STATS, statistics_sql(_source))
# From 32 values on, frames are computed as blocks of arrays.
_plan_query("f_statistics_wide", hma(statistics_window=64), _STATS, statistics_sql("close", 64))
_plan_query("f_statistics_wide_folded", atr_smooth(multiplier=1.0, statistics_window=48, statistics_source="log_return"), _STATS, statistics_sql("log_return", 48))


def composite_parts(multiplier: float, window: int) -> str:
    """The relation geo_: every column of the composite plan, unrounded."""
    return ", ".join([
        RANGES, hull_sql("scaled_", "hull_"), stop_sql(multiplier, "hull_"), DISTANCE, reversal_sql("reference_regime"), SEGMENTS.replace("FROM dist_", "FROM reversed_").replace("AS segment_id,", "AS segment_id, CASE WHEN reference_regime <> 0 THEN reference_regime END AS segment_regime,"),
        "aged_ AS (SELECT *, bar_index - segment_start_index AS segment_age FROM seg_)", statistics_parts("close", window, "aged_"), GEOMETRY.replace("FROM dist_", "FROM kept_"),
    ])


# All published columns as they are compared: doubles to six places (the position, which near-zero denominators magnify, to three; negative zero is zero).
_SHOWN = [c for c in hma_atr_smooth().columns if c not in ("timestamp",)]
_EXACT = {"bar_index", "reference_regime", "statistics_observation_count", *REVERSAL, "segment_regime", "segment_id", "segment_start_index", "segment_age", "segment_transition", "hma_price_atrsmooth_alignment"}


def _places(c: str) -> int:
    return 3 if c.endswith("position") else 6


def shown_sql(columns: list[str]) -> str:
    return ", ".join(c if c in _EXACT else f"round({'volume' if c == 'tick_volume' else c} + {NUDGE}, {_places(c)}) + 0.0 AS {c}" for c in columns)


def shown(df: DataFrame, columns: list[str], *more: str) -> DataFrame:
    return df.select("symbol", *more, *[F.col(c) if c in _EXACT else (F.round(F.col(c) + NUDGE, _places(c)) + F.lit(0.0)).alias(c) for c in columns])


@query("f_tick_bars", f"WITH {BARS} SELECT symbol, bar_index, ts, open, high, low, close, volume, volume < {TICKS} AS is_partial FROM bars_")
def _tick_bars(spark: SparkSession, sf: str) -> DataFrame:
    return event_bars(spark, sf)


@query("f_time_bars", """WITH o AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS TIMESTAMP) AS ts, CAST(o_totalprice AS DOUBLE) AS p, o_orderkey AS k FROM orders),
b AS (SELECT symbol, date_trunc('day', ts) AS ts, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, CAST(count(*) AS DOUBLE) AS volume FROM o GROUP BY 1, 2)
SELECT symbol, ts, open, high, low, close, volume, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS INTEGER) AS bar_index FROM b""")
def _time_bars(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("ts"), "o_totalprice", "o_orderkey")
    b = bar_ops.time_bars(o, "symbol", "ts", "o_totalprice", tie=("o_orderkey",))
    return b.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("f_two_sided_quotes", """WITH e AS (SELECT session_id, symbol_id, msg_seq, price, CASE WHEN lower(trim(side)) IN ('bid', '0') THEN 'bid' WHEN lower(trim(side)) IN ('ask', 'offer', '1') THEN 'ask' END AS s
 FROM eurusd_quotes WHERE lower(trim("update")) NOT IN ('delete', '2') AND price IS NOT NULL AND msg_seq IS NOT NULL AND session_id IS NOT NULL AND symbol_id IS NOT NULL),
m AS (SELECT session_id, symbol_id, msg_seq, max(CASE WHEN s = 'bid' THEN price END) AS bid, min(CASE WHEN s = 'ask' THEN price END) AS ask FROM e GROUP BY ALL),
f AS (SELECT session_id, symbol_id, msg_seq, last_value(bid IGNORE NULLS) OVER w AS bid, last_value(ask IGNORE NULLS) OVER w AS ask FROM m
 WINDOW w AS (PARTITION BY session_id, symbol_id ORDER BY msg_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT session_id, symbol_id, msg_seq, bid, ask, round(ask - bid, 8) AS spread FROM f WHERE bid IS NOT NULL AND ask IS NOT NULL""")
def _two_sided(spark: SparkSession, sf: str) -> DataFrame:
    t = bar_ops.two_sided(bar_ops.messages(table(spark, sf, "eurusd_quotes")), ["session_id", "symbol_id"], ["msg_seq"])
    return t.select("session_id", "symbol_id", "msg_seq", "bid", "ask", F.round("spread", 8).alias("spread"))


@query("f_scan_summary", """WITH b AS (SELECT symbol, row_id, ts_recv_utc AS ts, lag(ts_recv_utc) OVER (PARTITION BY symbol ORDER BY row_id) AS before FROM ticks WHERE ts_recv_utc IS NOT NULL)
SELECT symbol, count(*) AS "rows", arg_min(ts, row_id) AS first_ts, arg_max(ts, row_id) AS last_ts, count(CASE WHEN ts = before THEN 1 END) AS duplicates, count(CASE WHEN ts < before THEN 1 END) AS regressions
FROM b GROUP BY symbol""")
def _scan(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "ticks").filter("ts_recv_utc IS NOT NULL").withColumnRenamed("ts_recv_utc", "ts")
    return bar_ops.scan_summary(t, order="row_id")


def _window_sql(inside: str) -> str:
    return f"""WITH o AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS TIMESTAMP) AS ts, o_orderkey FROM orders), f AS (SELECT symbol, min(ts) + INTERVAL 1 YEAR AS until FROM o GROUP BY 1)
SELECT o.symbol, count(*) AS n, min(o.o_orderkey) AS lowest, max(o.o_orderkey) AS greatest FROM o JOIN f ON o.symbol = f.symbol WHERE {inside} GROUP BY 1"""


@query("f_research_window", _window_sql("ts < until"))
def _research(spark: SparkSession, sf: str, holdout: bool = False) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("ts"), "o_orderkey")
    return bar_ops.research_window(o, holdout=holdout).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("lowest"), F.max("o_orderkey").alias("greatest"))


@query("f_holdout_window", _window_sql("ts >= until"))
def _holdout(spark: SparkSession, sf: str) -> DataFrame:
    return _research(spark, sf, True)


@query("f_box_exits", select(["is_box_exit"], "exits_", BARS, RANGES, BOX, DISTANCE, reversal_sql("reference_regime"), "exits_ AS (SELECT *, coalesce(reversal_is_bar AND before = 0 AND reference_regime <> 0, false) AS is_box_exit FROM reversed_)"))
def _exits(spark: SparkSession, sf: str) -> DataFrame:
    return stages.box_exits(darvas_box().apply(event_bars(spark, sf)), Lane()).select("symbol", "bar_index", "is_box_exit")


@query("f_listing", f"WITH RECURSIVE {BARS}, {RANGES}, {BOX}, {DISTANCE}, {statistics_parts('close', WINDOW, 'dist_')} SELECT symbol, bar_index AS bar, "
       + ", ".join(f"printf('%.5f', {c}) AS {n}" for n, c in series.LISTING.items()) + " FROM kept_ WHERE bar_index BETWEEN 10 AND 300 AND bar_index % 7 = 0")
def _listing(spark: SparkSession, sf: str) -> DataFrame:
    return series.listing(darvas_box().apply(event_bars(spark, sf)), 10, 300, 7)


_GAPS = ("reversal_bars_since", "reversal_is_bar", "reversal_direction")


@query(
    "f_chart_series",
    f"WITH RECURSIVE {BARS}, {composite_parts(1.0, WINDOW)} SELECT symbol, "
    + ", ".join(
        f"CASE WHEN reversal_direction <> 0 THEN CAST({c} AS DOUBLE) ELSE 'NaN'::DOUBLE END AS {c}" if c in _GAPS else c if c in _EXACT else f"coalesce(round({'volume' if c == 'tick_volume' else c} + {NUDGE}, {_places(c)}) + 0.0, 'NaN'::DOUBLE) AS {c}" for c in _SHOWN
    ) + " FROM geo_",
)
def _chart(spark: SparkSession, sf: str) -> DataFrame:
    return shown(series.chart_series(hma_atr_smooth(multiplier=1.0).apply(event_bars(spark, sf))), _SHOWN)


_BASE_RULES = {
    "prices_finite": "isfinite(open) AND isfinite(high) AND isfinite(low) AND isfinite(close)", "reference_finite": "isfinite(reference_price)", "regime_in_range": "reference_regime IN (-1, 0, 1)",
    "distance_finite": "isfinite(distance_signed) AND distance_absolute >= 0", "scale_positive": "isfinite(scale) AND scale > 0", "normalized_not_negative": "isfinite(normalized_measurement) AND normalized_measurement >= 0",
    "statistics_finite": " AND ".join(f"isfinite({c})" for c in _STATS[1:]),
}
_FINITE = "({0} IS NULL OR isfinite({0}))"
_COMPOSITE_RULES = _BASE_RULES | {
    "geometry_finite": " AND ".join(_FINITE.format(c) for c in _GEO if "alignment" not in c), "alignment_in_range": "hma_price_atrsmooth_alignment IN (-1, 0, 1)",
    "segment_consistent": "(segment_id IS NULL) = (segment_start_index IS NULL) AND (segment_id IS NULL OR segment_age = bar_index - segment_start_index AND segment_regime = reference_regime) AND segment_transition IN (0, reference_regime)",
    "segment_contract": f"NOT (reference_regime = 0 AND coalesce(max(abs(reference_regime)) OVER {UPTO}, 0) > 0)",
}
_BOX_RULES = _BASE_RULES | {"box_distance_finite": " AND ".join(_FINITE.format(c) for c in _BOXED[1:])}


def quality_sql(rules: dict[str, str], source: str, *parts: str) -> str:
    flags = ", ".join(f"({r}) AS {n}" for n, r in rules.items())
    counts = " UNION ALL ".join(f"""SELECT '{n}' AS rule, count(*) AS "rows", count(CASE WHEN {n} IS NOT TRUE THEN 1 END) AS violations FROM flags_""" for n in rules)
    return f"WITH RECURSIVE {', '.join(parts)}, flags_ AS (SELECT {flags} FROM {source}) {counts}"


@query("f_quality", quality_sql({"scale_positive": _BASE_RULES["scale_positive"]}, "scaled_", BARS, RANGES))
def _quality(spark: SparkSession, sf: str) -> DataFrame:
    """One rule by itself."""
    return checks.quality(hma().apply(event_bars(spark, sf)).select("symbol", "scale"))


@query("f_quality_composite", quality_sql(_COMPOSITE_RULES, "geo_", BARS, composite_parts(1.0, WINDOW)))
def _quality_composite(spark: SparkSession, sf: str) -> DataFrame:
    """All rules of the composite plan."""
    return checks.quality(hma_atr_smooth(multiplier=1.0).apply(event_bars(spark, sf)))


@query("f_quality_box", quality_sql(_BOX_RULES, "kept_", BARS, RANGES, BOX, DISTANCE, BOX_DISTANCE, statistics_parts("close", WINDOW, "boxed2_")))
def _quality_box(spark: SparkSession, sf: str) -> DataFrame:
    """All rules of the box plan."""
    return checks.quality(darvas_box().apply(event_bars(spark, sf)))


USER_BARS = BARS.replace("event_type AS symbol", "CAST(user_id AS VARCHAR) AS symbol").replace("PARTITION BY event_type", "PARTITION BY user_id")


@query("f_all_features", f"WITH RECURSIVE {USER_BARS}, {composite_parts(1.0, WINDOW)} SELECT symbol, ts AS timestamp, {shown_sql(_SHOWN)} FROM geo_")
def _all(spark: SparkSession, sf: str) -> DataFrame:
    """Every column of the composite plan over bars of single users: many instruments."""
    t = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("symbol"), "ts", "event_id", "value")
    df = hma_atr_smooth(multiplier=1.0).apply(bar_ops.tick_bars(t, TICKS, order=("ts", "event_id"), price="value", spread=None))
    return shown(df, _SHOWN, "timestamp")


_REPLAYED = [*LEVEL, *REVERSAL, *_SEG]


@query("f_live_replay", f"WITH RECURSIVE {BARS}, {composite_parts(1.0, WINDOW)} SELECT symbol, bar_index, {shown_sql(_REPLAYED)} FROM geo_")
def _live_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Bars published twice, the first time with other prices, and replayed message by message: the last row of each bar is what the batch gives."""
    b = event_bars(spark, sf).drop("is_partial")
    early = b.withColumns({"close": F.col("close") + 1, "high": F.col("high") + 2, "seq": F.lit(0)})
    rows = replay_all(early.unionByName(b.withColumn("seq", F.lit(1))), hma_atr_smooth(multiplier=1.0))
    return shown(rows.filter("status = 'updated'"), ["bar_index", *_REPLAYED])


LONG_WINDOW = 252
LONG_BARS = """ticks_ AS (SELECT CAST(l_linenumber AS VARCHAR) AS symbol, CAST(l_shipdate AS TIMESTAMP) AS ts, CAST(l_extendedprice AS DOUBLE) AS p, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_shipdate, l_orderkey, CAST(l_extendedprice AS DOUBLE)) - 1 AS n
 FROM lineitem WHERE l_extendedprice IS NOT NULL), bars_ AS (SELECT symbol, CAST(n AS INTEGER) AS bar_index, ts, p AS open, p AS high, p AS low, p AS close, CAST(1 AS DOUBLE) AS volume FROM ticks_)"""
# Long runs have values of very different sizes: six digits of each are compared, moved off the ties by a relative nudge.
_BIG = 1.000000001234567


def long_run(spark: SparkSession, sf: str) -> DataFrame:
    """The composite plan as exports use it (statistics of 252 closes) over a bar for every line item; symbols are line numbers."""
    t = table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("string").alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("ts"), "l_orderkey", F.col("l_extendedprice").cast("double").alias("value"))
    b = bar_ops.tick_bars(t, 1, order=("ts", "l_orderkey", "value"), price="value", spread=None)  # keys repeat in these tables
    return hma_atr_smooth(statistics_window=LONG_WINDOW).apply(b)


@query(
    "f_long_run",
    f"WITH RECURSIVE {LONG_BARS}, {composite_parts(5.1, LONG_WINDOW)} SELECT symbol, "
    + ", ".join(c if c in _EXACT else f"printf('%.5e', {'volume' if c == 'tick_volume' else c} * {_BIG} + 0.0) AS {c}" for c in _SHOWN) + " FROM geo_",
)
def _long_run(spark: SparkSession, sf: str) -> DataFrame:
    """`long_run` with six digits of each value."""
    df = long_run(spark, sf)
    return df.select("symbol", *[F.col(c) if c in _EXACT else F.when(F.col(c).isNotNull(), F.format_string("%.5e", F.col(c) * _BIG + F.lit(0.0))).alias(c) for c in _SHOWN])
