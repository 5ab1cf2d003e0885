"""Queries of sources and sinks, each a round trip over the test tables: what is written as a capture, a recorded message or an artifact is read back."""

from __future__ import annotations

import glob
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import feature_queries as fq
from barloom.common import scratch_dir, table
from barloom.operators import bars as bar_ops
from barloom.pipeline.change_feed import SIDES, UPDATES, _lookup
from barloom.plans import Mode
from barloom.sinks.export import export, file_hash
from barloom.sources import fix
from barloom.sources.captures import read_permissive, read_strict
from barloom.sources.synthetic import capture_fields

QUERIES: dict[str, fq.Query] = {}
SQL: dict[str, str] = {}
PART = 5000  # bars of one capture


def query(name: str, sql: str):
    def add(f: fq.Query) -> fq.Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _captures(spark: SparkSession, sf: str) -> str:
    """The event bars as strict captures of PART bars each; the pattern of their paths."""
    b = fq.event_bars(spark, sf).withColumn("part", F.floor(F.col("bar_index") / PART))
    folder = f"{scratch_dir(spark)}/captures-{uuid.uuid4().hex}"
    # One file a capture: its bars meet in one task, in order.
    rows = b.repartition("symbol", "part").sortWithinPartitions("symbol", "part", "bar_index").select("symbol", "part", *capture_fields())
    rows.write.partitionBy("symbol", "part").option("header", True).csv(folder)
    return f"{folder}/*/*/*.csv"


_CAPTURE_SQL = f"""WITH {fq.BARS} SELECT symbol, CAST(bar_index // {PART} AS INTEGER) AS part, CAST(bar_index % {PART} + 2 AS INTEGER) AS line_no, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '0Z' AS t_time, epoch_us(ts) AS us,
 open, high, low, close, volume FROM bars_"""


@query("f_strict_capture", _CAPTURE_SQL)
def _strict(spark: SparkSession, sf: str) -> DataFrame:
    """Captures written from bars and read back strictly: line numbers, tokens to the letter, typed values."""
    r = read_strict(spark, _captures(spark, sf))
    of = lambda name: F.regexp_extract("path", rf"{name}=([^/]*)/", 1)
    return r.select(of("symbol").alias("symbol"), of("part").cast("int").alias("part"), "line_no", "t_time", F.unix_micros("ts").alias("us"), "open", "high", "low", "close", "volume")


@query("f_permissive_capture", f"WITH {fq.BARS} SELECT epoch_us(ts) AS us, open, high, low, close, volume FROM bars_")
def _permissive(spark: SparkSession, sf: str) -> DataFrame:
    """The same captures by the permissive reader."""
    return read_permissive(spark, _captures(spark, sf)).select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "open", "high", "low", "close", "volume")


_CODES = {"new": "0", "change": "1", "delete": "2"}


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "eurusd_quotes")
    return q.select("session_id", "symbol_id", "msg_seq", _lookup("update", UPDATES).alias("update"), _lookup("side", SIDES).alias("side"), "entry_id", "price", "size").dropna(subset=["session_id", "symbol_id", "msg_seq", "update", "side", "entry_id"]).distinct()


@query("f_fix_messages", """SELECT DISTINCT session_id, symbol_id, CASE WHEN lower(trim(side)) IN ('bid', '0') THEN 'bid' ELSE 'ask' END AS side, price, size, entry_id,
 CASE lower(trim("update")) WHEN '0' THEN 'new' WHEN '1' THEN 'change' WHEN '2' THEN 'delete' ELSE lower(trim("update")) END AS "update", CAST(msg_seq AS BIGINT) AS msg_seq
 FROM eurusd_quotes WHERE session_id IS NOT NULL AND symbol_id IS NOT NULL AND msg_seq IS NOT NULL AND "update" IS NOT NULL AND side IS NOT NULL AND entry_id IS NOT NULL""")
def _fix(spark: SparkSession, sf: str) -> DataFrame:
    """The quote feed as recorded tag=value messages, snapshots and refreshes, parsed again."""
    tag = lambda n, c: F.when(c.isNotNull(), F.concat(F.lit(f"{n}="), c.cast("string")))
    side = F.when(F.col("side") == "bid", "0").otherwise("1")
    code = F.element_at(F.create_map(*[F.lit(x) for kv in _CODES.items() for x in kv]), F.col("update"))
    body = [tag(269, side), tag(270, F.col("price")), tag(271, F.col("size")), tag(278, F.col("entry_id"))]
    entry = F.when(F.col("update") == "snapshot", F.concat_ws(fix.SOH, *body)).otherwise(F.concat_ws(fix.SOH, tag(279, code), tag(55, F.col("symbol_id")), *body))
    # A message holds the entries that came under one number.
    m = _entries(spark, sf).withColumns({"entry": entry, "whole": F.col("update") == "snapshot"}).groupBy("session_id", "symbol_id", "msg_seq", "whole").agg(F.sort_array(F.collect_list("entry")).alias("all"))
    head = [F.when(F.col("whole"), "35=W").otherwise("35=X"), tag(34, F.col("msg_seq")), F.when(F.col("whole"), tag(55, F.col("symbol_id"))), tag(268, F.size("all"))]
    messages = m.select("session_id", F.concat_ws(fix.SOH, F.lit("8=FIX.4.4"), *head, F.concat_ws(fix.SOH, "all"), F.lit("10=000")).alias("message"))
    return fix.quotes(messages, keep=("session_id",)).select("session_id", "symbol_id", "side", "price", "size", "entry_id", "update", "msg_seq")


@query("f_fix_securities", "SELECT symbol, max(struct_pack(a := symbol_id, b := digits)).a AS symbol_id, max(struct_pack(a := symbol_id, b := digits)).b AS digits FROM instruments WHERE symbol IS NOT NULL GROUP BY 1")
def _securities(spark: SparkSession, sf: str) -> DataFrame:
    """Instruments as a security list, ten to a message, the first of each message listed again."""
    one = F.concat(F.lit("55="), F.col("symbol_id").cast("string"), F.lit(fix.SOH + "1007="), F.col("symbol"), F.lit(fix.SOH + "1008="), F.col("digits").cast("string"))
    lists = table(spark, sf, "instruments").dropna(subset=["symbol"]).groupBy(F.floor(F.col("symbol_id") / 10)).agg(F.sort_array(F.collect_list(one)).alias("all"))
    return fix.securities(lists.select(F.concat_ws(fix.SOH, F.lit("35=y"), F.concat_ws(fix.SOH, "all"), F.col("all")[0]).alias("message")))


_DAYS = """o_ AS (SELECT CAST(o_orderdate AS TIMESTAMP) AS ts, CAST(o_totalprice AS DOUBLE) AS p, o_orderkey AS k FROM orders),
days_ AS (SELECT 'orders' AS symbol, date_trunc('day', ts) AS ts, arg_min(p, struct_pack(t := ts, k := k, p := p)) AS open, max(p) AS high, min(p) AS low, arg_max(p, struct_pack(t := ts, k := k, p := p)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM o_ GROUP BY 2),
bars_ AS (SELECT *, CAST(row_number() OVER (ORDER BY ts) - 1 AS INTEGER) AS bar_index FROM days_ WHERE ts < (SELECT min(ts) + INTERVAL 1 YEAR FROM days_))"""
_INTS = fq._EXACT - {"reversal_is_bar"}


@query(
    "f_export",
    f"WITH RECURSIVE {_DAYS}, {fq.composite_parts(5.1, fq.LONG_WINDOW)} SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '0Z' AS timestamp, "
    + ", ".join("CAST(reversal_is_bar AS INTEGER) AS reversal_is_bar" if c == "reversal_is_bar" else c if c in _INTS else f"printf('%.5e', {'volume' if c == 'tick_volume' else c} * {fq._BIG} + 0.0) AS {c}" for c in fq._SHOWN) + " FROM geo_",
)
def _export(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars of all orders as one registered capture, exported in the composite mode, and the artifact read back: the first calendar year, tokens to the letter."""
    o = table(spark, sf, "orders").select(F.lit("orders").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_totalprice").cast("double").alias("p"), "o_orderkey")
    b = bar_ops.time_bars(o, "symbol", "ts", "p", tie=("o_orderkey", "p"))
    folder = f"{scratch_dir(spark)}/export-{uuid.uuid4().hex}"
    local = folder.removeprefix("file://").removeprefix("file:")
    # A capture is one file by definition.
    b.orderBy("bar_index").select(*capture_fields()).coalesce(1).write.option("header", True).csv(f"{folder}/capture")
    (capture,) = glob.glob(f"{local}/capture/*.csv")
    first, last = (r["t"] for r in b.agg(F.min("ts").alias("a"), F.max("ts").alias("z")).select(F.explode(F.array("a", "z")).alias("ts")).select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0Z'").alias("t")).collect())
    entry = {"dataset_id": "orders", "dataset_version": "1", "filename": os.path.basename(capture), "source_sha256": file_hash(capture), "source_schema": "recorder_v1", "first_timestamp": first, "last_timestamp": last, "partition_policy": "first_calendar_year_only"}
    with open(f"{local}/registry.json", "w", encoding="utf-8") as f:
        json.dump([entry], f)
    export(spark, f"{local}/registry.json", "orders", Mode.HMA_ATR_SMOOTH, capture, f"{local}/features.csv")
    a = spark.read.csv(f"{folder}/features.csv", header=True)
    number = lambda c: F.when(F.col(c) != "NaN", F.format_string("%.5e", F.col(c).cast("double") * fq._BIG + F.lit(0.0)))
    return a.select("timestamp", *[F.col(c).cast("int").alias(c) if c in _INTS | {"reversal_is_bar"} else number(c).alias(c) for c in fq._SHOWN])
