"""Bars, quotes and scans chunk by chunk must be what one sort of each key gives."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.common import carry_last, default_chunk, scratch_dir, shared_dir
from barloom.operators import bars as bar_ops
from barloom.plans import hma

TICKS = "symbol string, ts timestamp, event_id long, bid double, spread double"


def ticks(spark, n=900):
    """One symbol has most ticks, over several days; times tie, some are null, as are some prices and a symbol."""
    r, rows = random.Random(4), []
    for i in range(n):
        symbol = "hot" if r.random() < 0.8 else r.choice(["a", "b", None])
        at = None if r.random() < 0.02 else datetime(2024, 3, 1) + timedelta(hours=r.randrange(24 * 6), minutes=r.randrange(3))
        rows.append((symbol, at, i, None if r.random() < 0.05 else round(r.random() * 9, 2), r.random()))
    return spark.createDataFrame(rows, TICKS)


def test_tick_bars_of_a_hot_symbol(spark):
    t = ticks(spark)
    whole = bar_ops.tick_bars(t, 7, order=("ts", "event_id"), chunk=F.lit(0))
    split = bar_ops.tick_bars(t, 7, order=("ts", "event_id"))
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, split.collect())) and {r["symbol"] for r in split.select("symbol").collect()} == {"hot", "a", "b", None}
    assert bar_ops.tick_bars(t.filter("false"), 7, order=("ts", "event_id")).collect() == []
    with pytest.raises(ValueError):
        bar_ops.tick_bars(t, 0)


def test_scan_summary_across_chunks(spark):
    t = ticks(spark).filter("ts IS NOT NULL")
    before = F.lag("ts").over(Window.partitionBy("symbol").orderBy("event_id"))
    want = t.withColumn("b", before).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("ts") == F.col("b"), 1)).alias("duplicates"), F.count(F.when(F.col("ts") < F.col("b"), 1)).alias("regressions"))
    for chunk in (None, F.floor(F.col("event_id") / 17)):
        got = bar_ops.scan_summary(t, order="event_id", chunk=chunk)
        assert {tuple(r) for r in got.select("symbol", "rows", "duplicates", "regressions").collect()} == {tuple(r) for r in want.collect()}


def test_carried_quotes_across_chunks(spark):
    r = random.Random(8)
    rows = [(r.choice([1, 1, 1, 2, None]), i, None if r.random() < 0.7 else r.random(), None if r.random() < 0.95 else r.random()) for i in range(400)]
    q = spark.createDataFrame(rows, "k int, seq long, bid double, ask double").withColumns({"carry_chunk": F.lit(5), "bid_head": F.lit("x")})
    whole = carry_last(q, ["k"], ["seq"], ["bid", "ask"])
    split = carry_last(q, ["k"], ["seq"], ["bid", "ask"], F.floor(F.col("seq") / 13))
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, split.select(whole.columns).collect()))
    two = bar_ops.two_sided(q.drop("carry_chunk", "bid_head"), "k", ["seq"], chunk=F.floor(F.col("seq") / 13))
    assert two.count() == whole.filter("bid IS NOT NULL AND ask IS NOT NULL").count() > 0


def test_chunks_follow_the_order(spark):
    df = ticks(spark)
    c = [(r["ts"], r["c"]) for r in df.withColumn("c", default_chunk(df, "ts")).orderBy("ts").select("ts", "c").collect()]
    assert [x for _, x in c] == sorted(x for _, x in c) and default_chunk(df, "symbol") is None


def test_plan_fitted_to_its_lanes(spark):
    b = spark.range(500).selectExpr("IF(id < 400, 'long', 'short') AS symbol", "CAST(id % 400 AS INT) AS bar_index")
    plan = hma(9, statistics_window=5)
    assert plan.fitted(b).part_bars is None and plan.fitted(b.filter("false")).part_bars is None
    assert plan.fitted(b, most=300, part=100).part_bars == 100 and plan.fitted(b, most=300, part=1).part_bars == 20  # no shorter than what frames look back to


def test_scratch_folder(spark):
    assert scratch_dir(spark).startswith(shared_dir(spark)) and spark.sparkContext.applicationId in scratch_dir(spark)
