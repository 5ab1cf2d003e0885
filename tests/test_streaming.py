import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.statistics import STATISTICS, Statistic, register
from barloom.plans import FeaturePlan, atr_smooth, darvas_box, hma, hma_atr_smooth
from barloom.streaming.live import live_features, live_tick_bars, replay, stored_bars
from test_features import SCHEMA, walk


def messages(n=90, seed=5):
    c = walk(n, seed)
    return pd.DataFrame({"bar_index": range(n), "high": [x + 0.4 for x in c], "low": [x - 0.4 for x in c], "close": c, "volume": [float(1 + i % 5) for i in range(n)]})


@pytest.mark.parametrize("plan", [atr_smooth(5, 1.0, 10, statistics_window=8), darvas_box(5, statistics_window=8), hma(9, statistics_window=8, reversal_by_close=True), hma_atr_smooth(9, 5, 1.0, 10, statistics_window=8)])
def test_live_equals_batch_and_republishing_changes_nothing(spark, plan):
    m = messages()
    # Every bar is published three times, the first two with other prices.
    noisy = pd.concat([m.assign(close=m.close + 1, high=m.high + 2, r=0), m.assign(low=m.low - 3, r=1), m.assign(r=2)]).sort_values(["bar_index", "r"])
    live = replay(noisy, plan).drop_duplicates("bar_index", keep="last").set_index("bar_index")
    rows = [("X", int(r.bar_index), None, r.close, r.high, r.low, r.close, r.volume) for r in m.itertuples()]
    batch = plan.apply(spark.createDataFrame(rows, SCHEMA)).toPandas().set_index("bar_index").sort_index()
    for c in live.columns:
        if c == "status" or c not in batch:
            continue
        for x, y in zip(live[c], batch[c]):
            gone = x is None or x != x
            assert (gone and (y is None or y != y)) or math.isclose(float(x), float(y), rel_tol=1e-9, abs_tol=1e-9), c


def test_gaps_and_closed_bars_are_refused():
    m = messages(10)
    jump = pd.concat([m.iloc[:4], m.iloc[6:7], m.iloc[1:2], m.iloc[4:6]])
    assert list(replay(jump, hma(4)).status) == ["appended"] * 4 + ["refused", "refused", "appended", "appended"]
    assert list(replay(m.iloc[[0, 0, 1, 1, 0, 1]], hma(4)).status) == ["appended", "updated", "appended", "updated", "restarted", "appended"]


def test_discontinuities_are_replayed_from_the_store(spark, tmp_path):
    """After a gap, a late bar or a restart, states are those of a clean run; what the store lacks is refused."""
    plan = hma_atr_smooth(9, 5, 1.0, 10, statistics_window=8)
    m = messages(40)
    m.assign(symbol="A").query("bar_index != 30").to_parquet(tmp_path / "bars.parquet")
    history = stored_bars(f"file://{tmp_path}/bars.parquet", "symbol", "A")
    want = replay(m, plan)
    # 0..9, a jump to 15, 16; a late bar 5 and what follows it; a jump over the bar that the store lacks.
    order = [*range(10), 15, 16, 5, 6, 7, 35]
    got = replay(m.iloc[order], plan, history)
    tail = [("appended", i) for i in range(10)] + [("replayed", i) for i in range(16)] + [("appended", 16)] + [("replayed", i) for i in range(6)] + [("appended", 6), ("appended", 7), ("refused", 35)]
    assert list(zip(got.status, got.bar_index)) == tail
    for r in got[got.status != "refused"].itertuples():
        w = want.iloc[r.bar_index]
        for c in want.columns:
            if c != "status":
                x, y = getattr(r, c), w[c]
                assert pd.isna(x) and pd.isna(y) or math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-12), (c, r.bar_index)
    assert list(replay(m.iloc[[0, 1, 2, 9]], plan, stored_bars(str(tmp_path / "bars.parquet"), "symbol", "B")).status)[-1] == "refused"


def test_stream_recovers_and_restarts(spark, tmp_path):
    """A query that is stopped and started again goes on from its checkpoint, and a gap is replayed from the store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    plan = atr_smooth(5, 1.0, 10, statistics_window=8)
    m = messages(30).assign(symbol="A", seq=range(30))
    m.drop(columns="seq").to_parquet(tmp_path / "store.parquet")
    df = spark.createDataFrame(m).withColumn("bar_index", F.col("bar_index").cast("int"))
    src, out = str(tmp_path / "messages"), {}
    for lo, hi in [(0, 10), (10, 12), (20, 30)]:  # three runs; 12..19 never come
        df.filter(F.col("bar_index").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(src)
        stream = live_features(spark.readStream.schema(df.schema).parquet(src), plan, store=f"file://{tmp_path}/store.parquet")
        q = stream.writeStream.foreachBatch(lambda b, _: out.update({r["bar_index"]: r for r in b.collect()})).outputMode("update")
        q.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    want = replay(m, plan).set_index("bar_index")
    assert sorted(out) == list(range(30))
    assert {out[i]["status"] for i in range(20)} <= {"replayed", "appended"} and out[29]["status"] == "appended"
    assert all(math.isclose(out[i]["reference_price"], want.reference_price[i], rel_tol=1e-12) for i in out)


def run(stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append" if name == "ticks_out" else "update").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    m = messages(30)
    src = tmp_path / "in"
    a = m.assign(symbol="A", seq=range(30))
    b = pd.concat([a, a.assign(symbol="B", close=a.close + 1, high=a.high + 2)])
    spark.createDataFrame(b).select("symbol", F.col("bar_index").cast("int"), "high", "low", "close", "volume", F.col("seq").cast("long")).coalesce(1).write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    plan = atr_smooth(5, 1.0, 10, statistics_window=8)
    run(live_features(spark.readStream.schema(schema).parquet(str(src)), plan), "live_out", tmp_path)
    got = spark.table("live_out").filter("symbol = 'A'").orderBy("bar_index").toPandas()
    want = replay(m, plan)
    assert len(got) == 30 and spark.table("live_out").count() == 60
    assert all(math.isclose(x, y) for x, y in zip(got.reference_price, want.reference_price))
    ticks = spark.read.parquet(str(src)).select("symbol", F.timestamp_seconds("seq").alias("ts"), F.col("close").alias("bid"), "seq")
    ticks.coalesce(1).write.parquet(str(tmp_path / "t"))
    run(live_tick_bars(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "t")), 7), "ticks_out", tmp_path)
    bars = spark.table("ticks_out").filter("symbol = 'A'").orderBy("bar_index").collect()
    assert len(bars) == 4 and bars[1]["open"] == m.close[7] and bars[1]["close"] == m.close[13]


OPTIONS = [
    hma_atr_smooth(9, 5, 1.0, 10, statistics_window=8, statistics_source="log_return", mean_window=6),
    atr_smooth(5, 1.0, 10, statistics_window=40, statistics_source="simple_return"),
    darvas_box(5, statistics_window=3, mean_window=4, retain=False),
    hma(9, statistics_window=3, statistics_source="log_return", statistics=("mean", "skewness", "kurtosis"), retain=False),
    darvas_box(4, statistics_window=5, statistics=("median", "kurtosis"), mean_window=30),
]


@pytest.mark.parametrize("plan", OPTIONS)
def test_live_publishes_all_columns_of_the_plan(spark, plan):
    m = messages(90, 7)
    m["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(m.bar_index, unit="min")
    m["open"] = m.close - 0.1
    # Equal closes leave skewness and kurtosis undefined; a close of 0 has no returns; a missing volume counts as 0.
    m.loc[30:42, ["open", "high", "low", "close"]] = 50.0
    m.loc[60, ["low", "close"]] = 0.0
    m["volume"] = m.volume.astype(object).where(m.bar_index % 11 != 3, None)
    noisy = pd.concat([m.assign(close=m.close + 1, high=m.high + 2, r=0), m.assign(r=1)]).sort_values(["bar_index", "r"])
    live = replay(noisy, plan).drop_duplicates("bar_index", keep="last")
    assert set(live.columns) == {*plan.columns, "status"}
    rows = [("X", int(r.bar_index), r.ts.to_pydatetime(), r.open, r.high, r.low, r.close, r.volume) for r in m.itertuples()]
    batch = plan.apply(spark.createDataFrame(rows, SCHEMA)).orderBy("bar_index").toPandas()
    assert len(live) == len(batch) == 90
    for c in plan.columns:
        for i, x, y in zip(batch.bar_index, live[c], batch[c]):
            if pd.isna(x) or pd.isna(y):
                assert pd.isna(x) and pd.isna(y), (c, i, x, y)
            elif c == "timestamp":
                assert x == y, (c, i)
            else:
                # Powers of noise in the variance of returns.
                assert math.isclose(float(x), float(y), rel_tol=1e-7, abs_tol=1e-7), (c, i, x, y)


def test_plans_without_a_live_twin_are_refused():
    class Own:
        halo = 1

    with pytest.raises(ValueError, match="level"):
        replay(messages(3), FeaturePlan(Own()))
    with pytest.raises(ValueError, match="strict"):
        replay(messages(3), hma(4, strict=True))
    register(Statistic("sum_of_all", 1, lambda x, w: F.sum(x).over(w)))
    try:
        with pytest.raises(ValueError, match="sum_of_all"):
            replay(messages(3), hma(4))
    finally:
        del STATISTICS["sum_of_all"]


def test_stream_publishes_all_columns_of_the_plan(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    plan = hma_atr_smooth(9, 5, 1.0, 10, statistics_window=8, statistics_source="log_return", key="pair")
    m = messages(40)
    src = str(tmp_path / "all")
    a = m.assign(pair="A", seq=range(40), open=m.close, ts=pd.Timestamp("2024-01-01") + pd.to_timedelta(m.bar_index, unit="min"))
    spark.createDataFrame(a).withColumn("bar_index", F.col("bar_index").cast("int")).coalesce(1).write.parquet(src)
    got = live_features(spark.readStream.schema(spark.read.parquet(src).schema).parquet(src), plan)
    batch = plan.apply(spark.read.parquet(src))
    assert {k: v for k, v in got.dtypes if k != "status"} == dict(batch.dtypes)
    run(got, "live_all", tmp_path)
    want = batch.orderBy("bar_index").toPandas()
    live = spark.table("live_all").orderBy("bar_index").toPandas()
    assert len(live) == 40 and list(live.timestamp) == list(want.timestamp) and list(live.pair) == ["A"] * 40
    for c in plan.columns:
        if c != "timestamp":
            assert all(pd.isna(x) and pd.isna(y) or math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-7) for x, y in zip(live[c], want[c])), c
