from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from barloom.pipeline.regrid import complete, regular_grid

TICKS = "row_id long, symbol string, ts_recv_utc timestamp_ntz, bid double, ask double"
INST = "symbol_id int, symbol string, digits int, grid_s int"


def test_periods(spark):
    base = datetime(2024, 1, 1, 12)
    at = lambda s, us=0: base + timedelta(seconds=s, microseconds=us)
    rows = [("A", at(1), 1.0, 2.0), ("A", at(14, 999999), 3.0, 4.0), ("A", at(15), 5.0, 6.0), ("A", at(61), 7.0, 8.0), ("A", at(61), 7.0, 8.0), ("A", at(30), None, 1.0), ("A", None, 1.0, 1.0), (None, at(0), 1.0, 1.0), ("A", at(86400), 9.0, 9.5), ("Z", at(0), 1.0, 1.0), ("B", at(0), 1.0, 1.0)]
    t = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], TICKS).withColumns({"day": F.lit(1), "part": F.lit(2), "slot_s": F.lit(3)})
    inst = spark.createDataFrame([(1, "A", 2, 15), (1, "A", 2, 60), (2, "B", 2, None), (3, None, 2, 15), (4, "C", 2, 15)], INST)
    got = {(r["symbol"], r["slot_s"]): (r["bid"], r["ask"], r["status"]) for r in regular_grid(t, inst).collect()}
    s0 = int((base - datetime(1970, 1, 1)).total_seconds())
    assert set(got) == {("A", s0 + k) for k in (0, 15, 30, 45, 60, 86400)}
    assert got["A", s0] == (3.0, 4.0, "observed") and got["A", s0 + 60] == (7.0, 8.0, "observed")
    # A's own path supports what lies between its readings.
    assert got["A", s0 + 30][2] == got["A", s0 + 45][2] == "filled" and 5.0 < got["A", s0 + 30][0] < got["A", s0 + 45][0] < 7.0
    assert regular_grid(t.filter("false"), inst).collect() == [] and regular_grid(t, inst.filter("false")).collect() == []


def test_missing_cells_follow_the_other_sources(spark):
    n = 400
    wave = np.cumsum(np.sin(np.arange(n) / 9)) * 0.01
    rows = []
    for j, s in enumerate("ABCD"):
        for i in range(n):
            if s == "A" and 150 <= i < 160:
                continue
            b = 10 * (j + 1) + (j + 1) * wave[i]
            rows.append((0, s, datetime(2024, 1, 1) + timedelta(seconds=15 * i + 3), float(b), float(b + 0.1)))
    t = spark.createDataFrame(rows, TICKS)
    inst = spark.createDataFrame([(k, s, 2, 15) for k, s in enumerate("ABCD")], INST)
    got = regular_grid(t, inst).filter("symbol = 'A'").orderBy("slot_s").collect()
    assert len(got) == n and [r["status"] for r in got[150:160]] == ["filled"] * 10
    spread = np.ptp(10 + wave)
    for i in range(150, 160):
        assert abs(got[i]["bid"] - (10 + wave[i])) < 0.05 * spread
    assert all(abs(r["bid"] - (10 + wave[i])) < 1e-12 for i, r in enumerate(got) if r["status"] == "observed")


def test_unsupported_periods_stay_empty(spark):
    at = lambda k: datetime(2024, 1, 1) + timedelta(seconds=60 * k)
    # E has two readings; F a long gap, in which C is seen once.
    rows = [(0, "E", at(0), 1.0, 2.0), (0, "E", at(4), 1.0, 2.0), (0, "C", at(20), 3.0, 3.5), (0, "C", at(21), 3.0, 3.5)] + [(0, "F", at(k), 1.0 + k, 2.0 + k) for k in (0, 1, 2, 50)]
    inst = spark.createDataFrame([(k, s, 2, 60) for k, s in enumerate("CEF")], INST)
    got = {(r["symbol"], (r["slot_s"] - 1704067200) // 60): r for r in regular_grid(spark.createDataFrame(rows, TICKS), inst).collect()}
    assert len(got) == 5 + 2 + 51
    assert all(got["E", k]["status"] == "unsupported" and got["E", k]["bid"] is None for k in (1, 2, 3))
    assert [k for k in range(51) if got["F", k]["status"] == "filled"] == [4, 20, 21]  # E and C were seen in these


def test_walks_are_filled_better_than_by_carrying(spark):
    """Sources that move on their own, with spikes: hidden periods are filled at least as well as by their neighbours."""
    rng = np.random.default_rng(3)
    n, names = 500, [f"S{j}" for j in range(6)]
    value = np.cumsum(rng.normal(size=(6, n)), 1) * 0.01 + 10
    hidden = rng.random((6, n)) < 0.15
    hidden[:, [0, n - 1]] = False
    said = value.copy()
    spikes = (rng.random((6, n)) < 0.01) & ~hidden
    said[spikes] += 5
    rows = [(0, names[j], datetime(2024, 1, 1) + timedelta(seconds=60 * i), float(said[j, i]), float(said[j, i] + 0.002)) for j in range(6) for i in range(n) if not hidden[j, i]]
    inst = spark.createDataFrame([(k, s, 2, 60) for k, s in enumerate(names)], INST)
    got = {(r["symbol"], (r["slot_s"] - 1704067200) // 60): r for r in regular_grid(spark.createDataFrame(rows, TICKS), inst).filter("status = 'filled'").collect()}
    assert len(got) == hidden.sum()
    errors, carried = [], []
    for j, i in zip(*np.nonzero(hidden)):
        errors.append(abs(got[names[j], i]["bid"] - value[j, i]))
        before = np.flatnonzero(~hidden[j, :i])[-1]
        carried.append(abs(said[j, before] - value[j, i]))
    assert np.median(errors) < np.median(carried) and np.quantile(errors, 0.99) < 0.1  # no spike reaches a filled value


def test_shared_movement_fills_long_gaps():
    """A source that moves with others is filled by them where its own path says nothing."""
    rng = np.random.default_rng(5)
    common = np.cumsum(rng.normal(size=400))
    m = np.outer([1.0, 2.0, -1.0, 0.5, 1.5], common) + rng.normal(size=(5, 400)) * 0.05
    seen = rng.random(m.shape) < 0.9
    seen[0, 150:200] = False
    got = complete(m, seen)
    line = np.interp(np.arange(150, 200), [149, 200], m[0, [149, 200]])
    assert np.abs(got[0, 150:200] - m[0, 150:200]).mean() < 0.3 * np.abs(line - m[0, 150:200]).mean()


def test_completion_is_the_same_every_time():
    rng = np.random.default_rng(1)
    m = np.outer(rng.normal(size=6), rng.normal(size=50))
    seen = rng.random(m.shape) < 0.8
    a, b = complete(m, seen), complete(m, seen)
    assert np.array_equal(a, b) and np.isfinite(a).all()
