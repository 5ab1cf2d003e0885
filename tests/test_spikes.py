import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.pipeline.spikes import flag_bars, flag_ticks, implausible, robust_components, unusual_cells

TICKS = "row_id long, symbol string, ts_recv_utc timestamp_ntz, bid double, ask double, spread double, msg_seq long"
BARS = "row_id long, dataset_id string, bar_index int, Open double, High double, Low double, Close double"


def ticks(spark, seed=3):
    """Two symbols over three days with planted readings, some at the turn of a day; the second one is sparse."""
    r, rows, bad = random.Random(seed), [], set()
    for s, n in (("A", 300), ("B", 40)):
        at, p = datetime(2024, 1, 1, 20), 100.0
        for i in range(n):
            at += timedelta(seconds=r.randrange(60, 300) * 300 // n)
            p += r.choice([-2, -1, 1, 2]) * 0.01
            rows.append([s, at, round(p, 2), 0.02])
    for k in (50, 120, 121, 200, 201, 202, 320):
        rows[k][2] += 5.0
        bad.add((rows[k][0], rows[k][1]))
    day = next(i for i in range(1, 300) if rows[i][1].date() != rows[i - 1][1].date())
    for k in (day - 1, day):  # a spike of two over midnight
        rows[k][2] += 7.0
        bad.add((rows[k][0], rows[k][1]))
    for k in range(day + 60, day + 85):
        rows[k][2] = rows[day + 60][2]
        bad.add((rows[k][0], rows[k][1]))
    for k, v in ((10, -0.01), (12, 0.3)):
        rows[k][3] = v
        bad.add((rows[k][0], rows[k][1]))
    rows[20][2] = 0.0
    bad.add((rows[20][0], rows[20][1]))
    out = [(i, s, at, b, b + sp, sp, i) for i, (s, at, b, sp) in enumerate(rows)]
    out += [(1000 + i, *out[k][1:]) for i, k in enumerate((50, 200, 5))]  # copies
    out += [(2000, "A", None, 5.0, 5.0, 0.0, 1), (2001, "A", datetime(2024, 1, 1), None, 1.0, 0.0, 1), (2002, None, datetime(2024, 1, 1), 1.0, 1.0, 0.0, 1), (2003, "C", datetime(2024, 1, 1), 1.0, 1.0, None, 1)]
    want = {x[0] for x in out if (x[1], x[2]) in bad}
    return spark.createDataFrame(out, TICKS), want


def bars(spark):
    r, rows = random.Random(5), []
    p = 50.0
    for i in range(260):
        p += r.uniform(-1, 1) * 0.05
        rows.append([0, "D", i, p, p + r.uniform(0.05, 0.15), p - r.uniform(0.05, 0.15), p])
    bad = {30, 96, 150, 200, 201, *range(220, 232)}
    rows[30][4] += 9
    rows[96][5] -= 9
    rows[150][5] = rows[150][4] + 1
    rows[200][5] = -1.0
    rows[201][3] = rows[201][4] + 1
    for k in range(220, 232):
        rows[k][3:] = rows[220][3:]
    rows = [(i, *x[1:]) for i, x in enumerate(rows)]
    rows += [(500, *rows[30][1:]), (501, "E", 0, 1.0, 2.0, 0.5, 1.0), (502, "E", None, 1.0, 2.0, 0.5, 1.0), (503, "E", 1, 1.0, None, 0.5, 1.0), (504, "E", 2, None, 2.0, 0.5, None)]
    return spark.createDataFrame(rows, BARS), {*bad, 500}


@pytest.mark.parametrize("slots", [48, 3])
def test_planted_readings(spark, slots):
    t, want = ticks(spark)
    b, want_b = bars(spark)
    got = implausible(t.withColumns({"day": F.lit(1), "slot": F.lit(2), "reasons": F.lit("x"), "usual": F.lit(0.0)}).repartition(3), b.withColumn("chunk", F.lit(1))).collect()
    assert {r["row_id"] for r in got if r["source_table"] == "ticks"} == want
    assert {r["row_id"] for r in got if r["source_table"] == "bars"} == want_b
    flags = flag_ticks(t, slots=slots)
    assert flags.count() == len(want) - 2
    small = flag_bars(b, row=10, chunk=16)
    assert small.count() == len(want_b) - 1


def test_empty(spark):
    t, _ = ticks(spark)
    b, _ = bars(spark)
    assert implausible(t.filter("false"), b.filter("false")).collect() == []


def test_low_rank_part_is_bounded_and_finds_the_profile():
    rng = np.random.default_rng(0)
    profile = np.outer(rng.uniform(0.5, 1.0, 20), rng.uniform(0.5, 1.5, 48))
    m = profile + rng.normal(0, 0.01, profile.shape)
    m[3, 7] = m[11, 40] = 12.0
    seen = rng.random(m.shape) < 0.9
    seen[3, 7] = seen[11, 40] = True
    low, rest = robust_components(m, seen, 3.0)
    assert low.max() <= 3.0 and rest[3, 7] > 9 and rest[11, 40] > 9
    normal = seen.copy()
    normal[3, 7] = normal[11, 40] = False
    assert np.abs(low - profile)[normal].max() < 0.5 and np.linalg.matrix_rank(low, tol=0.5) <= 2


def test_what_happens_every_day_is_normal(spark):
    """A surge at the same time every day is the source's profile; the same jump at another time is unusual. A fixed limit cannot tell them apart."""
    rng = np.random.default_rng(2)
    rows = []
    for day in range(40):
        for slot in range(48):
            x = 0.7 + 0.1 * rng.random() + (3.0 if slot == 16 else 1.5 if slot == 17 else 0.0)
            rows.append(("A", day, slot, 3.8 if (day, slot) in ((7, 30), (21, 3)) else x))
    rows += [("A", 3, None, 9.0), ("A", None, 3, 9.0), (None, 3, 3, 9.0), ("A", 50, 3, None), ("B", 0, 0, 5.0)]
    df = spark.createDataFrame(rows, "symbol string, day long, slot int, x double")
    got = {(r["symbol"], r["day"], r["slot"]) for r in unusual_cells(df, "symbol").collect()}
    assert got == {("A", 7, 30), ("A", 21, 3)}
    assert df.filter("x >= 3.7").count() > 20  # the surges are as large
    assert unusual_cells(df.filter("false"), "symbol").collect() == []
