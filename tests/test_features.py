import math
import random

import pytest
from pyspark.sql import functions as F

from barloom.feature_queries import QUERIES
from barloom.functions.lanes import Lane
from barloom.operators import checks, stages
from barloom.operators.levels import AtrSmooth, DarvasBox, Hma, trailing_step
from barloom.plans import FeaturePlan, atr_smooth, darvas_box, hma, hma_atr_smooth
from barloom.plans.features import latest

SCHEMA = "symbol string, bar_index int, ts timestamp, open double, high double, low double, close double, volume double"


def bars(spark, close, high=None, low=None, volume=100.0, symbol="X"):
    high, low = high or close, low or close
    rows = [(symbol, i, None, float(c), float(h), float(x), float(c), volume) for i, (c, h, x) in enumerate(zip(close, high, low))]
    return spark.createDataFrame(rows, SCHEMA)


def walk(n, seed, start=100.0):
    r, c, out = random.Random(seed), start, []
    for _ in range(n):
        c = max(1.0, c + (r.random() - 0.5) * 4)
        out.append(round(c, 4))
    return out


def column(df, name):
    return [r[0] for r in df.orderBy("bar_index").select(name).collect()]


def close_to(a, b, tol=1e-9):
    assert len(a) == len(b)
    for i, (x, y) in enumerate(zip(a, b)):
        if x is None or y is None:
            assert x is None and y is None, (i, x, y)
        else:
            assert math.isclose(x, y, rel_tol=tol, abs_tol=tol), (i, x, y)


def test_known_dataset(spark):
    c = [100.0 + 2 * i for i in range(20)]
    df = atr_smooth(14, 5.1, 20, statistics_window=20).apply(bars(spark, c, [x + 0.5 for x in c], [x - 0.5 for x in c]))
    r = df.filter("bar_index = 19").collect()[0]
    # A ramp of two a bar, to eight places.
    for k, v in {
        "reference_price": 122.37724421291009, "distance_signed": 15.62275578708991, "scale": 2.5, "normalized_measurement": 6.249102314835964, "statistics_mean": 119,
        "statistics_median": 119, "statistics_variance": 140, "statistics_standard_deviation": math.sqrt(140), "statistics_mad": 10, "statistics_minimum": 100, "statistics_maximum": 138,
    }.items():
        assert math.isclose(r[k], v, abs_tol=1e-8), k
    first = atr_smooth(14, 5.1, 5).apply(bars(spark, c, [x + 0.5 for x in c], [x - 0.5 for x in c])).filter("bar_index = 0").collect()[0]
    assert math.isclose(first["reference_price"], 102.55, abs_tol=1e-9)


def brute_boxes(high, low, close, n):
    """Price, regime and whether there is a box, bar by bar, from the rule as it is stated."""
    out, broke, since, box = [], None, None, None
    for i in range(len(close)):
        if i >= n and high[i] > max(high[i - n : i]):
            broke, since = high[i], i
        falling = i >= n - 2 and max(high[i - n + 3 : i + 1]) < max(high[i - n + 2 : i + 1])
        if falling and since is not None and i - since == n - 2:
            box = (broke, min(low[i - n + 1 : i + 1]))
        if box is None:
            out.append((close[i], 0, False))
        else:
            out.append(((box[0] + box[1]) / 2, 1 if close[i] > box[0] else -1 if close[i] < box[1] else 0, True))
    return out


@pytest.mark.parametrize(("part", "n", "seed"), [(None, 5, 11), (24, 5, 11), (None, 3, 12), (None, 7, 13)])
def test_boxes(spark, part, n, seed):
    c = [round(x, 1) for x in walk(160, seed)]  # coarse prices, so that highs tie
    h, low = [x + 0.5 + (i % 3) / 2 for i, x in enumerate(c)], [x - 0.5 - (i % 2) / 2 for i, x in enumerate(c)]
    want = brute_boxes(h, low, c, n)
    assert len({r for _, r, _ in want}) == 3 and len({p for p, _, there in want if there}) > 3
    df = darvas_box(n, scale_period=2, statistics_window=3, part_bars=part, mean_window=4).apply(bars(spark, c, h, low))
    close_to(column(df, "reference_price"), [p for p, _, _ in want], 1e-10)
    assert column(df, "reference_regime") == [r for _, r, _ in want] and column(df, "darvas_has_box") == [there for _, _, there in want]


def test_the_edges_of_a_box_are_inside(spark):
    # A break at bar 4, confirmed at bar 5 as highs fall: the box is 20 to 8. Closes on its edges are inside, beyond them outside (whatever the highs, which break at the last bar only).
    h = [10.0, 10.0, 10.0, 10.0, 20.0, 15.0, 15.0, 15.0, 15.0, 15.0, 21.0]
    low = [9.0, 9.0, 9.0, 8.0, 9.0, 9.0, 9.0, 8.0, 9.0, 7.0, 9.0]
    c = [9.5, 9.5, 9.5, 9.5, 12.0, 12.0, 12.0, 8.0, 20.0, 7.5, 20.5]
    df = darvas_box(3).apply(bars(spark, c, h, low))
    assert column(df, "darvas_has_box") == [False] * 5 + [True] * 6
    assert column(df, "reference_regime") == [0] * 9 + [-1, 1]
    assert column(df, "darvas_signed_closing_distance")[5:] == [0.0, 0.0, 0.0, 0.0, -0.5, 0.5]


def brute_hull(c, n):
    def mean(x, k):
        return [None if i < k - 1 or any(v is None for v in x[i - k + 1 : i + 1]) else sum(v * (j + 1) for j, v in enumerate(x[i - k + 1 : i + 1])) / (k * (k + 1) / 2) for i in range(len(x))]

    fast, slow = mean(c, n // 2), mean(c, n)
    return mean([None if b is None else 2 * a - b for a, b in zip(fast, slow)], math.isqrt(n))


@pytest.mark.parametrize(("part", "n"), [(None, 16), (24, 16), (None, 9), (None, 30)])
def test_hull_average(spark, part, n):
    lane, level = Lane(part_bars=part), Hma(n)
    for c in (walk(70, 21), [3.5 * i for i in range(50)]):
        df = lane.open(bars(spark, c), level.halo)
        df = level.carried(lane.close(level.bounded(df, lane)), lane)
        want = brute_hull(c, n)
        first = n + math.isqrt(n) - 2
        assert want[first - 1] is None and want[first] is not None
        close_to(column(df, "hma"), want, 1e-12)
        assert column(df, "reference_price")[:first] == c[:first]
    flat = hma(n).apply(bars(spark, [100.0] * 60))
    assert column(flat, "reference_price") == [100.0] * 60 and set(column(flat, "reference_regime")) == {0}


def brute_segments(regime):
    """id, start, age, transition, reversal, direction and bars since, bar by bar."""
    out, n, start, turn, way = [], -1, None, None, 0
    for i, r in enumerate(regime):
        before = regime[i - 1] if i else 0
        begins = r != 0 and r != before
        if begins:
            n, start = n + 1, i
        turned = i > 0 and r != before
        if turned:
            turn, way = i, 1 if r > before else -1
        out.append((n if r else None, start if r else None, i - start if r else None, r if begins and before else 0, turned, way, None if turn is None else i - turn))
    return out


@pytest.mark.parametrize("part", [None, 4])
def test_segments(spark, part):
    r = random.Random(9)
    regime = [0] * 3 + [s for _ in range(8) for s in [r.choice([-1, 1])] * r.randrange(1, 6)]
    lane = Lane(part_bars=part)
    df = spark.createDataFrame([("X", i, r) for i, r in enumerate(regime)], "symbol string, bar_index int, reference_regime int").withColumn("distance_signed", F.lit(0.0))
    df = lane.close(lane.open(df, 0))
    df = stages.segments(stages.reversals(df, lane), lane)
    names = ["segment_id", "segment_start_index", "segment_age", "segment_transition", "reversal_is_bar", "reversal_direction", "reversal_bars_since"]
    for name, want in zip(names, zip(*brute_segments(regime))):
        assert column(df, name) == list(want), name


def test_moments(spark):
    x = [2.0, 3.0, 5.0, 11.0, 12.5, 30.0]
    n, mean = len(x), sum(x) / len(x)
    m2, m3, m4 = (sum((v - mean) ** k for v in x) / n for k in (2, 3, 4))
    r = hma(2, statistics_window=20).apply(bars(spark, x)).filter("bar_index = 5").collect()[0]
    assert math.isclose(r["statistics_skewness"], m3 / m2**1.5 * math.sqrt(n * (n - 1)) / (n - 2), abs_tol=1e-11)
    assert math.isclose(r["statistics_kurtosis"], ((n + 1) * (m4 / m2**2 - 3) + 6) * (n - 1) / ((n - 2) * (n - 3)), abs_tol=1e-11)
    flat = hma(2).apply(bars(spark, [0.1] * 30)).filter("bar_index = 29").collect()[0]
    assert flat["statistics_skewness"] == 0.0 and flat["statistics_kurtosis"] == 0.0 and flat["statistics_variance"] == 0.0


def brute_level(h, low, c, v, period, mult, smooth):
    a, e, stop, before, side, out = 2 / (period + 1), None, None, None, 0, []
    for i in range(len(c)):
        tr = h[i] - low[i] if i == 0 else max(h[i] - low[i], abs(h[i] - c[i - 1]), abs(low[i] - c[i - 1]))
        e = tr if i == 0 else a * tr + (1 - a) * e
        prev = c[i] if i == 0 else stop
        b = c[i] if i == 0 else before
        stop = trailing_step(prev, b, c[i], mult * e)
        if i and b < prev and c[i] > prev:
            side = 1
        elif i and b > prev and c[i] < prev:
            side = -1
        lo = max(0, i - smooth + 1)
        w = sum(v[lo : i + 1])
        vw = sum(x * y for x, y in zip(c[lo : i + 1], v[lo : i + 1])) / w if w > 0 else c[i]
        out.append(((vw + stop) / 2, side))
        before = c[i]
    return out


@pytest.mark.parametrize("part", [None, 150])
def test_trailing_level_of_two_instruments(spark, part):
    frames, want = None, {}
    for s, seed in (("A", 1), ("B", 2)):
        c = walk(500, seed)
        h, low = [x + 0.3 for x in c], [x - 0.2 for x in c]
        v = [float(i % 7) for i in range(500)]
        rows = [(s, i, None, c[i], h[i], low[i], c[i], v[i] or None) for i in range(500)]
        want[s] = brute_level(h, low, c, v, 16, 1.0, 20)
        df = spark.createDataFrame(rows, SCHEMA)
        frames = df if frames is None else frames.unionByName(df)
    out = hma_atr_smooth(16, 16, 1.0, 20, part_bars=part).apply(frames.orderBy(F.rand(3)))
    for s in "AB":
        got = out.filter(F.col("symbol") == s)
        close_to(column(got, "reference_price"), [p for p, _ in want[s]])
        assert column(got, "reference_regime") == [r for _, r in want[s]]


@pytest.mark.parametrize("plan", [atr_smooth(5, 1.0, 10, statistics_window=6), darvas_box(5, statistics_window=6, statistics_source="log_return"), hma(9, reversal_by_close=True, statistics_source="simple_return"), hma_atr_smooth(9, 5, 1.0, 10)])
def test_parts_and_prefixes_change_nothing(spark, plan):
    import dataclasses

    c = walk(130, 7)
    b = bars(spark, c, [x + 0.5 for x in c], [x - 0.5 for x in c])
    whole = plan.apply(b).orderBy("bar_index").collect()
    parts = dataclasses.replace(plan, part_bars=40).apply(b).orderBy("bar_index").collect()
    prefix = plan.apply(b.filter("bar_index < 60")).orderBy("bar_index").collect()
    for other in (parts, prefix):
        for x, y in zip(whole, other):
            for k in x.asDict():
                p, q = x[k], y[k]
                assert p == q or math.isclose(p, q, rel_tol=1e-8, abs_tol=1e-8), (x["bar_index"], k, p, q)
    assert len(parts) == 130 and list(whole[0].asDict()) == ["symbol", *plan.columns]


def test_column_counts_and_parameters(spark):
    assert [len(p.columns) for p in (hma(), darvas_box(), atr_smooth(), hma_atr_smooth())] == [27, 31, 32, 36]
    for make in (lambda: AtrSmooth(0), lambda: AtrSmooth(multiplier=math.inf), lambda: AtrSmooth(smooth=0), lambda: DarvasBox(2), lambda: Hma(1), lambda: hma(scale_period=0), lambda: hma(statistics_window=0), lambda: FeaturePlan(None), lambda: hma(statistics_source="x")):
        with pytest.raises(ValueError):
            make()


def test_quality_and_strict(spark):
    good = hma(4).apply(bars(spark, walk(30, 3), [x + 1 for x in walk(30, 3)]))
    assert all(r["violations"] == 0 for r in checks.quality(good).collect())
    flat = hma(4).apply(bars(spark, [5.0] * 30))
    broken = {r["rule"]: r["violations"] for r in checks.quality(flat).collect()}
    assert broken["scale_positive"] == 29
    with pytest.raises(Exception, match="rule broken"):
        checks.strict(flat).collect()


def test_nulls_empty_and_last_version(spark):
    empty = bars(spark, [])
    assert hma_atr_smooth().apply(empty).collect() == []
    b = bars(spark, [1.0, 2.0, 3.0]).withColumn("v", F.lit(1)).unionByName(bars(spark, [1.0, 2.0, 9.0]).withColumn("v", F.lit(2)))
    assert column(latest(b, "v"), "close") == [1.0, 2.0, 9.0]
    gap = bars(spark, [1.0, 2.0, 3.0]).withColumn("close", F.when(F.col("bar_index") != 1, F.col("close")))
    assert len(atr_smooth().apply(gap).collect()) == 3


@pytest.mark.parametrize("source", ["close", "log_return"])
def test_wide_windows_give_what_window_functions_give(spark, source, monkeypatch):
    from barloom.operators import rolling

    c = [*walk(120, 9), *[7.0] * 45, *walk(60, 4)]
    b = bars(spark, c).unionByName(bars(spark, walk(90, 11), symbol="Y"))
    plan = hma(4, statistics_window=40, statistics_source=source)
    wide = plan.apply(b).orderBy("symbol", "bar_index").collect()
    monkeypatch.setattr(rolling, "WIDE", 10**9)
    narrow = plan.apply(b).orderBy("symbol", "bar_index").collect()
    assert len(wide) == len(narrow) == 315
    for x, y in zip(wide, narrow):
        for k in x.asDict():
            assert x[k] == y[k] or math.isclose(x[k], y[k], rel_tol=1e-8, abs_tol=1e-8), (x["bar_index"], k, x[k], y[k])


def test_quality_queries_report_all_rules(spark, tmp_path):
    # Bars of 5 events: those of type "b" are all 0, and so is their scale.
    rows = [(t, i, float(v)) for t, vs in (("a", walk(200, 3)), ("b", [0.0] * 20)) for i, v in enumerate(vs)]
    e = spark.createDataFrame(rows, "event_type string, event_id long, value double").withColumn("ts", F.timestamp_seconds("event_id"))
    e.write.parquet(str(tmp_path / "events.parquet"))
    base = {"prices_finite", "reference_finite", "regime_in_range", "distance_finite", "scale_positive", "normalized_not_negative", "statistics_finite"}
    for name, own in (("f_quality_composite", {"geometry_finite", "alignment_in_range", "segment_consistent", "segment_contract"}), ("f_quality_box", {"box_distance_finite"})):
        got = {r["rule"]: (r["rows"], r["violations"]) for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert set(got) == base | own
        assert all(n == (44, 4 if rule in ("scale_positive", "normalized_not_negative") else 0) for rule, n in got.items()), got


def test_regime_that_falls_back_breaks_the_contract(spark):
    rows = [("X", i, r) for i, r in enumerate([0, 1, 1, 0, 0, 1, -1])] + [("Y", i, r) for i, r in enumerate([0, 0, -1, 1])]
    df = spark.createDataFrame(rows, "symbol string, bar_index int, reference_regime int")
    got = stages.segments(df, Lane())
    report = {r["rule"]: (r["rows"], r["violations"]) for r in checks.quality(got).collect()}
    assert report["segment_contract"] == (11, 2)
    with pytest.raises(Exception, match="segment_contract"):
        stages.segments(df, Lane(), strict=True).collect()
    assert stages.segments(df.filter("symbol = 'Y'"), Lane(), strict=True).count() == 4


def test_scale_distance_and_normalization_of_your_own(spark):
    class Range:
        halo = 4

        def bounded(self, df, lane):
            return df.withColumn("scale", F.max("high").over(lane.rows(3)) - F.min("low").over(lane.rows(3)))

    c = walk(60, 4)
    b = bars(spark, c, [x + 0.5 for x in c], [x - 0.5 for x in c])
    options = {"scale": Range(), "distance": lambda close, level: F.log(close / level), "normalize": lambda d, s: d / (s + 1)}
    plain, own = hma(9).apply(b).orderBy("bar_index").collect(), hma(9, **options).apply(b).orderBy("bar_index").collect()
    for i, (p, o) in enumerate(zip(plain, own)):
        span = max(c[max(0, i - 3) : i + 1]) - min(c[max(0, i - 3) : i + 1]) + 1
        d = math.log(p["close"] / p["reference_price"])
        assert math.isclose(o["scale"], span) and math.isclose(o["distance_signed"], d, abs_tol=1e-12) and math.isclose(o["normalized_measurement"], abs(d) / (span + 1), abs_tol=1e-12)
    close_to([r["scale"] for r in own], column(hma(9, part_bars=30, **options).apply(b), "scale"))
