import hashlib
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.__main__ import main
from barloom.operators import bars as bar_ops
from barloom.plans import Mode, hma
from barloom.sinks import export, series, tokens
from barloom.sources import captures, fix, registry, synthetic

HEAD = "OpenTimeUtc,Open,High,Low,Close,TickVolume"


def capture(tmp_path, n=40, name="c.csv", head=HEAD, change=None, tail="", step=86400 * 10):
    lines = [head]
    for i in range(n):
        t = pd.Timestamp("2020-02-29T10:00:00Z") + pd.Timedelta(seconds=i * step)
        c = 100 + (i * 7 % 11) / 10
        lines.append(f"{t:%Y-%m-%dT%H:%M:%S}.1234567Z,{c},{c + 1},{c - 1.5:.2f},{c},{i + 1}" + tail)
    if change:
        lines = change(lines)
    p = tmp_path / name
    p.write_bytes(("\n".join(lines) + "\n").encode())
    return p, lines


def registered(tmp_path, p, lines, **other):
    e = {
        "dataset_id": "D", "dataset_version": "v1", "filename": p.name, "source_sha256": hashlib.sha256(p.read_bytes()).hexdigest(), "source_schema": "recorder_v1",
        "first_timestamp": lines[1].split(",")[0], "last_timestamp": lines[-1].split(",")[0], "partition_policy": "first_calendar_year_only",
    } | other
    r = tmp_path / "r.json"
    r.write_text(json.dumps([e]))
    return str(r)


def test_number_tokens():
    for x, t in {100.0: "100", 0.1: "0.1", 1e-7: "1E-07", 1e-5: "1E-05", 0.0001: "0.0001", 1e15: "1E+15", 123456789012345.0: "123456789012345", 1.5e300: "1.5E+300", -0.0: "-0", 2.5: "2.5", -1234.5678: "-1234.5678"}.items():
        assert tokens.number(x) == t
        assert float(t) == x
    assert [tokens.number(None), tokens.number(float("nan")), tokens.number(float("-inf")), tokens.counter(None), tokens.flag(True), tokens.flag(None)] == ["NaN", "NaN", "-Infinity", "", "1", "0"]


def test_export(spark, tmp_path):
    p, lines = capture(tmp_path)
    reg = registered(tmp_path, p, lines)
    m = export.export(spark, reg, "D", Mode.HMA, str(p), str(tmp_path / "a.csv"))
    data = (tmp_path / "a.csv").read_bytes()
    rows = data.decode().splitlines()
    # A leap day's year ends on 28 February: 37 bars of ten days.
    assert m["row_count"] == 37 == len(rows) - 1 and hashlib.sha256(data).hexdigest() == m["artifact_sha256"] and b"\r" not in data
    assert len(rows[0].split(",")) == 27 and rows[1].split(",")[1:7] == lines[1].split(",")
    assert [int(r.split(",")[0]) for r in rows[1:]] == list(range(37)) and m["holdout_start"] == lines[38].split(",")[0]
    assert list(json.loads((tmp_path / "a.csv.manifest.json").read_text())) == list(m) and len(m) == 22
    with pytest.raises(export.ExportError, match="exists"):
        export.export(spark, reg, "D", Mode.HMA, str(p), str(tmp_path / "a.csv"))


@pytest.mark.parametrize("why, change, other", [
    ("unknown header", lambda x: ["a,b,c", *x[1:]], {}), ("hash", None, {"source_sha256": "0" * 64}), ("fall back", lambda x: [x[0], x[2], x[1], *x[3:]], {}), ("empty", lambda x: [*x[:3], "", *x[3:]], {}),
    ("bad time", lambda x: [*x[:3], "noon" + x[3][28:], *x[4:]], {}), ("bad high", lambda x: [*x[:3], x[3].replace(",", ",x", 2).replace(",x", ",", 1), *x[4:]], {}), ("schema", None, {"source_schema": "fixture_v1"}), ("first or last", None, {"last_timestamp": "x"}),
])
def test_refused_exports_leave_nothing(spark, tmp_path, why, change, other):
    p, lines = capture(tmp_path, change=change)
    with pytest.raises(export.ExportError, match=why):
        export.export(spark, registered(tmp_path, p, lines, **other), "D", Mode.HMA, str(p), str(tmp_path / "a.csv"))
    assert sorted(f.name for f in tmp_path.iterdir()) == ["c.csv", "r.json"]


def test_spread_and_usage(spark, tmp_path):
    p, lines = capture(tmp_path, 3, head=HEAD + ",Spread", tail=",0.5")
    assert [r["spread"] for r in captures.read_strict(spark, p.as_uri()).collect()] == [0.5] * 3
    p, _ = capture(tmp_path, 3, name="bad.csv", head=HEAD + ",Spread", tail=",-1")
    with pytest.raises(Exception, match="bad spread"):
        captures.read_strict(spark, p.as_uri()).collect()
    assert main(["--mode", "hma"]) == 1
    assert captures.detect_schema(HEAD) == "recorder_v1" and captures.detect_schema(HEAD.lower()) is None


def test_registry():
    e = {"dataset_id": "b", "dataset_version": "1", "filename": "f", "source_sha256": "a" * 64, "first_timestamp": "x", "last_timestamp": "y", "partition_policy": registry.POLICY}
    assert [d.dataset_id for d in registry.load(json.dumps([e, e | {"dataset_id": "a"}]))] == ["a", "b"]
    for bad in ([e, e], [e | {"source_sha256": "A" * 64}], [e | {"partition_policy": "all"}], [e | {"source_schema": "z"}], [{"dataset_id": "q"}]):
        with pytest.raises(ValueError):
            registry.load(json.dumps(bad))
    with pytest.raises(KeyError):
        registry.find([], "a")


def test_frames(spark):
    pdf = pd.DataFrame({"O": [1.0, 2], "High": [2.0, 3], "l": [0.5, 1], "Price": [1.5, 2.5], "Vol": [10, 20], "DateTime": ["2024-01-01", "2024-01-02"]})
    got = captures.from_pandas(spark, pdf).orderBy("bar_index").collect()
    assert [(r["open"], r["close"], r["volume"], str(r["ts"])) for r in got] == [(1.0, 1.5, 10.0, "2024-01-01 00:00:00"), (2.0, 2.5, 20.0, "2024-01-02 00:00:00")]
    with pytest.raises(ValueError):
        captures.from_pandas(spark, pdf.iloc[:0])
    with pytest.raises(KeyError):
        captures.from_pandas(spark, pdf.drop(columns="Vol"))
    with pytest.raises(ValueError):
        captures.from_arrays(spark, [1.0], [1.0], [1.0], [1.0, 2.0])
    assert captures.from_arrays(spark, [1.0], [1.0], [1.0], [1.0]).collect()[0]["ts"] is None
    rates = spark.createDataFrame([(60, 1.0, 2.0, 0.5, 1.5, 7), (0, 1.0, 2.0, 0.5, 1.0, 3)], "time long, open double, high double, low double, close double, tick_volume long")
    assert [(r["bar_index"], r["volume"]) for r in captures.from_rates(rates).orderBy("bar_index").collect()] == [(0, 3.0), (1, 7.0)]
    with pytest.raises(ValueError):
        captures.materialize(synthetic.ramp(spark, 5), 6)


def test_permissive(spark, tmp_path):
    (tmp_path / "x.csv").write_text("whatever;a;b;c;d;e;f\n2024-01-01 00:00:00;1;2;x;4;5;zz\n")
    r = captures.read_permissive(spark, str(tmp_path / "x.csv"), ";").collect()[0]
    assert (r["open"], r["low"], r["volume"]) == (1.0, None, 5.0)


def test_fix_messages(spark):
    m = lambda *f: "\x01".join(f) + "\x01"
    rows = [
        (m("8=FIX.4.4", "35=W", "34=3", "55=1", "268=2", "269=0", "270=1.1", "271=5", "278=a", "269=1", "270=1.2", "278=b"),),
        (m("35=X", "34=4", "268=2", "279=2", "278=a", "55=1", "279=0", "269=1", "278=c", "270=1.3"),),
        (m("35=y", "34=1", "146=2", "55=1", "1007=EURUSD", "1008=5", "55=2", "1007=GBPUSD", "1008=5"),),
        (m("35=0", "34=9"),),
    ]
    df = spark.createDataFrame(rows, "message string")
    got = sorted(map(tuple, fix.quotes(df).collect()), key=str)
    assert got == sorted([(1, "bid", 1.1, 5.0, "a", "snapshot", 3), (1, "ask", 1.2, None, "b", "snapshot", 3), (1, None, None, None, "a", "delete", 4), (1, "ask", 1.3, None, "c", "new", 4)], key=str)
    assert sorted(map(tuple, fix.securities(df).collect())) == [("EURUSD", 1, 5), ("GBPUSD", 2, 5)]


def test_tick_bars_and_quotes(spark):
    q = spark.createDataFrame([("X", 1, None, 2.0), ("X", 2, 1.0, None), ("X", 3, None, 3.0), ("X", 4, 1.5, None), ("X", 5, 0.5, None)], "symbol string, ts int, bid double, ask double")
    t = bar_ops.two_sided(q, "symbol", ["ts"])
    assert [(r["ts"], r["bid"], r["ask"]) for r in t.orderBy("ts").collect()] == [(2, 1.0, 2.0), (3, 1.0, 3.0), (4, 1.5, 3.0), (5, 0.5, 3.0)]
    b = bar_ops.tick_bars(t, 3).orderBy("bar_index").collect()
    assert [(r["open"], r["high"], r["low"], r["close"], r["volume"], r["spread"], r["is_partial"]) for r in b] == [(1.0, 1.5, 1.0, 1.5, 3.0, 1.5, False), (0.5, 0.5, 0.5, 0.5, 1.0, 2.5, True)]
    n = bar_ops.numbered(q, "symbol", ["ts"], chunk=F.floor(F.col("ts") / 2))
    assert [r["bar_index"] for r in n.orderBy("ts").collect()] == [0, 1, 2, 3, 4]
    s = bar_ops.scan_summary(spark.createDataFrame([("X", 1, 5), ("X", 2, 5), ("X", 3, 4)], "symbol string, line_no int, ts int")).collect()[0]
    assert (s["rows"], s["first_ts"], s["last_ts"], s["duplicates"], s["regressions"]) == (3, 5, 4, 1, 1)


def test_series(spark):
    f = hma(4).apply(synthetic.walk(spark, 30))
    assert series.listing(f, 3, 20, 5).count() == 4 and len(series.listing(f).columns) == 14
    c = series.chart_series(f).orderBy("bar_index").collect()
    assert c[0]["reversal_is_bar"] != c[0]["reversal_is_bar"] and dict(series.chart_series(f).dtypes)["reversal_is_bar"] == "double"
    assert series.terminal_buffers(f).columns[2:] == ["reference", "distance", "scale", "normalized"]
    assert len(series.to_dicts(f)) == 30 == len(series.to_pandas(f))


def test_captures_are_split_over_tasks(spark, tmp_path):
    """Lines keep their numbers when a file is read in many blocks, and when several files are."""
    rows = [f"2024-01-01T00:{i // 60 % 60:02d}:{i % 60:02d}.0000000Z,1.5,2,1,{1 + i / 1000},{i}" for i in range(2000)]
    head = "OpenTimeUtc,Open,High,Low,Close,TickVolume"
    (tmp_path / "a.csv").write_bytes("\r\n".join([head, *rows]).encode())
    (tmp_path / "b.csv").write_bytes(("\n".join([head, *rows[:7]]) + "\n").encode())
    (tmp_path / "bad.csv.x").write_bytes(b"OpenTimeUtc\xff")
    (tmp_path / "empty.csv.x").write_bytes(b"")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = captures.read_strict(spark, f"file://{tmp_path}/*.csv")
        assert got.rdd.getNumPartitions() > 5
        found = sorted((r["path"][-5:], r["line_no"], r["close"], r["volume"]) for r in got.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == sorted([("a.csv", i + 2, 1 + i / 1000, float(i)) for i in range(2000)] + [("b.csv", i + 2, 1 + i / 1000, float(i)) for i in range(7)])
    with pytest.raises(Exception, match="not UTF-8"):
        captures.strict_lines(spark, f"file://{tmp_path}/bad.csv.x").collect()
    with pytest.raises(ValueError, match="empty"):
        captures.strict_lines(spark, f"file://{tmp_path}/empty.csv.x")
