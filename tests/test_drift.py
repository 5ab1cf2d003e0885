from pyspark.sql import functions as F

from barloom.pipeline.schema_drift import bar_table, drift, headers, type_statistics, cells

LINES = "filename string, line_no int, line_text string"
REG = "row_id long, dataset_id string, dataset_version string, filename string, source_schema string"


def capture(filename, header, first, n, row, delimiter=","):
    """Lines of `n` bars from number `first`; `row` makes the values of a bar."""
    return [(filename, 1, delimiter.join(header))] + [(filename, 2 + k, delimiter.join(row(first + k))) for k in range(n)]


def t(i):
    return f"2024-01-01T00:{i:02d}:00.1230000Z"


def price(i, k):
    return f"{1.3 + i / 1000 + k / 7:.5f}"


def tables(spark):
    lines = capture("a1", ["OpenTimeUtc", "Open", "High", "Low", "Close", "TickVolume"], 0, 14, lambda i: [t(i), price(i, 0), price(i, 1), price(i, 2), price(i, 3), str(100 + i * i)])
    v2 = capture("a2", ["﻿OPENTIMEUTC", "PX_OPEN", "CLOSE", "HIGH", "LOW", "n_ticks", "Venue"], 4, 14, lambda i: [t(i), price(i, 0), price(i, 3), price(i, 1), price(i, 2), f"{100 + i * i}.0" if i % 5 else "", "asia"], ";")
    v10 = capture("a10", ["px_open", "open_time", "close", "high", "low", "n_ticks", "venue"], 8, 12, lambda i: [price(i, 0), str(1704067200123 + 60000 * i), "$" + price(i, 3), price(i, 1), price(i, 2), str(100 + i * i), "asia"], "\t")
    lines += [("a2", 0, "# note")] + v2[::-1] + [v2[3]] + v10
    reg = [(1, "A", "v1", "a1", "recorder_v1"), (2, "A", "ver 2", "a2", " Recorder_V1_1 "), (3, "A", "V10", "a10", None), (4, "A", "10", "a10", ""), (5, "A", "v3", "none", "fixture_v1"), (6, "A", "v1", "a1", "odd")]
    return spark.createDataFrame(lines, LINES), spark.createDataFrame(reg, REG)


WANT = {
    ("A", "a2", "renamed", "open", "px_open"), ("A", "a2", "renamed", "tickvolume", "n_ticks"), ("A", "a2", "added", "", "venue"), ("A", "a2", "mislabelled", "recorder_v1_1", ""),
    ("A", "a10", "renamed", "opentimeutc", "open_time"), ("A", "a10", "retyped", "close", "close"), ("A", "a10", "retyped", "n_ticks", "n_ticks"),
}


def test_changes(spark):
    lines, reg = tables(spark)
    assert {tuple(r) for r in drift(lines, reg).collect()} == WANT
    extra = lines.withColumns({"m": F.lit(1), "text": F.lit("x"), "fields": F.lit(2), "path": F.lit(0)}).repartition(4)
    assert {tuple(r) for r in drift(extra, reg.withColumn("before", F.lit(1)).orderBy(F.desc("row_id"))).collect()} == WANT


def test_equal_fields_renamed_at_once(spark):
    lines = capture("b1", ["OpenTimeUtc", "Swap", "Bonus", "Fee", "Rate"], 0, 9, lambda i: [t(i), "0", "0", "0", price(i, 0)])
    lines += capture("b2", ["OpenTimeUtc", "x", "y", "rate_2", "z"], 0, 9, lambda i: [t(i), "0", "0", price(i, 0), "0"])
    reg = [(1, "B", "1", "b1", None), (2, "B", "2", "b2", None)]
    got = {tuple(r)[2:] for r in drift(spark.createDataFrame(lines, LINES), spark.createDataFrame(reg, REG)).collect()}
    assert got == {("renamed", "bonus", "x"), ("renamed", "fee", "y"), ("renamed", "swap", "z"), ("renamed", "rate", "rate_2")}


def test_bar_table(spark):
    lines, reg = tables(spark)
    rows = bar_table(lines, reg)
    assert rows.count() == 14 + 14 + 12
    r = rows.filter("filename = 'a10' AND line_no = 3").collect()[0]
    assert (r["open"], r["close"], r["volume"], r["time_us"], r["others"], r["failed"]) == (float(price(9, 0)), float(price(9, 3)), 181.0, 1704067740123000, {"venue": "asia"}, [])
    assert rows.filter("filename = 'a2' AND volume IS NULL").count() == 3


def test_odd_lines(spark):
    rows = [("f", 1, "a,a,,b"), ("f", 2, "1,2.5,x,true,9"), ("f", 3, "1"), ("f", 4, ""), ("f", 5, None), (None, 1, "a,b"), ("f", None, "1,2"), ("g", 1, "# only notes"), ("h", 1, "x" * 200_000)]
    lines = spark.createDataFrame(rows, LINES)
    assert {r["filename"]: r["fields"] for r in headers(lines).filter("filename <> 'h'").collect()} == {"f": ["a", "a#2", "#3", "b"]}
    heads = headers(lines)
    s = {r["path"]: r["type"] for r in type_statistics(cells(lines, heads), heads).collect()}
    assert s == {"a": "integer", "a#2": "decimal", "#3": "text", "b": "boolean", "#5": "integer"}
    reg = spark.createDataFrame([(1, "D", None, "f", None), (2, None, "v1", "f", "recorder_v1"), (3, "D", "no number", "h", "fixture_v1")], REG)
    assert {r["change"] for r in drift(lines, reg).collect()} <= {"added", "removed", "mislabelled"}
    assert drift(lines.filter("false"), reg).collect() == [] and bar_table(lines.filter("false"), reg).collect() == []


def test_failed_casts_and_zones(spark):
    """Values that cannot be cast are named, whatever column they are in; times without zone are wall time of the file's recorder."""
    lines = [("z1", 1, "OpenTimeUtc,Open,High,Low,Close,TickVolume"), ("z1", 2, "03/07/2024 12:00:00,1.5,n/a,$1.25,1.3 px,12"), ("z1", 3, "soon,1.5,1.6,1.2,1.3,twelve"), ("z1", 4, "03/07/2024 12:01:00,,1.6,1.2,0x30"), ("z1", 4, "03/07/2024 12:01:00,,1.6,1.2,0x30")]
    lines += [("z2", 1, "OpenTimeUtc,Open,High,Low,Close,TickVolume"), ("z2", 2, "2024-07-03T10:00:00.1234567Z,1,2,1,2,3"), ("z2", 3, "2024-02-30T10:00:00.0000000Z,1,2,1,2,3"), ("n", 1, "a,a,a#2"), ("n", 2, "1,2,3,4")]
    reg = spark.createDataFrame([("Z", "1", "z1", None, 4), ("Y", "1", "z2", None, 99)], "dataset_id string, dataset_version string, filename string, source_schema string, recorder_id int")
    recorders = spark.createDataFrame([(4, "Europe/Berlin", "dmy"), (4, "Europe/Paris", "ymd")], "recorder_id int, zone string, date_order string")
    got = {(r["filename"], r["line_no"]): r for r in bar_table(spark.createDataFrame(lines, LINES), reg, recorders).collect()}
    assert len(got) == 6
    a, b, c = got["z1", 2], got["z1", 3], got["z1", 4]
    assert (a["time_us"], a["open"], a["low"], a["close"], a["failed"]) == (1720000800000000, 1.5, 1.25, 1.3, ["high"])  # Berlin, two hours ahead
    assert (b["time_us"], b["failed"]) == (None, ["time", "volume"]) and c["failed"] == ["close"] and c["open"] is None
    assert got["z2", 2]["time_us"] == 1720000800123456 and got["z2", 3]["failed"] == ["time"]
    assert got["n", 2]["dataset_id"] is None and len(got["n", 2]["others"]) >= 3
