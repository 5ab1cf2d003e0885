from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from barloom.pipeline.timestamps import abbreviations, parse_times, settle_twice, table_times

NY, BERLIN, KOLKATA = "America/New_York", "Europe/Berlin", "Asia/Kolkata"


def us(*a, zone="UTC", micro=0):
    return int(datetime(*a, tzinfo=ZoneInfo(zone)).timestamp()) * 1_000_000 + micro


CASES = [
    ("2024-06-01T10:20:30.1234567Z", "UTC", "ymd", us(2024, 6, 1, 10, 20, 30, micro=123456)),
    (" 2024-06-01 10:20:30.538+02:00 ", NY, "mdy", us(2024, 6, 1, 8, 20, 30, micro=538000)),
    ("2024-06-01t10:20:30.5z", NY, "mdy", us(2024, 6, 1, 10, 20, 30, micro=500000)),
    ("2024-10-22 21:45:26,920-05:00", "UTC", "ymd", us(2024, 10, 23, 2, 45, 26, micro=920000)),
    ("2024-03-25 04:43:46+0100", "UTC", "ymd", us(2024, 3, 25, 3, 43, 46)),
    ("2024-02-19T15:43:14+11:00[Australia/Sydney]", NY, "ymd", us(2024, 2, 19, 4, 43, 14)),
    ("2024-02-19T15:43:14[Australia/Sydney]", NY, "ymd", us(2024, 2, 19, 4, 43, 14)),
    ("21/07/2023 19:02:06", BERLIN, "dmy", us(2023, 7, 21, 17, 2, 6)),
    ("07/08/2023 7:02:06 PM", NY, "mdy", us(2023, 7, 8, 19, 2, 6, zone=NY)),
    ("07/08/2023 12:02:06 AM", NY, "dmy", us(2023, 8, 7, 0, 2, 6, zone=NY)),
    ("2024/06/14 5:24:47 PM", KOLKATA, "ymd", us(2024, 6, 14, 11, 54, 47)),
    ("2023.11.10 20:45", BERLIN, "dmy", us(2023, 11, 10, 19, 45)),
    ("15-Jul-2026 03:07:24", "UTC", "ymd", us(2026, 7, 15, 3, 7, 24)),
    ("Tue, 24 Oct 2023 05:16:08 -0500", "UTC", "ymd", us(2023, 10, 24, 10, 16, 8)),
    ("Tue, 24 Oct 2023 10:16:08 GMT", NY, "mdy", us(2023, 10, 24, 10, 16, 8)),
    ("2023-02-08 14:58:23 CET", BERLIN, "dmy", us(2023, 2, 8, 13, 58, 23)),
    ("2023-07-08 14:58:23 IST", KOLKATA, "dmy", us(2023, 7, 8, 9, 28, 23)),
    ("20251105 141306", "UTC", "ymd", us(2025, 11, 5, 14, 13, 6)),
    ("20230208T135833Z", NY, "ymd", us(2023, 2, 8, 13, 58, 33)),
    ("1689930126.186", NY, "ymd", 1689930126186000), ("1740502409", NY, "ymd", 1740502409000000), ("1774544762198", NY, "ymd", 1774544762198000), ("1729777740046000", NY, "ymd", 1729777740046000),
    ("2024-02-29 00:00:00", "UTC", "ymd", us(2024, 2, 29)), ("2024-06-01", "UTC", "ymd", us(2024, 6, 1)),
    # what names no instant
    *[(t, NY, "mdy", None) for t in (None, "", "n/a", "NULL", "0000-00-00 00:00:00", "2025-06-", "2023-02-30T10:00:00Z", "2023-02-29 10:00:00", "2023-13-10 11:46:00", "2025-05-15T25:43:11Z", "31/05/2021 19:00:00", "13:00", "2024-06-01 13:00:00 PM", "2024-03-10T02:36:00.743", "2023-07-08 14:58:23 CET", "12345", "x" * 100_000)],
    ("2024-06-01 10:00:00", "No/Where", "mdy", None), ("2024-06-01T10:00:00[No/Where]", NY, "mdy", None), ("2024-06-01 10:00:00", None, "mdy", None), ("01/02/2024 10:00:00", NY, None, None),
]


def test_long_texts(spark):
    pad = " " * 50_000
    at = us(2024, 6, 1, 10, 20, 30, micro=123456)
    cases = [
        (pad + "2024-06-01T10:20:30.123456Z" + pad, at), ("2024-06-01T10:20:30.123456" + "7" * 50_000 + "Z", at), ("2024-06-01" + pad + "10:20:30.123456" + pad + "+00:00" + pad + "[UTC]", at),
        ("1717237230.123456" + "9" * 200, at), (pad + "01-Jun-2024" + pad + "10:20:30,123456 GMT", at),
        (pad, None), (pad + "2024-06-01" + pad + "10:20:30" + pad + "x", None), ("2024-06-01T10:20:30." + "7" * 50_000 + "x", None), ("9" * 50_000, None),
    ]
    df = spark.createDataFrame([(i, t, "UTC", "ymd", w) for i, (t, w) in enumerate(cases)], "i int, text string, zone string, o string, want long")
    for r in parse_times(df, "text", "zone", "o", {}).collect():
        assert r["early_us"] == r["late_us"] == r["want"], (r["i"], r["early_us"])


def test_notations(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, text string, zone string, o string, want long")
    out = parse_times(df, "text", "zone", "o", abbreviations([NY, BERLIN, KOLKATA])).collect()
    for r in out:
        assert r["early_us"] == r["want"] == r["late_us"], (r["text"] or "")[:60]


def test_clashing_columns_and_empty(spark):
    df = spark.createDataFrame([("2024-06-01 10:00:00 EDT", NY, "mdy")], "text string, zone string, o string").withColumns({"tp_parts": F.lit(1), "early_us": F.lit(2), "tp_wall": F.lit(3)})
    r = parse_times(df, "text", "zone", "o", abbreviations([NY])).collect()[0]
    assert (r["early_us"], r["tp_parts"], r["tp_wall"]) == (us(2024, 6, 1, 14), 1, 3)
    assert parse_times(df.filter("false"), "text", "zone", "o", {}).collect() == []


def test_hour_that_occurs_twice(spark):
    start = datetime(2020, 11, 1, 4, 30, tzinfo=timezone.utc)
    rows = [("D", i, (start + timedelta(minutes=5 * i)).astimezone(ZoneInfo(NY)).strftime("%Y-%m-%d %H:%M:%S"), us(2020, 11, 1, 4, 30) + 300_000_000 * i) for i in range(40)]
    rows[20] = ("D", 20, (start + timedelta(minutes=100)).strftime("%Y-%m-%dT%H:%M:%SZ"), rows[20][3])
    rows += [rows[19], ("E", 0, "2020-11-01 01:30:00", us(2020, 11, 1, 5, 30)), (None, 3, "2020-11-01 01:30:00", us(2020, 11, 1, 5, 30))]
    df = spark.createDataFrame(rows, "d string, i int, text string, want long").withColumns({"zone": F.lit(NY), "o": F.lit("mdy")}).repartition(3)
    p = parse_times(df, "text", "zone", "o", abbreviations([NY]))
    assert p.filter("early_us <> late_us").count() > 10
    for chunk in (4096, 7):
        for r in settle_twice(p, ["d"], "i", chunk=chunk).collect():
            assert r["utc_us"] == r["want"], r


def test_tables(spark):
    t = lambda rows, s: spark.createDataFrame(rows, s)
    rec = t([(1, "a", NY, "mdy"), (1, "a", NY, "mdy")], "recorder_id int, recorder_name string, zone string, date_order string")
    reg = t([(1, "2024-06-01T10:00:00.0000000Z", 1), (2, "1740502409", 1), (3, None, None)], "row_id long, first_timestamp string, recorder_id int")
    bars = t([(1, "D", 0, "06/01/2024 6:00:00 AM", 1)], "row_id long, dataset_id string, bar_index int, OpenTimeUtc string, recorder_id int")
    quotes = t([(1, "2024-06-01T10:00:00.000+00:00", 1), (2, "2024-06-01T10:00:00.000+01:00", 9)], "row_id long, ts_utc string, recorder_id int")
    got = {(r["source_table"], r["row_id"]): (r["utc_us"], r["plain"]) for r in table_times(reg, bars, quotes, rec).collect()}
    ten = us(2024, 6, 1, 10)
    assert got == {("registry", 1): (ten, True), ("registry", 2): (1740502409000000, False), ("registry", 3): (None, False), ("bars", 1): (ten, False), ("eurusd_quotes", 1): (ten, True), ("eurusd_quotes", 2): (ten - 3600_000_000, False)}
