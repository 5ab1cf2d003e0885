"""Times in mixed notations and zones, brought to one UTC instant.

All notations are one regular expression with named groups: one pass in the JVM writes the
components of a text in a fixed order, whatever its notation. Components are checked against the
calendar and put together by integer day arithmetic; no date parser and no Python is involved.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.common import chunk_prefix, cut, free_names, settled

# The parts of a notation. Group names end in a letter of their own, as Java wants them distinct.
_CLOCK = r"(?<h{k}>\d{{1,2}}):(?<n{k}>\d{{2}})(?::(?<s{k}>\d{{2}})(?:[.,](?<f{k}>\d+))?)?(?:\s*(?<p{k}>[AaPp][Mm])(?![A-Za-z]))?"
_ZONE = r"(?:\s*(?<z{k}>[+-]\d{{2}}:?\d{{2}}|[A-Za-z]{{1,5}}))?(?:\s*\[(?<r{k}>[A-Za-z_/+\-0-9]+)\])?"
_NOTATIONS = {
    "a": r"(?<y{k}>\d{{4}})-(?<m{k}>\d{{1,2}})-(?<d{k}>\d{{1,2}})(?:[Tt\s]\s*" + _CLOCK + _ZONE + ")?",
    "b": r"(?<y{k}>\d{{4}})[./](?<m{k}>\d{{1,2}})[./](?<d{k}>\d{{1,2}})(?:[Tt\s]\s*" + _CLOCK + _ZONE + ")?",
    "c": r"(?<i{k}>\d{{1,2}})/(?<j{k}>\d{{1,2}})/(?<y{k}>\d{{4}})(?:[Tt\s]\s*" + _CLOCK + _ZONE + ")?",
    "d": r"(?:[A-Za-z]{{3,9}},?\s+)?(?<d{k}>\d{{1,2}})[-\s](?<o{k}>[A-Za-z]{{3,9}})[-\s](?<y{k}>\d{{4}})(?:\s+" + _CLOCK + _ZONE + ")?",
    "e": r"(?<y{k}>\d{{4}})(?<m{k}>\d{{2}})(?<d{k}>\d{{2}})[Tt\s](?<h{k}>\d{{2}})(?<n{k}>\d{{2}})(?<s{k}>\d{{2}})(?:[.,](?<f{k}>\d+))?" + _ZONE,
    "g": r"(?<e{k}>\d{{9,10}}|\d{{12,13}}|\d{{15,16}})(?:\.(?<x{k}>\d+))?",
}
_PARTS = "ymoijdhnsfpzrex"
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
PLAIN_Z7 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{7}Z$"
PLAIN_UTC = r"^[1-9]\d{3}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?(?:Z|\+00:00)$"
PLAIN_MS = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}\+00:00$"

US = 1_000_000
DAY_US = 86_400 * US


def _compiled() -> tuple[str, str]:
    """The alternation, and the replacement that writes every part in the order of _PARTS after a mark."""
    alternatives = {k: p.format(k=k) for k, p in _NOTATIONS.items()}
    pattern = r"^[\s﻿ ]*(?:" + "|".join(alternatives.values()) + r")[\s ]*$"
    parts = ("".join(f"${{{p}{k}}}" for k, a in alternatives.items() if f"(?<{p}{k}>" in a) for p in _PARTS)
    return pattern, "\u0002\u0001" + "\u0001".join(parts)


def abbreviations(zones: Sequence[str], since: int = 1970, until: int = 2038) -> dict[tuple[str, str], int]:
    """Offset in seconds of each zone's abbreviations, found by walking its year; the latest use counts."""
    from zoneinfo import ZoneInfo

    found: dict[tuple[str, str], int] = {}
    for zone in zones:
        try:
            z = ZoneInfo(zone)
        except Exception:  # noqa: BLE001  an unknown zone has no abbreviations; its wall times stay unresolved
            continue
        at = datetime(since, 1, 1, tzinfo=timezone.utc)
        while at.year < until:
            local = at.astimezone(z)
            if (name := local.tzname() or "").isalpha():
                found[zone, name.upper()] = int(local.utcoffset().total_seconds())
            at += timedelta(days=20)
    return found


def known_zones(df: DataFrame) -> list[str]:
    """Names of the zones that the session knows. Others would end a query, so times in them stay unresolved."""
    jvm = df.sparkSession.sparkContext._jvm
    return sorted(jvm.java.lang.String.join(",", jvm.java.time.ZoneId.getAvailableZoneIds()).split(","))


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a civil date, counted from March so that the leap day comes last."""
    y = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(y / 400).cast("long")
    yoe = y - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return (era * 146097 + doe - 719468).cast("long")


def _utc(wall: Column, zone: Column) -> Column:
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), zone))


def _wall(utc: Column, zone: Column) -> Column:
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc), zone))


def parse_times(df: DataFrame, text: str, zone: str, date_order: str, offsets: dict[tuple[str, str], int], early: str = "early_us", late: str = "late_us") -> DataFrame:
    """`df` with the instants a text may name, in microseconds since 1970 UTC: `early` and `late`.

    They are equal unless the text is wall time that occurs twice. Both are null where the text is null,
    empty, in no known notation, not in the calendar, or wall time left out by the zone. A text without zone
    is wall time of the column `zone` (null or unknown zone: null); `date_order` (dmy, mdy) orders dates with
    slashes that do not begin with the year. `offsets` comes from `abbreviations`.
    """
    pattern, replacement = _compiled()
    own = free_names(df, ["tp_parts", "tp_num", "tp_zone", "tp_wall", "tp_utc", "tp_after", "tp_plain", "tp_rest"])
    c, k, z, w, u, a, q, t = own
    # Most texts are plain UTC times, which a cast reads (digits beyond the microsecond are dropped); they take no part in the alternation.
    plain = F.col(text).rlike(PLAIN_UTC)
    df = settled(df, **{q: F.when(plain, F.unix_micros(F.col(text).try_cast("timestamp"))), t: F.when(~plain, F.col(text))})
    raw = F.split(F.regexp_replace(F.col(t), F.lit(pattern), F.lit(replacement)), "\u0001")
    # Blanks and fractions may be of any length. No two repeats of the pattern share characters without one between, so a text is scanned in linear time.
    df = settled(df, **{c: raw})
    df = settled(df, **{c: F.when(F.get(F.col(c), F.lit(0)) == "\u0002", F.col(c))})
    part = {p: F.get(F.col(c), F.lit(i + 1)) for i, p in enumerate(_PARTS)}

    number = lambda p: part[p].try_cast("int")
    mdy = F.lower(F.trim(F.col(date_order))) == "mdy"
    dmy = F.lower(F.trim(F.col(date_order))) == "dmy"
    at = F.instr(F.lit(_MONTHS), F.lower(F.substring(part["o"], 1, 3)))
    numbers = (
        F.struct(
            number("y").alias("y"),
            F.coalesce(number("m"), F.when((part["o"] != "") & (at % 3 == 1), ((at + 2) / 3).cast("int")), F.when(mdy, number("i")).when(dmy, number("j"))).alias("m"),
            F.coalesce(number("d"), F.when(mdy, number("j")).when(dmy, number("i"))).alias("d"),
            F.coalesce(number("h"), F.lit(0)).alias("h"),
            F.lower(part["p"]).alias("p"),
            F.coalesce(number("n"), F.lit(0)).alias("n"),
            F.coalesce(number("s"), F.lit(0)).alias("s"),
            F.rpad(F.substring(part["f"], 1, 6), 6, "0").cast("int").alias("f"),
            F.nullif(F.upper(part["z"]), F.lit("")).alias("z"),
            F.nullif(part["r"], F.lit("")).alias("r"),
            _epoch(part["e"], part["x"]).alias("e"),
        )
    )
    df = settled(df, **{k: numbers})
    y, m, d, h, n, s = (F.col(f"{k}.{x}") for x in "ymdhns")
    last = F.when(m == 2, F.when((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)), 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    hour = F.when(F.col(f"{k}.p") == "", h).when(h.between(1, 12), h % 12 + F.when(F.col(f"{k}.p") == "pm", 12).otherwise(0))
    valid = (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= last) & (hour <= 23) & (n <= 59) & (s <= 59)
    wall = F.when(valid, _days(y, m, d) * DAY_US + ((hour * 60 + n) * 60 + s).cast("long") * US + F.col(f"{k}.f"))
    df = settled(df, **{w: wall})

    zt = F.col(f"{k}.z")
    minutes = F.substring(zt, 2, 2).try_cast("int") * 60 + F.substring(zt, -2, 2).try_cast("int")
    named = F.element_at(F.create_map(*[F.lit(x) for (zn, ab), o in offsets.items() for x in (f"{zn}|{ab}", o)]), F.concat_ws("|", F.col(zone), zt)) if offsets else F.lit(None).cast("int")
    offset = F.when(zt.startswith("+"), minutes * 60).when(zt.startswith("-"), minutes * -60).otherwise(F.coalesce(named, F.when(zt.isin("Z", "UTC", "GMT"), 0)))
    fixed = F.coalesce(F.col(q), F.col(f"{k}.e"), F.when(zt.isNotNull(), F.col(w) - offset.cast("long") * US))
    free = F.when(zt.isNull() & F.col(f"{k}.e").isNull(), F.col(w))  # null for plain times as well, which have no components
    df = settled(df.drop(early, late), **{early: fixed, u: free, z: F.coalesce(F.col(f"{k}.r"), F.col(zone))})
    # One text that all names stand in: a list of some hundred literals would slow down the planning of every later step.
    known = F.instr(F.lit("|" + "|".join(known_zones(df)) + "|"), F.concat(F.lit("|"), F.col(z), F.lit("|"))) > 0
    df = settled(df, **{z: F.when(F.col(u).isNotNull() & known & ~F.col(z).contains("|"), F.col(z))})
    df = settled(df.drop(w), **{w: F.col(u), u: _utc(F.col(u), F.col(z))})
    later = F.col(w) + F.col(u) + DAY_US - _wall(F.col(u) + DAY_US, F.col(z))
    df = settled(df, **{a: later, u: F.when(_wall(F.col(u), F.col(z)) == F.col(w), F.col(u))})
    twice = (F.col(a) > F.col(u)) & (_wall(F.col(a), F.col(z)) == F.col(w))
    return settled(df, **{late: F.coalesce(F.col(early), F.when(twice, F.col(a)).otherwise(F.col(u))), early: F.coalesce(F.col(early), F.col(u))}).drop(*own)


def _epoch(digits: Column, fraction: Column) -> Column:
    """Microseconds of a plain number: seconds, milliseconds or microseconds by its length."""
    n = digits.try_cast("long")
    more = lambda size: F.rpad(F.substring(fraction, 1, size), size, "0").cast("long")
    return F.when(F.length(digits).between(9, 10), n * US + more(6)).when(F.length(digits).between(12, 13), n * 1000 + more(3)).otherwise(n)


def settle_twice(df: DataFrame, keys: Sequence[str], order: str, early: str = "early_us", late: str = "late_us", out: str = "utc_us", chunk: int = 4096) -> DataFrame:
    """Settle wall times that occur twice by the rows before them: within `keys`, time does not fall as `order` rises.

    A row takes its late instant if an earlier row is certain to be at or after its early one, the early instant
    otherwise; rows of equal `order` do not settle each other. Once a row of an hour is late, those after it are.
    Rows without instant, key or order neither settle nor are settled by others (they take the early one).
    """
    c, lo, lo2, flag = free_names(df, ["time_chunk", "low_us", "low2_us", "late_flag"])
    df = df.withColumn(c, F.floor(F.col(order) / chunk))
    ordered = F.col(order).isNotNull()
    for k in keys:
        ordered &= F.col(k).isNotNull()
    some = df.filter(ordered & F.col(early).isNotNull())
    # One row per position first: copies must not settle each other.
    at = some.groupBy(*keys, c, order).agg(F.min(early).alias(lo), F.max(F.when(F.col(early) != F.col(late), F.col(early))).alias(flag), F.max(F.when(F.col(early) != F.col(late), F.col(late))).alias(lo2))
    at = chunk_prefix(at, keys, c, [order], F.col(lo), "before_us")
    first = F.col("before_us") >= F.col(flag)
    at = at.withColumn("sure_us", F.when(first, F.col(lo2)).otherwise(F.col(lo)))
    at = chunk_prefix(at, keys, c, [order], F.col("sure_us"), "before2_us")
    own = free_names(df, [f"{x}_at" for x in (*keys, order)])
    at = at.filter(F.col(flag).isNotNull() & (F.col("before2_us") >= F.col(flag))).select(*[F.col(x).alias(y) for x, y in zip((*keys, order), own)], F.lit(True).alias(flag))
    same = [F.col(x) == F.col(y) for x, y in zip((*keys, order), own)]
    joined = df.join(at, same, "left").withColumn(out, F.when(F.col(flag), F.col(late)).otherwise(F.col(early)))
    return joined.drop(c, flag, *own)


def table_times(registry: DataFrame, bars: DataFrame, quotes: DataFrame, recorders: DataFrame) -> DataFrame:
    """source_table, row_id, utc_us and `plain` (the text has its table's own form) of every row of the three tables.

    A recorder listed twice counts once, the least zone and order standing. Wall times of bars that occur twice are settled by the dataset's
    earlier bars; those of the other tables, which have no such order, take the earlier instant. `utc_us` is null where no instant is named.
    """
    rec = recorders.groupBy("recorder_id").agg(F.min("zone").alias("zone"), F.min("date_order").alias("date_order"))
    # Zones are names of the IANA list, some hundreds at most: the one thing that the driver reads.
    offsets = abbreviations(sorted(r[0] for r in rec.select("zone").distinct().dropna().collect()))

    def parsed(df: DataFrame, text: str, plain: str, *more: str) -> DataFrame:
        df = df.select("row_id", *more, F.col(text).alias("text"), "recorder_id").join(rec, "recorder_id", "left")
        return parse_times(df, "text", "zone", "date_order", offsets).withColumn("plain", F.coalesce(F.col("text").rlike(plain), F.lit(False)))

    # Parsed once: settling reads the rows several times.
    b = cut(parsed(bars, "OpenTimeUtc", PLAIN_Z7, "dataset_id", "bar_index").select("row_id", "dataset_id", "bar_index", "early_us", "late_us", "plain"), "bar_times")
    b = settle_twice(b, ["dataset_id"], "bar_index")
    parts = [("bars", b.select("row_id", "utc_us", "plain"))]
    for name, df, text, plain in (("registry", registry, "first_timestamp", PLAIN_Z7), ("eurusd_quotes", quotes, "ts_utc", PLAIN_MS)):
        parts.append((name, parsed(df, text, plain).select("row_id", F.col("early_us").alias("utc_us"), "plain")))
    out = [df.select(F.lit(n).alias("source_table"), "*") for n, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])
