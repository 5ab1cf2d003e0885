"""Captures whose fields drift between versions: one bar table, and a report of each change.

Lines are read as values by path (the paths of a file are held once, by place), with raw types; type statistics are aggregated per file and path. Successive
versions of a dataset are then compared by these statistics alone; only for paths that may have been renamed
are values looked at, by the bars that both captures hold. Typed columns are projected by path, casts that fail are reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.common import cut, settled
from barloom.pipeline.timestamps import abbreviations, parse_times

# The declared schemas and their field names, in lower case; delimiters; raw types of values.
SCHEMAS = {
    "recorder_v1": ["opentimeutc", "open", "high", "low", "close", "tickvolume"],
    "recorder_v1_1": ["opentimeutc", "open", "high", "low", "close", "tickvolume", "spread"],
    "fixture_v1": ["datetime", "open", "high", "low", "close", "volume"],
}
DELIMITERS = [",", ";", "|", "\t"]
_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
_TIME = r"^\d{4}[-./]\d{1,2}[-./]\d{1,2}(?:[Tt ]\s*\d{1,2}:\d{2}.*)?$|^\d{1,2}[-/ ](?:\d{1,2}|[A-Za-z]{3})[-/ ]\d{4}(?: .*)?$|^\d{8}[Tt ]\d{6}\S*$"
# Raw types by number, in the order of precedence when they are equally common in a column.
TYPES = ["text", "time", "boolean", "decimal", "integer"]


def raw_type(v: Column) -> Column:
    """integer, decimal, boolean, time or text; null for an empty value."""
    # What is left of plain numbers without their digits settles most values; only others are matched.
    rest = F.translate(v, "0123456789", "")
    return (
        F.when(v == "", None)
        .when(rest == "", "integer")
        .when((rest == ".") & (F.length(v) > 1), "decimal")
        .when(v.rlike(r"^[+-]?\d+$"), "integer")
        .when(v.rlike(f"^{_NUMBER}$"), "decimal")
        .when(F.lower(v).isin("true", "false", "yes", "no"), "boolean")
        .when(v.rlike(_TIME), "time")
        .otherwise("text")
    )


def _clean(c: str) -> Column:
    """A line without byte order mark, blanks before it and line end. A leading tab is a delimiter and stays."""
    return F.rtrim(F.ltrim(F.col(c), F.lit(" \ufeff")), F.lit("\r\n"))


def _pieces(line: Column, delimiter: Column) -> Column:
    # One branch a delimiter: a split at a fixed character needs no pattern.
    parts = [F.split(line, "[|]" if d == "|" else d, -1) for d in DELIMITERS]
    whole = F.coalesce(*[F.when(delimiter == d, p) for d, p in zip(DELIMITERS, parts)])
    return F.transform(whole, lambda x: F.trim(x))


def _data(lines: DataFrame) -> DataFrame:
    text = lines.select("filename", "line_no", _clean("line_text").alias("text"))
    return text.dropna().filter((F.trim("text") != "") & ~F.col("text").startswith("#"))


def headers(lines: DataFrame) -> DataFrame:
    """Per file: the header's line number, the delimiter and the fields, lower-cased and trimmed.

    The header is the first line, by line_no, that is not blank and does not begin with `#`; of two texts with one number, the lesser. Its delimiter is the
    one it holds most. An empty field name becomes its place (`#3`), a repeated one gets its place added.
    """
    heads = _data(lines).groupBy("filename").agg(F.min(F.struct("line_no", "text")).alias("h")).select("filename", "h.line_no", "h.text")
    count = lambda d: F.length("text") - F.length(F.replace("text", F.lit(d)))
    best = F.greatest(*[count(d) for d in DELIMITERS])
    delimiter = F.coalesce(*[F.when(count(d) == best, F.lit(d)) for d in DELIMITERS])
    heads = heads.withColumn("delimiter", delimiter)
    heads = heads.withColumn("names", F.transform(_pieces(F.col("text"), F.col("delimiter")), lambda x: F.lower(x)))
    unique = F.transform("names", lambda x, i: F.when(x == "", F.concat(F.lit("#"), i + 1)).when(F.array_position("names", x) <= i, F.concat(x, F.lit("#"), i + 1)).otherwise(x))
    return heads.select("filename", F.col("line_no").alias("header_no"), "delimiter", unique.alias("fields"))


def cells(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Data lines as values by place: filename, line_no, `v`, and what `files` (filename, header_no, delimiter, ...) has beside. The path of a place is its field in the header, see `path_of`; short
    lines lack places."""
    rows = _data(lines).join(files, "filename").filter("line_no > header_no")
    more = [c for c in files.columns if c not in ("filename", "header_no", "delimiter", "fields")]
    return rows.select("filename", "line_no", _pieces(F.col("text"), F.col("delimiter")).alias("v"), *more)


def path_of(fields: Column, place: Column) -> Column:
    """The path of a place (from 0): its field, or the place itself for a surplus value."""
    return F.coalesce(F.get(fields, place), F.concat(F.lit("#"), place + 1))


def type_statistics(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Per file and path: values of each raw type, empty values, and the type the path has.

    Integers and decimals together are decimal; of other mixtures the commonest type counts, a tie goes to the first of text, time, boolean, decimal, integer.
    """
    long = settled(rows.select("filename", F.posexplode("v").alias("place", "value")), kind=raw_type(F.col("value")))
    n = long.groupBy("filename", "place").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in TYPES], F.count(F.when(F.col("kind").isNull(), 1)).alias("empty"))
    figures = {"text": F.col("text"), "time": F.col("time"), "boolean": F.col("boolean"), "decimal": F.when(F.col("decimal") > 0, F.col("decimal") + F.col("integer")).otherwise(0), "integer": F.when(F.col("decimal") == 0, F.col("integer")).otherwise(0)}
    best = F.greatest(*figures.values())
    n = n.withColumn("type", F.coalesce(*[F.when((c == best) & (best > 0), k) for k, c in figures.items()]))
    return n.join(heads.select("filename", "fields"), "filename").select("filename", path_of(F.col("fields"), F.col("place")).alias("path"), *TYPES, "empty", "type")


def _versions(registry: DataFrame) -> DataFrame:
    """filename, dataset_id and version as numbers, part by part. A version without number comes first."""
    digits = F.filter(F.split(F.regexp_replace("dataset_version", r"[^0-9.]+", ""), r"\."), lambda x: x != "")
    return (
        registry.select("filename", "dataset_id", F.transform(digits, lambda x: x.try_cast("int")).alias("version")).dropna(subset=["filename", "dataset_id"])
        .groupBy("filename").agg(F.min("dataset_id").alias("dataset_id"), F.min("version").alias("version"))
    )


def _bare_number(v: Column) -> Column:
    """The number in a value with a sign of currency or a unit around it, null without one."""
    plain = F.when(F.translate(v, "0123456789.", "") == "", v.try_cast("double"))
    return F.coalesce(plain, F.nullif(F.regexp_extract(v, rf"^[^\d.+-]{{0,3}}\s*({_NUMBER})\s*[A-Za-z%]{{0,4}}$", 1), F.lit("")).try_cast("double"))


def _comparable(value: Column, kind: Column, instant: Column) -> Column:
    """A value so that equal readings are equal texts: numbers without notation and unit, times as instants."""
    number = F.when(kind != "boolean", _bare_number(value))
    return F.when(value == "", None).otherwise(F.coalesce(instant.cast("string"), number.cast("string"), F.lower(value)))


def _zones(registry: DataFrame, recorders: DataFrame | None) -> tuple[DataFrame, dict]:
    """Zone and date order of each file by its recorder, UTC and ymd where none is known; and the offsets of the zones' abbreviations. Of several recorders of a file the least counts."""
    if recorders is None:
        return registry.select("filename", F.lit("UTC").alias("zone"), F.lit("ymd").alias("date_order")).dropna().distinct(), {}
    who = recorders.groupBy("recorder_id").agg(F.min("zone").alias("zone"), F.min("date_order").alias("date_order"))
    # Zones are names of the IANA list, some hundreds at most: the one thing that the driver reads.
    offsets = abbreviations(sorted(r[0] for r in who.select("zone").distinct().dropna().collect()))
    files = registry.dropna(subset=["filename"]).groupBy("filename").agg(F.min("recorder_id").alias("recorder_id")).join(who, "recorder_id", "left")
    return files.select("filename", F.coalesce("zone", F.lit("UTC")).alias("zone"), F.coalesce("date_order", F.lit("ymd")).alias("date_order")), offsets


def _clock(v: Column) -> Column:
    """The place of a line's own instant: the first value that is a time or a long enough plain number, null without one."""
    timely = lambda x: (F.length(x) >= 8) & (x.rlike(r"^\d{12,16}$|^\d{9,10}\.\d+$|^1\d{9}$") | x.rlike(_TIME))
    return F.get(F.filter(F.transform(v, lambda x, i: F.when(timely(x), i)), lambda i: i.isNotNull()), F.lit(0))


def _pairs(heads: DataFrame, registry: DataFrame) -> DataFrame:
    """Successive versions of a dataset: the later file and the one before, their fields, and those that are gone and new."""
    w = Window.partitionBy("dataset_id").orderBy("version", "filename")
    files = heads.select("filename", "fields").join(_versions(registry), "filename").select("dataset_id", "filename", "fields", F.lag("filename").over(w).alias("before"), F.lag("fields").over(w).alias("old_fields"))
    return cut(files.filter("before IS NOT NULL").select("*", F.array_except("old_fields", "fields").alias("gone"), F.array_except("fields", "old_fields").alias("new")), "pairs")


def _asked(pairs: DataFrame) -> DataFrame:
    return pairs.filter("size(gone) > 0 AND size(new) > 0")


def timed_cells(lines: DataFrame, heads: DataFrame, registry: DataFrame, recorders: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """`cells` with the place of the line's instant, `at`, and the instant, `us`, in the zone of the file's recorder. Written once: everything below reads it.

    With `only`, times are read in the files it names; in others they are null.
    """
    zones, offsets = _zones(registry, recorders)
    files = heads.select("filename", "header_no", "delimiter").join(zones, "filename", "left")
    files = files.withColumns({"zone": F.coalesce("zone", F.lit("UTC")), "date_order": F.coalesce("date_order", F.lit("ymd"))})
    timed = F.lit(True)
    if only is not None:
        files = files.join(only.select("filename", F.lit(True).alias("timed")).distinct(), "filename", "left")
        timed = F.col("timed")
    # One small table of the files, so that lines are joined once.
    rows = settled(cells(lines, cut(files, "files")), at=F.when(timed, _clock(F.col("v"))))
    rows = parse_times(rows.withColumn("clock", F.get("v", F.col("at"))), "clock", "zone", "date_order", offsets, "us", "us_late")
    return cut(rows.select("filename", "line_no", "v", "at", "us"), "cells")


def drift(lines: DataFrame, registry: DataFrame, recorders: DataFrame | None = None) -> DataFrame:
    """Changes between the captures of successive versions, and files whose declared schema is another than their header's.

    dataset_id, filename (the later version's), change (added, removed, renamed, retyped, mislabelled), old_name, new_name; names that do not apply are empty. Files
    that the registry lacks have no version and are left out. A removed and an added field are one renamed field if, on every bar of both
    captures where both have a value (two bars at least), these are the same; of several partners the pair that agrees on most bars comes first, then the
    first by name, until no two fields that are left agree.
    Empty values agree with nothing; a path without any value has no type and is never retyped. A declared schema of unknown name, null or empty is no mislabelling.
    """
    heads = cut(headers(lines), "headers")
    pairs = _pairs(heads, registry)
    # Bars are compared only where fields may be renamed.
    sides = _asked(pairs).select(F.explode(F.array("filename", "before")).alias("filename"))
    return _changes(timed_cells(lines, heads, registry, recorders, sides), heads, pairs, registry)


def _changes(rows: DataFrame, heads: DataFrame, pairs: DataFrame, registry: DataFrame) -> DataFrame:
    versions = _versions(registry)
    types = type_statistics(rows, heads).select("filename", "path", "type").filter("type IS NOT NULL")

    old = types.select(F.col("filename").alias("before"), "path", F.col("type").alias("old_type"))
    retyped = (
        pairs.join(types, "filename").join(old, ["before", "path"]).filter("type <> old_type")
        .select("dataset_id", "filename", F.lit("retyped").alias("change"), F.col("path").alias("old_name"), F.col("path").alias("new_name"))
    )

    # Values of the fields that may be renamed, by bar. The bar is the instant in its line.
    asked = _asked(pairs)
    places = lambda names, fields: F.transform(names, lambda x: F.struct(x.alias("path"), (F.array_position(fields, x) - 1).cast("int").alias("place")))
    sides = asked.select("filename", F.col("filename").alias("pair"), F.lit(True).alias("later"), places(F.col("new"), F.col("fields")).alias("wanted")).unionByName(
        asked.select(F.col("before").alias("filename"), F.col("filename").alias("pair"), F.lit(False).alias("later"), places(F.col("gone"), F.col("old_fields")).alias("wanted"))
    )
    picked = rows.filter("us IS NOT NULL").join(sides, "filename")
    picked = picked.select("pair", "later", F.col("us").alias("bar"), F.inline(F.transform("wanted", lambda x: F.struct(x.path.alias("path"), F.get("v", x.place).alias("value")))))
    picked = settled(picked.filter("value IS NOT NULL"), kind=raw_type(F.col("value")))
    # The line's own instant stands for any time in it.
    said = picked.select("pair", "later", "bar", "path", _comparable(F.col("value"), F.col("kind"), F.when((F.col("kind") == "time") | F.col("value").rlike(r"^\d{12,16}$"), F.col("bar"))).alias("v")).filter("v IS NOT NULL")
    a = said.filter("later").select("pair", "bar", F.col("path").alias("new_name"), F.col("v").alias("nv")).distinct()
    b = said.filter("NOT later").select("pair", "bar", F.col("path").alias("old_name"), F.col("v").alias("ov")).distinct()
    agree = a.join(b, ["pair", "bar"]).groupBy("pair", "old_name", "new_name").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("nv") == F.col("ov"), 1)).alias("same")).filter("same = n AND n >= 2")
    # Best pairs first, each name once: what repeated rounds of mutual best come to. A pair of files has a candidate for two of its own fields at most.
    best = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("rank"), "old_name", "new_name")))
    free = lambda done, x: ~F.exists(done, lambda d: (d.old_name == x.old_name) | (d.new_name == x.new_name))
    none = F.array().cast("array<struct<rank:bigint,old_name:string,new_name:string>>")
    chosen = F.aggregate("best", none, lambda done, x: F.when(free(done, x), F.concat(done, F.array(x))).otherwise(done))
    renamed = cut(agree.groupBy("pair").agg(best.alias("best")).select(F.col("pair").alias("filename"), F.inline(chosen)).drop("rank"), "renamed")

    taken = renamed.groupBy("filename").agg(F.collect_set("old_name").alias("olds"), F.collect_set("new_name").alias("news"))
    left = pairs.join(taken, "filename", "left")
    rest = lambda names, used: F.explode(F.array_except(names, F.coalesce(used, F.slice(names, 1, 0))))
    added = left.select("dataset_id", "filename", F.lit("added").alias("change"), F.lit("").alias("old_name"), rest("new", F.col("news")).alias("new_name"))
    removed = left.select("dataset_id", "filename", F.lit("removed").alias("change"), rest("gone", F.col("olds")).alias("old_name"), F.lit("").alias("new_name"))
    moved = renamed.join(versions.select("filename", "dataset_id"), "filename").select("dataset_id", "filename", F.lit("renamed").alias("change"), "old_name", "new_name")

    declared = registry.select("dataset_id", "filename", F.lower(F.trim("source_schema")).alias("old_name")).distinct()
    expected = F.element_at(F.create_map(*[x for k, names in SCHEMAS.items() for x in (F.lit(k), F.array_sort(F.array(*map(F.lit, names))))]), F.col("old_name"))
    wrong = declared.join(heads, "filename").filter(expected != F.array_sort("fields")).select("dataset_id", "filename", F.lit("mislabelled").alias("change"), "old_name", F.lit("").alias("new_name"))
    return added.unionByName(removed).unionByName(moved).unionByName(retyped).unionByName(wrong)


# The columns of the bar table, and the names under which captures first hold them.
COLUMNS = {"open": ["open"], "high": ["high"], "low": ["low"], "close": ["close"], "volume": ["tickvolume", "volume"], "spread": ["spread"]}
TIMES = ["opentimeutc", "datetime"]


def lineage(heads: DataFrame, registry: DataFrame, changes: DataFrame) -> DataFrame:
    """The first name of each path of each file, its renamings followed back through the versions of its dataset: filename, path, name.

    One dataset's headers and renamings, a line or two a version, are walked in one task; no values are.
    """
    versions = _versions(registry)
    moves = changes.filter("change = 'renamed'").groupBy("filename").agg(F.map_from_entries(F.collect_list(F.struct("new_name", "old_name"))).alias("moves"))
    files = heads.select("filename", "fields").join(versions, "filename").join(moves, "filename", "left")
    none = F.create_map().cast("map<string,string>")
    ordered = F.collect_list(F.struct("version", "filename", "fields", F.map_entries(F.coalesce("moves", none)).alias("moves")))
    begin = F.struct(none.alias("known"), F.array().cast("array<struct<filename:string,known:map<string,string>>>").alias("out"))

    def walk(so_far: Column, file: Column) -> Column:
        moved = F.map_from_entries(file.moves)
        known = F.map_from_arrays(file.fields, F.transform(file.fields, lambda p: F.coalesce(F.element_at(so_far.known, F.coalesce(F.element_at(moved, p), p)), p)))
        return F.struct(known.alias("known"), F.concat(so_far.out, F.array(F.struct(file.filename.alias("filename"), known.alias("known")))).alias("out"))

    walked = files.groupBy("dataset_id").agg(F.array_sort(ordered).alias("files")).select(F.inline(F.aggregate("files", begin, walk, lambda end: end.out)))
    return walked.select("filename", F.explode("known").alias("path", "name"))


def bar_table(lines: DataFrame, registry: DataFrame, recorders: DataFrame | None = None) -> DataFrame:
    """All captures as one table: dataset_id, filename, line_no, time_us, open, high, low, close, volume, spread, others, failed.

    Columns follow their fields through renamings; numbers lose notation and unit, times are read in the zone of their file's recorder. `others` maps the remaining fields to their texts; `failed`
    names the columns whose value is there but could not be cast (null in their column). A line comes once, however often it is repeated; of several texts with one number the least counts, value by
    value. Files without registration have a null dataset_id and keep their own field names.
    """
    heads = cut(headers(lines), "headers")
    rows = timed_cells(lines, heads, registry, recorders)
    changes = _changes(rows, heads, _pairs(heads, registry), registry)
    names = lineage(heads, registry, changes)
    # A file's fields by place, as they were first called. A name of an older field that came back beside its renamed one would clash: the path's own name then counts, with its place.
    first = F.transform("fields", lambda x: F.coalesce(F.element_at("names", x), x))
    called = F.transform("first", lambda x, i: F.when(F.array_position("first", x) == i + 1, x).otherwise(F.concat(x, F.lit("#"), i + 1)))
    names = names.groupBy("filename").agg(F.map_from_entries(F.collect_list(F.struct("path", "name"))).alias("names"))
    named = heads.join(names, "filename", "left").withColumn("first", first).select("filename", called.alias("called"))
    zones, offsets = _zones(registry, recorders)
    files = cut(named.join(_versions(registry).select("filename", "dataset_id"), "filename", "left").join(zones, "filename", "left"), "files")

    place = lambda names: F.coalesce(*[F.nullif(F.array_position("called", F.lit(n)), F.lit(0)) for n in names])
    text = lambda names: F.nullif(F.coalesce(*[F.get("v", (F.nullif(F.array_position("called", F.lit(n)), F.lit(0)) - 1).cast("int")) for n in names]), F.lit(""))
    rows = rows.join(files, "filename")
    rows = settled(rows, clock=text(TIMES), same=F.coalesce(place(TIMES) - 1 == F.col("at"), F.lit(False)), **{f"t_{c}": text(ns) for c, ns in COLUMNS.items()})
    # The instant of a line is parsed already; a time field at another place is not.
    rows = rows.withColumns({"rest": F.when(~F.col("same"), F.col("clock")), "zone": F.coalesce("zone", F.lit("UTC")), "date_order": F.coalesce("date_order", F.lit("ymd"))})
    rows = parse_times(rows.withColumnRenamed("us", "own_us"), "rest", "zone", "date_order", offsets, "us", "us_late")
    rows = settled(rows, time_us=F.when(F.col("same"), F.col("own_us")).otherwise(F.col("us")), **{c: _bare_number(F.col(f"t_{c}")) for c in COLUMNS})
    failed = F.array_compact(F.array(F.when(F.col("clock").isNotNull() & F.col("time_us").isNull(), F.lit("time")), *[F.when(F.col(f"t_{c}").isNotNull() & F.col(c).isNull(), F.lit(c)) for c in COLUMNS]))
    known = [n for ns in (*COLUMNS.values(), TIMES) for n in ns]
    entries = F.transform("v", lambda x, i: F.struct(path_of(F.col("called"), i).alias("key"), x.alias("value")))
    others = F.array_sort(F.filter(entries, lambda e: ~e.key.isin(known)))
    keys = F.transform(others, lambda e: e.key)
    others = F.filter(others, lambda e, i: F.array_position(keys, e.key) == i + 1)
    bar = F.struct("time_us", *COLUMNS, others.alias("others"), failed.alias("failed"))
    once = rows.select("dataset_id", "filename", "line_no", bar.alias("bar")).groupBy("filename", "line_no").agg(F.min("dataset_id").alias("dataset_id"), F.min("bar").alias("bar"))
    return once.select("dataset_id", "filename", "line_no", "bar.time_us", *[f"bar.{c}" for c in COLUMNS], F.map_from_entries("bar.others").alias("others"), "bar.failed")
