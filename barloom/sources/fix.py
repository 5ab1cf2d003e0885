"""Recorded quote sessions in tag=value messages, parsed in bulk: snapshots (35=W), incremental refreshes (35=X) and security lists (35=y).

A live session is not a Spark job; recorders write its messages as lines, and these are read in batch or as a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Meanings of the codes in MDEntryType (269) and MDUpdateAction (279).
SIDES = {"0": "bid", "1": "ask"}
ACTIONS = {"0": "new", "1": "change", "2": "delete"}
SOH = "\x01"


def _codes(table: dict[str, str], c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def _fields(df: DataFrame, message: str) -> DataFrame:
    pairs = F.filter(F.split(F.col(message), SOH), lambda x: x.contains("="))
    pairs = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^(\d+)=", 1).alias("tag"), F.regexp_replace(x, r"^[^=]*=", "").alias("value")))
    return df.withColumn("_f", pairs)


def _first(tag: str) -> Column:
    return F.get(F.filter(F.col("_f"), lambda x: x.tag == tag), F.lit(0)).value


def _group(opens: str) -> Column:
    """The repeating groups of a message: each begins at tag `opens`, and is a map from tag to value."""
    f = F.col("_f")
    starts = F.filter(F.transform(f, lambda x, i: F.when(x.tag == opens, i)), lambda i: i.isNotNull())
    ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(f)))
    spans = F.arrays_zip(starts.alias("a"), ends.alias("b"))
    return F.when(F.size(starts) > 0, F.transform(spans, lambda s: F.slice(f, s["a"] + 1, s["b"] - s["a"])))


def _in(group: str, tag: str) -> Column:
    return F.get(F.filter(F.col(group), lambda x: x.tag == tag), F.lit(0)).value


def quotes(messages: DataFrame, message: str = "message", keep: tuple[str, ...] = ()) -> DataFrame:
    """Long quote entries of snapshot and refresh messages: `keep`, symbol_id, side, price, size, entry_id, update, msg_seq.

    In a refresh each entry names its symbol, or takes that of the entry before it in the message; entries of other types than bid and ask are left out.
    """
    df = _fields(messages, message).withColumn("_kind", _first("35")).filter(F.col("_kind").isin("W", "X"))
    df = df.withColumn("_g", F.when(F.col("_kind") == "W", _group("269")).otherwise(_group("279")))
    rows = df.select(*keep, "_kind", _first("55").alias("_symbol"), _first("34").cast("long").alias("msg_seq"), F.col("_g").alias("_all"), F.posexplode("_g").alias("_i", "_e"))
    earlier = F.slice("_all", F.lit(1), F.col("_i") + 1)
    named = F.filter(F.transform(earlier, lambda e: F.get(F.filter(e, lambda x: x.tag == "55"), F.lit(0)).value), lambda v: v.isNotNull())
    symbol = F.when(F.col("_kind") == "W", F.col("_symbol")).otherwise(F.element_at(named, F.when(F.size(named) > 0, -1)))
    update = F.when(F.col("_kind") == "W", F.lit("snapshot")).otherwise(_codes(ACTIONS, _in("_e", "279")))
    out = rows.select(
        *keep, symbol.cast("int").alias("symbol_id"), _codes(SIDES, _in("_e", "269")).alias("side"), _in("_e", "270").cast("double").alias("price"), _in("_e", "271").cast("double").alias("size"),
        _in("_e", "278").alias("entry_id"), update.alias("update"), "msg_seq",
    )
    return out.filter(F.col("side").isNotNull() | (F.col("update") == "delete"))


def securities(messages: DataFrame, message: str = "message", name_tag: str = "1007", digits_tag: str = "1008") -> DataFrame:
    """symbol, symbol_id and digits of security list messages; a symbol that is listed again counts once."""
    df = _fields(messages, message).filter(_first("35") == "y").withColumn("_g", _group("55"))
    rows = df.select(F.explode("_g").alias("_e")).select(_in("_e", name_tag).alias("symbol"), _in("_e", "55").cast("int").alias("symbol_id"), _in("_e", digits_tag).cast("int").alias("digits"))
    return rows.filter("symbol IS NOT NULL").groupBy("symbol").agg(F.max(F.struct("symbol_id", "digits")).alias("s")).select("symbol", "s.symbol_id", "s.digits")
