"""The queries on texts, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.common import table
from barloom.llm import langid, mixing, packing
from barloom.llm.tokens import count_tokens


def p6_packs(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(count_tokens(table(spark, sf, "documents"), ["doc_id"]), table(spark, sf, "pack_sizes"))


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(p6_packs(spark, sf), table(spark, sf, "pack_sizes"))


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    targets, docs = table(spark, sf, "mix_targets"), table(spark, sf, "documents")
    # Texts of sources without a target are not measured.
    wanted = targets.select(mixing.source_name("source").alias("s")).distinct()
    docs = docs.join(wanted.hint("broadcast"), mixing.source_name("source") == wanted["s"], "left_semi")
    return mixing.mix(count_tokens(docs, ["doc_id", "source"]), targets)


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[1]


def p7_shares_by_chars(spark: SparkSession, sf: str) -> DataFrame:
    """The shares with sizes in characters, which SQL can count as well: quotas to the character, and whether each source is within half its longest text of it."""
    docs = table(spark, sf, "documents")
    sized = docs.select("doc_id", "source", F.length("text").alias("n_tokens"))
    shares = mixing.mix(sized, table(spark, sf, "mix_targets"))[1]
    longest = sized.groupBy(mixing.source_name("source").alias("source")).agg(F.max("n_tokens").alias("longest"))
    near = F.abs(F.col("tokens") - F.col("quota_tokens")) <= F.coalesce(F.col("longest"), F.lit(0)) / 2 + 1
    return shares.join(longest, "source", "left").select("source", "target_share", "tokens_once", "tokens_at_cap", F.round("quota_tokens", 0).cast("long").alias("quota"), "status", near.alias("near_quota"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    scorer = langid.fit(table(spark, sf, "lang_samples"), docs)
    return langid.relabelled(docs, scorer).select("doc_id", "lang", "first_cue")


def p8_spans(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return langid.label_texts(docs, langid.fit(table(spark, sf, "lang_samples"), docs))


def p6_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Packs of the texts measured in characters: per capacity the pieces, their characters, packs of whole pieces, and whether any pack is over its capacity."""
    caps = table(spark, sf, "pack_sizes")
    packs = packing.pack(table(spark, sf, "documents").select("doc_id", F.length("text").alias("n_tokens")), caps)
    packs = packs.withColumn("capacity", F.element_at(F.map_from_entries(F.array(*[F.struct(F.lit(r[0]), F.lit(r[1])) for r in caps.select("pack_name", "capacity_tokens").collect()])), F.col("pack_name")))
    filled = packs.groupBy("pack_name", "capacity", "shard", "pack_no").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).withColumn("none", F.col("pack_no").isNull())
    return filled.groupBy("pack_name").agg(
        F.sum("n").alias("pieces"), F.sum("t").cast("long").alias("chars"), F.count(F.when(~F.col("none") & (F.col("n") == 1) & (F.col("t") == F.col("capacity")), 1)).alias("whole_packs"),
        F.count(F.when(~F.col("none") & (F.col("t") > F.col("capacity")), 1)).alias("over"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p6_packs, p6_fill, p6_sizes, p7_mix, p7_shares, p7_shares_by_chars, p8_found, p8_spans)}


SQL = {}
# A source at its cap leaves the round, and the rest is shared out again: at most one round a source.
SQL["p7_shares_by_chars"] = """WITH RECURSIVE g AS (SELECT lower(trim(source)) AS source, sum(target_weight) AS w, min(max_repeats) AS r FROM mix_targets GROUP BY 1),
o AS (SELECT lower(trim(source)) AS source, sum(length(text)) AS once FROM documents WHERE length(text) > 0 GROUP BY 1),
s AS (SELECT g.source, w, coalesce(once, 0) AS once, coalesce(once * r, 0) AS most FROM g LEFT JOIN o USING (source)),
f(k, unit) AS (SELECT 0, (SELECT sum(once) / sum(w) FROM s WHERE once > 0)
 UNION ALL SELECT k + 1, (SELECT (t.total - coalesce(sum(CASE WHEN w * f.unit >= most THEN most END), 0)) / sum(CASE WHEN w * f.unit < most THEN w END) FROM s, (SELECT sum(once) AS total FROM s) t WHERE once > 0 GROUP BY t.total)
 FROM f WHERE k < 20),
u AS (SELECT max(unit) AS unit FROM f)
SELECT source, w AS target_share, CAST(once AS BIGINT) AS tokens_once, CAST(most AS BIGINT) AS tokens_at_cap, CAST(round(least(w * unit, most)) AS BIGINT) AS quota,
 CASE WHEN most = 0 THEN 'absent' WHEN w * unit >= most THEN 'capped' ELSE 'met' END AS status, true AS near_quota FROM s, u"""
# What of a packing does not hang on its choices: splits, whole packs that hold nothing else, and that no pack is over.
SQL["p6_sizes"] = """WITH n AS (SELECT pack_name, capacity_tokens AS c, coalesce(length(text), 0) AS n FROM documents, pack_sizes)
SELECT pack_name, CAST(sum(greatest(1, (n + c - 1) // c)) AS BIGINT) AS pieces, CAST(sum(n) AS BIGINT) AS chars, CAST(sum(n // c) AS BIGINT) AS whole_packs, CAST(0 AS BIGINT) AS over FROM n GROUP BY 1"""


def oracle_sql() -> dict[str, str]:
    """What SQL can say: packs and shares of the texts in characters. Tokens, hashes and floating point in order it cannot; tests hold the others to their rules."""
    return dict(SQL)
