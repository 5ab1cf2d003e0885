"""Mixing sources to target weights along a curriculum that changes over time.

Each source has a weight schedule over training time 0..1 whose integral is its share. The cumulative token demand of the
schedule is inverted: the document that begins at a source's token number c is due when the demand reaches c. Documents are then sorted by range of
that position. Cumulative tokens come from sums over chunks of a hashed order, so that no source is gathered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.common import cut


def source_name(c: str) -> Column:
    """A source as the targets spell it: trimmed, lower case."""
    return F.lower(F.trim(F.col(c)))


@dataclass(frozen=True)
class Share:
    """What a source gives: `quota` tokens of `once` it has, so that its share is `reached`; `slope` of its schedule."""

    source: str
    target: float
    once: int
    most: int
    quota: float
    slope: float


def plan(targets: list[tuple[str, float, int]], once: dict[str, int], total: float | None = None, exact: bool = False, strength: float = 0.5) -> list[Share]:
    """Quotas and schedules of all sources.

    Weights are taken relative to the sources that have tokens at all. The mix has `total` tokens, without it as many as these sources hold; a source at its cap gives all it may, and
    the others make up for it by their weights, until all are at their caps. With `exact`, the mix is the largest in which each source has just its share within its cap, and `total`
    is at most that: one scarce source then bounds it. A schedule is linear, w(t) = share x (1 + slope x (2t - 1)); sources with fewer tokens rise towards the end, slopes balance so
    that weights sum to 1 at any time.
    """
    import math

    there = [(s, w, r) for s, w, r in targets if once.get(s, 0) > 0 and w > 0 and r > 0]
    weight = sum(w for _, w, _ in there)
    most = {s: once[s] * r for s, _, r in there}
    if total is None:
        total = sum(once[s] for s, _, _ in there)
    if exact:
        total = min((most[s] / (w / weight) for s, w, _ in there), default=0.0)
    quota: dict[str, float] = {}
    open_, rest = {s: w for s, w, _ in there}, min(float(total), float(sum(most.values())))
    while open_:
        unit = rest / sum(open_.values())
        capped = [s for s, w in open_.items() if w * unit >= most[s] * (1 - 1e-12)]
        for s in capped or list(open_):
            quota[s] = min(float(most[s]), open_[s] * unit)
        if not capped:
            break
        rest -= sum(quota[s] for s in capped)
        for s in capped:
            del open_[s]
        rest = max(rest, 0.0)
    given = sum(quota.values()) or 1.0
    size = {s: math.log(once[s]) for s in quota}
    mean = sum(size[s] * quota[s] / given for s in quota)
    widest = max((abs(mean - x) for x in size.values()), default=0.0) or 1.0
    return [Share(s, w, once.get(s, 0), most.get(s, 0), quota.get(s, 0.0), strength * (mean - size[s]) / widest if s in quota else 0.0) for s, w, _ in targets]


def due(c: Column, quota: Column, slope: Column) -> Column:
    """The time at which a source's cumulative demand, quota x (t + slope x (t^2 - t)), reaches `c` tokens."""
    x = c / quota
    # The root in a form that holds for slope 0 as well.
    x = F.least(x, F.lit(1.0))
    return 2 * x / ((1 - slope) + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * x))


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, exact: bool = False, strength: float = 0.5, seed: int = 17, chunks: int = 4096, fine: float = 1 / 256) -> tuple[DataFrame, DataFrame]:
    """The chosen documents in training order, and the shares reached. `total` and `exact` as in `plan`.

    `docs` has doc_id, source and n_tokens; sources are matched trimmed and in lower case, those without target or null are left out, as are documents of no tokens. Chosen:
    doc_id, source, repeat (from 0), n_tokens, position (0..1). A source gives itself whole as often as its quota allows, then a part. Of the part, documents longer than `fine` of the quota
    are placed first, in proportion to what they are of the source, and the shorter ones make up what is left, both in hashed order: the source then misses its quota by half a short document
    at most, where it has short ones. Rows of equal doc_id are documents of their own, tied rows in any order. Shares: every target with its tokens once, cap, quota, tokens chosen, share of the mix,
    greatest repeat and status (met; capped: the whole source as often as allowed, short of its target; absent). A source named twice in `targets` counts with the sum of its weights and its least cap.
    """
    # Settings, one row a source; their number does not grow with the data.
    goal = targets.select(source_name("source").alias("source"), "target_weight", "max_repeats").dropna().groupBy("source").agg(F.sum("target_weight").alias("w"), F.min("max_repeats").alias("r"))
    goals = [(r["source"], float(r["w"]), int(r["r"])) for r in goal.orderBy("source").collect()]
    named = docs.select("doc_id", source_name("source").alias("source"), F.col("n_tokens").cast("long").alias("n_tokens")).filter(F.col("source").isin([s for s, _, _ in goals]) & (F.col("n_tokens") > 0))
    named = cut(named.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "n_tokens")).withColumn("chunk", F.pmod("h", F.lit(chunks)).cast("int")), "sized")
    once = {r["source"]: int(r["s"]) for r in named.groupBy("source").agg(F.sum("n_tokens").alias("s")).collect()}
    shares = plan(goals, once, total, exact, strength)
    spark = docs.sparkSession
    whole = {s.source: min(int(s.quota * (1 + 1e-12) / s.once), s.most // s.once) if s.once else 0 for s in shares}
    rows = [(s.source, s.target, s.once, s.most, s.quota, s.slope, whole[s.source], max(s.quota - whole[s.source] * s.once, 0.0), s.quota * fine) for s in shares]
    quotas = F.broadcast(spark.createDataFrame(rows, "source string, target double, once long, most long, quota double, slope double, whole int, part double, longest double"))

    # Tokens of long and of short documents before each document, in hashed order.
    kinds = {"far": F.when(F.col("n_tokens") > F.col("longest"), F.col("n_tokens")).otherwise(0), "near": F.when(F.col("n_tokens") > F.col("longest"), 0).otherwise(F.col("n_tokens"))}
    named = named.join(quotas, "source").withColumns(kinds)
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    heads = named.groupBy("source", "chunk").agg(*[F.sum(k).alias(k) for k in kinds]).select("source", "chunk", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"head_{k}") for k in kinds])
    within = Window.partitionBy("source", "chunk").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = named.select("*", *[F.coalesce(F.sum(k).over(within), F.lit(0)).alias(f"{k}_0") for k in kinds]).join(heads, ["source", "chunk"])
    placed = placed.select("doc_id", "source", "n_tokens", "far", *[(F.col(f"{k}_0") + F.col(f"head_{k}")).alias(f"{k}_before") for k in kinds])
    placed = cut(placed, "placed").join(quotas, "source")

    def taken(kind: str, quota: dict[str, float]) -> dict[str, int]:
        """Tokens of a source's documents of the kind, one after another while half of the next lies within the quota: what goes over and what stays short evens out."""
        if not quota:
            return {}
        limit = F.element_at(F.create_map(*[F.lit(x) for kv in quota.items() for x in kv]), F.col("source"))
        mine = placed.filter((F.col("far") > 0) == F.lit(kind == "far")).filter(F.col(f"{kind}_before") + F.col("n_tokens") / 2 <= limit)
        return {r["source"]: int(r["t"]) for r in mine.groupBy("source").agg(F.max(F.col(f"{kind}_before") + F.col("n_tokens")).alias("t")).collect()}

    all_long = {r["source"]: int(r["t"]) for r in placed.groupBy("source").agg(F.sum("far").alias("t")).collect()}
    part = {r[0]: r[7] for r in rows if r[2] and r[7] > 0}
    # Long ones also fill what the short ones cannot.
    long_ = taken("far", {s: max(p * all_long.get(s, 0) / once[s], p - (once[s] - all_long.get(s, 0))) for s, p in part.items() if all_long.get(s)})
    short = taken("near", {s: p - long_.get(s, 0) for s, p in part.items()})
    ends = F.broadcast(spark.createDataFrame([(s, long_.get(s, 0), short.get(s, 0)) for s in once] or [("", 0, 0)], "source string, far_end long, near_end long"))
    placed = placed.join(ends, "source")
    # Both kinds are taken from their beginnings, so that tokens chosen before a document follow from tokens before it.
    last = F.when(F.col("far") > 0, F.col("far_before") < F.col("far_end")).otherwise(F.col("near_before") < F.col("near_end"))
    c = F.when(F.col("repeat") < F.col("whole"), F.col("far_before") + F.col("near_before")).otherwise(F.least("far_before", "far_end") + F.least("near_before", "near_end"))
    times = F.col("whole") + F.when(last, 1).otherwise(0)
    chosen = (
        placed.filter(times > 0)
        .withColumn("repeat", F.explode(F.sequence(F.lit(0), times - 1)))
        .withColumn("position", due(c + F.col("repeat").cast("long") * F.col("once"), F.col("quota"), F.col("slope")))
        .select("doc_id", "source", "repeat", "n_tokens", "position")
    )
    chosen = cut(chosen, "chosen")
    got = chosen.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.max("repeat").alias("repeats"))
    all_tokens = Window.partitionBy(F.lit(1))
    status = F.when(F.col("most") <= 0, "absent").when(F.col("quota") >= F.col("most") * (1 - 1e-9), "capped").otherwise("met")
    report = (
        quotas.join(F.broadcast(got), "source", "left")
        .select(
            "source", F.col("target").alias("target_share"), F.col("once").alias("tokens_once"), F.col("most").alias("tokens_at_cap"), F.col("quota").alias("quota_tokens"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"), F.col("repeats").alias("greatest_repeat"), status.alias("status"),
        )
        .withColumn("share", F.try_divide(F.col("tokens"), F.sum("tokens").over(all_tokens)))
    )
    return chosen.repartitionByRange("position").sortWithinPartitions("position", "source", "doc_id"), report
