"""Implausible readings: spikes, stuck values and impossible ranges, each against its own source.

Spikes: per source, jumps in units of its usual move fill daily profile matrices (rows are days, columns
times of day). Robust principal components part each matrix into a low-rank profile of normal behaviour
and a sparse rest. Normal behaviour is bounded by the spike limit, so that no jump beyond it can be taken for normal: the
rest holds every cell with a spike in it, and the readings of those cells are then checked one by one.
Stuck values and ranges have tests of their own.

Where the limit is fixed, as in `flag_ticks` and `flag_bars`, the check decides and the profile only says where to look. `unusual_cells` lets the profile decide: what a source does
every day at that time is normal, however large.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.common import chunk_neighbours, cut

ROWS = 64  # rows of one profile matrix: longer histories are split, so that no task holds a whole source


def robust_components(m: np.ndarray, seen: np.ndarray, limit: float, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Low-rank and sparse part of `m` (principal component pursuit by alternating multipliers).

    Unseen cells are filled with their column's median and are never sparse. No cell of the low-rank part exceeds `limit`.
    """
    m = np.where(seen, m, np.nan)
    with np.errstate(all="ignore"):
        filled = np.where(np.isnan(m), np.nan_to_num(np.nanmedian(np.where(seen.any(0), m, 0.0), axis=0)), m)
    filled = np.minimum(filled, limit)  # what lies beyond the limit is no normal behaviour to learn from
    norm = np.linalg.norm(filled)
    low, sparse = np.zeros_like(filled), np.zeros_like(filled)
    if norm > 0:
        lam = 1 / np.sqrt(max(filled.shape))
        two = np.linalg.norm(filled, 2)
        dual = filled / max(two, np.abs(filled).max() / lam)
        mu, top = 1.25 / two, 1.25e7 / two
        for _ in range(rounds):
            u, s, vt = np.linalg.svd(filled - sparse + dual / mu, full_matrices=False)
            low = (u * np.maximum(s - 1 / mu, 0)) @ vt
            r = filled - low + dual / mu
            sparse = np.sign(r) * np.maximum(np.abs(r) - lam / mu, 0)
            rest = filled - low - sparse
            dual, mu = dual + mu * rest, min(mu * 1.5, top)
            if np.linalg.norm(rest) < 1e-6 * norm:
                break
    low = np.minimum(low, limit)
    return low, np.where(seen, np.nan_to_num(m) - low, 0.0)


def sparse_cells(cells: DataFrame, source: str, limit: float) -> DataFrame:
    """Cells (source, day, slot) whose jump `x` (log1p of usual moves) is not explained by the low-rank profile of its source.

    `cells` has at most one row a cell; `day` is an integer. A cell counts when it exceeds its normal value by more than the normal value
    leaves up to the limit, or half of log1p(limit).
    """
    bound = float(np.log1p(limit))

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        days, r = np.unique(pdf["day"].to_numpy(), return_inverse=True)
        slots, c = np.unique(pdf["slot"].to_numpy(), return_inverse=True)
        m, seen = np.zeros((len(days), len(slots))), np.zeros((len(days), len(slots)), bool)
        m[r, c], seen[r, c] = pdf["x"].to_numpy(), True
        low, rest = robust_components(m, seen, bound * 0.999)
        hit = rest > np.minimum(bound - low, bound / 2)
        i, j = np.nonzero(hit & seen)
        return pd.DataFrame({source: pdf[source].iloc[0], "day": days[i], "slot": slots[j], "excess": rest[i, j]})

    kind = dict(cells.dtypes)[source]
    blocks = cells.withColumn("block", F.floor(F.col("day") / ROWS)).groupBy(source, "block")
    # Written out, so that its size is known before it is joined: the readings then move only if it is large.
    return cut(blocks.applyInPandas(part, f"{source} {kind}, day long, slot int, excess double"), "cells")


def _median(c: Column) -> Column:
    """Exact median. Values are counted before they are merged; rounding off float noise keeps the counts few."""
    return F.percentile(F.round(c, 9), F.lit(0.5))


def unusual_cells(cells: DataFrame, source: str, times: float = 8.0) -> DataFrame:
    """Cells that are unusual for their time of day: source, day, slot, x, `normal` (the low-rank profile) and `excess` over it.

    A cell counts when its excess is `times` robust deviations of its matrix's excesses, and at least a doubling of the jump. What a source does every day at that time is its profile and no excess;
    the same jump at another time is one. `cells` as for `sparse_cells`; nulls and NaN are no cells.
    """

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        days, r = np.unique(pdf["day"].to_numpy(), return_inverse=True)
        slots, c = np.unique(pdf["slot"].to_numpy(), return_inverse=True)
        m, seen = np.zeros((len(days), len(slots))), np.zeros((len(days), len(slots)), bool)
        m[r, c], seen[r, c] = pdf["x"].to_numpy(), True
        low, rest = robust_components(m, seen, np.inf)
        values = rest[seen]
        usual = 1.4826 * np.median(np.abs(values - np.median(values)))
        i, j = np.nonzero(seen & (rest > max(times * usual, np.log(2.0))))
        return pd.DataFrame({source: pdf[source].iloc[0], "day": days[i], "slot": slots[j], "x": m[i, j], "normal": low[i, j], "excess": rest[i, j]})

    kind = dict(cells.dtypes)[source]
    known = cells.filter(F.col(source).isNotNull() & F.col("day").isNotNull() & F.col("slot").isNotNull() & F.col("x").isNotNull() & ~F.isnan("x"))
    blocks = known.withColumn("block", F.floor(F.col("day") / ROWS)).groupBy(source, "block")
    return blocks.applyInPandas(part, f"{source} {kind}, day long, slot int, x double, normal double, excess double")


def _tick_readings(ticks: DataFrame, longest: int, slots: int) -> tuple[DataFrame, DataFrame]:
    """Readings with their neighbours and their symbol's usual move, and the cells of daily profiles: the largest jump of each slot in usual moves."""
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000)
    num = lambda c: F.when(~F.isnan(c), F.col(c))
    r = (
        ticks.select("symbol", F.col("ts_recv_utc").alias("ts"), num("bid").alias("bid"), num("spread").alias("spread"))
        .dropna(subset=["symbol", "ts", "bid"])
        .withColumn("day", day)
        .groupBy("symbol", "day", "ts")
        .agg(F.min("bid").alias("bid"), F.min("spread").alias("spread"))
    )
    r = chunk_neighbours(r, ["symbol"], "day", "ts", F.struct("bid", "ts"), after=longest, run_of=F.col("bid"))
    r = r.withColumn("slot", F.floor(F.pmod(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(86_400_000_000)) / (86_400_000_000 // slots)).cast("int"))
    before = F.col("nb_prev.bid")
    usual = cut(r.groupBy("symbol").agg(_median(F.abs(F.col("bid") - before)).alias("usual"), _median(F.col("spread")).alias("usual_spread")), "usual")
    r = r.join(usual, "symbol")
    jump = F.coalesce(F.abs(F.col("bid") - before), F.abs(F.col("bid") - F.col("nb_next1.bid")))
    return r, r.groupBy("symbol", "day", "slot").agg(F.max(_in_units(jump, F.col("usual"))).alias("x")).dropna()


def unusual_tick_hours(ticks: DataFrame, times: float = 8.0, slots: int = 48) -> DataFrame:
    """Stretches of a day (`slots` a day) in which a symbol's bid jumped more than it does at that time on other days: symbol, slot_us (start), jump and normal jump in usual moves."""
    found = unusual_cells(_tick_readings(ticks, 1, slots)[1], "symbol", times)
    start = (F.col("day") * 86_400 + F.col("slot") * (86_400 // slots)) * 1_000_000
    return found.select("symbol", start.alias("slot_us"), F.expm1("x").alias("jump"), F.expm1("normal").alias("normal_jump"))


def flag_ticks(ticks: DataFrame, moves: float = 25, longest: int = 3, stuck: int = 20, wide: float = 15, slots: int = 48) -> DataFrame:
    """Symbol, time and reasons of implausible tick readings; `flagged_rows` gives their rows.

    Readings are ordered by ts_recv_utc per symbol; rows with null symbol, time or bid are no readings, copies (same symbol and time) count once,
    the least bid and spread standing for a time with several. Reasons: bid not above zero (range); up to `longest` readings
    more than `moves` usual moves from both neighbours, which are closer than that to each other (spike); `stuck` or more successive readings with
    one bid (stuck); spread negative or at least `wide` medians (spread). A null spread is not tested; NaN counts as null.
    The usual move is the symbol's median absolute change; a symbol with one reading has none and no spikes.
    """
    r, cells = _tick_readings(ticks, longest, slots)
    before = F.col("nb_prev.bid")
    odd = sparse_cells(cells, "symbol", moves)

    # A run of spikes is found at its first reading, the one that jumps away from the reading before.
    far = F.col("usual") * moves
    nexts = [F.col(f"nb_next{k}") for k in range(1, longest + 1)]
    sizes = []
    for k in range(1, longest + 1):
        after = nexts[k - 1].bid
        off = F.abs(before - after) < far
        for v in [F.col("bid"), *[x.bid for x in nexts[: k - 1]]]:
            off &= (F.abs(v - before) > far) & (F.abs(v - after) > far)
        sizes.append(F.when(off, k).otherwise(0))
    spikes = (
        r.join(odd.select("symbol", "day", "slot"), ["symbol", "day", "slot"], "left_semi")
        .withColumn("size", F.greatest(*sizes, F.lit(0)))
        .filter("size > 0")
        .select("symbol", F.explode(F.slice(F.array("ts", *[x.ts for x in nexts[:-1]]), F.lit(1), F.col("size"))).alias("ts"), F.lit("spike").alias("reason"))
    )

    frozen = _stuck(r, "symbol", "ts", stuck)
    at_once = F.array(
        F.when(F.col("bid") <= 0, F.lit("range")), F.when((F.col("spread") < 0) | (F.col("spread") >= F.col("usual_spread") * wide), F.lit("spread"))
    )
    others = r.select("symbol", "ts", F.explode(F.array_compact(at_once)).alias("reason"))
    return _reasons(spikes.unionByName(frozen).unionByName(others), "symbol", "ts")


def flag_bars(bars: DataFrame, jumps: float = 15, stuck: int = 10, row: int = 96, chunk: int = 4096) -> DataFrame:
    """Dataset, bar_index and reasons of implausible bars; `flagged_rows` gives their rows.

    Bars are ordered by bar_index per dataset (times may be damaged, positions are not); rows with null dataset_id, bar_index, High or Low are no
    bars, copies (same dataset and index) count once. Reasons: High below Low, Open or Close, Low above Open or Close, or Low not above zero
    (range); High above, or Low below, that of each neighbour by more than `jumps` medians of High - Low (spike);
    `stuck` or more successive bars with one High and one Low (stuck). A null Open or Close is not tested. A dataset's profile has `row` bars a row.
    """
    num = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    b = (
        bars.select("dataset_id", F.col("bar_index").cast("long").alias("bar_index"), num("Open"), num("High"), num("Low"), num("Close"))
        .dropna(subset=["dataset_id", "bar_index", "High", "Low"])
        .withColumn("chunk", F.floor(F.col("bar_index") / chunk))
        .groupBy("dataset_id", "chunk", "bar_index")
        .agg(*[F.min(c).alias(c) for c in ("Open", "High", "Low", "Close")])
    )
    b = chunk_neighbours(b, ["dataset_id"], "chunk", "bar_index", F.struct("High", "Low"), run_of=F.struct("High", "Low"))
    b = b.join(cut(b.groupBy("dataset_id").agg(_median(F.col("High") - F.col("Low")).alias("usual")), "usual"), "dataset_id")
    prev, nxt = F.col("nb_prev"), F.col("nb_next1")

    beyond = lambda side: F.greatest(F.col("High") - side.High, side.Low - F.col("Low"))
    jump = F.greatest(F.coalesce(beyond(prev), beyond(nxt)), F.lit(0.0))
    cells = b.withColumn("day", F.floor(F.col("bar_index") / row)).withColumn("slot", F.pmod("bar_index", F.lit(row)).cast("int"))
    odd = sparse_cells(cells.select("dataset_id", "day", "slot", _in_units(jump, F.col("usual")).alias("x")).dropna(), "dataset_id", jumps)
    limit = F.col("usual") * jumps
    none = prev.isNull() & nxt.isNull()
    above = F.coalesce(F.col("High") - prev.High > limit, F.lit(True)) & F.coalesce(F.col("High") - nxt.High > limit, F.lit(True))
    below = F.coalesce(prev.Low - F.col("Low") > limit, F.lit(True)) & F.coalesce(nxt.Low - F.col("Low") > limit, F.lit(True))
    spikes = cells.join(odd.select("dataset_id", "day", "slot"), ["dataset_id", "day", "slot"], "left_semi").filter(~none & (above | below)).select("dataset_id", "bar_index", F.lit("spike").alias("reason"))

    frozen = _stuck(b, "dataset_id", "bar_index", stuck)
    top, bottom = F.greatest("Low", "Open", "Close"), F.least("Open", "Close", "High")
    ranges = b.filter((F.col("High") < top) | (F.col("Low") > bottom) | (F.col("Low") <= 0)).select("dataset_id", "bar_index", F.lit("range").alias("reason"))
    return _reasons(spikes.unionByName(frozen).unionByName(ranges), "dataset_id", "bar_index")


def _stuck(r: DataFrame, source: str, position: str, least: int) -> DataFrame:
    """The rows of runs of `least` or more equal values. Runs are counted before they are joined."""
    held = cut(r.groupBy(source, "run_start").count().filter(F.col("count") >= least).select(source, "run_start"), "held")
    return r.select(source, "run_start", position).join(held, [source, "run_start"], "left_semi").select(source, position, F.lit("stuck").alias("reason"))


def _in_units(jump: Column, usual: Column) -> Column:
    """Size of a jump in usual moves, as a logarithm. Where the usual move is nothing, any jump is as large as can be."""
    return F.when(usual > 0, F.log1p(jump / usual)).otherwise(F.when(jump > 0, 700.0).when(jump == 0, 0.0))


def _reasons(flags: DataFrame, source: str, position: str) -> DataFrame:
    return cut(flags.groupBy(source, position).agg(F.array_sort(F.collect_set("reason")).alias("reasons")), "flags")


def flagged_rows(rows: DataFrame, flags: DataFrame, on: dict[str, str]) -> DataFrame:
    """`row_id` and reasons of the rows, each copy included, at the flagged positions; `on` maps a column of `rows` to one of `flags`."""
    f = flags.select(*[F.col(b).alias(f"_{b}") for b in on.values()], "reasons")
    r = rows.select("row_id", *on)
    return r.join(f, [r[a] == f[f"_{b}"] for a, b in on.items()]).select("row_id", "reasons")


def implausible(ticks: DataFrame, bars: DataFrame) -> DataFrame:
    """`source_table`, `row_id` and reasons of every row of ticks and bars with an implausible reading."""
    t = flagged_rows(ticks.filter("bid IS NOT NULL AND NOT isnan(bid)"), flag_ticks(ticks), {"symbol": "symbol", "ts_recv_utc": "ts"})
    b = flagged_rows(bars.filter("High IS NOT NULL AND Low IS NOT NULL"), flag_bars(bars), {"dataset_id": "dataset_id", "bar_index": "bar_index"})
    return t.select(F.lit("ticks").alias("source_table"), "*").unionByName(b.select(F.lit("bars").alias("source_table"), "*"))
