"""Irregular readings onto a regular grid, missing periods filled or marked.

Per day, sources with one period length form source-by-time matrices. Alternating least squares fits low-rank factors that sources share and a path
of each source's own, all of them smooth along time; their sum fills the missing cells. Observed cells stay exact, and cells without support (too few observations
in their row, or a gap too long that no other source was seen in) stay empty and marked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_S = 86_400
WIDTH = 64  # sources of one matrix at most
CELLS = 1_000_000  # cells of one matrix at most: periods of a few seconds have fewer sources to a matrix
REACH = 32  # periods between two observations of a source up to which its own path supports what lies between
FACTORS = ((1, 1000.0), (1, 1.0), (2, 1.0), (3, 1.0))  # ranks and penalties on loadings to choose from; under the heaviest, sources hardly share anything
_GRID = "symbol string, slot_s long, bid double, ask double, status string"


def trust(x: np.ndarray, seen: np.ndarray, usual_moves: float = 10.0, around: int = 3) -> np.ndarray:
    """Weight 0..1 of each observed cell: low where it lies many usual moves of its row from the median of the observations around it (a spike)."""
    out = np.zeros(x.shape)
    for i, on in enumerate(seen):
        at = np.flatnonzero(on)
        v = x[i, at]
        out[i, at] = 1.0
        k = min(around, (len(v) - 1) // 2)
        if k > 0 and (move := np.median(np.abs(np.diff(v)))) > 0:
            padded = np.concatenate([v[:k][::-1], v, v[::-1][:k]])
            middle = np.median(np.lib.stride_tricks.sliding_window_view(padded, 2 * k + 1), axis=1)
            out[i, at] = 1 / (1 + ((v - middle) / (usual_moves * move)) ** 2)
    return out


def own_paths(x: np.ndarray, on: np.ndarray) -> np.ndarray:
    """Each row's smoothest path (least sum of squared steps) through its cells `on`; level beyond the first and the last."""
    columns = np.arange(x.shape[1])
    return np.stack([np.interp(columns, at, x[i, at]) if len(at := np.flatnonzero(on[i])) else np.zeros(len(columns)) for i in range(len(x))])


def factorise(x: np.ndarray, weight: np.ndarray, rank: int, ridge: float, rounds: int = 4, smooth: float = 0.5) -> np.ndarray:
    """The fitted matrix: loadings u of `rank` shared column factors v, and own paths of what these leave.

    Minimises weighted squared errors + ridge |u|^2 + smooth |steps of v|^2, solving in turn for loadings, for the factors of even columns, for those of odd ones, and at last for the
    own paths. Cells of weight 0 count for nothing.
    """
    on = weight > 0
    path = own_paths(x, on)
    inside = np.maximum.accumulate(on, 1) & np.maximum.accumulate(on[:, ::-1], 1)[:, ::-1]
    start = np.where(inside, path, 0.0)
    rank = min(rank, len(x))
    # Factors start from the leading directions of the paths.
    v = start.T @ np.linalg.eigh(start @ start.T)[1][:, : -rank - 1 : -1]
    size = np.sqrt((v * v).mean(0))
    v /= np.where(size > 0, size, 1.0)
    eye, wx, n = np.eye(rank), weight * x, x.shape[1]
    u = np.zeros((len(x), rank))
    for _ in range(rounds):
        vv = (v[:, :, None] * v[:, None, :]).reshape(n, -1)
        u = np.linalg.solve((weight @ vv).reshape(-1, rank, rank) + eye * ridge, (wx @ v)[..., None])[..., 0]
        uu = (u[:, :, None] * u[:, None, :]).reshape(len(u), -1)
        a, b = (weight.T @ uu).reshape(-1, rank, rank) + eye * (0.05 + 2 * smooth), wx.T @ u
        for parity in (0, 1):
            beside = np.concatenate([v[:1], v[:-1]]) + np.concatenate([v[1:], v[-1:]])
            v[parity::2] = np.linalg.solve(a[parity::2], (b[parity::2] + smooth * beside[parity::2])[..., None])[..., 0]
    shared = u @ v.T
    return shared + own_paths(x - shared, on)


def complete(m: np.ndarray, seen: np.ndarray, factors: tuple[tuple[int, float], ...] = FACTORS, sure: float = 0.5) -> np.ndarray:
    """Completion of `m`, rows in units of their own spread. Observed cells that are not trusted at least `sure` take no part.

    Rank and penalty are those of `factors` with the least error on a tenth of the cells, held out by their place in their row.
    """
    weight = trust(m, seen)
    weight = np.where(weight >= sure, weight, 0.0)
    on = weight > 0
    count = np.maximum(on.sum(1, keepdims=True), 1)
    mean = np.where(on, m, 0.0).sum(1, keepdims=True) / count
    scale = np.sqrt((np.where(on, m - mean, 0.0) ** 2).sum(1, keepdims=True) / count)
    scale[scale == 0] = 1.0
    x = np.where(on, (m - mean) / scale, 0.0)
    held = on & (np.cumsum(on, 1) % 10 == 5)
    chosen = factors[0]
    if len(factors) > 1 and held.any():
        rest = np.where(held, 0.0, weight)
        chosen = min(factors, key=lambda f: np.abs(factorise(x, rest, *f) - x)[held].mean())
    return mean + scale * factorise(x, weight, *chosen)


def gap_sizes(seen: np.ndarray) -> np.ndarray:
    """Per cell: periods from the last observation before it to the next one, 0 at observations; as large as can be where there is none on a side."""
    n = seen.shape[1]
    col = np.broadcast_to(np.arange(n), seen.shape)
    last = np.maximum.accumulate(np.where(seen, col, -n), 1)
    following = np.minimum.accumulate(np.where(seen, col, 2 * n)[:, ::-1], 1)[:, ::-1]
    return following - last


def fill_block(pdf: pd.DataFrame, least: int = 3, reach: int = REACH) -> pd.DataFrame:
    """All periods of the block's sources between the first and the last reading of each, as `_GRID`."""
    grid = int(pdf["grid_s"].iloc[0])
    names, row = np.unique(pdf["symbol"].to_numpy().astype(str), return_inverse=True)
    slot = pdf["slot_s"].to_numpy() // grid
    lo, hi = slot.min(), slot.max()
    bid, ask, seen = (np.zeros((len(names), hi - lo + 1)) for _ in range(3))
    bid[row, slot - lo], ask[row, slot - lo], seen[row, slot - lo] = pdf["bid"].to_numpy(), pdf["ask"].to_numpy(), 1
    seen = seen.astype(bool)
    col = np.arange(hi - lo + 1)
    first = np.where(seen, col, len(col)).min(1)[:, None]
    last = np.where(seen, col, -1).max(1)[:, None]
    inside = (col >= first) & (col <= last)
    missing = inside & ~seen
    status = np.where(seen, "observed", "filled")
    if missing.any():
        full = complete(np.concatenate([bid, ask]), np.concatenate([seen, seen]))
        supported = (seen.sum(1) >= least)[:, None] & (seen.any(0)[None, :] | (gap_sizes(seen) <= reach))
        n = len(names)
        bid, ask = np.where(seen, bid, np.where(supported, full[:n], np.nan)), np.where(seen, ask, np.where(supported, full[n:], np.nan))
        status = np.where(missing & ~supported, "unsupported", status)
    i, j = np.nonzero(inside)
    return pd.DataFrame({"symbol": names[i], "slot_s": (j + lo) * grid, "bid": bid[i, j], "ask": ask[i, j], "status": status[i, j]})


def regular_grid(ticks: DataFrame, instruments: DataFrame) -> DataFrame:
    """Bid and ask per symbol and regular period, between the periods of its first and last reading of each UTC day.

    A reading is a row with symbol, time, bid and ask (NaN counts as null); a period includes its start and not its end and takes its latest reading,
    the greatest bid and ask where several share that time. `status` is observed, filled or unsupported (bid and ask null): a symbol with fewer than three observed periods that day, or a gap of
    more than REACH periods in which no other symbol of its matrix was observed. Matrices hold symbols of one period length, in order of the currency they are quoted in. Symbols that instruments lack, or whose grid_s is null or
    not above zero, have no periods; an instrument listed twice counts with its least grid_s. Copies and order of rows do not matter.
    """
    w = Window.partitionBy("grid_s").orderBy(F.right("symbol", F.lit(3)), "symbol")
    width = F.greatest(F.least(F.lit(WIDTH), F.floor(F.lit(CELLS) * F.col("grid_s") / (2 * DAY_S))), F.lit(1))
    known = (
        instruments.filter("symbol IS NOT NULL AND grid_s > 0").groupBy("symbol").agg(F.min("grid_s").cast("long").alias("grid_s"))
        .withColumn("part", F.floor((F.row_number().over(w) - 1) / width))
    )
    ts = F.unix_micros(F.col("ts_recv_utc").cast("timestamp"))
    readings = ticks.select("symbol", ts.alias("us"), "bid", "ask").dropna().filter("NOT isnan(bid) AND NOT isnan(ask)")
    cells = (
        readings.join(known, "symbol")
        .withColumn("slot_s", F.floor(F.col("us") / (F.col("grid_s") * 1_000_000)) * F.col("grid_s"))
        .groupBy("grid_s", "part", "symbol", "slot_s")
        .agg(F.max(F.struct("us", "bid", "ask")).alias("r"))
        .select("grid_s", "part", "symbol", "slot_s", F.floor(F.col("slot_s") / DAY_S).alias("day"), "r.bid", "r.ask")
    )
    filled = cells.groupBy("grid_s", "part", "day").applyInPandas(lambda pdf: fill_block(pdf), _GRID)
    return filled.select("symbol", "slot_s", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("bid", "ask")], "status")
