"""The live twin of the feature plan.

Each instrument keeps two states: that after the last closed bar, and none for the live one. A message for the live bar starts from the closed state
again, so that publishing a bar ten times leaves the same result as once. The next bar closes the live one. Bar 0 begins a fresh pass. Anything else (a gap, a bar
that is long closed) is a discontinuity: with a bar store, the instrument's state is rebuilt by replaying all bars before the message's own from it, and all are published again; where
the store lacks one, or without a store, the message is refused and reported.

All columns of the plan are published, by its statistics source and options. A plan with a level or statistics of your own, or a strict one, is
refused with ValueError: their expressions exist for DataFrames only, and a live bar may still change.
"""

from __future__ import annotations

import math
import pickle
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.common import shuffle_parts
from barloom.functions.statistics import STATISTICS
from barloom.operators.levels import AtrSmooth, DarvasBox, Hma, HmaAtrSmooth, trailing_step
from barloom.operators import stages
from barloom.operators.rolling import frame_statistics
from barloom.plans import FeaturePlan

# The published columns that are no doubles.
_INTS = [
    "bar_index", "reference_regime", "statistics_observation_count", "reversal_bars_since", "reversal_direction", "segment_regime", "segment_id", "segment_start_index", "segment_age",
    "segment_transition", "hma_price_atrsmooth_alignment",
]
_FLAGS = ["reversal_is_bar", "darvas_has_box"]


def possible(plan: FeaturePlan) -> None:
    """ValueError for a plan that has no live twin."""
    if not isinstance(plan.level, (AtrSmooth, DarvasBox, Hma, HmaAtrSmooth)):
        raise ValueError("a live plan cannot have a level of your own")
    if own := [n for n in plan.statistics if not STATISTICS[n].standard]:
        raise ValueError(f"a live plan cannot have statistics of your own: {own}")
    if plan.scale is not None or plan.distance is not stages.plain_distance or plan.normalize is not stages.in_scales:
        raise ValueError("a live plan cannot have a scale, distance or normalization of your own")
    if plan.strict:
        raise ValueError("a live plan cannot be strict")


@dataclass
class Engine:
    """All state of one instrument after its last closed bar; `step` gives the features of a bar and the state after it."""

    at: int = -1
    closes: deque = field(default_factory=deque)
    highs: deque = field(default_factory=deque)
    lows: deque = field(default_factory=deque)
    volumes: deque = field(default_factory=deque)
    ranges: deque = field(default_factory=deque)
    raws: deque = field(default_factory=deque)
    stop: tuple | None = None
    side: int = 0
    regime: int | None = None
    box: tuple = (None, None)
    break_high: float | None = None
    break_at: int | None = None
    hma: float | None = None
    turn: int | None = None
    way: int = 0
    segment: int = -1
    segment_start: int | None = None
    observed: deque = field(default_factory=deque)
    kept: dict = field(default_factory=dict)
    meant: deque = field(default_factory=deque)

    def copy(self) -> Engine:
        return Engine(**{k: v.copy() if isinstance(v, (deque, dict)) else v for k, v in self.__dict__.items()})


def _store(closed: Engine, live: tuple | None) -> bytes:
    """States as plain values: a worker that reads them need not have this class."""
    return pickle.dumps((closed.__dict__, live))


def _load(data: bytes) -> tuple[Engine, tuple | None]:
    fields, live = pickle.loads(data)
    if fields.keys() != Engine().__dict__.keys():
        raise ValueError("the checkpoint holds states of another version: replay its instruments by a fresh query")
    return Engine(**fields), live


def _wma(values: list[float], n: int) -> float | None:
    if len(values) < n:
        return None
    return sum(v * (k + 1) for k, v in enumerate(values[-n:])) / (n * (n + 1) / 2)


def _observed(source: str, before: float | None, close: float) -> float:
    """What statistics observe at a bar, NaN where a return has no positive closes."""
    if source == "close":
        return close
    if before is None or not (close > 0 and before > 0):
        return math.nan
    return close / before - 1 if source == "simple_return" else math.log(close / before)


def _statistics(e: Engine, plan: FeaturePlan) -> dict:
    """Statistics of the frame that ends at the bar; a value that is missing is the last one, as the plan retains it. `e` takes the values."""
    width = plan.statistics_window + (plan.statistics_source == "close")
    found = {n: v[0].item() for n, v in frame_statistics(np.array([list(e.observed)[-width:]], float)).items()}
    out = {"statistics_observation_count": found["observation_count"]}
    for n in STATISTICS:
        v = found.get(n, math.nan)
        if n not in plan.statistics:
            v = None
        elif not math.isnan(v):
            e.kept[n] = v
        else:
            v = e.kept.get(n, 0.0) if plan.retain else None
        out[f"statistics_{n}"] = v
    return out


def _mean(e: Engine, plan: FeaturePlan, x: float | None) -> float | None:
    """Mean of the last values of `x` that are there."""
    e.meant.append(x)
    while len(e.meant) > plan.mean_window:
        e.meant.popleft()
    there = [v for v in e.meant if v is not None]
    return sum(there) / len(there) if there else None


def step(e: Engine, plan: FeaturePlan, bar: tuple) -> tuple[Engine, dict]:
    """One bar (ts, open, high, low, close, volume) after state `e`: the state after it and all of `plan.columns`; `e` itself is not changed."""
    possible(plan)
    e = e.copy()
    ts, begin, high, low, close, published = bar
    volume = 0.0 if published is None or math.isnan(published) else published
    at = e.at + 1
    before = e.closes[-1] if e.closes else None
    level = plan.level
    atr = level.atr if isinstance(level, HmaAtrSmooth) else level if isinstance(level, AtrSmooth) else None
    hull = level.hma if isinstance(level, HmaAtrSmooth) else level if isinstance(level, Hma) else None
    box = level if isinstance(level, DarvasBox) else None
    tr = high - low if before is None else max(high - low, abs(high - before), abs(low - before))
    for q, x in ((e.closes, close), (e.highs, high), (e.lows, low), (e.volumes, volume), (e.observed, _observed(plan.statistics_source, before, close))):
        q.append(x)
    if at:
        e.ranges.append(tr)
    closes, price, regime = list(e.closes), close, 0
    if hull:
        half, root = hull.spans
        e.raws.append(2 * _wma(closes, half) - _wma(closes, hull.period) if len(closes) >= hull.period else None)
        raw = [r for r in list(e.raws)[-root:] if r is not None]
        now = _wma(raw, root) if len(raw) == root else None
        regime = 0 if now is None or e.hma is None else (now > e.hma) - (now < e.hma)
        e.hma, price = now, close if now is None else now
    if atr:
        a = 2 / (atr.period + 1)
        mean, stop, prev = (tr, close, close) if e.stop is None else (a * tr + (1 - a) * e.stop[0], e.stop[1], e.stop[2])
        new = trailing_step(stop, prev, close, atr.multiplier * mean)
        if e.stop is not None and prev < stop < close:
            e.side = 1
        elif e.stop is not None and prev > stop > close:
            e.side = -1
        e.stop, regime = (mean, new, close), e.side
        v, c = list(e.volumes)[-atr.smooth :], closes[-atr.smooth :]
        weight = sum(v)
        price = ((sum(x * y for x, y in zip(c, v)) / weight if weight > 0 else close) + new) / 2
    if box:
        n, highs, lows = box.length, list(e.highs), list(e.lows)
        if at >= n and high > max(highs[-n - 1 : -1]):
            e.break_high, e.break_at = high, at
        lower = at >= n - 2 and max(highs[-(n - 2) :]) < max(highs[-(n - 1) :])
        if lower and e.break_at is not None and at - e.break_at == n - 2:
            e.box = (e.break_high, min(lows[-n:]) if at >= n - 1 else None)
        top, bottom = e.box
        price = close if top is None else (top + bottom) / 2
        regime = 0 if top is None else 1 if close > top else -1 if close < bottom else 0
    recent = list(e.ranges)[-plan.scale_period :]
    scale = sum(recent) / len(recent) if recent else close
    signed = close - price
    state = (1 if signed >= 0 else -1) if plan.reversal_by_close else regime
    turned = e.regime is not None and state != e.regime[0]
    if turned:
        e.turn, e.way = at, 1 if state > e.regime[0] else -1
    moved = 0
    if regime and (e.regime is None or regime != e.regime[1]):
        e.segment, e.segment_start = e.segment + 1, at
        moved = regime if e.regime is not None and e.regime[1] else 0
    row = {
        "bar_index": at, "timestamp": ts, "open": begin, "high": high, "low": low, "close": close, "tick_volume": published,
        "reference_price": price, "reference_regime": regime, "distance_signed": signed, "distance_absolute": abs(signed), "scale": scale,
        "normalized_measurement": abs(signed) / scale if scale > 0 else None, **_statistics(e, plan),
        "reversal_bars_since": None if e.turn is None else at - e.turn, "reversal_direction": e.way, "reversal_is_bar": turned,
    }
    if atr:
        within = lambda x: x if regime else None
        start = e.segment_start
        row |= {
            "segment_regime": within(regime), "segment_id": within(e.segment), "segment_start_index": within(start), "segment_age": within(at - start if regime else None),
            "segment_transition": moved,
        }
    if box:
        top, bottom = e.box
        beyond = None if top is None else close - top if close > top else close - bottom if close < bottom else 0.0
        row |= {
            "darvas_has_box": top is not None, "darvas_signed_closing_distance": beyond, "darvas_absolute_closing_distance": None if beyond is None else abs(beyond),
            "darvas_mean_signed_distance": _mean(e, plan, beyond),
        }
    if atr and hull:
        gap = None if e.hma is None else e.hma - price
        row |= {
            "mean_hma_atrsmooth_distance": _mean(e, plan, gap),
            "hma_price_atrsmooth_alignment": 0 if e.hma is None or e.hma == price or close == price else 1 if (e.hma > price) == (close > price) else -1,
            "hma_atrsmooth_separation": gap / scale if gap is not None and scale > 0 else None,
            "hma_atrsmooth_relative_close_position": signed / gap if gap else None,
        }
    e.regime, e.at = (state, regime), at
    keep = max(level.halo, plan.scale_period, plan.statistics_window) + 2
    for q in (e.closes, e.highs, e.lows, e.volumes, e.ranges, e.raws, e.observed):
        while len(q) > keep:
            q.popleft()
    return e, {c: row[c] for c in plan.columns}


def advance(closed: Engine, live: tuple | None, plan: FeaturePlan, index: int, bar: tuple) -> tuple[Engine, tuple | None, dict]:
    """One message: `closed` is the state before the live bar `live` (index and bar). New states and a row with status appended, updated, restarted (bar 0 comes again after others) or refused."""
    at = closed.at + 1
    restarted = index == 0 and at > 0
    if restarted:
        closed, live, at = Engine(), None, 0
    if live is not None and index == live[0] + 1:
        closed, _ = step(closed, plan, live[1])
        at += 1
    elif live is not None and index != live[0] or live is None and index != at:
        return closed, live, {"bar_index": index, "status": "refused"}
    status = "restarted" if restarted else "updated" if live is not None and index == live[0] else "appended"
    _, row = step(closed, plan, bar)
    return closed, (index, bar), row | {"status": status}


# Bars of one instrument with an index from the first number up to, and without, the second: index and bar, in order.
History = Callable[[int, int], list[tuple[int, tuple]]]
SPAN = 50_000  # bars that a replay holds at once


def stored_bars(store: str, key: str, value) -> History:
    """The bars of the instrument `value` in a Parquet table that all executors see, with `key`, bar_index, high, low, close, volume and, where it has them, ts and open."""
    import pyarrow.dataset as ds

    def between(lo: int, hi: int) -> list[tuple[int, tuple]]:
        data = ds.dataset(store.removeprefix("file://"), format="parquet", exclude_invalid_files=True)
        columns = [c for c in ("bar_index", "ts", "open", "high", "low", "close", "volume") if c in data.schema.names]
        inside = (ds.field(key) == value) & (ds.field("bar_index") >= lo) & (ds.field("bar_index") < hi)
        found = data.to_table(columns=columns, filter=inside).to_pandas().sort_values("bar_index", kind="stable").drop_duplicates("bar_index", keep="last")
        return [(i, tuple(bar)) for i, bar in _messages(found)]

    return between


def recovered(plan: FeaturePlan, index: int, bar: tuple, history: History) -> Iterator[tuple[Engine, dict]]:
    """States and rows of all bars before `index`, replayed from nothing, and of the message's own bar; none if the history lacks a bar. `SPAN` bars are held at once."""
    spans = [(lo, min(lo + SPAN, index)) for lo in range(0, index, SPAN)]
    if all([i for i, _ in history(lo, hi)] == list(range(lo, hi)) for lo, hi in spans):
        e = Engine()
        for lo, hi in spans:
            for _, old in history(lo, hi):
                e, row = step(e, plan, old)
                yield e, row | {"status": "replayed"}
        yield e, step(e, plan, bar)[1] | {"status": "replayed"}


def follow(closed: Engine, live: tuple | None, plan: FeaturePlan, messages: Iterator[tuple[int, tuple]], history: History | None = None) -> Iterator[tuple[Engine, tuple | None, dict]]:
    """States and rows of messages in order, discontinuities recovered from `history`."""
    for index, bar in messages:
        now, ahead, row = advance(closed, live, plan, index, bar)
        if row["status"] == "refused" and history is not None:
            for e, old in recovered(plan, index, bar, history):
                now, ahead, row = e, (index, bar), old
                if old["bar_index"] < index:
                    yield e, (index, bar), old
        closed, live = now, ahead
        yield closed, live, row


def _messages(bars: pd.DataFrame) -> Iterator[tuple[int, tuple]]:
    """Index and bar of each message; a time or opening price that messages lack is None."""
    none = [None] * len(bars)
    values = [bars[c] if c in bars else none for c in ("ts", "open", "high", "low", "close", "volume")]
    return ((int(i), bar) for i, *bar in zip(bars["bar_index"], *values))


def replay(bars: pd.DataFrame, plan: FeaturePlan, history: History | None = None) -> pd.DataFrame:
    """Features of one instrument's messages in order, as a live query gives them: status and the plan's columns, without a time or opening price that messages lack."""
    possible(plan)
    rows = [row for _, _, row in follow(Engine(), None, plan, ((i, tuple(b)) for i, b in _messages(bars)), history)]
    lacking = [out for out, c in (("timestamp", "ts"), ("open", "open")) if c not in bars]
    return pd.DataFrame(rows, columns=[*plan.columns, "status"]).drop(columns=lacking)


def _typed(rows: list[dict], types: dict[str, str]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=list(types))
    kinds = {"int": "Int32", "boolean": "boolean", "double": "float64"}
    pdf = pdf.astype({c: kinds[t] for c, t in types.items() if t in kinds and c != "timestamp"})
    return pdf.assign(timestamp=pd.to_datetime(pdf["timestamp"]))


def _types(bars: DataFrame, plan: FeaturePlan) -> dict[str, str]:
    kinds = dict(bars.dtypes)
    own = {c: "int" if c in _INTS else "boolean" if c in _FLAGS else "double" for c in plan.columns}
    return {plan.key: kinds[plan.key], "bar_index": "int", "status": "string"} | own | {"timestamp": kinds.get("ts", "timestamp")}


def replay_all(messages: DataFrame, plan: FeaturePlan) -> DataFrame:
    """Recorded messages (columns as of live_features) of many instruments replayed in order of bar_index and seq: key, status and the plan's columns, a row a message.

    Messages are sorted within partitions and stepped through batch by batch with carried state, so that no instrument is gathered.
    """
    possible(plan)
    types, key = _types(messages, plan), plan.key

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, closed, live = None, Engine(), None
        for pdf in batches:
            out = []
            for value, part in pdf.groupby(key, sort=False, dropna=False):
                if value != at:
                    at, closed, live = value, Engine(), None
                for closed, live, row in follow(closed, live, plan, ((i, tuple(b)) for i, b in _messages(part))):
                    out.append(row | {key: value})
            yield _typed(out, types)

    ordered = messages.repartition(shuffle_parts(messages.sparkSession), key).sortWithinPartitions(key, "bar_index", "seq")
    return ordered.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in types.items()))


def live_features(bars: DataFrame, plan: FeaturePlan, store: str | None = None) -> DataFrame:
    """Features of a stream of bar messages (the plan's key, bar_index, high, low, close, volume, and `seq`, their order), a row for each: key, status and the plan's columns.

    `ts` and `open` are passed on where the stream has them, else null. Messages of one micro-batch apply in order of seq where there is a `store` to recover from, else
    of bar_index and seq. `store` is a Parquet table of bars in a folder that all executors see (see stored_bars). The state of an instrument is bounded by the plan's look-back.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    possible(plan)
    kinds = dict(bars.dtypes)
    types = _types(bars, plan)

    class Live(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("engine", "data binary")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            closed, live = _load(bytes(self.state.get()[0])) if self.state.exists() else (Engine(), None)
            history = stored_bars(store, plan.key, key[0]) if store else None
            out = []
            messages = pd.concat(list(rows)).sort_values(["seq"] if store else ["bar_index", "seq"])
            for closed, live, row in follow(closed, live, plan, ((i, tuple(b)) for i, b in _messages(messages)), history):
                out.append(row | {plan.key: key[0]})
                if len(out) >= SPAN:
                    yield _typed(out, types)
                    out = []
            self.state.update((_store(closed, live),))
            yield _typed(out, types)

        def close(self) -> None:
            pass

    prices = [F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume") if c in kinds or c != "open"]
    picked = bars.select(plan.key, "bar_index", *[c for c in ("ts",) if c in kinds], *prices, "seq")
    return picked.groupBy(plan.key).transformWithStateInPandas(
        statefulProcessor=Live(), outputStructType=", ".join(f"`{c}` {t}" for c, t in types.items()), outputMode="Update", timeMode="None"
    )


def live_tick_bars(ticks: DataFrame, size: int = 25, price: str = "bid") -> DataFrame:
    """Bars of `size` ticks from a stream (symbol, ts, `price`, seq), each given out when it is full. Ticks of one micro-batch apply in order of seq."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    schema = "symbol string, bar_index int, ts timestamp, open double, high double, low double, close double, volume double"

    class Bars(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("bar", "data binary")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            index, bar = pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else (0, None)
            out = []
            for ts, p in pd.concat(list(rows)).sort_values("seq")[["ts", "price"]].itertuples(index=False):
                if p is None or math.isnan(p):
                    continue
                bar = (ts, p, p, p, p, 1.0) if bar is None else (bar[0], bar[1], max(bar[2], p), min(bar[3], p), p, bar[5] + 1)
                if bar[5] >= size:
                    out.append((key[0], index, *bar))
                    index, bar = index + 1, None
            self.state.update((pickle.dumps((index, bar)),))
            yield pd.DataFrame(out, columns=["symbol", "bar_index", "ts", "open", "high", "low", "close", "volume"])

        def close(self) -> None:
            pass

    return ticks.select("symbol", "ts", F.col(price).cast("double").alias("price"), "seq").groupBy("symbol").transformWithStateInPandas(statefulProcessor=Bars(), outputStructType=schema, outputMode="Append", timeMode="None")
