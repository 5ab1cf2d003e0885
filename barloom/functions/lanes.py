"""Lanes: how ordered windows over bars are partitioned.

A lane is one instrument's bars in order of bar_index. Long lanes can be cut into parts of `part_bars` bars: every part also gets the bars before
it that bounded frames look back to (its halo), and what is carried without bound comes from a table with one row per part. One instrument with a third of all
bars is then spread over many tasks, and results are the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.common import cut, free_names

PART, HALO = "_lane_part", "_lane_halo"


@dataclass(frozen=True)
class Lane:
    key: str = "symbol"
    order: str = "bar_index"
    part_bars: int | None = None

    @property
    def keys(self) -> list[str]:
        return [self.key, PART] if self.part_bars else [self.key]

    def rows(self, back: int | None = None, to: int = 0) -> WindowSpec:
        """The window of `back` bars before up to the bar itself; without `back` the bare order."""
        w = Window.partitionBy(*self.keys).orderBy(self.order)
        return w if back is None else w.rowsBetween(-back, to)

    def open(self, df: DataFrame, halo: int) -> DataFrame:
        """`df` ready for bounded frames that look back `halo` bars at most."""
        if not self.part_bars:
            return df
        if halo > self.part_bars:
            raise ValueError(f"parts of {self.part_bars} bars are shorter than the {halo} bars that frames look back to")
        own = F.floor(F.col(self.order) / self.part_bars)
        late = F.col(self.order) % self.part_bars >= self.part_bars - halo
        copies = F.when(late, F.array(F.struct(own.alias(PART), F.lit(False).alias(HALO)), F.struct((own + 1).alias(PART), F.lit(True).alias(HALO)))).otherwise(
            F.array(F.struct(own.alias(PART), F.lit(False).alias(HALO)))
        )
        return df.select("*", F.inline(copies))

    def close(self, df: DataFrame) -> DataFrame:
        """Without the halo: from here on only `hold`, `back` and `running` may look at other bars."""
        return df.filter(~F.col(HALO)).drop(HALO) if self.part_bars else df

    def done(self, df: DataFrame) -> DataFrame:
        return df.drop(PART) if self.part_bars else df

    def hold(self, df: DataFrame, **values: Column) -> DataFrame:
        """Each value as of the last bar, up to this one, where it was not null."""
        w = Window.partitionBy(*self.keys).orderBy(self.order).rowsBetween(Window.unboundedPreceding, 0)
        if not self.part_bars:
            return df.withColumns({n: F.last(v, ignorenulls=True).over(w) for n, v in values.items()})
        own = free_names(df, [f"_own_{n}" for n in values])
        df = cut(df.withColumns(dict(zip(own, values.values()))), "lane")  # read twice below
        ends = df.groupBy(*self.keys).agg(*[F.max_by(o, F.when(F.col(o).isNotNull(), F.col(self.order))).alias(f"_head{o}") for o in own])
        before = Window.partitionBy(self.key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        heads = ends.select(*self.keys, *[F.last(f"_head{o}", ignorenulls=True).over(before).alias(f"_head{o}") for o in own])
        df = df.withColumns({n: F.last(o, ignorenulls=True).over(w) for n, o in zip(values, own)}).join(heads, self.keys)
        return df.withColumns({n: F.coalesce(n, f"_head{o}") for n, o in zip(values, own)}).drop(*own, *[f"_head{o}" for o in own])

    def back(self, df: DataFrame, **values: Column) -> DataFrame:
        """Each value one bar back; null at the first bar."""
        w = Window.partitionBy(*self.keys).orderBy(self.order)
        if not self.part_bars:
            return df.withColumns({n: F.lag(v).over(w) for n, v in values.items()})
        own = free_names(df, [f"_own_{n}" for n in values])
        df = cut(df.withColumns(dict(zip(own, values.values()))), "lane")  # read twice below
        ends = df.groupBy(*self.keys).agg(*[F.max_by(o, self.order).alias(f"_head{o}") for o in own])
        heads = ends.select(*self.keys, *[F.lag(f"_head{o}").over(Window.partitionBy(self.key).orderBy(PART)).alias(f"_head{o}") for o in own])
        first = F.row_number().over(w) == 1
        df = df.withColumn("_first", first).withColumns({n: F.lag(o).over(w) for n, o in zip(values, own)}).join(heads, self.keys)
        return df.withColumns({n: F.when(F.col("_first"), F.col(f"_head{o}")).otherwise(F.col(n)) for n, o in zip(values, own)}).drop("_first", *own, *[f"_head{o}" for o in own])

    def running(self, df: DataFrame, **values: Column) -> DataFrame:
        """Each value summed up to and with this bar."""
        w = Window.partitionBy(*self.keys).orderBy(self.order).rowsBetween(Window.unboundedPreceding, 0)
        if not self.part_bars:
            return df.withColumns({n: F.sum(v).over(w) for n, v in values.items()})
        own = free_names(df, [f"_own_{n}" for n in values])
        df = cut(df.withColumns(dict(zip(own, values.values()))), "lane")  # read twice below
        before = Window.partitionBy(self.key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        heads = df.groupBy(*self.keys).agg(*[F.sum(o).alias(f"_head{o}") for o in own])
        heads = heads.select(*self.keys, *[F.coalesce(F.sum(f"_head{o}").over(before), F.lit(0)).alias(f"_head{o}") for o in own])
        df = df.withColumns({n: F.sum(o).over(w) for n, o in zip(values, own)}).join(heads, self.keys)
        return df.withColumns({n: F.col(n) + F.col(f"_head{o}") for n, o in zip(values, own)}).drop(*own, *[f"_head{o}" for o in own])


def highest(lane: Lane, x: Column, n: int) -> Column:
    """Greatest of the last `n` bars, this one included; null before there are `n`."""
    return F.when(F.col(lane.order) >= n - 1, F.max(x).over(lane.rows(n - 1))) if n >= 1 else F.lit(None).cast("double")


def lowest(lane: Lane, x: Column, n: int) -> Column:
    return F.when(F.col(lane.order) >= n - 1, F.min(x).over(lane.rows(n - 1))) if n >= 1 else F.lit(None).cast("double")


def shifted(lane: Lane, x: Column, n: int = 1) -> Column:
    """The value `n` bars back, within the halo."""
    return F.lag(x, n).over(lane.rows())


def wma(lane: Lane, x: Column, n: int) -> Column:
    """Weighted mean of the last `n` bars, weights 1..n from oldest to newest, summed in that order; null until all are there."""
    total = None
    for j in range(n):
        term = (x if j == n - 1 else F.lag(x, n - 1 - j).over(lane.rows())) * float(j + 1)
        total = term if total is None else total + term
    return total / (n * (n + 1) / 2.0)
