"""Passes over ordered bars in Arrow batches, for what windows cannot express or only at great cost.

All steps of a pass share one partitioning and sort: state is carried from batch to batch, so that no instrument is gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.common import free_names
from barloom.functions.lanes import Lane

_ARROW = {T.DoubleType(): pa.float64(), T.IntegerType(): pa.int32()}


@dataclass(frozen=True)
class Step:
    """`run(inputs, state)` gives the output arrays and the state for a stretch of bars of one lane; NaN in a double is null. The state is None at a lane's first bar."""

    inputs: Sequence[str]
    outputs: Sequence[tuple[str, T.DataType]]
    run: Callable[[list[np.ndarray], Any], tuple[list[np.ndarray], Any]]


def one_pass(df: DataFrame, keys: Sequence[str], order: str, steps: Sequence[Step]) -> DataFrame:
    """`df` with the outputs of all steps, bars in order within each lane (rows of equal `keys`)."""
    added = [(name, kind) for s in steps for name, kind in s.outputs]
    names = df.columns
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, k) for n, k in added]])
    (no,) = free_names(df, ["lane_no"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, states = None, [None] * len(steps)
        for b in batches:
            if not b.num_rows:
                continue
            ids = [np.array(b.column(b.schema.get_field_index(k)).to_pylist(), object) for k in keys]
            inputs = [[b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in s.inputs] for s in steps]
            new = np.zeros(b.num_rows, bool)
            for a in ids:
                new[1:] |= a[1:] != a[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
            parts: list[list[np.ndarray]] = [[] for _ in added]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                lane = tuple(a[lo] for a in ids)
                if lane != at:
                    at, states = lane, [None] * len(steps)
                k = 0
                for i, s in enumerate(steps):
                    found, states[i] = s.run([x[lo:hi] for x in inputs[i]], states[i])
                    for x in found:
                        parts[k].append(x)
                        k += 1
            arrays = []
            for (_, kind), p in zip(added, parts):
                x = np.concatenate(p)
                arrays.append(pa.array(x, _ARROW[kind], mask=np.isnan(x) if x.dtype.kind == "f" else None))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *arrays], names=[*names, *[n for n, _ in added]])

    # A window asks for whole lanes in order, and shares the exchange and sort of the windows before it, which a repartition would not.
    ordered = df.withColumn(no, F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return ordered.mapInArrow(run, schema)


def lane_pass(df: DataFrame, lane: Lane, steps: Sequence[Step], parts: bool = True) -> DataFrame:
    """`one_pass` over the lanes; without `parts` over whole instruments, even where lanes are cut into parts."""
    return one_pass(df, lane.keys if parts else [lane.key], lane.order, steps)
