"""Export of a registered capture's research window: pinned source, one CSV artifact, one manifest, both or nothing."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import replace
from itertools import groupby
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import __version__
from barloom.common import cut
from barloom.operators import bars as bar_ops
from barloom.plans import FeaturePlan, Mode, atr_smooth, darvas_box, hma, hma_atr_smooth
from barloom.plans.features import BARS
from barloom.sinks import tokens
from barloom.sources import registry
from barloom.sources.captures import read_strict

SCHEMA_VERSION = "1.1.0"
# Modes as the configuration names them, and its order of statistics.
MODE_NAMES = {Mode.ATR_SMOOTH: "ATRSmooth2", Mode.DARVAS_BOX: "DarvasBox", Mode.HMA: "Hma", Mode.HMA_ATR_SMOOTH: "HmaAtrSmooth"}
MODELS = ["Mean", "StandardDeviation", "Minimum", "Maximum", "Median", "Variance", "MedianAbsoluteDeviation", "Range", "Skewness", "Kurtosis"]


class ExportError(Exception):
    """The export was refused; nothing was left behind."""


def preset(mode: Mode) -> FeaturePlan:
    """The plan that a mode exports with."""
    make = {Mode.ATR_SMOOTH: atr_smooth, Mode.DARVAS_BOX: darvas_box, Mode.HMA: hma, Mode.HMA_ATR_SMOOTH: hma_atr_smooth}[mode]
    return make(scale_period=14, statistics_window=252)


def configuration(mode: Mode) -> str:
    """The preset as one line of JSON, keys in fixed order."""
    own = {}
    if mode in (Mode.ATR_SMOOTH, Mode.HMA_ATR_SMOOTH):
        own |= {"atr_period": 16, "atr_multiplier": "5.1", "smooth_length": 100}
    if mode is Mode.DARVAS_BOX:
        own |= {"darvas_length": 5}
    if mode in (Mode.HMA, Mode.HMA_ATR_SMOOTH):
        own |= {"hma_period": 16}
    rest = {
        "scale_period": 14, "statistics_window_size": 252, "statistics_source": "Close", "reversal_mode": "TrailingStopPosition",
        "mean_darvas_window_size": 20, "mean_hma_atrsmooth_window_size": 20, "statistic_models": MODELS,
    }
    return json.dumps({"reference_mode": MODE_NAMES[mode]} | own | rest, separators=(",", ":"))


def file_hash(path: str | os.PathLike) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def rendered(features: DataFrame, columns: list[str]) -> DataFrame:
    """bar_index and the line of each row. Columns `t_<name>` stand, to the letter, for the bar's own fields.

    Whole numbers, flags and texts are put together in the JVM; only doubles are written in Python, whose shortest form reads back as the same number.
    """
    kinds = dict(features.dtypes)
    token = {"timestamp": "t_time", "open": "t_open", "high": "t_high", "low": "t_low", "close": "t_close", "tick_volume": "t_volume"}
    names = [token.get(c, c) if c in BARS and token.get(c) in kinds else c for c in columns]
    text = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), "1").otherwise("0") if kinds[c] == "boolean" else F.coalesce(F.col(c).cast("string"), F.lit(""))
    pieces, plain = [], []
    for double, run in groupby(names, lambda c: kinds[c] == "double"):
        run = list(run)
        for part in [[c] for c in run] if double else [run]:
            pieces.append((F.col(part[0]) if double else F.concat_ws(",", *map(text, part))).alias(f"p{len(pieces)}"))
            plain.append(not double)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [b.column(i + 1).to_pylist() if is_text else list(map(tokens.number, b.column(i + 1).to_pylist())) for i, is_text in enumerate(plain)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(",".join, zip(*texts))), pa.string())], names=["bar_index", "line"])

    return features.select(F.col("bar_index").alias("_at"), *pieces).mapInArrow(write, "bar_index int, line string")


def write_lines(lines: DataFrame, header: str, path: Path) -> tuple[int, str]:
    """Write the lines, in their order, as one file, which must not exist: UTF-8, LF. Rows and hash. Partitions are fetched one by one."""
    h, n = hashlib.sha256(), 0
    with open(path, "xb") as f:
        def put(text: str) -> None:
            data = (text + "\n").encode()
            f.write(data)
            h.update(data)

        put(header)
        for row in lines.select("line").toLocalIterator(prefetchPartitions=True):
            put(row[0])
            n += 1
    return n, h.hexdigest()


def export(spark: SparkSession, registry_path: str, dataset_id: str, mode: Mode, capture: str, out: str, commit: str = "", dirty: bool = False) -> dict:
    """Export the research window of a registered capture; the manifest. ExportError where a gate is not passed.

    Gates: the capture's hash before and after, its schema, first and last time token, times that never fall back, a new artifact and manifest, and the row count.
    """
    target, manifest_path = Path(out), Path(str(out) + ".manifest.json")
    partial = [Path(f"{target}.partial"), Path(f"{manifest_path}.partial")]
    try:
        dataset = registry.find(registry.load(Path(registry_path).read_text(encoding="utf-8")), dataset_id)
    except (KeyError, ValueError, OSError) as e:
        raise ExportError(str(e)) from e
    for p in (target, manifest_path):
        if p.exists():
            raise ExportError(f"{p} exists already")
    if file_hash(capture) != dataset.source_sha256:
        raise ExportError("the capture's hash is not the registered one")
    try:
        b = read_strict(spark, Path(capture).resolve().as_uri()).withColumn("symbol", F.lit(dataset_id))
        # No line is blank or left out, so that its number is that of its bar.
        b = b.withColumn("bar_index", (F.col("line_no") - 2).cast("int")).cache()
        scan = bar_ops.scan_summary(b).collect()
        if not scan:
            raise ExportError("the capture has no rows")
        scan = scan[0]
        if scan["regressions"]:
            raise ExportError(f"{scan['regressions']} times fall back")
        ends = b.agg(F.min_by("t_time", "line_no").alias("first"), F.max_by("t_time", "line_no").alias("last"), F.first("schema").alias("schema")).collect()[0]
        if dataset.source_schema and ends["schema"] != dataset.source_schema:
            raise ExportError(f"the capture's schema is {ends['schema']}, not {dataset.source_schema}")
        if (ends["first"], ends["last"]) != (dataset.first_timestamp, dataset.last_timestamp):
            raise ExportError("the capture's first or last time is not the registered one")
        window = bar_ops.research_window(b)
        span = window.agg(F.count(F.lit(1)).alias("n"), F.min_by("t_time", "line_no").alias("start"), F.max_by("t_time", "line_no").alias("end")).collect()[0]
        rest = bar_ops.research_window(b, holdout=True).agg(F.min_by("t_time", "line_no").alias("start")).collect()[0]
        plan = replace(preset(mode), strict=True).fitted(window)
        rows = plan.apply(window).join(window.select("bar_index", *[c for c in window.columns if c.startswith("t_")]), "bar_index")
        # Sorted by range first, then written in many tasks; read once for bounds and rows, so it is kept.
        rows = cut(rows, "export").repartitionByRange("bar_index").sortWithinPartitions("bar_index")
        n, digest = write_lines(rendered(rows, plan.columns), ",".join(plan.columns), partial[0])
        if n != span["n"]:
            raise ExportError(f"{n} rows were written, not {span['n']}")
        if file_hash(capture) != dataset.source_sha256:
            raise ExportError("the capture changed during the export")
        manifest = {
            "schema_version": SCHEMA_VERSION, "exporter_version": __version__, "engine_commit": commit, "engine_tree_dirty": dirty, "engine_configuration": configuration(mode),
            "dataset_id": dataset.dataset_id, "dataset_version": dataset.dataset_version, "source_file": dataset.filename, "source_schema": ends["schema"], "source_sha256": dataset.source_sha256,
            "source_preprocessing": "none", "row_count": n, "first_timestamp": ends["first"], "last_timestamp": ends["last"], "duplicate_timestamp_count": scan["duplicates"],
            "partition_policy": dataset.partition_policy, "research_start": span["start"], "research_end": span["end"], "holdout_start": rest["start"] or "",
            "artifact_file": target.name, "artifact_sha256": digest, "columns": plan.columns,
        }
        partial[1].write_bytes((json.dumps(manifest, indent=2, ensure_ascii=False) + "\n").encode())
        for p, final in zip(partial, (target, manifest_path)):
            os.link(p, final)  # fails where the name is taken by now
        return manifest
    except FileExistsError as e:
        raise ExportError(f"{e.filename2 or e.filename} exists already") from e
    except ExportError:
        raise
    except Exception as e:
        raise ExportError(str(e).splitlines()[0] if str(e) else repr(e)) from e
    finally:
        for p in partial:
            p.unlink(missing_ok=True)


def write_table(features: DataFrame, path: str, key: str = "symbol") -> None:
    """Features of many instruments as a table, a folder for each; an existing one is refused. This is the sink for large runs."""
    features.write.mode("error").partitionBy(key).parquet(path)
