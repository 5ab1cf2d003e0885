"""Helpers shared by all operators: shared folder, lineage cuts, chunked scans."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the folder `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where it is unset, a local session makes one of its own; others have no folder that all machines see, and fail."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        conf = spark.conf.get("spark.barloom.ownSharedDir", None)
        if not conf:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            conf = "file://" + tempfile.mkdtemp(prefix="barloom-")
            spark.conf.set("spark.barloom.ownSharedDir", conf)
    return conf.rstrip("/")


def hadoop_path(spark: SparkSession, name: str):
    """A path in the JVM and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder. It goes when the driver ends, or with `release`."""
    name = f"{shared_dir(spark)}/barloom/{spark.sparkContext.applicationId}"
    path, fs = hadoop_path(spark, name)
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return name


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application. DataFrames that read them cannot be read any more: write results first."""
    path, fs = hadoop_path(spark, scratch_dir(spark))
    fs.delete(path, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: short lineage that outlives a lost executor."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_names(df: DataFrame, names: Sequence[str]) -> list[str]:
    """`names` changed until none clashes with a column of `df` (case is ignored, as Spark does)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def chunk_prefix(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str],
    value: Column,
    out: str,
    combine: Callable[[Column], Column] = F.max,
    before: bool = True,
) -> DataFrame:
    """Running aggregate of `value` along `order` within `keys`, without one task per key.

    `chunk` names a column that splits each key along `order` (it must not fall as `order` rises). Each chunk is aggregated
    on the map side first; the running aggregate over chunks then has one row per chunk, and the rows
    of a chunk add what came before it. With `before` the row itself does not count. `combine` must be
    associative and ignore nulls (max, min, sum).
    """
    v, head = free_names(df, ["v_scan", "head_scan"])
    df = df.withColumn(v, value)
    wc = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    heads = df.groupBy(*keys, chunk).agg(combine(F.col(v)).alias(v)).select(*keys, chunk, combine(F.col(v)).over(wc).alias(head))
    wr = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    return (
        df.withColumn(out, combine(F.col(v)).over(wr))
        .join(heads, [*keys, chunk])
        .withColumn(out, _pair(combine)(F.col(out), F.col(head)))
        .drop(v, head)
    )


def _pair(combine: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    if combine is F.max:
        return F.greatest
    if combine is F.min:
        return F.least
    return lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def default_chunk(df: DataFrame, order: str) -> Column | None:
    """A column that splits long keys along `order`, from its type: days of a time, spans of a whole number; null comes first, as it sorts. None for other types."""
    kind = dict(df.dtypes).get(order)
    if kind in ("timestamp", "timestamp_ntz", "date"):
        c = F.unix_date(F.to_date(F.col(order))).cast("long")
    elif kind in ("tinyint", "smallint", "int", "bigint"):
        c = F.floor(F.col(order).cast("long") / 65_536).cast("long")
    else:
        return None
    return F.coalesce(c, F.lit(-(2**62)))


def with_heads(df: DataFrame, heads: DataFrame, on: Sequence[str]) -> DataFrame:
    """`df` joined to `heads`, one row for each of the values of `on`; null keys meet each other."""
    own = free_names(df, [f"{c}_of_head" for c in on])
    heads = heads.withColumnsRenamed(dict(zip(on, own)))
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(on, own)]
    return df.join(heads, same).drop(*own)


def carry_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], chunk: Column | None = None) -> DataFrame:
    """`df`, each of `columns` as of the last row of its key, by `order` and up to this row, where it was not null.

    With `chunk`, which must not fall as `order` rises, rows are sorted per chunk only; what comes from chunks before is in a table with one row a chunk.
    """
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
    c, *heads = free_names(df, ["carry_chunk", *[f"{x}_head" for x in columns]])
    df = df.withColumn(c, chunk)
    at = F.struct(*order)
    ends = df.groupBy(*keys, c).agg(*[F.max_by(x, F.when(F.col(x).isNotNull(), at)).alias(h) for x, h in zip(columns, heads)])
    before = Window.partitionBy(*keys).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, c, *[F.last(h, ignorenulls=True).over(before).alias(h) for h in heads])
    w = Window.partitionBy(*keys, c).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = with_heads(df.withColumns({x: F.last(x, ignorenulls=True).over(w) for x in columns}), ends, [*keys, c])
    return df.withColumns({x: F.coalesce(x, h) for x, h in zip(columns, heads)}).drop(c, *heads)


def publish(df: DataFrame, target: str, keep: int = 2) -> DataFrame:
    """Write `df` as a new version of the table at `target` and point to it with one rename: `current` reads the old table or the new, whole.

    Task attempts go through Spark's commit protocol, so that a lost executor leaves no half-written bucket. The last `keep` versions stay for who is still reading them. One writer at a time.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    version = f"v-{uuid.uuid4().hex}"
    before = versions(spark, target)
    df.write.parquet(f"{target}/{version}")
    pointer, fs = hadoop_path(spark, f"{target}/_CURRENT")
    fresh, _ = hadoop_path(spark, f"{target}/_CURRENT-{version}")
    kept = [version, *before][: max(keep, 1)]
    out = fs.create(fresh, True)
    out.write(bytearray("\n".join(kept).encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fresh, pointer, how)
    for old in before:
        if old not in kept:
            fs.delete(hadoop_path(spark, f"{target}/{old}")[0], True)
    return spark.read.schema(df.schema).parquet(f"{target}/{version}")


def versions(spark: SparkSession, target: str) -> list[str]:
    """The versions of a published table that are there, the current one first; none if nothing was published."""
    pointer, fs = hadoop_path(spark, f"{target}/_CURRENT")
    if not fs.exists(pointer):
        return []
    stream = fs.open(pointer)
    try:
        return bytes(stream.readAllBytes()).decode().split()
    finally:
        stream.close()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The published table at `target` as it is now; the DataFrame stays with that version. FileNotFoundError if nothing was published."""
    there = versions(spark, target)
    if not there:
        raise FileNotFoundError(f"nothing is published at {target}")
    return spark.read.parquet(f"{target}/{there[0]}")


def chunk_neighbours(df: DataFrame, keys: Sequence[str], chunk: str, order: str, value: Column, after: int = 1, prefix: str = "nb", run_of: Column | None = None, run: str = "run_start") -> DataFrame:
    """`df` with the value of the row before (`<prefix>_prev`) and of the `after` rows after it (`<prefix>_next1`, ...).

    As lag and lead over `keys` by `order`, but sorted in one task per chunk only (see chunk_prefix): what lies beyond a
    chunk's edge comes from a table with one row per chunk. `value` must not be null; `order` must be unique within `keys`. With `run_of`, which must not be null either,
    `run` is the `order` of the first row of the run of equal `run_of` that a row is in. Rows are written to the shared folder on the way: the result can be read several times.
    """
    v, rn, last, first, n, before, beyond, same, begun, mark = free_names(df, [f"{x}_nb" for x in ("v", "rn", "last", "first", "n", "before", "beyond", "same", "begun", "mark")])
    w = Window.partitionBy(*keys, chunk).orderBy(order)
    df = df.withColumn(v, value).withColumn(same, run_of if run_of is not None else F.lit(0))
    df = df.select("*", F.row_number().over(w).alias(rn), F.lag(v).over(w).alias(f"{prefix}_prev"), F.lag(same).over(w).alias(begun), *[F.lead(v, k).over(w).alias(f"{prefix}_next{k}") for k in range(1, after + 1)])
    # Within a chunk a run begins where the value changes; that of the first row may have begun before.
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    # Written once: the edges and the rows are both read from it, and the rows as often as the result is.
    df = cut(df.withColumn(mark, F.max(F.when(F.col(begun) != F.col(same), F.col(order))).over(upto)).drop(begun), "local")
    edges = df.groupBy(*keys, chunk).agg(
        F.max_by(F.struct(v, same), order).alias(last),
        F.array_sort(F.collect_list(F.when(F.col(rn) <= max(after, 1), F.struct(order, v, same)))).alias(first),
        F.max(mark).alias(mark),
        F.count(F.lit(1)).alias(n),
    )
    wk = Window.partitionBy(*keys).orderBy(chunk)
    none = F.slice(F.col(first), 1, 0)
    following = [F.coalesce(F.lead(first, k).over(wk), none) for k in range(1, after + 1)]
    edges = edges.select(*keys, chunk, n, first, mark, F.lag(last).over(wk).alias(before), F.flatten(F.array(*following)).alias(beyond))
    own = F.when(F.col(before).isNull() | (F.col(before)[same] != F.col(first)[0][same]), F.col(first)[0][order])
    edges = edges.withColumn(begun, own).withColumn(last, F.coalesce(mark, begun))
    carried = F.last(last, ignorenulls=True).over(wk.rowsBetween(Window.unboundedPreceding, -1))
    edges = cut(edges.select(*keys, chunk, n, F.col(before)[v].alias(before), beyond, F.coalesce(F.col(begun), carried).alias(begun)), "edges")
    df = df.join(edges, [*keys, chunk])
    out = [F.coalesce(f"{prefix}_prev", F.when(F.col(rn) == 1, F.col(before))).alias(f"{prefix}_prev")]
    for k in range(1, after + 1):
        at = (F.lit(k - 1) - (F.col(n) - F.col(rn))).cast("int")
        out.append(F.coalesce(F.col(f"{prefix}_next{k}"), F.when(at >= 0, F.get(F.col(beyond), at)[v])).alias(f"{prefix}_next{k}"))
    if run_of is not None:
        out.append(F.coalesce(mark, begun).alias(run))
    keep = [c for c in df.columns if c not in {v, rn, last, first, n, before, beyond, same, begun, mark} and not c.startswith(f"{prefix}_")]
    return df.select(*keep, *out)


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with columns computed once, here: the optimizer neither repeats their expressions where they are used nor moves filters on them below.

    The row goes through a generator of one element, which stays inside whole-stage code. Columns of these names are replaced.
    """
    keep = [df[c] for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
