"""Packing: items of varying length into sequences of fixed capacity, at balanced attention cost."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.common import cut

_PACKED = "pack_name string, item long, n long, rest_no long, whole_no long"


def balance(sizes: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1 / 4096) -> np.ndarray:
    """The sequence of each item, items in descending order of size (none above `capacity`).

    Each goes to the sequence of lowest cost that has room for it; the cost of an item is `linear` x size + `quadratic` x size squared. Sequences without room for the
    present size wait by the room they have left, and come back when sizes have shrunk to it. A new sequence is begun when none has room.
    """
    out = np.empty(len(sizes), np.int64)
    costs = (linear * sizes + quadratic * sizes.astype(float) ** 2).tolist()
    ready: list[tuple[float, int, int]] = []
    waiting: dict[int, list[tuple[float, int, int]]] = {}
    shrunk, opened = capacity + 1, 0
    for i, size in enumerate(sizes.tolist()):
        while shrunk > size:
            shrunk -= 1
            for s in waiting.pop(shrunk, ()):
                heapq.heappush(ready, s)
        if ready:
            cost, no, room = ready[0]
        else:
            cost, no, room = 0.0, opened, capacity
            opened += 1
        room -= size
        now = (cost + costs[i], no, room)
        if room >= size:
            heapq.heapreplace(ready, now) if cost else heapq.heappush(ready, now)
        else:
            if cost:
                heapq.heappop(ready)
            if room:
                waiting.setdefault(room, []).append(now)
        out[i] = no
    return out


def pack(items: DataFrame, sizes: DataFrame, item: str = "doc_id", size: str = "n_tokens", shard_items: int = 200_000) -> DataFrame:
    """The pack of each item for each capacity: pack_name, item, piece, start, size, shard, pack_no (a pack is pack_name, shard and pack_no together).

    An item above the capacity is split into pieces of just the capacity, packs of their own, and a rest that is packed like an item; others stay whole. Items are
    spread evenly over shards by hash, one for each `shard_items` items (the bound of what one task packs; whole pieces are written out behind it), and every shard is packed by itself: what
    stays free grows by a pack or two a shard. Items of size 0 or null come with piece 0 and null pack. Equal ids are items of their own each; ties of size go by id. Capacities that are null
    or not above 0 are left out; one named twice counts with its least.
    """
    caps = sizes.filter("pack_name IS NOT NULL AND capacity_tokens > 0").groupBy("pack_name").agg(F.min("capacity_tokens").cast("long").alias("capacity"))
    all_items = items.select(F.col(item).cast("long").alias("item"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("n"))
    all_items = cut(all_items, "sized")
    count = all_items.count()
    shards = max(1, -(-count // shard_items))
    # Sizes of packs are settings, a row each; every item is packed once for each of them.
    named = [(r["pack_name"], r["capacity"]) for r in caps.orderBy("pack_name").collect()]
    each = F.array(*[F.struct(F.lit(a).alias("pack_name"), F.lit(c).alias("capacity")) for a, c in named]) if named else F.from_json(F.lit("[]"), "array<struct<pack_name:string,capacity:long>>")
    both = all_items.select("item", "n", F.inline(each))
    both = both.withColumn("shard", F.pmod(F.xxhash64("item", "n", "pack_name"), F.lit(shards)).cast("int"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        """A row an item: the pack of its rest, -1 without one, and the first of the packs of its whole pieces."""
        capacity = int(pdf["capacity"].iloc[0])
        pdf = pdf.sort_values(["n", "item"], kind="stable", ascending=[False, True])
        n = pdf["n"].to_numpy()
        full, rest = n // capacity, n % capacity
        small = np.flatnonzero(rest)
        small = small[np.argsort(-rest[small], kind="stable")]
        no = balance(rest[small], capacity)
        rest_no = np.full(len(n), -1)
        rest_no[small] = no
        begun = int(no.max()) + 1 if len(no) else 0
        return pd.DataFrame({"pack_name": pdf["pack_name"].iloc[0], "item": pdf["item"].to_numpy(), "n": n, "rest_no": rest_no, "whole_no": begun + np.cumsum(full) - full}).assign(shard=int(pdf["shard"].iloc[0]))

    packed = both.groupBy("pack_name", "shard").applyInPandas(one, _PACKED + ", shard int").join(F.broadcast(caps), "pack_name")
    full, rest = F.floor(F.col("n") / F.col("capacity")), F.col("n") % F.col("capacity")
    pieces = packed.withColumn("full", full).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("full") - F.when(rest > 0, 0).otherwise(1), F.lit(0)))))
    whole = F.col("piece") < F.col("full")
    return pieces.select(
        "pack_name", F.col("item").alias(item), F.col("piece").cast("int").alias("piece"), (F.col("piece") * F.col("capacity")).alias("start"), F.when(whole, F.col("capacity")).otherwise(rest).alias(size),
        F.when(F.col("n") > 0, F.col("shard")).alias("shard"), F.when(F.col("n") > 0, F.when(whole, F.col("whole_no") + F.col("piece")).otherwise(F.col("rest_no"))).alias("pack_no"),
    )


def fill_report(packed: DataFrame, sizes: DataFrame, size: str = "n_tokens") -> DataFrame:
    """Per capacity: packs, tokens in them, room left over as a share, and the fewest packs that could hold them."""
    caps = sizes.filter("pack_name IS NOT NULL AND capacity_tokens > 0").groupBy("pack_name").agg(F.min("capacity_tokens").cast("long").alias("capacity"))
    packs = packed.filter("pack_no IS NOT NULL").groupBy("pack_name", "shard", "pack_no").agg(F.sum(size).alias("t"))
    return (
        packs.groupBy("pack_name").agg(F.count(F.lit(1)).alias("packs"), F.sum("t").alias("tokens")).join(F.broadcast(caps), "pack_name")
        .select("pack_name", "capacity", "packs", "tokens", (1 - F.col("tokens") / (F.col("packs") * F.col("capacity"))).alias("left_over"), F.ceil(F.col("tokens") / F.col("capacity")).alias("fewest"))
    )
