import random

import pytest

from pyspark.sql import functions as F

from barloom.common import current, versions
from barloom.pipeline.change_feed import SIDES, UPDATES, book_at_end, current_state, published_book, rebuild_book

SCHEMA = "row_id long, session_id long, symbol_id int, side string, entry_id string, update string, msg_seq long"


def brute(rows):
    book = {}
    rows = [r for r in rows if r[4] is not None and r[6] is not None]
    for key in {(r[1], r[2]) for r in rows}:
        mine = [r for r in rows if (r[1], r[2]) == key]
        for seq in sorted({r[6] for r in mine}):
            message = [r for r in mine if r[6] == seq]
            kinds = {UPDATES.get(r[5].strip().lower()) for r in message}
            if "snapshot" in kinds:
                for k in [k for k in book if k[:2] == key]:
                    del book[k]
            for r in message:
                k = (*key, SIDES[r[3].strip().lower()], r[4])
                kind = UPDATES[r[5].strip().lower()]
                if kind in ("snapshot", "new") or kind == "change" and k in book:
                    book[k] = seq
                elif kind == "delete":
                    book.pop(k, None)
    return {(*k, v) for k, v in book.items()}


def feed(n=600, seed=1):
    r, rows = random.Random(seed), []
    names = {}
    for i in range(n):
        session, symbol, seq = r.choice([1, 1, 1, 2, 3]), r.choice([1, 2]), r.randrange(80)
        kind = names.setdefault((session, symbol, seq), "snapshot" if r.random() < 0.05 else None) or r.choice(["new", "0", " Change", "1", "DELETE ", "2"])
        rows.append([0, session, symbol, r.choice(["bid", "ASK", "0", "1", "offer"]), str(r.randrange(12)), kind, seq])
    seen, out = set(), []
    for x in rows:  # a message names an entry once
        k = (x[1], x[2], SIDES[x[3].strip().lower()], x[4], x[6])
        if k not in seen:
            seen.add(k)
            out.append(x)
    out += [list(r.choice(out)) for _ in range(100)]
    r.shuffle(out)
    return [(i, *x[1:]) for i, x in enumerate(out)]


def test_any_order_and_copies_give_the_book(spark):
    rows = feed()
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert want
    for d in (df, df.orderBy(F.desc("row_id")).repartition(5)):
        assert {tuple(r) for r in book_at_end(d, buckets=3).collect()} == want


def test_nulls_empty_and_clashing_columns(spark):
    rows = [(1, 1, 1, "bid", "a", "new", 1), (2, 1, 1, "bid", None, "snapshot", 9), (3, 1, 1, "bid", "b", "new", None), (4, None, 1, "bid", "c", "new", 2), (5, 1, 1, None, "d", "new", 2), (6, 1, 1, "bid", "e", None, 2), (7, 1, 1, "bid", "", "new", 3), (8, 1, 1, "up", "f", "new", 3), (9, 1, 1, "bid", "g", "odd", 3)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"put_seq": F.lit(7), "live": F.lit("x"), "salt": F.lit(1), "seq": F.lit(99), "kind": F.lit("delete")})
    assert {tuple(r) for r in book_at_end(df).collect()} == {(1, 1, "bid", "a", 1), (1, 1, "bid", "", 3)}
    assert book_at_end(df.filter("false")).collect() == []


def test_tombstones_and_ties(spark):
    rows = [(1, 1, 1, "bid", "a", "new", 1), (2, 1, 1, "bid", "a", "delete", 3), (3, 1, 1, "bid", "a", "change", 4), (4, 1, 1, "bid", "b", "new", 2), (5, 1, 1, "bid", "b", "delete", 2)]
    book = {r["entry_id"]: r for r in rebuild_book(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not book["a"]["live"] and book["a"]["delete_seq"] == 3 and not book["b"]["live"]


def test_publishing_is_atomic(spark, tmp_path):
    target = f"file://{tmp_path}/book"
    with pytest.raises(FileNotFoundError):
        current(spark, target)
    feeds = [spark.createDataFrame(feed(50, seed), SCHEMA) for seed in (1, 2, 3)]
    books = [{tuple(r) for r in published_book(f, target).collect()} for f in feeds[:1]]
    reader = current(spark, target)  # opened between two publications: it stays with what it found
    first = versions(spark, target)
    books.append({tuple(r) for r in published_book(feeds[1], target).collect()})
    assert {tuple(r) for r in reader.collect()} == books[0] != books[1] == {tuple(r) for r in current(spark, target).collect()}
    published_book(feeds[2], target)
    assert len(versions(spark, target)) == 2 and first[0] not in versions(spark, target)
    assert {p.name for p in (tmp_path / "book").iterdir() if p.is_dir()} == set(versions(spark, target))


def test_payload_follows_the_sequence(spark):
    rows = [
        (1, "a", "new", 1, 1.0, "x"), (1, "a", "change", 3, None, "z"), (1, "a", "change", 2, 2.0, "y"), (1, "a", "change", 2, 2.0, "y"),
        (1, "b", "change", 5, 9.0, "q"), (1, "b", "new", 6, None, "n"), (1, "b", "change", 4, 8.0, None),  # put in anew without a price
        (1, "c", "new", 1, 3.0, "c"), (1, "c", "delete", 2, 7.0, "d"), (2, "a", "change", 1, 4.0, "e"), (2, "d", "new", 1, 5.0, "f"), (2, "d", "new", 1, 6.0, "f"),
    ]
    df = spark.createDataFrame(rows, "g int, id string, what string, at long, price double, note string").withColumns({"k0": F.lit(1), "v0": F.lit(2), "put_seq": F.lit(3)})
    for d in (df, df.orderBy(F.desc("at")).repartition(4)):
        got = {(r["g"], r["id"]): r for r in current_state(d, ["g", "id"], "at", F.col("what"), ["price", "note"], buckets=2, bucket_rows=2).collect()}
        assert (got[1, "a"]["price"], got[1, "a"]["note"], got[1, "a"]["live"], got[1, "a"]["seq"]) == (2.0, "z", True, 3)
        assert (got[1, "b"]["price"], got[1, "b"]["note"], got[1, "b"]["live"]) == (None, "n", True)
        assert not got[1, "c"]["live"] and not got[2, "a"]["live"] and got[2, "a"]["put_seq"] is None and got[2, "d"]["price"] == 6.0
    with pytest.raises(ValueError):
        current_state(df.withColumn("id", F.array("id")), ["id"], "at", F.col("what"))


def test_feed_above_the_memory_of_a_bucket(spark):
    """More entries than one bucket may hold: splits hand on what they have, and buckets are as many as needed."""
    df = spark.range(60_000).selectExpr("id % 30000 AS id", "CAST(id AS STRING) || repeat('x', 100) AS note", "id AS at", "CASE WHEN id % 7 = 0 AND id >= 30000 THEN 'delete' ELSE 'new' END AS what")
    got = current_state(df, ["id"], "at", F.col("what"), ["note"], bucket_rows=2000, bucket_memory="20MB")
    assert got.count() == 30_000 and got.filter("live").count() == 30_000 - len([i for i in range(30_000, 60_000) if i % 7 == 0])
    assert got.filter("live AND NOT startswith(note, CAST(at AS STRING))".replace("at", "seq")).count() == 0
