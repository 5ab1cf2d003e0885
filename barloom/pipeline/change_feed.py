"""Change feeds: rebuild the current state of a keyed table from inserts, updates and deletes.

Every bucket owns an embedded DuckDB database. A change is upserted with a conditional conflict
update that compares the stored sequence numbers; deletes stay as tombstones. What is stored of an
entry, the greatest sequence of a put, of a change and of a delete, and of each payload column the last value with its sequence, is the same for any order and
any number of copies of the messages, so that the upsert runs twice: over each input split (a hot
entry leaves a split as one row) and then over each bucket. Buckets are hashed by the whole key, so that a hot group of entries is spread over all of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.common import cut, publish, scratch_dir, shuffle_parts

# Spellings of `update` and `side` after trimming and lower-casing, with the feed's codes.
UPDATES = {"snapshot": "snapshot", "new": "new", "0": "new", "change": "change", "1": "change", "delete": "delete", "2": "delete"}
SIDES = {"bid": "bid", "0": "bid", "ask": "ask", "1": "ask", "offer": "ask"}

NONE = -(2**63)
# Types of keys and payload, and what they are in the embedded database.
_TYPES = {"string": "VARCHAR", "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "float": "FLOAT", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}
_SEQS = ["put_seq", "change_seq", "delete_seq"]


def _lookup(column: str, table: dict[str, str]) -> Column:
    spelt = F.lower(F.trim(F.col(column).cast("string")))
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), spelt)


class _Bucket:
    """One embedded database: the table `book`, a row an entry. `keys` and `payload` are the types of its key and payload columns."""

    def __init__(self, keys: Sequence[str], payload: Sequence[str], memory: str):
        import duckdb

        self.con = duckdb.connect(":memory:", config={"threads": 1})
        self.run(f"SET memory_limit='{memory}'")
        self.run("SET temp_directory=''")
        ks, n = [f"k{i}" for i in range(len(keys))], len(payload)
        columns = [*[f"{k} {t}" for k, t in zip(ks, keys)], *[f"{s} BIGINT" for s in _SEQS], *[f"v{i} {t}, s{i} BIGINT" for i, t in enumerate(payload)]]
        self.run(f"CREATE TABLE book ({', '.join(columns)}, PRIMARY KEY ({', '.join(ks)}))")
        last = [f"max(struct_pack(s := s{i}, v := v{i})) AS p{i}" for i in range(n)]
        found = f"SELECT {', '.join(ks)}, {', '.join(f'max({s}) AS {s}' for s in _SEQS)}{''.join(', ' + x for x in last)} FROM feed GROUP BY ALL"
        picked = ", ".join([*ks, *_SEQS, *[f"p{i}.v, p{i}.s" for i in range(n)]])
        newer = [f"(excluded.s{i} > book.s{i} OR excluded.s{i} = book.s{i} AND excluded.v{i} > book.v{i})" for i in range(n)]
        sets = [*[f"{s} = greatest(book.{s}, excluded.{s})" for s in _SEQS], *[f"v{i} = CASE WHEN {w} THEN excluded.v{i} ELSE book.v{i} END, s{i} = greatest(book.s{i}, excluded.s{i})" for i, w in enumerate(newer)]]
        self.sql = (
            f"INSERT INTO book SELECT {picked} FROM ({found}) ON CONFLICT ({', '.join(ks)}) DO UPDATE SET {', '.join(sets)}"
            f" WHERE {' OR '.join([*[f'excluded.{s} > book.{s}' for s in _SEQS], *newer])}"
        )

    def run(self, sql: str) -> list:
        return self.con.execute(sql).fetchall()

    def upsert(self, batch: pa.RecordBatch) -> None:
        self.con.register("feed", pa.Table.from_batches([batch]))
        self.run(self.sql)
        self.con.unregister("feed")

    def size(self) -> int:
        return self.run("SELECT count(*) FROM book")[0][0]

    def export(self) -> Iterator[pa.RecordBatch]:
        yield from self.con.sql("SELECT * FROM book").to_arrow_reader(65536)


def current_state(
    changes: DataFrame, keys: Sequence[str], sequence: str, kind: Column, payload: Sequence[str] = (), scope: Sequence[str] = (), bucket_rows: int = 400_000, bucket_memory: str = "512MB", buckets: int | None = None
) -> DataFrame:
    """State of every key after all changes, tombstones included: `keys`, `seq` (the last that named it), put_seq, change_seq, delete_seq, `payload`, `live`.

    `kind` is snapshot, new, change or delete. Changes apply by `sequence`, whatever the order of the rows; copies change nothing. new puts a key in or replaces it; change alters a live
    key only; delete takes it out; a snapshot row puts its key in and ends what was put into its `scope` (some of the keys) under an earlier sequence. A payload column has its last value that is not null
    since the key was put in, null without one; of values under one sequence the greatest. Where one sequence names a key more than once with different kinds, delete holds before put, and put before change.

    Rows with a null key, sequence or kind have no effect, nor have unknown kinds. Other columns are ignored; an empty feed gives an empty state. Sequences of kinds that never came are null.
    Buckets are as many as keep each below `bucket_rows` rows by the counted number, so that `bucket_memory` is not reached; a split hands on what it has when its book is that long.
    """
    kinds = dict(changes.dtypes)
    if odd := [c for c in (*keys, *payload) if kinds[c] not in _TYPES]:
        raise ValueError(f"columns of unsupported types: {', '.join(f'{c} {kinds[c]}' for c in odd)}")
    ks, n = [f"k{i}" for i in range(len(keys))], len(payload)
    rows = changes.select(*[F.col(c).alias(k) for c, k in zip(keys, ks)], F.col(sequence).cast("long").alias("seq"), kind.alias("kind"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(payload)])
    rows = rows.dropna(subset=[*ks, "seq", "kind"]).filter(F.col("kind").isin("snapshot", "new", "change", "delete"))
    never = F.lit(NONE)
    only = lambda *names: F.when(F.col("kind").isin(*names), F.col("seq")).otherwise(never)
    values = []
    for i in range(n):
        said = (F.col("kind") != "delete") & F.col(f"v{i}").isNotNull()
        values += [F.when(said, F.col(f"v{i}")).alias(f"v{i}"), F.when(said, F.col("seq")).otherwise(never).alias(f"s{i}")]
    feed = rows.select(*ks, only("snapshot", "new").alias("put_seq"), only("change").alias("change_seq"), only("delete").alias("delete_seq"), *values)
    types = [_TYPES[kinds[c]] for c in keys], [_TYPES[kinds[c]] for c in payload]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _Bucket(*types, bucket_memory)
        for b in batches:
            if b.num_rows:
                bucket.upsert(b)
                if bucket.size() >= bucket_rows:
                    yield from bucket.export()
                    bucket = _Bucket(*types, bucket_memory)
        yield from bucket.export()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _Bucket(*types, bucket_memory)
        for b in batches:
            if b.num_rows:
                bucket.upsert(b)
        yield from bucket.export()

    partial = cut(feed.mapInArrow(split, feed.schema), "upserts")
    buckets = buckets or max(shuffle_parts(changes.sparkSession), -(-partial.count() // bucket_rows))
    book = partial.repartition(buckets, *ks).mapInArrow(merge, feed.schema)
    floor = F.lit(NONE)
    if scope:
        within = [ks[list(keys).index(c)] for c in scope]
        ends = rows.filter("kind = 'snapshot'").groupBy(*within).agg(F.max("seq").alias("floor"))
        book = book.join(ends, within, "left")
        floor = F.coalesce("floor", F.lit(NONE))
    came = lambda c: F.when(c != NONE, c)
    return book.select(
        *[F.col(k).alias(c) for c, k in zip(keys, ks)], F.greatest(*_SEQS).alias("seq"), *[came(F.col(s)).alias(s) for s in _SEQS],
        *[F.when(F.col(f"s{i}") >= F.col("put_seq"), F.col(f"v{i}")).alias(c) for i, c in enumerate(payload)], ((F.col("put_seq") > F.col("delete_seq")) & (F.col("put_seq") >= floor)).alias("live"),
    )


def rebuild_book(quotes: DataFrame, payload: Sequence[str] = (), **how) -> DataFrame:
    """State of every entry of quote books after all messages (see current_state): session_id, symbol_id, side, entry_id, msg_seq, put_seq, change_seq, delete_seq, `payload`, live.

    Entries are told apart by session, symbol, side and entry_id; a snapshot replaces the book of its session and symbol. Rows with an unknown side or update have no effect; an empty
    entry_id is an id like any other.
    """
    rows = quotes.select(
        F.col("session_id").cast("long").alias("session_id"), F.col("symbol_id").cast("int").alias("symbol_id"), _lookup("side", SIDES).alias("side"), F.col("entry_id").cast("string").alias("entry_id"),
        F.col("msg_seq").cast("long").alias("seq"), _lookup("update", UPDATES).alias("kind"), *payload,
    )
    state = current_state(rows, ["session_id", "symbol_id", "side", "entry_id"], "seq", F.col("kind"), payload, ["session_id", "symbol_id"], **how)
    return state.withColumnRenamed("seq", "msg_seq")


def published_book(quotes: DataFrame, target: str | None = None, **how) -> DataFrame:
    """`rebuild_book`, its buckets written beside `target` and published at once. Without `target` the book goes with the application's other intermediate tables."""
    target = target or f"{scratch_dir(quotes.sparkSession)}/book-{uuid.uuid4().hex}"
    return publish(rebuild_book(quotes, **how), target)


def book_at_end(quotes: DataFrame, target: str | None = None, **how) -> DataFrame:
    """The entries in the book at the end of every session, with the message that last put in or changed each, and their payload."""
    return published_book(quotes, target, **how).filter("live").select("session_id", "symbol_id", "side", "entry_id", "msg_seq", *how.get("payload", ()))
