"""Exact deduplication by Grace hash partitioning.

Texts are equal when their whole contents are. Each scan partition first
removes its own repeats, so of a text copied into a third of all rows each
partition sends one row on, not its copies. The survivors are dealt by SHA-256
and the same routine finishes the work: records go to buckets by bits of their
hash, a bucket too large for memory goes to a spill file and is partitioned
again by the next bits, and a bucket that fits is resolved in an open-addressing
table whose probes compare complete contents. The table stores distinct texts
only, so repeats never make a bucket too large.

Every row's label comes by its digest. The rows' ids travel as lists, one for a
digest and a part of a partition, and are written to the shared folder before
anything reads them twice: which list has the row that stays is decided on that
one written copy, so nothing hangs on the order in which rows arrive. The lists
of one text in a third of all rows are that many times fewer than its rows; what
is left of the skew in their join is split by adaptive execution alone.

Spill files are anonymous (already unlinked), private to one task and gone with
it; a task that is run again writes them anew, so no other task depends on them.

Defined cases: null text counts as empty; a null id loses to any other id; of
rows with equal text and equal id exactly one is kept, whichever; texts of any
length and any bytes are compared whole, also bytes that are no UTF-8; an empty
table gives an empty result; other columns pass through untouched inside
``row``, whatever their names, and count for the memory that a bucket may take.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.llm.common import cut, prepare, spread

#: Bytes of distinct texts and their rows that one table holds before its bucket is partitioned again.
TABLE_BYTES = 20 << 20
#: Buckets per level, as bits of the hash.
FAN_BITS = 4
#: Ids that a task gathers before it sends their lists on.
MEMBERS = 100_000
#: SHA-256 has so many levels of FAN_BITS; deeper there is nothing left to split by.
MAX_LEVEL = 256 // FAN_BITS


def _contents(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def _digests(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("sha").to_pylist()


class OpenTable:
    """Linear probing over a power-of-two slot array; entries hold whole records.

    Of equal contents the record with the largest id represents the class.
    ``add`` says False when a new content would exceed the byte limit.
    """

    def __init__(self, limit: int):
        self.limit, self.bytes = limit, 0
        self.slots = np.full(1 << 10, -1, dtype=np.int64)
        self.hashes: list[bytes] = []
        self.texts: list[bytes] = []
        self.best: list[tuple[pa.RecordBatch, int] | None] = []
        self.rank: list[tuple[bool, int]] = []
        self.count: list[int] = []

    def _probe(self, sha: bytes, text: bytes) -> int:
        mask = len(self.slots) - 1
        at = int.from_bytes(sha[-8:], "little") & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == sha and self.texts[entry] == text:
                return at
            at = (at + 1) & mask
        return at

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, dtype=np.int64)
        mask = len(self.slots) - 1
        for entry, sha in enumerate(self.hashes):
            at = int.from_bytes(sha[-8:], "little") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry

    def add(self, sha: bytes, text: bytes, rank: tuple[bool, int], n: int, row_bytes: int, touched: dict[int, int], i: int) -> bool:
        at = self._probe(sha, text)
        entry = self.slots[at]
        if entry < 0:
            size = len(text) + max(row_bytes, len(text)) + 64  # the text is held twice: here and in its row
            if self.bytes + size > self.limit and self.texts:
                return False
            if 2 * len(self.texts) >= len(self.slots):
                self._grow()
                at = self._probe(sha, text)
            self.slots[at] = len(self.texts)
            self.hashes.append(sha)
            self.texts.append(text)
            self.rank.append(rank)
            self.best.append(None)
            self.count.append(n)
            self.bytes += size
            touched[len(self.texts) - 1] = i
        else:
            self.count[entry] += n
            if rank > self.rank[entry]:
                self.rank[entry] = rank
                touched[entry] = i
        return True

    def keep(self, batch: pa.RecordBatch, touched: dict[int, int]) -> None:
        """Copies the touched entries' records out, so that the batch can go.

        New entries share a batch, as all of it stays. One that replaces a record
        gets a batch of its own, or others would hold on to what it replaced.
        """
        fresh = [entry for entry in touched if self.best[entry] is None]
        own = batch.take(pa.array([touched[e] for e in fresh], pa.int64())) if fresh else None
        for at, entry in enumerate(fresh):
            self.best[entry] = (own, at)
        for entry in touched.keys() - set(fresh):
            self.best[entry] = (batch.take(pa.array([touched[entry]])), 0)


class Bucket:
    """Record batches in memory, or in a spill file once they pass the limit."""

    def __init__(self, limit: int):
        self.limit, self.held, self.bytes, self.file, self.writer = limit, [], 0, None, None

    def put(self, batch: pa.RecordBatch) -> None:
        self.held.append(batch)
        self.bytes += batch.nbytes
        if self.bytes > self.limit:
            self.spill()

    def spill(self) -> None:
        for batch in self.held:
            if self.writer is None:
                self.file = tempfile.TemporaryFile()
                self.writer = pa.ipc.new_stream(self.file, batch.schema)
            self.writer.write_batch(batch)
        self.held, self.bytes = [], 0

    def read(self) -> Iterator[pa.RecordBatch]:
        if self.writer is not None:
            self.spill()
            self.writer.close()
            self.file.seek(0)
            yield from pa.ipc.open_stream(self.file)
        else:
            yield from self.held

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.held = []


def _fan(batches: Iterator[pa.RecordBatch], level: int, limit: int) -> list[Bucket]:
    n = 1 << FAN_BITS
    buckets = [Bucket(limit // n) for _ in range(n)]
    shift = 256 - FAN_BITS * (level + 1)
    for batch in batches:
        to = np.array([(int.from_bytes(s, "big") >> shift) & (n - 1) for s in _digests(batch)], dtype=np.int64)
        for k in np.unique(to):
            buckets[k].put(batch.take(pa.array(np.flatnonzero(to == k))))
    return buckets


def resolve(batches: Iterator[pa.RecordBatch], text_at: str, limit: int = TABLE_BYTES, level: int = 0) -> Iterator[pa.RecordBatch]:
    """One record for each distinct content, with summed counts. Columns: sha, n, id, row."""
    held = Bucket(limit)
    opened = OpenTable(limit if level < MAX_LEVEL else 1 << 62)
    over = False
    for batch in batches:
        held.put(batch)
        if over:
            continue
        texts = _contents(batch.column("row").field(text_at))
        ids, ns = (batch.column(c).to_pylist() for c in ("id", "n"))
        row_bytes = batch.nbytes // max(1, batch.num_rows)
        touched: dict[int, int] = {}
        for i, (sha, text) in enumerate(zip(_digests(batch), texts, strict=True)):
            if not opened.add(sha, text, (ids[i] is not None, ids[i] or 0), ns[i], row_bytes, touched, i):
                over = True
                break
        else:
            opened.keep(batch, touched)
    if not over:
        held.close()
        yield from _records(opened)
        return
    del opened
    buckets = _fan(held.read(), level, limit)
    held.close()
    for bucket in buckets:
        yield from resolve(bucket.read(), text_at, limit, level + 1)
        bucket.close()


def _records(opened: OpenTable) -> Iterator[pa.RecordBatch]:
    by_batch: dict[int, list[int]] = {}
    for entry, (batch, _) in enumerate(opened.best):
        by_batch.setdefault(id(batch), []).append(entry)
    for entries in by_batch.values():
        batch = opened.best[entries[0]][0]
        out = batch.take(pa.array([opened.best[e][1] for e in entries]))
        columns = {name: out.column(name) for name in out.schema.names}
        columns["n"] = pa.array([opened.count[e] for e in entries], pa.int64())
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _start(batches: Iterator[pa.RecordBatch], id_at: str, text_at: str) -> Iterator[pa.RecordBatch]:
    """Adds sha, id and n to each row."""
    for batch in batches:
        row = batch.column("row")
        shas = [hashlib.sha256(t).digest() for t in _contents(row.field(text_at))]
        ones = pa.array(np.ones(batch.num_rows, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(shas, pa.binary()), row.field(id_at).cast(pa.int64()), ones, row], names=["sha", "id", "n", "row"])


def _members(batches: Iterator[pa.RecordBatch], id_at: str, text_at: str) -> Iterator[pa.RecordBatch]:
    """(sha, part, ids): the ids of rows with one digest, of up to MEMBERS rows of this task together. part tells lists apart."""
    part = TaskContext.get().partitionId() << 33
    held: dict[bytes, list[int | None]] = {}
    n = 0

    def sent() -> pa.RecordBatch:
        parts = np.arange(part, part + len(held), dtype=np.int64)
        ids = pa.array(list(held.values()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(parts), ids], names=["sha", "part", "ids"])

    for batch in batches:
        row = batch.column("row")
        for text, own in zip(_contents(row.field(text_at)), row.field(id_at).cast(pa.int64()).to_pylist(), strict=True):
            held.setdefault(hashlib.sha256(text).digest(), []).append(own)
        n += batch.num_rows
        if n >= MEMBERS:
            yield sent()
            part, n = part + len(held), 0
            held.clear()
    if held:
        yield sent()


def _base(df: DataFrame, columns: list[str]) -> DataFrame:
    prepare(df.sparkSession)
    return spread(df).select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))


def distinct_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """One row per distinct text: sha, id of the row that stays, n (rows that have the text), and that row."""
    base = _base(df, columns or df.columns)
    schema = T.StructType(
        [
            T.StructField("sha", T.BinaryType()),
            T.StructField("id", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("row", base.schema["row"].dataType),
        ]
    )

    def within(batches):
        yield from resolve(_start(batches, id_col, text_col), text_col)
        pa.default_memory_pool().release_unused()  # workers live on after the task

    def across(batches):
        yield from resolve(batches, text_col)
        pa.default_memory_pool().release_unused()

    return base.mapInArrow(within, schema).repartition("sha").mapInArrow(across, schema)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id, sha, keep_id, group_size, kept. Equal texts share a group; the largest id stays."""
    base = _base(df, [id_col, text_col])
    lists = cut(base.mapInArrow(lambda b: _members(b, id_col, text_col), "sha binary, part long, ids array<long>"))
    groups = distinct_texts(df, id_col, text_col, [id_col, text_col]).select("sha", F.col("id").alias("keep_id"), F.col("n").alias("group_size"))
    # Of the lists with the largest id, the last one has the row that stays: its first with that id.
    most = F.array_max("ids")  # null where all ids are
    last = lists.groupBy("sha").agg(F.max(F.struct(most.isNotNull().alias("known"), most.alias("id"), "part")).alias("last"))
    met = lists.join(groups.join(last.select("sha", F.col("last.part").alias("last")), "sha"), "sha")
    first = F.coalesce(F.array_position("ids", F.col("keep_id")) - 1, F.lit(0))
    rows = met.select("sha", "keep_id", "group_size", F.when(F.col("part") == F.col("last"), first).otherwise(-1).alias("stays"), F.posexplode("ids").alias("at", "id"))
    return rows.select("id", "sha", "keep_id", "group_size", (F.col("at") == F.col("stays")).alias("kept"))


def dedup_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, all columns as they were."""
    return distinct_texts(df, id_col, text_col).select("row.*")


#: DuckDB: groups by the text itself.
ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
