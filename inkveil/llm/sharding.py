"""Sharding by vector bin packing.

Shards shall have near equal bytes, tokens and rows at once. Rows with equal
texts form a group, which goes to one shard whole. Only a group with over
SPLIT_ABOVE of a mean shard's bytes or rows is split, into parts of PART at most
on average, as no shard could hold it beside anything else.

Groups are placed large ones first, each in the shard where the dot product of
its vector with the residual capacity is highest. That order is kept by classes:
a class has the groups whose largest share of a shard is within a factor of
CLASS, so the first has at most 3 * CLASS groups for each shard, whatever the
input. Within a class, groups are dealt to cells by hash. A cell packs its own
against its part of the residual capacity that all classes before have left; a
class's loads, a few numbers a shard, are known before the next begins. No task
holds more than one cell's groups, as three numbers each.

The law kept is ``bytes``. Rows of the first class find their shard by a broadcast
of that bounded class, so no hot text meets in one task; the others by a join.
Slots number a shard's rows without gaps: a prefix sum over the written
partitions, then the place in the partition.

Defined cases: null text has no bytes, and null texts form a group with empty
ones; texts of any length count whole, and one longer than a mean shard makes its
shard larger; rows that repeat an id get a slot each, and null ids are allowed, as
parts go by row; ties go to the first shard, in an order of shards that each cell has of its own;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkveil.llm.common import cut, prepare

SHARDS = 40
#: Shares of a mean shard: a group above the first is split into parts of the second, on average.
SPLIT_ABOVE, PART = 0.9, 0.45
#: Factor between the largest and the smallest group of a class.
CLASS = 64
#: Groups of a cell, on average.
CELL_GROUPS = 10_000
#: Bytes that a row costs beside its text.
ROW_BYTES = 16
VECTOR = ("size", "tokens", "n")


def place(vectors: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The bin of each vector: large ones first, each by the highest dot product with what is left of the bins' capacity."""
    out = np.zeros(len(vectors), dtype=np.int64)
    left = left.copy()
    for i in np.argsort(-vectors.max(axis=1), kind="stable") if len(vectors) else ():
        k = int(np.argmax(left @ vectors[i]))
        out[i] = k
        left[k] -= vectors[i]
    return out


def packed(vectors: np.ndarray, left: np.ndarray, turn: int) -> np.ndarray:
    """place() of a cell's vectors against its part of what is left; bins are asked from bin turn on, so that no bin gets every cell's ties."""
    own = left * (vectors.sum(axis=0) / np.maximum(left.sum(axis=0), 1e-300))
    turn %= len(left)
    return (place(vectors, np.roll(own, -turn, axis=0)) + turn) % len(left)


def _placed(batches: Iterator[pa.RecordBatch], left: np.ndarray, unit: np.ndarray) -> Iterator[pa.RecordBatch]:
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got).sort_by([("h", "ascending"), ("part", "ascending")])  # equal weights go by hash
    vectors = np.stack([t.column(c).to_numpy() for c in VECTOR], axis=1) * unit
    to = packed(vectors, left, TaskContext.get().partitionId())
    yield from t.append_column("shard", pa.array(to.astype(np.int32))).to_batches(max_chunksize=50_000)


def _numbered(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Adds the partition, and each row's place among its rows of one shard."""
    task, seen = TaskContext.get().partitionId(), np.zeros(shards, dtype=np.int64)
    for batch in batches:
        to = batch.column("shard").to_numpy()
        order = np.argsort(to, kind="stable")
        counts = np.bincount(to, minlength=shards)
        at = np.empty(len(to), dtype=np.int64)
        at[order] = np.arange(len(to)) - np.repeat(np.cumsum(counts) - counts, counts)
        at += seen[to]
        seen += counts
        yield batch.append_column("task", pa.array(np.full(len(to), task, dtype=np.int64))).append_column("place", pa.array(at))


def shard(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard (null, as the law is ``bytes``)."""
    prepare(df.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = cut(
        df.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.monotonically_increasing_id().alias("row"),
            F.xxhash64(text).alias("h"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("long").alias("tokens"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        )
    )
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")]
    whole = cut(rows.groupBy("h").agg(*sums))
    totals = whole.agg(*[F.sum(c) for c in VECTOR]).first()
    unit = np.array([shards / max(1, t or 0) for t in totals])  # a mean shard has 1 of each
    most = lambda cols: F.greatest(*[F.col(c) * float(u) for c, u in cols])
    share = most(zip(VECTOR, unit, strict=True))
    weight = most([("size", unit[0]), ("n", unit[2])])
    # Groups of the first class: 3 * CLASS for each shard at most, as each has 1 / CLASS of a shard's bytes, tokens or rows.
    parts = F.when(weight > SPLIT_ABOVE, F.least("n", F.ceil(weight / PART))).otherwise(1).cast("int")
    heavy = cut(whole.filter(share > 1 / CLASS).select("h", parts.alias("parts")))
    part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    hot = rows.join(F.broadcast(heavy), "h").withColumn("part", part).drop("parts")
    cold = rows.join(F.broadcast(heavy.select("h")), "h", "left_anti")
    level = F.greatest(F.lit(0), F.floor(-F.log(float(CLASS), share))).cast("int")
    groups = hot.groupBy("h", "part").agg(*sums).withColumn("level", F.lit(0))
    groups = cut(groups.unionByName(whole.filter(~(share > 1 / CLASS)).withColumn("part", F.lit(0)).withColumn("level", F.greatest(F.lit(1), level))))

    left = np.ones((shards, len(VECTOR)))
    schema = "h long, part int, size long, tokens long, n long, shard int"
    none = groups.select("h", "part", F.lit(0).alias("shard")).limit(0)
    first = rest = none
    for r in sorted(groups.groupBy("level").count().collect()):  # as many as the logarithm of a shard's rows
        level, count = r
        own = groups.filter(F.col("level") == level).select("h", "part", *VECTOR)
        dealt = own.repartition(1 if level == 0 else math.ceil(count / CELL_GROUPS), "h", "part")
        found = cut(dealt.mapInArrow(lambda b, left=left: _placed(b, left, unit), schema))
        load = np.zeros_like(left)
        for x in found.groupBy("shard").agg(*[F.sum(c).alias(c) for c in VECTOR]).collect():
            load[x["shard"]] = np.array([x[c] for c in VECTOR]) * unit
        left = np.maximum(left - load, 0)
        told = found.select("h", "part", "shard")
        first, rest = (told, rest) if level == 0 else (first, rest.union(told))

    keep = ["doc_id", "size", "text_crc32", "shard"]
    hot = hot.join(F.broadcast(first), ["h", "part"]).select(*keep)
    done = cut(hot.union(cold.join(rest.select("h", "shard"), "h").select(*keep)))

    placed = done.mapInArrow(lambda b: _numbered(b, shards), "doc_id long, size long, text_crc32 long, shard int, task long, place long")
    counts = placed.groupBy("shard", "task").agg(F.count("*").alias("n"))
    order = W.partitionBy("shard").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    bases = cut(counts.select("shard", "task", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base")))
    return placed.join(bases, ["shard", "task"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
