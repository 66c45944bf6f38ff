"""What the corpus operators share: table access, cutting lineage, batch sizes."""

from __future__ import annotations

import itertools
import os
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.sources.tables import partitions, plain_scan, spread  # noqa: F401  (used by the operators)

#: Rows per Arrow batch; long texts make larger batches costly in memory.
ARROW_ROWS = 512


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from spark.checkpoint.dir. Only a local session, where one
    machine is everything, gets a folder of its own when the setting is unset.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        sc = spark.sparkContext
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "inkveil-checkpoints")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Writes df's rows to the shared checkpoint folder and goes on from there.

    A lost executor then loses nothing that later steps read. Spark's cleaner
    removes the files once no plan refers to them, if it is told to do so.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stable(df: DataFrame) -> DataFrame:
    """df with equal partitions in equal order whenever it is read: a plain scan as it is, anything else written first."""
    return df if plain_scan(df) else cut(df)


def texts_of(column: pa.Array) -> list[str | None]:
    """A column's texts. Bytes that are no UTF-8 are read as the replacement character; only batches that have some take longer."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def numbered(names: list[str], wanted: str) -> str:
    """wanted, or wanted with a number, so that it clashes with none of names (in any case)."""
    low = {n.lower() for n in names}
    tries = itertools.chain([wanted], (f"{wanted}_{i}" for i in itertools.count(1)))
    return next(t for t in tries if t.lower() not in low)


def widened(df: DataFrame, more: str) -> T.StructType:
    """df's schema and the fields of more, which is DDL."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])


def crc32_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8")) % n
