"""Reading tables so that their work spreads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def plain_scan(df: DataFrame) -> bool:
    """Whether df is read straight from files, rows or checkpoints: no shuffle, no cache, neither in its plan nor behind its rows.

    Such a frame has equal partitions with rows in equal order however often it
    is read. Blocks of a shuffle come in any order. Asking starts no job: an
    adaptive plan is not touched, as it would run its stages.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    if any(sign in plan for sign in ("AdaptiveSparkPlan", "Exchange", "InMemoryTableScan", "TakeOrderedAndProject", "Limit")):
        return False
    return "Shuffled" not in df._jdf.queryExecution().toRdd().toDebugString()


def partitions(df: DataFrame) -> int:
    """Partitions of a plain scan; of another frame, those that a shuffle makes at most. Starts no job."""
    if plain_scan(df):
        return df._jdf.queryExecution().toRdd().getNumPartitions()
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Deals a scan with fewer partitions than cores to all cores; everything else stays as it is.

    A file with one row group is one task however the scan is cut, which wastes
    a small table's cores; a table with as many partitions as cores never moves.
    Dealt rows come in another order each time they are read, so this is for
    work that looks at each row alone and does so once.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plain_scan(df) and partitions(df) < cores else df


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return spread(df.select(*columns) if columns else df)
