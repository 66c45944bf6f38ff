"""The stateless stages on a stream: each micro-batch's documents are laid out and searched as a table's are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkveil.operators.merge import merge_detections, pad_detections
from inkveil.operators.patterns import detect_patterns
from inkveil.sources.text_layout import text_lines
from inkveil.targets import Target, resolve_targets


def detections_stream(docs: DataFrame, targets: list[str | Target], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pattern detections of a streaming table; there is no state, so late rows need no watermark."""
    return detect_patterns(text_lines(docs, id_col, text_col), resolve_targets(targets))


def redact_stream(docs: DataFrame, targets: list[str | Target], path: str, checkpoint: str, padding: float = 2.0, **trigger) -> StreamingQuery:
    """Merged regions of each micro-batch as Parquet under path, a folder for each batch: written again on a retry, not twice."""

    def batch(rows: DataFrame, n: int) -> None:
        regions = merge_detections(detections_stream(rows, targets))
        pad_detections(regions, padding).withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_stream(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
