"""The corpus pipeline: toxicity, quality rules, exact dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before
it kept, and returns the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkveil.llm import exact_dedup, packing, quality_rules, simhash, toxicity
from inkveil.llm.common import shared_dir, table
from inkveil.llm.queries import tokenizer_path, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from the labels' rows as op7 does.

    Null and empty texts match nothing and stay; texts of any length are scored
    whole; equal texts, repeated rows and rows without an id are judged alike, by
    their text only; without labels of both classes, and so for an empty table,
    everything stays. All columns come back as they were, whatever their names.
    """
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("predicted = 0").select("row.*")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules do not reject, without their failing lines; n_chars follows the text.

    Null, empty and short texts are rejected; a text of any length is judged
    whole; repeated rows are judged alike; an empty table gives an empty result.
    All other columns come back as they were, whatever their names.
    """
    return quality_rules.clean(quality_rules.quality(docs).filter("kept").select("row.*"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts the one with the largest id.

    Null counts as empty, a null id is the smallest, and of rows equal in text
    and id one stays; texts of any length are compared whole; an empty table gives
    an empty result. All columns come back as they were, whatever their names.
    """
    return exact_dedup.dedup_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join the one with the smallest id.

    Null and blank texts are near copies of each other; a null id stays only where
    a component has no other; of rows that share their component's smallest id
    one stays; texts of any length count whole; an empty table gives an empty
    result. All columns come back as they were, whatever their names.
    """
    return simhash.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences.

    Null and empty texts give their end id alone; very long texts give many full
    pieces; repeated rows are packed each; an empty table gives an empty result;
    no column but doc_id and text is read.
    """
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("packing", pack),
]

#: SQL cannot express the learned and the bit-wise stages; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, each written as Parquet in the shared folder and read again.

    A stage's files go once the next one's are written; the last ones stay, as the result reads them.
    """
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            folder = spark._jvm.org.apache.hadoop.fs.Path(before)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        before = path
    return docs
