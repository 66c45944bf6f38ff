"""One region once: filter, greedy merge in page order, padding.

The merge is a fold: detections by (y, x) join the first region so far that they
overlap enough, which grows; regions are not merged with each other afterwards.
So it is no connected components, and it runs per page over a sorted array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.geometry import padded, same_region, union

REGION = "struct<target:string,box:struct<x:double,y:double,width:double,height:double>,text:string,confidence:double,source:string,word_ids:array<string>>"


def worth_painting(detections: DataFrame, min_confidence: float) -> DataFrame:
    return detections.filter((F.col("confidence") >= min_confidence) & (F.col("box.width") > 0.5) & (F.col("box.height") > 0.5))


def joined_targets(a: Column, b: Column) -> Column:
    parts = F.array_sort(F.array_distinct(F.split(F.concat(a, F.lit("+"), b), "[+]")))
    return F.when(a == b, a).otherwise(F.array_join(parts, "+"))


def joined_text(host: Column, item: Column) -> Column:
    """The host's text, with the item's behind a bar unless it is in there or empty."""
    nothing = item.isNull() | (item == "")
    return F.when(nothing, host).when(host.isNull() | (host == ""), item).when(host.contains(item), host).otherwise(F.concat(host, F.lit(" | "), item))


def _absorbed(host: Column, item: Column) -> Column:
    ids = lambda r: F.coalesce(r["word_ids"], F.array().cast("array<string>"))
    return F.struct(
        joined_targets(host["target"], item["target"]).alias("target"),
        union(host["box"], item["box"]).alias("box"),
        joined_text(host["text"], item["text"]).alias("text"),
        F.greatest(host["confidence"], item["confidence"]).alias("confidence"),
        F.when(item["source"] == "pattern", "pattern").otherwise(host["source"]).alias("source"),
        F.array_distinct(F.concat(ids(host), ids(item))).alias("word_ids"),
    ).cast(REGION)


def merge_detections(detections: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Merged regions per (doc_id, page), with ord in the order they were opened. One shuffle, of detections only."""
    item = F.struct("target", "box", "text", "confidence", "source", "word_ids").cast(REGION)
    ranked = F.struct(F.col("box.y").alias("y"), F.col("box.x").alias("x"), F.col("seq").alias("seq"), item.alias("item"))
    pages = worth_painting(detections, min_confidence).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(ranked)).alias("all"))

    def step(regions: Column, e: Column) -> Column:
        new = e["item"]
        host = F.array_position(F.transform(regions, lambda r: same_region(r["box"], new["box"])), F.lit(True))
        grown = F.transform(regions, lambda r, i: F.when(i + 1 == host, _absorbed(r, new)).otherwise(r))
        return F.when(host > 0, grown).otherwise(F.concat(regions, F.array(new)))

    folded = pages.select("doc_id", "page", F.aggregate("all", F.array().cast(f"array<{REGION}>"), step).alias("regions"))
    return folded.select("doc_id", "page", F.posexplode("regions").alias("ord", "r")).select("doc_id", "page", "ord", "r.*")


def pad_detections(regions: DataFrame, padding: float, sizes: DataFrame | None = None) -> DataFrame:
    """Regions grown by padding and clipped to their pages (sizes: doc_id, page, width, height); no padding changes nothing."""
    if padding <= 0:
        return regions
    if sizes is None:
        return regions.withColumn("box", padded(F.col("box"), padding, F.lit(None).cast("double"), F.lit(None).cast("double")))
    met = regions.join(sizes.select("doc_id", "page", "width", "height"), ["doc_id", "page"], "left")
    return met.withColumn("box", padded(F.col("box"), padding, F.col("width"), F.col("height"))).drop("width", "height")
