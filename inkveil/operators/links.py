"""Hyperlinks: which visible texts go, and how links are told to a model.

Words meet links by an equi join on the page with the spatial test on top.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions.geometry import centre_inside, union_all
from inkveil.functions.text import trimmed
from inkveil.targets import Target

LINK = ["doc_id", "page", "link_ord"]


def link_words(links: DataFrame, words: DataFrame) -> DataFrame:
    """links with ``covered``: their words (x, ord, word_id, text, box) whose centres are inside, from left to right."""
    w = words.select(F.col("doc_id").alias("d"), F.col("page").alias("p"), "word_id", "ord", F.col("text").alias("word"), F.col("box").alias("word_box"))
    met = links.join(w, (links["doc_id"] == w["d"]) & (links["page"] == w["p"]) & centre_inside(w["word_box"], links["box"]), "left")
    item = F.when(F.col("word_id").isNotNull(), F.struct(F.col("word_box.x").alias("x"), "ord", "word_id", F.col("word").alias("text"), F.col("word_box").alias("box")))
    return met.groupBy(*LINK, "url", "box").agg(F.array_sort(F.collect_list(item)).alias("covered"))


def detect_links(links: DataFrame, words: DataFrame, targets: list[Target], policy: str = "keep") -> DataFrame:
    """Detections for links whose visible text goes. The first target asked for that has a pattern in the address names it."""
    named = F.lit(None).cast("string")
    for t in reversed([t for t in targets if t.patterns and not t.visual_only]):
        hit = F.lit(False)
        for pattern in t.patterns:
            hit = hit | F.col("url").rlike(pattern)
        named = F.when(hit, t.id).otherwise(named)
    found = links.filter((F.col("box.width") > 0) & (F.col("box.height") > 0)).withColumn("named", named)
    if policy == "keep":
        found = found.filter(F.lit(False))
    elif policy == "redact-identifying":
        found = found.filter(F.col("named").isNotNull())
    met = link_words(found.drop("named"), words).join(found.select(*LINK, "named"), LINK)
    return met.select(
        "doc_id", "page", F.coalesce("named", F.lit("link")).alias("target"), F.coalesce(union_all(F.transform("covered", lambda w: w["box"])), "box").alias("box"),
        F.col("url").alias("text"), F.lit(1.0).alias("confidence"), F.lit("link").alias("source"),
        F.transform(F.array_sort(F.transform("covered", lambda w: F.struct(w["ord"].alias("o"), w["word_id"].alias("id")))), lambda w: w["id"]).alias("word_ids"),
        F.array(F.lit(1), F.col("link_ord")).alias("seq"),
    )


def describe_links(links: DataFrame, words: DataFrame) -> DataFrame:
    """Per page a list of "visible text -> address", each entry once, in the order first seen: doc_id, page, section."""
    anchor = trimmed(F.array_join(F.transform("covered", lambda w: w["text"]), " "))
    shown = F.when(anchor == "", "(no visible text)").otherwise(anchor)
    entries = link_words(links, words).select("doc_id", "page", "link_ord", F.concat(F.lit("- "), shown, F.lit(" -> "), "url").alias("entry"))
    first = entries.groupBy("doc_id", "page", "entry").agg(F.min("link_ord").alias("at"))
    listed = first.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("at", "entry"))).alias("e"))
    return listed.select("doc_id", "page", F.array_join(F.transform("e", lambda x: x["entry"]), "\n").alias("section"))
